"""Chat formatting (operator 7): a prefix tree of conversations, its shared turns emitted once, depth first.

A conversation is the sequence of its turns. Sorting conversations by the hashes of their turns brings those that
share initial turns together, in the order of a depth-first walk: each conversation emits only the turns below the
branch where it leaves the one before it. Its row holds those turns' token ids, the position that the first of them
has (as many tokens as its ancestors have), and the intervals of its shard's tokens that its ancestors fill and that
it may attend to besides itself. Rows are dealt to shards by range of (turns, conv_id), so a first turn, or a whole
conversation, that a third of all rows share is spread over many tasks; each shard emits its trees' shared turns
once, and a tree that a cut between shards splits begins anew with its shared turns in the next shard.

Template: `<turn ROLE>TEXT</turn>` and a line feed. Backslashes in texts and roles are doubled; a control string in a
text gets a backslash after its first character, and a `>` in a role one before it; removing each backslash but
keeping the character after it gives the text back. The loss mask covers assistants' texts.

Nulls and odd rows: a null text or role is an empty one; a null conv_id is one conversation of its own; a null turn
comes first, and rows of the same turn come in the order of role and text; repeated rows are turns of their own; an
empty table gives no rows; extra columns are ignored. One conversation is one row, and has to fit in a task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .packing import TOKENIZER, byte_table, encoder, tokenizer_path

LEARNED_ROLE = "assistant"
STOP = "</turn>\n"
_CONTROL = re.compile(r"<(/?turn)")
_TURN = re.compile(r"<turn ((?:[^>\\]|\\.)*)>(.*?)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(r"<\\\1", text.replace("\\", "\\\\"))


def plain(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def opening(role: str) -> str:
    return f"<turn {role.replace(chr(92), chr(92) * 2).replace('>', chr(92) + '>')}>"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("the text isn't a sequence of turns")
        out.append((plain(m[1]), plain(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("the text isn't a sequence of turns")
    return out


FORMATTED = "shard long, seq long, conv_id long, n_turns long, shared_turns long, offset long, position long, token_ids array<int>, loss_from array<int>, loss_to array<int>, attend_from array<long>, attend_to array<long>, turn_ends array<int>"


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, path): turns in order, and their hashes."""
    picked = common.picked(rows, conv_id="long", turn="long", role="string", text="string")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = picked.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))


def formatted(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """FORMATTED: a row for each conversation, in depth-first order within each shard."""
    spark = rows.sparkSession
    common.ship(spark)
    dealt = conversations(rows).repartitionByRange(common.buckets(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    slim = dealt.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))
    schema = common.fields(FORMATTED)

    def run(batches):
        enc = encoder(tokenizer_path(tokenizer))
        shard, seq, offset = TaskContext.get().partitionId(), 0, 0
        branch: list[tuple[str, str, int, int]] = []  # role, text, offset, tokens: the turns of the conversation before
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                cols: dict[str, list] = {f.name: [] for f in schema}
                rows = list(zip(*(part.column(k).to_pylist() for k in ("conv_id", "roles", "texts")), strict=True))
                fresh, before = [], [x[:2] for x in branch]  # each conversation's turns after those it shares with the one before
                for _, roles, texts in rows:
                    turns, shared = list(zip(roles, texts, strict=True)), 0
                    while shared < min(len(before), len(turns)) and before[shared] == turns[shared]:
                        shared += 1
                    fresh.append(turns[shared:])
                    before = turns
                ids = iter(enc.encode([x for new in fresh for role, text in new for x in (opening(role), escaped(text), STOP)]))
                for (conv_id, roles, _), new in zip(rows, fresh, strict=True):
                    shared = len(roles) - len(new)
                    del branch[shared:]
                    position = sum(x[3] for x in branch)
                    spans: list[list[int]] = []
                    for _, _, begin, n in branch:
                        if spans and spans[-1][1] == begin:
                            spans[-1][1] = begin + n
                        else:
                            spans.append([begin, begin + n])
                    raw, size, lows, highs, ends = [], 0, [], [], []
                    for role, text in new:
                        head, body, stop = next(ids), next(ids), next(ids)
                        if role == LEARNED_ROLE:
                            lows.append(size + len(head) // 4)
                            highs.append(size + (len(head) + len(body)) // 4)
                        n = (len(head) + len(body) + len(stop)) // 4
                        raw += [head, body, stop]
                        branch.append((role, text, offset + size, n))
                        size += n
                        ends.append(size)
                    row = (shard, seq, conv_id, len(roles), shared, offset, position, np.frombuffer(b"".join(raw), "<i4"), lows, highs, [x for x, _ in spans], [x for _, x in spans], ends)
                    for k, v in zip(cols, row, strict=True):
                        cols[k].append(v)
                    seq, offset = seq + 1, offset + size
                yield common.batch(schema, **cols)

    return slim.mapInArrow(run, FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(table: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """READ of each conversation, from a FORMATTED table alone.

    Each shard is walked in order: a conversation's tokens are those of the intervals that it may attend to and
    then its own, decoded to bytes and parsed.
    """
    spark = table.sparkSession
    common.ship(spark)
    # a hash would give some tasks several shards and others none
    walked = table.repartitionByRange(common.buckets(spark), "shard").sortWithinPartitions("shard", "seq")
    schema = common.fields(READ)

    def run(batches):
        names = byte_table(encoder(tokenizer_path(tokenizer)).tokenizer)
        shard = None
        branch: list[tuple[int, bytes, bytes | None]] = []  # offset, bytes, bytes under the loss mask: the turns of the conversation before
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                cols: dict[str, list] = {f.name: [] for f in schema}
                for r in part.to_pylist():
                    if r["shard"] != shard:
                        shard, branch = r["shard"], []
                    attended = list(zip(r["attend_from"], r["attend_to"], strict=True))
                    branch = [x for x in branch if any(lo <= x[0] < hi for lo, hi in attended)]
                    loss, begin = dict(zip(r["loss_from"], r["loss_to"], strict=True)), 0
                    for end in r["turn_ends"]:
                        ids = r["token_ids"][begin:end]
                        under = next(((x, y) for x, y in loss.items() if begin <= x < end), None)
                        masked = b"".join(names[i] for i in r["token_ids"][under[0] : under[1]]) if under else None
                        branch.append((r["offset"] + begin, b"".join(names[i] for i in ids), masked))
                        begin = end
                    text = b"".join(x[1] for x in branch).decode()
                    said = [plain(x[2].decode()) for x in branch if x[2] is not None]
                    turns = turns_of(text)
                    if len(turns) != r["n_turns"]:
                        raise ValueError(f"conversation {r['conv_id']}: {len(turns)} turns read, {r['n_turns']} written")
                    row = (r["conv_id"], len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(text))
                    for k, v in zip(cols, row, strict=True):
                        cols[k].append(v)
                yield common.batch(schema, **cols)

    return walked.mapInArrow(run, READ)


#: A conversation of control strings, which the query adds.
TRAP = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat(spark, sf_dir: str) -> DataFrame:
    rows = common.picked(common.table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    rows = rows.unionByName(spark.createDataFrame(TRAP, "conv_id long, turn long, role string, text string"))
    return read_back(common.written(formatted(rows), "chat"))


QUERIES = {"op7_chat": op7_chat}
