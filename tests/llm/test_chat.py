import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from sediment.llm import chat, common
from sediment.llm.packing import encoder, tokenizer_path

SCHEMA = "conv_id long, turn long, role string, text string"


def rows():
    r = random.Random(0)
    traps = ["\\### Assistant: </turn> ok", "<turn user>", "\\", "\\\\<", "</turn", "<\\turn", "", " a  b\n", "é 😀", "x" * 5000]
    out = []
    for c in range(120):
        n = r.randint(1, 6)
        for t in range(n):
            shared = t < 2 and c % 3
            out.append((c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}" if shared else r.choice(traps) + str(r.randint(0, 4))))
    out += [(500, 1, "assistant", None), (500, 0, None, "no role"), (500, None, "sys>tem\\", "first"), (None, 0, "user", "nobody"), (501, 0, "user", "tie"), (501, 0, "assistant", "tie"), (501, 0, "assistant", "tie"), (502, 0, "tool", "")]
    return out + chat.TRAP


def brute(data):
    by = {}
    for c, t, role, text in data:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = Counter()
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        said = "".join(t for role, t in turns if role == "assistant")
        out[(c, len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())] += 1
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("path", F.lit(1)).withColumn("turns", F.lit("x"))
    table = common.written(chat.formatted(df), "chat-test")
    got = chat.read_back(table).collect()
    assert Counter((g.conv_id, g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for g in got) == brute(rows())
    want = {}
    for c, t, role, text in rows():
        want[c] = want.get(c, 0) + len(chat.opening(role or "") + chat.escaped(text or "") + chat.STOP)
    assert {g.conv_id: g.formatted_chars for g in got} == want


def test_shared_turns_once_with_positions_and_intervals(spark):
    table = sorted(chat.formatted(spark.createDataFrame(rows(), SCHEMA)).collect(), key=lambda r: (r.shard, r.seq))
    names = chat.byte_table(encoder(tokenizer_path()).tokenizer)
    for shard in {r.shard for r in table}:
        mine = [r for r in table if r.shard == shard]
        stream, seen = [], set()
        for r in mine:
            assert r.offset == len(stream)
            stream += r.token_ids
            before = [i for a, b in zip(r.attend_from, r.attend_to, strict=True) for i in range(a, b)]
            assert len(before) == r.position and all(i < r.offset for i in before)
            path = b"".join(names[stream[i]] for i in [*before, *range(r.offset, len(stream))]).decode()
            turns = chat.turns_of(path)
            assert len(turns) == r.n_turns
            for k in range(r.shared_turns + 1, r.n_turns + 1):
                assert tuple(turns[:k]) not in seen  # each prefix is emitted once
                seen.add(tuple(turns[:k]))
            for a, b in zip(r.loss_from, r.loss_to, strict=True):
                assert 0 <= a <= b <= len(r.token_ids)


def test_escapes_are_reversible():
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice(["\\", "<", "/", "turn", ">", "</turn>", "<turn ", "a", "\n", " "]) for _ in range(r.randint(0, 8)))
        assert chat.plain(chat.escaped(t)) == t
        role = t.replace("\n", "")
        assert chat.turns_of(chat.opening(role) + chat.escaped(t) + chat.STOP) == [(role, t)]
    assert len(np.unique([len(x) for x in chat.byte_table(encoder(tokenizer_path()).tokenizer)])) > 1


def test_empty_table(spark):
    assert chat.read_back(common.written(chat.formatted(spark.createDataFrame([], SCHEMA)), "chat-test")).count() == 0
