"""Best-fit packing (operator 3): large-item matching on a histogram of lengths.

Every text becomes token ids and an end id. Only a text longer than the capacity is cut, into full pieces after a
first one that may be shorter. Which lengths share a sequence is planned from how many pieces there are of each
length, at most `capacity` numbers, so the plan's cost doesn't grow with the corpus: pieces above a third of the
capacity are matched greedily, the largest with the largest that fits, at most two to a sequence; smaller ones, the
largest first, go to the tightest gap that holds them. Each piece then finds its place from its rank among the pieces
of its length, which Spark counts in buckets (the tasks that made the pieces, or runs of RUN rows), so that a length that many
pieces share is no single task's work.

Pieces of one length are placed by doc_id within a bucket; `packing_in_order` places them in the order of the table's
files and rows instead, and gives each piece its row's number in that order, so that what reads the sequences can
follow it.

Nulls and odd rows: a null text is an empty one (its end id is one token); null doc_ids are kept as null; repeated rows
are packed each by itself; an empty table gives no rows; extra columns are ignored. Whole texts are tokenized.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Words that a worker remembers in each of two generations, for memory; what it forgets is encoded again.
CACHE = 250_000
#: Bytes of text whose distinct words are looked up together (a longer text comes alone).
SLICE_BYTES = 4 << 20
#: Unseen words that are encoded as one text.
TOGETHER = 200
#: Rows whose pieces are ranked together, in the order of a table.
RUN = 1 << 14
_SPACES = {0xC2: {(0x85,), (0xA0,)}, 0xE1: {(0x9A, 0x80)}, 0xE2: {(0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)} | {(0x81, 0x9F)}, 0xE3: {(0x80, 0x80)}}
_OTHER = re.compile(r"[^\S \n]|[\x00-\x08\x0b-\x1f]")
_RARE = np.zeros(256, bool)
_RARE[[*range(0x0A), *range(0x0B, 0x20), *_SPACES]] = True


def other_spaces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold white space (or a control character) other than spaces and line feeds."""
    out = np.zeros(len(off) - 1, bool)
    for at in np.flatnonzero(_RARE[data]).tolist():
        ends = _SPACES.get(int(data[at]))
        if ends is None or any(tuple(data[at + 1 : at + 1 + len(e)]) == e for e in ends):
            out[np.searchsorted(off, at, "right") - 1] = True
    return out


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The vocabulary's splitting rule never joins what stands before a single space or line feed with what follows: where
    it is between two characters that aren't white space, the text can be cut before it, and each part (a word with
    its space or line feed) is encoded once and remembered. Unseen parts are encoded together, as one text that is
    cut at the same places. A text with any other white space is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = np.array([len(x) for x in byte_table(self.tokenizer)])
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, words: list[str]) -> list[bytes]:
        """Ids of each word with the space or line feed before it."""
        out: list[bytes] = []
        full = [w if w[0] == "\n" else " " + w for w in words]
        groups = [full[i : i + TOGETHER] for i in range(0, len(full), TOGETHER)]
        for group, ids in zip(groups, self.whole(["".join(g) for g in groups]), strict=True):
            ends = np.cumsum(self.size[np.frombuffer(ids, "<u4")])
            at = (4 * (np.searchsorted(ends, np.cumsum([len(w.encode()) for w in group])) + 1)).tolist()
            out += [ids[x:y] for x, y in zip([0, *at], at, strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, off = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]

    def look(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from what is remembered or encoded now."""
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        out = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(out) if x is None]
        new = [words[k] for k in missing]
        ids = list(map(self.old.get, new))
        fresh = iter(self.parts([w for w, x in zip(new, ids, strict=True) if x is None]))
        ids = [next(fresh) if x is None else x for x in ids]
        self.known.update(zip(new, ids, strict=True))
        for k, x in zip(missing, ids, strict=True):
            out[k] = x
        return out

    def encode_column(self, col: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids, off): the ids of all texts (null: empty) one after the other, each text's with `end`; off has one entry more than texts.

        Arrow splits the texts and tells the distinct parts; only these are looked up one by one, and each text's ids
        are gathered from theirs.
        """
        n = len(col)
        odd = other_spaces(*common.arrow_bytes(col))
        col = pc.fill_null(col.cast(pa.large_string()), "")
        split = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", col), "\n", " \n"), " ")
        part = split.flatten().dictionary_encode()
        index = part.indices.to_numpy().astype(np.int64)
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        names = part.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        # a part that is empty or a bare line feed: white space beside white space
        bad = np.array([w in ("", "\n") for w in names], bool)[index]
        whole = odd | (np.add.reduceat(bad, first[:-1], dtype=np.int64) > 0) if n else odd
        mine = np.repeat(whole, np.diff(first))
        mine[first[:-1]] = True  # a text's first part has no space before it: it is no word of others
        used = np.zeros(len(names), bool)
        used[index[~mine]] = True
        at = np.cumsum(used) - 1
        entry = at[index]
        known = self.look([names[k] for k in np.flatnonzero(used).tolist()])
        begin = index[first[:-1]].tolist()
        texts = [t if w else names[k] for t, w, k in zip(col.to_numpy(zero_copy_only=False).tolist(), whole.tolist(), begin, strict=True)]
        pool = [*known, *self.whole(texts), end]
        entry[first[:-1]] = len(known) + np.arange(n)
        keep = ~mine
        keep[first[:-1]] = True
        sizes = np.add.reduceat(keep, first[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        entry = np.insert(entry[keep], ends, len(pool) - 1)
        length = np.array([len(x) for x in pool], np.int64) // 4
        start = np.cumsum(length) - length
        count = length[entry]
        to = np.cumsum(count)
        ids = np.frombuffer(b"".join(pool), "<u4")[np.repeat(start[entry] - (to - count), count) + np.arange(to[-1] if n else 0)]
        return ids, np.concatenate([[0], to[ends + np.arange(n)]]) if n else np.zeros(1, np.int64)


def byte_table(tokenizer) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable}
    chars |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(chars[c] for c in token)
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """PIECE (and token_ids) of every row of docs. `tokenizer` names a file that each executor has installed.

    carried: columns of whole numbers that each row's pieces have too.
    """
    common.ship(docs.sparkSession)
    out = PIECE + ", _salt long" + "".join(f", {c} long" for c in carried) + (", token_ids array<int>" if with_ids else "")
    schema = common.fields(out)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, task = encoder(tokenizer_path(tokenizer)), TaskContext.get().partitionId()
        for b in common.slices(batches, "text", SLICE_BYTES):
            cols: dict[str, list] = {f.name: [] for f in schema}
            ids, off = enc.encode_column(b.column("text"), end)
            more = zip(*(b.column(c).to_pylist() for c in carried), strict=True) if carried else repeat(())
            for doc_id, x, y, extra in zip(b.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), more, strict=False):
                n = y - x
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k in range(len(cut) - 1):
                    part = ids[x + cut[k] : x + cut[k + 1]]
                    cols["doc_id"].append(doc_id)
                    cols["piece"].append(k)
                    cols["start"].append(cut[k])
                    cols["length"].append(cut[k + 1] - cut[k])
                    cols["ids_crc32"].append(zlib.crc32(part))
                    cols["_salt"].append(task)
                    for c, value in zip(carried, extra, strict=True):
                        cols[c].append(value)
                    if with_ids:
                        cols["token_ids"].append(part.view("<i4"))
            yield common.batch(schema, **cols)
        enc.old = {}
        common.release()

    return common.picked(docs, doc_id="long", text="string", **dict.fromkeys(carried, "long")).mapInArrow(run, out)


@dataclass
class Group:
    """`count` sequences that hold the same lengths: (length, copies, offset of the first copy)."""

    count: int
    used: int
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, length: int, copies: int = 1) -> None:
        self.items.append((length, copies, self.used))
        self.used += length * copies


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Groups of sequences that hold all pieces of a histogram of lengths."""
    left = {n: c for n, c in histogram.items() if c}
    done: list[Group] = []
    gaps: dict[int, list[Group]] = {}
    sizes: list[int] = []

    def opened(g: Group) -> None:
        gap = capacity - g.used
        if gap == 0:
            done.append(g)
        elif gap in gaps:
            gaps[gap].append(g)
        else:
            gaps[gap] = [g]
            insort(sizes, gap)

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        # the largest other piece that fits beside a
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else 0
        if b == a and left[a] < 2:
            k -= 1
            b = large[k] if k >= 0 else 0
        if not b:
            g = Group(left[a], 0)
            g.add(a)
            left[a] = 0
        elif a == b:
            g = Group(left[a] // 2, 0)
            g.add(a, 2)
            left[a] %= 2
        else:
            g = Group(min(left[a], left[b]), 0)
            g.add(a)
            g.add(b)
            left[a] -= g.count
            left[b] -= g.count
        opened(g)
        large = [n for n in large if left[n]] if not (left[a] and (not b or left[b])) else large

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        while c:
            k = bisect_left(sizes, n)
            if k < len(sizes):
                gap = sizes[k]
                g = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(k)
                # the tightest gap stays the tightest until it holds no more of this length
                copies = min(gap // n, c)
                taken = min(g.count, c // copies)
                if taken < g.count:
                    opened(Group(g.count - taken, g.used, list(g.items)))
                    g.count = taken
                g.add(n, copies)
                c -= taken * copies
                opened(g)
            else:
                fit = capacity // n
                if c >= fit:
                    g = Group(c // fit, 0)
                    g.add(n, fit)
                else:
                    g = Group(1, 0)
                    g.add(n, c)
                c -= g.count * g.items[0][1]
                opened(g)
    return done + [g for k in sizes for g in gaps[k]]


def places(groups: list[Group]) -> dict[str, np.ndarray]:
    """Runs of ranks among the pieces of one length, by (length, first rank), and where they lie."""
    runs, ranks, base = [], {}, 0
    for g in groups:
        for length, copies, offset in g.items:
            at = ranks.get(length, 0)
            runs.append((length, at, copies, base, offset))
            ranks[length] = at + copies * g.count
        base += g.count
    runs.sort()
    a = np.array(runs, np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "copies": a[:, 2], "base": a[:, 3], "offset": a[:, 4]}


PLACE = "struct<sequence_id:long,offset:long>"


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for each piece of a written table; equal lengths by _salt, and then by position if it has one."""
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))

    @F.arrow_udf(PLACE)
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        p = where.value
        n, r = length.to_numpy(), rank.to_numpy()
        k = np.searchsorted(p["key"], (n << 44) + r, "right") - 1
        i = r - p["rank"][k]
        return pa.StructArray.from_arrays([pa.array(p["base"][k] + i // p["copies"][k]), pa.array(p["offset"][k] + i % p["copies"][k] * n)], ["sequence_id", "offset"])

    rows = common.ranked(found, ["length"], "_salt", [*(["position"] if "position" in found.columns else []), "doc_id", "piece", "start", "ids_crc32"], "_rank")
    kept = [c for c in found.columns if c != "_salt"]
    return rows.select(*kept, place("length", "_rank").alias("_p")).select(*kept, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """PIECE, sequence_id, offset (and token_ids) for all pieces of all rows of docs."""
    return packed(common.written(pieces(docs, capacity, tokenizer, end_id, with_ids), "pieces"), capacity)


def packing_in_order(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """As packing, with `position`, the number of each piece's row in the order of the table's files and their rows."""
    docs = common.on_file(docs)
    file, row = common.unused(docs, "file_key"), common.unused(docs, "row_number")
    found = common.written(pieces(common.located(docs, file, row), capacity, tokenizer, end_id, with_ids, (file, row)), "pieces")
    # small rows meet a row for each file
    numbered = found.join(common.file_starts(docs, file, "_begin"), file).withColumn("position", F.col("_begin") + F.col(row)).drop(file, row, "_begin", "_salt")
    return packed(numbered.withColumn("_salt", F.floor(F.col("position") / RUN)), capacity)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packing(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, each with its document's place in it."""
    return packing_in_order(docs)


QUERIES = {"op3_packing": op3_packing}
