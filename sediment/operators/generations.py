"""Generations: which run of ops each flush closes, and the sorted tables, logs, manifest and lookups that follow.

A put flushes once `threshold` keys wait (deletes that wait don't count); a delete flushes once keys and deletes
together reach it. Where a run ends depends on where the one before it ended, so one store's ops are folded in
order, as one store has one writer: the fold streams over (seq, key, op), holds one run's keys, and gives out a row for
each run, which is written once. A long log is folded chunk by chunk, each from the keys that waited at the end of the one
before, so that no task sorts more than a chunk. Ops meet their runs in a join on ranges of seq, and never pass through the fold. A
cluster has a store for each shard, and shards fold side by side. Flushes forced by number need no fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bloom, codec, hashing, vectors
from ..shared import drop, written
from ..shipping import ship
from . import state

THRESHOLD = 50
CHUNK = 1 << 22


def listed(col: pa.Array) -> list:
    """A column as Python values; by way of NumPy where that gives the same ones, which is much faster."""
    if pa.types.is_string(col.type) or (pa.types.is_integer(col.type) and not col.null_count):
        return col.to_numpy(zero_copy_only=False).tolist()
    return col.to_pylist()


def boundaries(log: DataFrame, threshold: int = THRESHOLD, shard: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(_shard,) generation, first_seq, last_seq, flushed of each run, as a written table; flushed is false for ops that no flush has closed yet.

    shard: a column that tells stores apart (else the log is one store). chunk: ops that a task sorts and folds, about.
    """
    ship(log.sparkSession)
    slim = log.select(*([F.col(shard).alias("_shard")] if shard else []), "seq", "key", "op")
    order = ["_shard", "seq"] if shard else ["seq"]
    seq = slim.schema["seq"].dataType
    own = [T.StructField("_shard", slim.schema["_shard"].dataType)] if shard else []
    schema = T.StructType([*own, T.StructField("generation", T.LongType()), T.StructField("first_seq", seq), T.StructField("last_seq", seq), T.StructField("flushed", T.BooleanType())])
    names = [f.name for f in schema]
    waits = [T.StructField(n, T.ArrayType(slim.schema["key"].dataType)) for n in ("puts", "gone")]

    def folded(rows: DataFrame, held: dict | None, ends: bool) -> DataFrame:
        """The runs of rows that follow `held`; unless the log ends here, the last row says what waits then (puts is not null)."""

        def fold(batches: Iterator[pa.RecordBatch]):
            puts: set = set(held["puts"]) if held else set()
            gone: set = set(held["gone"]) if held else set()
            generation, first, last = (held["generation"], held["first_seq"], held["last_seq"]) if held else (0, None, None)
            now = held.get("_shard") if held else object()
            found: list[tuple] = []
            types = None

            def run(flushed: bool, *waiting: list) -> tuple:
                return (*((now,) if shard else ()), generation, first, last, flushed, *(waiting or (None, None)))

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [*names, "puts", "gone"])

            for b in batches:
                kept = pa.list_(b.schema.field("key").type)
                types = types or [*([b.schema.field("_shard").type] if shard else []), pa.int64(), b.schema.field("seq").type, b.schema.field("seq").type, pa.bool_(), kept, kept]
                shards = listed(b.column("_shard")) if shard else repeat(None)
                for s, seq, key, op in zip(shards, listed(b.column("seq")), listed(b.column("key")), listed(b.column("op")), strict=False):
                    if s != now:
                        if first is not None:
                            found.append(run(False))
                        puts, gone, generation, now, first = set(), set(), 0, s, None
                    if first is None:
                        first = seq
                    last = seq
                    if op == state.PUT:
                        puts.add(key)
                        gone.discard(key)
                        full = len(puts) >= threshold
                    else:
                        puts.discard(key)
                        gone.add(key)
                        full = len(puts) + len(gone) >= threshold
                    if full:
                        found.append(run(True))
                        puts, gone, generation, first = set(), set(), generation + 1, None
                if found:
                    yield out()
                    found = []
            if types and not ends:
                found = [run(False, list(puts), list(gone))]
                yield out()
            elif first is not None:
                found = [run(False)]
                yield out()

        return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(fold, T.StructType([*schema, *waits]))

    ops = slim.count()
    if ops <= chunk:
        return written(folded(slim, None, True).select(*names), "runs")
    # by range, each op in one chunk: the table is written, so all jobs below see the same chunks
    dealt = written(slim.repartitionByRange(-(-ops // chunk), *order).withColumn("_chunk", F.spark_partition_id()), "chunks", "_chunk")
    chunks = sorted(r["_chunk"] for r in dealt.select("_chunk").distinct().collect())
    held, parts = None, []
    for c in chunks:
        parts.append(written(folded(dealt.where(F.col("_chunk") == c).drop("_chunk"), held, c == chunks[-1]), "part"))
        if c != chunks[-1]:
            held = parts[-1].where("puts is not null").first().asDict()
    runs = written(reduce(DataFrame.unionByName, parts).where("puts is null").select(*names), "runs")
    for table in (dealt, *parts):
        drop(table)
    return runs


def assigned(log: DataFrame, ends: DataFrame, shard: str | None = None) -> DataFrame:
    """The log with the generation and `flushed` of the run that holds each op.

    Runs and ops meet by ranges of seq about as wide as a run, so that a range has a few runs; Spark broadcasts the
    runs if they are few.
    """
    size = ends.agg(F.count(F.lit(1)).alias("n"), F.min("first_seq").alias("low"), F.max("last_seq").alias("high")).first()
    if not size["n"]:
        return log.withColumns({"generation": F.lit(0).cast("long"), "flushed": F.lit(False)}).where(F.lit(False))
    width = max(1, (size["high"] - size["low"] + 1) // size["n"])

    def place(seq: str):
        return F.floor((F.col(seq) - size["low"]) / width)

    keys = ["_at", *(["_shard"] if shard else [])]
    runs = ends.withColumn("_at", F.explode(F.sequence(place("first_seq"), place("last_seq"))))
    rows = log.withColumn("_at", place("seq"))
    rows = rows.withColumn("_shard", F.col(shard)) if shard else rows
    return rows.join(runs, keys).where("seq between first_seq and last_seq").drop("_at", "_shard", "first_seq", "last_seq")


def numbered(log: DataFrame, threshold: int = THRESHOLD, shard: str | None = None) -> DataFrame:
    """The log with `generation` and `flushed`. The fold runs here, once."""
    return assigned(log, boundaries(log, threshold, shard), shard)


def forced(log: DataFrame, every: int, width: int = 1 << 16) -> DataFrame:
    """The log with the generation and `flushed` of flushes forced after every so many ops, and by nothing else.

    An op's number is its rank in its range of seq and the ops of the ranges before: a row for each range.
    """
    at = log.withColumn("_at", F.floor(F.col("seq") / width))
    counts = at.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    begin = counts.select("_at", (F.sum("_n").over(Window.orderBy("_at")) - F.col("_n")).alias("_begin"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    number = F.col("_begin") + F.row_number().over(Window.partitionBy("_at").orderBy("seq")) - 1
    told = at.join(begin, "_at").withColumn("generation", F.floor(number / every))
    return told.withColumn("flushed", F.col("generation") < F.floor(F.col("_all") / every)).drop("_at", "_begin", "_all")


def records(runs: DataFrame) -> DataFrame:
    """The tables' records: the last op of each key in each flushed generation."""
    return state.last_ops(runs.where("flushed"), "generation").select("generation", "key", "op", "value")


def residual(runs: DataFrame) -> DataFrame:
    """What a restart replays: the last op of each key after the last flush."""
    return state.last_ops(runs.where(~F.col("flushed"))).select("key", "op", "value")


def index(table: DataFrame) -> DataFrame:
    """(generation, key, offset): where each record begins in its file, in key order."""
    w = Window.partitionBy("generation").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    size = codec.table_bytes(F.col("op"), F.col("key"), F.col("value"))
    return table.select("generation", "key", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long").alias("offset"))


def layout(table: DataFrame) -> DataFrame:
    """Sizes of each generation's file: records, index, whole."""
    key, value = F.col("key"), F.col("value")
    sums = table.groupBy("generation").agg(F.count(F.lit(1)).alias("records"), F.sum((F.col("op") == state.DELETE).cast("long")).alias("tombstones"), F.sum(codec.table_bytes(F.col("op"), key, value)).alias("data_bytes"), F.sum(codec.index_bytes(key)).alias("index_bytes"))
    return sums.withColumn("file_bytes", F.col("data_bytes") + F.col("index_bytes") + F.lit(codec.FOOTER_BYTES))


def manifest(runs: DataFrame) -> DataFrame:
    found = runs.where("flushed").select("generation").distinct()
    name = codec.file_name(F.col("generation"))
    return found.select("generation", name.alias("filename"), F.concat(F.col("generation").cast("string"), F.lit(","), name).alias("line"))


def last_generation(runs: DataFrame) -> DataFrame:
    return manifest(runs).agg(F.coalesce(F.max("generation"), F.lit(0)).alias("last_seq"))


def search(table: DataFrame, keys: list[str]) -> DataFrame:
    """(generation, key, found, is_tombstone, value) of each asked key in each generation's table."""
    asked = table.select("generation").distinct().withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys])))
    hit = table.where(F.col("key").isin(keys)).select("generation", "key", "op", "value")
    return asked.join(hit, ["generation", "key"], "left").select("generation", "key", F.col("op").isNotNull().alias("found"), F.coalesce(F.col("op") == state.DELETE, F.lit(False)).alias("is_tombstone"), F.coalesce("value", F.lit("")).alias("value"))


def merged(table: DataFrame, rest: DataFrame) -> DataFrame:
    """Live rows of the newest record of each key: waiting ops first, then generations from the newest."""
    newest = F.lit((1 << 63) - 1)
    rows = table.select("generation", "key", "op", "value").unionByName(rest.withColumn("generation", newest))
    best = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "generation").alias("_r"))
    return best.where(F.col("_r.op") == state.PUT).select("key", "_r.value")


def read_amplification(runs: DataFrame) -> DataFrame:
    """(key, runs_visited): tables opened, newest first, until one holds the key; none if the waiting ops do."""
    flushed = runs.where("flushed")
    last = flushed.agg(F.max("generation").alias("last"))
    newest = runs.groupBy("key").agg(F.max(F.when(F.col("flushed"), F.col("generation"))).alias("g"), F.max((~F.col("flushed")).cast("int")).alias("waits"))
    return newest.join(F.broadcast(last), how="cross").select("key", F.when(F.col("waits") == 1, F.lit(0)).otherwise(F.col("last") - F.col("g") + 1).cast("long").alias("runs_visited"))


def log_bytes(runs: DataFrame) -> DataFrame:
    size = codec.log_bytes(F.col("op"), F.col("key"), F.col("value"))
    return runs.groupBy("generation").agg(F.count(F.lit(1)).alias("ops"), F.sum(size).alias("wal_bytes"))


def filter_sizes(table: DataFrame) -> DataFrame:
    keys = table.groupBy("generation").agg(F.count(F.lit(1)).alias("keys"))
    return keys.withColumn("bits", bloom.size(F.col("keys")))


def filter_bits(table: DataFrame) -> DataFrame:
    """(generation, bits, bit): every set bit of each generation's filter, once."""
    sizes = filter_sizes(table).select("generation", "bits")
    return table.select("generation", "key").join(sizes, "generation").select("generation", "bits", F.explode(vectors.probes(F.col("key"), F.col("bits"))).alias("bit")).distinct()


def packed_filters(table: DataFrame, block: int) -> DataFrame:
    """(_sub, bits, n, rows): the filters of each `block` generations, those of one size together, as a written table.

    Row b of `rows` has a bit for each of the n filters: whether bit b is set in it.
    """
    ship(table.sparkSession)

    def pack(t: pa.Table) -> pa.Table:
        key = t.column("key").combine_chunks()
        first, second = vectors.fnv(key), vectors.fnv(key, hashing.SECOND_SEED)
        _, of, count = np.unique(t.column("generation").to_numpy(), return_inverse=True, return_counts=True)
        size = np.maximum(count * bloom.BITS_PER_KEY, bloom.LEAST_BITS)
        out = []
        for bits in np.unique(size):
            same = size == bits
            at = (np.cumsum(same) - 1)[of]
            mine = same[of]
            one = np.zeros((bits, same.sum()), bool)
            for place in vectors.places(first[mine], second[mine], bits):
                one[place, at[mine]] = True
            out.append((t.column("_sub")[0].as_py(), int(bits), int(same.sum()), np.packbits(one, axis=1).tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["_sub", "bits", "n", "rows"])

    rows = table.select(F.floor(F.col("generation") / block).alias("_sub"), "generation", "key")
    return written(rows.groupBy("_sub").applyInArrow(pack, "_sub long, bits long, n long, rows binary"), "filters")


def skips(table: DataFrame, keys: DataFrame, records: int = 1 << 22) -> DataFrame:
    """(key, runs, skipped): of each asked key, how many tables the filters spare.

    Every key has to ask every filter. Filters of one size lie bit by bit beside each other, so that a key asks 64 of them
    by one AND of five words. A task has one group of keys and the filters of about `records` records, and gives one
    number for each key; nothing is made for a pair of a key and a filter.
    """
    asked = keys.select("key").distinct()
    size = table.agg(F.count(F.lit(1)).alias("n"), F.min("generation").alias("low"), F.max("generation").alias("high")).first()
    if not size["n"]:
        return asked.select("key", F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("skipped"))
    sub = max(1, min(1 << 13, records // 8 * (size["high"] - size["low"] + 1) // size["n"]))
    filters = packed_filters(table, sub)
    runs = F.lit(filters.agg(F.sum("n")).first()[0]).cast("long")
    block = F.floor(F.col("_sub") / 8).alias("_block")
    blocks = [r["_block"] for r in filters.select(block).distinct().collect()]
    groups = max(16, asked.count() >> 17)

    def ask(mine: pa.Table, held: pa.Table) -> pa.Table:
        key = mine.column("key").combine_chunks()
        first, second = vectors.fnv(key), vectors.fnv(key, hashing.SECOND_SEED)
        maybe = np.zeros(len(key), np.int64)
        sizes: dict[int, list[np.ndarray]] = {}
        for bits, rows in zip(held.column("bits").to_pylist(), held.column("rows").to_pylist(), strict=True) if len(key) else ():
            sizes.setdefault(bits, []).append(np.frombuffer(rows, np.uint8).reshape(bits, -1))
        for bits, parts in sizes.items():
            wide = np.hstack(parts)
            if wide.shape[1] > 4:
                wide = np.pad(wide, ((0, 0), (0, -wide.shape[1] % 8))).view(np.uint64)
            step = max(1, (1 << 21) // wide[0].nbytes)
            for a in range(0, len(key), step):
                left = None
                for place in vectors.places(first[a : a + step], second[a : a + step], bits):
                    left = wide[place] if left is None else np.bitwise_and(left, wide[place], out=left)
                maybe[a : a + step] += np.bitwise_count(left).sum(axis=1, dtype=np.int64)
        if key.null_count:
            maybe[key.is_null().to_numpy(zero_copy_only=False)] = 0
        return pa.table([key, pa.array(maybe)], ["key", "maybe"])

    tasks = min(4096, groups * len(blocks))
    dealt = asked.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("_group"), F.explode(F.array(*[F.lit(b).cast("long") for b in blocks])).alias("_block"), "key")
    held = filters.select(F.explode(F.array(*[F.lit(g).cast("long") for g in range(groups)])).alias("_group"), block, "bits", "rows")
    sides = [side.repartition(tasks, "_group", "_block").groupBy("_group", "_block") for side in (dealt, held)]
    found = sides[0].cogroup(sides[1]).applyInArrow(ask, f"key {asked.schema['key'].dataType.simpleString()}, maybe long")
    return found.groupBy("key").agg(runs.alias("runs"), (runs - F.sum("maybe")).alias("skipped"))
