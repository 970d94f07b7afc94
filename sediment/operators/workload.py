"""Workloads and their figures: keys, value sizes, delete samples, read plans, hit and miss counts."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import state

ALPHABET = string.ascii_letters + string.digits


def present_key(i: Column) -> Column:
    return F.concat(F.lit("key_"), i.cast("string"))


def absent_key(i: Column) -> Column:
    return F.concat(F.lit("miss_"), i.cast("string"))


def random_value(i: Column, low: int, high: int, seed: int = 0) -> Column:
    """Text of a size between low and high, the same for the same i and seed."""
    ship()
    letters = np.frombuffer(ALPHABET.encode(), np.uint8)

    def numbers(x: np.ndarray) -> np.ndarray:
        """As `scattered`: with the sign of x."""
        return np.sign(x) * ((np.abs(x).astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    @F.arrow_udf("string")
    def run(i: pa.Array) -> pa.Array:
        at = i.fill_null(0).to_numpy(zero_copy_only=False)
        size = np.where(i.is_valid().to_numpy(zero_copy_only=False), np.maximum(low + np.fmod(numbers(at * 31 + seed), high - low + 1), 0), 0)
        step = max(1, (1 << 18) // max(high, 1))
        parts = []
        for a in range(0, len(at), step):
            some = size[a : a + step]
            k = np.arange(1, some.sum() + 1) - np.repeat(np.cumsum(some) - some, some)
            place = np.fmod(numbers(np.repeat(at[a : a + step] * 1031 + seed, some) + k * 7) >> 8, len(letters))
            parts.append(letters[np.where(place >= 0, place, np.where(place == -1, 0, place + 1))])  # below 0 as SQL's substring counts
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.concatenate(parts) if parts else b""))

    return run(i.cast("long"))


def split_range(spark: SparkSession, total: int, parts: int) -> DataFrame:
    """(part, start, stop): near-equal ranges, the first ones longer; some empty if there are more parts than numbers."""
    base, rest = divmod(total, parts)
    p = F.col("id")
    start = p * base + F.least(p, F.lit(rest))
    return spark.range(parts).select(p.alias("part"), start.alias("start"), (start + base + (p < rest).cast("long")).alias("stop"))


def write_stats(log: DataFrame) -> DataFrame:
    n, size = F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long")
    sums = log.where(F.col("op") == state.PUT).agg(n.alias("write_ops"), size.alias("total_value_bytes"))
    return sums.withColumn("avg_value_bytes", ratio(F.col("total_value_bytes"), F.col("write_ops")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def expected_generations(log: DataFrame, threshold: int) -> DataFrame:
    """(generation, records) of a bulk load of dense unique keys: a flush after each `threshold` puts."""
    g = F.floor(F.col("seq") / threshold)
    return log.groupBy(g.alias("generation")).agg(F.count(F.lit(1)).alias("records"))


def scattered(i: Column) -> Column:
    """A number that orders i, i + 1, ... as if shuffled, and is the same everywhere: i * 2654435761 mod 2^32, with the sign of i.

    The product is put together from halves of i, as longs must not overflow.
    """
    low = i % 4294967296
    high = (low - low % 65536) / 65536
    return (high.cast("long") * 2654435761 % 65536 * 65536 + low % 65536 * 2654435761) % 4294967296


def delete_sample(log: DataFrame, share: float) -> DataFrame:
    """Keys to delete: the share of all keys whose scattered numbers are smallest (ties: by seq), none twice.

    Counts of 2^16 ranges of the number give the range in which the share ends; all rows of the ranges below it belong
    to the share, and only that range's own rows are sorted.
    """
    rows = log.select("seq", "key", scattered(F.col("seq")).alias("_at"))
    band = F.shiftright("_at", 16)
    counts = sorted((r["band"], r["n"]) for r in rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect())
    left = int(sum(n for _, n in counts) * share)
    for at, n in counts:
        if left < n:
            break
        left -= n
    else:
        return log.select("seq", "key")
    last = rows.where(band == at).orderBy("_at", "seq").limit(left)
    return rows.where(band < at).unionByName(last).select("seq", "key")


def read_plan(spark: SparkSession, keys: int, reads: int, miss_rate: float) -> DataFrame:
    """(n, key): hits drawn with replacement, and misses."""
    misses = min(reads, int(reads * miss_rate + 0.5))
    i = F.col("id")
    drawn = F.when(F.lit(keys) > 0, scattered(i * 7 + 42) % max(keys, 1)).otherwise(F.lit(0))
    return spark.range(reads).select(i.alias("n"), F.when(i < reads - misses, present_key(drawn)).otherwise(absent_key(i - (reads - misses))).alias("key"))


def read_stats(log: DataFrame, plan: DataFrame) -> DataFrame:
    held = state.live(log.join(plan.select("key").distinct(), "key", "left_semi"))
    got = plan.join(held, "key", "left")
    hit = F.coalesce(F.sum(F.col("value").isNotNull().cast("long")), F.lit(0))
    sums = got.agg(F.count(F.lit(1)).alias("read_ops"), hit.alias("read_hits"))
    return sums.withColumn("read_misses", F.col("read_ops") - F.col("read_hits")).withColumn("miss_rate_observed", ratio(F.col("read_misses"), F.col("read_ops")))


def report(*frames: DataFrame) -> DataFrame:
    """(metric, value) of one-row frames' columns."""
    out = None
    for df in frames:
        cells = F.array(*[F.struct(F.lit(c.upper()).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        part = df.select(F.explode(cells).alias("c")).select("c.metric", "c.value")
        out = part if out is None else out.unionByName(part)
    return out
