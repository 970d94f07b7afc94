"""What the training-data operators share: code shipping, joins on hot keys, rows on file, Arrow slicing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..shared import drop, shared_dir, shared_path, written  # noqa: F401

#: Bytes of text that a Python worker turns into NumPy arrays at once (a longer text comes alone).
SLICE_BYTES = 1 << 20
#: Rows of one Arrow batch, where the session names no number: with long texts, Spark's own would take much memory twice.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors; and small Arrow batches, where the session names no number of rows."""
    if not spark.sparkContext.getConf().contains("spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shipping.ship(spark)


def buckets(spark: SparkSession) -> int:
    """Parts for an explicit repartition: as many as the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int):
    """crc32 of a column's text, modulo n; null where the column is."""
    return F.crc32(F.col(col).cast("string")) % n


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; a null has no bytes.

    offsets has one entry more than rows, and starts at 0.
    """
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def cuts(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text (one row at least), in order."""
    _, off = arrow_bytes(text)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to
    release()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of at most `most` bytes of `text` (one row at least)."""
    for b in batches:
        for at, to in cuts(b.column(b.schema.get_field_index(text)), most):
            yield b.slice(at, to - at)


def on_file(df: DataFrame) -> DataFrame:
    """df itself if it is read straight from files, so that rows have a place of their own; else as a written table."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return written(df, "on-file")
    return df


def located(docs: DataFrame, file: str, row: str) -> DataFrame:
    """Rows on file with the hash of the path of each one's file, and its number in it: the same at every reading."""
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def file_starts(docs: DataFrame, file: str, begin: str) -> DataFrame:
    """(file, begin) for each file of rows on file: how many rows the files before it hold, by name."""
    from pyspark.sql import Window

    path = F.col("_metadata.file_path")
    files = docs.select(path.alias("path"), F.col("_metadata.row_index").alias("row")).groupBy("path").agg((F.max("row") + 1).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("path")) - F.col("rows")
    return files.select(F.xxhash64("path").alias(file), before.alias(begin))


#: Keys that hold more than one in HOT_SHARE of all rows are known to every task: fewer than so many.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined with right, which has one row for each key and how many rows of left (of total) bear it.

    Hot keys, fewer than HOT_SHARE, are broadcast, so that their rows stay where they are; the others are shuffled.
    left is read twice: pass a written table.
    """
    hot, cold = right.where(F.col(n) * HOT_SHARE > total), right.where(F.col(n) * HOT_SHARE <= total)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark's names may ignore case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def fields(schema: str) -> pa.Schema:
    """Arrow schema of a short list 'name type, ...' with long, double, boolean, string, binary, int and [] of these."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "float": pa.float32()}
    out = []
    for part in schema.split(","):
        name, kind = part.split()
        out.append(pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(out)


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema], schema=schema)


def picked(df: DataFrame, **casts: str) -> DataFrame:
    """Only the columns that an operator reads, by exact name, cast to its types; further columns never clash."""
    return df.select(*[F.col(f"`{k}`").cast(v).alias(k) for k, v in casts.items()])


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list, rank: str) -> DataFrame:
    """Adds `rank`: 0, 1, ... within `keys`, ordered by (bucket, order), without one task per key.

    `bucket` is a column that spreads each key's rows; a key's rows are numbered bucket by bucket, and the
    buckets' counts (at most keys x buckets rows) give where each begins. Keys and bucket must not be null.
    df is read twice: pass a written table, or one whose rows come out alike each time.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    begin = counts.withColumn("_begin", F.sum("_n").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("_n")).drop("_n")
    local = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - F.lit(1))
    return local.join(begin, [*keys, bucket]).select(*[f"`{c}`" for c in df.columns], (F.col("_begin") + F.col("_at")).cast("long").alias(rank))
