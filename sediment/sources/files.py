"""Log segments and sorted tables in their binary form, byte for byte: written and read by tasks, one file each.

Numbers are little-endian. A sorted table: records in key order, then (key length, key, offset) of each, then a footer
of index offset, index count and magic. Readers go through Spark, so files may lie in any store; a file that is cut
short or has another magic is an error, never a silent gap.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

MAGIC = 0x53535442
PUT, DELETE = 1, 2
TABLE_ROWS = "generation long, op int, key binary, value binary, offset long"
LOG_ROWS = "segment long, n long, op int, generation long, key binary, value binary"


def table_record(op: int, key: bytes, value: bytes | None) -> bytes:
    head = struct.pack("<BI", op, len(key)) + key
    return head + struct.pack("<I", len(value or b"")) + (value or b"") if op == PUT else head


def log_record(op: int, generation: int, key: bytes, value: bytes | None) -> bytes:
    head = struct.pack("<BQI", op, generation, len(key)) + key
    return head + struct.pack("<I", len(value or b"")) + (value or b"") if op == PUT else head


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_tables(records: DataFrame, folder: str, parts: int = 8) -> DataFrame:
    """One file for each generation of (generation, key, op, value); (generation, filename, bytes) as written."""
    ship(records.sparkSession)
    rows = records.select("generation", F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value"))
    dealt = rows.repartition(parts, "generation").sortWithinPartitions("generation", "key")
    schema = pa.schema([("generation", pa.int64()), ("filename", pa.string()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        now, out, at, index = None, None, 0, []

        def close():
            tail = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<Q", o) for k, o in index)
            out.write(tail + struct.pack("<QQI", at, len(index), MAGIC))
            out.close()
            name = f"{now:06d}.sst"
            fs.move(f"{root}/.{name}", f"{root}/{name}")  # a name appears when its file is whole
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([name]), pa.array([at + len(tail) + 20], pa.int64())], schema=schema)

        for b in batches:
            for g, key, op, value in zip(*(b.column(c).to_pylist() for c in ("generation", "key", "op", "value")), strict=True):
                if g != now:
                    if out is not None:
                        yield close()
                    now, out, at, index = g, fs.open_output_stream(f"{root}/.{g:06d}.sst", compression=None), 0, []
                raw = table_record(op, key, value)
                index.append((key, at))
                out.write(raw)
                at += len(raw)
        if out is not None:
            yield close()

    return dealt.mapInArrow(run, "generation long, filename string, bytes long")


def parse_table(raw: bytes) -> Iterator[tuple[int, bytes, bytes | None, int]]:
    """(op, key, value, offset) of each record, by the file's own index."""
    if len(raw) < 20:
        raise ValueError("a table file of fewer than 20 bytes")
    at, count, magic = struct.unpack("<QQI", raw[-20:])
    if magic != MAGIC:
        raise ValueError("a table file with another magic")
    for _ in range(count):
        (n,) = struct.unpack_from("<I", raw, at)
        key = raw[at + 4 : at + 4 + n]
        (offset,) = struct.unpack_from("<Q", raw, at + 4 + n)
        at += 12 + n
        op, size = struct.unpack_from("<BI", raw, offset)
        if raw[offset + 5 : offset + 5 + size] != key:
            raise ValueError(f"the index and the record at {offset} differ")
        value = None
        if op == PUT:
            (v,) = struct.unpack_from("<I", raw, offset + 5 + size)
            value = raw[offset + 9 + size : offset + 9 + size + v]
        yield op, key, value, offset
    if at != len(raw) - 20:
        raise ValueError("a table file whose index is cut short")


def parse_log(raw: bytes) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(op, generation, key, value) of each record; a record that is cut short, as after a crash, ends the log."""
    at = 0
    while at + 13 <= len(raw):
        op, generation, n = struct.unpack_from("<BQI", raw, at)
        if op not in (PUT, DELETE):
            raise ValueError(f"no op at {at}")
        end = at + 13 + n
        value = None
        if op == PUT:
            if end + 4 > len(raw):
                return
            (v,) = struct.unpack_from("<I", raw, end)
            value = raw[end + 4 : end + 4 + v]
            end += 4 + v
        if end > len(raw):
            return
        yield op, generation, raw[at + 13 : at + 13 + n], value
        at = end


def _read(spark: SparkSession, folder: str, glob: str, parse, schema: str, number: str) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    named = files.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias(number), "content")

    def run(batches):
        for b in batches:
            for n, raw in zip(b.column(number).to_pylist(), b.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(parse(n, raw), schema=_arrow(schema))

    return named.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(","))])


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """TABLE_ROWS of every sorted table in a folder."""
    return _read(spark, folder, "*.sst", lambda n, raw: [{"generation": n, "op": op, "key": k, "value": v, "offset": o} for op, k, v, o in parse_table(raw)], TABLE_ROWS, "generation")


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """LOG_ROWS of every log segment in a folder; n is the record's place."""
    return _read(spark, folder, "*.log", lambda n, raw: [{"segment": n, "n": i, "op": op, "generation": g, "key": k, "value": v} for i, (op, g, k, v) in enumerate(parse_log(raw))], LOG_ROWS, "segment")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(line, generation, filename) of a manifest: lines without a comma are skipped."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    cut = F.instr("value", ",")
    return lines.where(cut > 0).select("line", F.expr("substring(value, 1, instr(value, ',') - 1)").cast("long").alias("generation"), F.expr("substring(value, instr(value, ',') + 1)").alias("filename"))
