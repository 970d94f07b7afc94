"""WARC (operator 1): archives as seekable Zstandard bundles, with revisit records for equal payloads.

Records are grouped into independent Zstandard frames of about FRAME_BYTES; a seek table (a skippable frame with
each frame's compressed and plain size) ends each archive, so that any frame can be read alone and any Zstandard
reader can read the whole. The index maps each record to its archive, frame, and offset within the frame.

Equal payloads are found by SHA-1 in Spark: the least page_id of each digest is a partially aggregated minimum. Only
payloads that may occur twice are shuffled: digests that occur once are told apart by a bitmap of PREFIX_BITS bits of
those that repeat (a set bit may be chance; then the join decides), and digests that fill a thousandth of the
repeated rows or more, so at most a thousand, are known to every task and need no join. Each task
writes archives under names of its own attempt; only archives that the index names count, so a lost or repeated
task leaves nothing wrong behind.

Reading deals runs of RUN frames over all tasks. A frame is found by its archive's seek table, and each record by its
offset within the frame, as the index has it: any selection of the index's rows can be read, and nothing besides
their frames is.

Nulls and odd rows: a null html is an empty payload; a null url is left out of the record; a null page_id is written
as such, never named as the page that others revisit, and revisits a named page of equal payload; if rows repeat the
least page_id of a payload, each of them is a response; an empty table gives no archive and no rows; extra columns are
ignored. Archives are written through pyarrow's file systems, so the folder must be one that it can open.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The seekable format's numbers: a skippable frame's magic, and the seek table's at its end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10
#: An archive is closed at this plain size, and the task goes on with the next.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
#: Frames that are read by one task together: neighbours in an archive, about 4 MB plain.
RUN = 16
#: Size of the bitmap of repeated digests; with many more of them than bits, all rows are joined.
PREFIX_BITS = 24
HOT_SHARE = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    found = name[len("<urn:page:") : -1]
    return None if found == "none" else int(found)


def quoted(url: str) -> str:
    """A URL that can't break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quoted(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open archive."""
    size = f.size()
    n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("the archive does not end in a seek table")
    raw = f.read_at(8 * n, size - 9 - 8 * n)
    out, at = [], 0
    for k in range(n):
        c, d = struct.unpack_from("<II", raw, 8 * k)
        out.append((at, c, d))
        at += c
    return out


class Writer:
    """One archive: frames of whole records, then the seek table."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.stream = fs.open_output_stream(path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset within it)."""
        if self.held and self.size + len(raw) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(raw)
        self.size += len(raw)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.stream.write(packed)
            self.frames.append((len(packed), self.size))
            self.total += self.size
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.stream.write(seek_table(self.frames))
        self.stream.close()


def bitmap(digests: DataFrame) -> np.ndarray:
    """A bit for each prefix of PREFIX_BITS bits that a digest has: that many bits, and so many / 64 rows to the driver at most."""
    prefix = F.conv(F.substring("digest", 1, PREFIX_BITS // 4), 16, 10).cast("long")
    cells = digests.select(F.shiftright(prefix, 6).alias("cell"), F.expr("shiftleft(1L, cast(pmod(conv(substring(digest, 1, " + str(PREFIX_BITS // 4) + "), 16, 10), 64) as int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << PREFIX_BITS - 6, np.int64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


INDEX = "page_id long, archive string, frame int, offset long, length long"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes all rows of pages (page_id, url, html) into archives in a shared folder; the index (INDEX) as a written table."""
    spark = pages.sparkSession
    common.ship(spark)
    rows = common.picked(pages, page_id="long", url="string", html="string").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = common.written(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"), "warc-digests")
    total = again.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = {r["digest"]: r["first"] for r in again.where(F.col("n") * HOT_SHARE >= total).collect()}
    cold = again.where(F.col("n") * HOT_SHARE < total).select("digest", "first")
    known = spark.sparkContext.broadcast((hot, bitmap(cold)))

    @F.arrow_udf("boolean")
    def may_repeat(digest: pa.Array) -> pa.Array:
        hot, bits = known.value
        at = np.array([int(d[: PREFIX_BITS // 4], 16) for d in digest.to_pylist()], np.int64)
        return pa.array([x and d not in hot for x, d in zip((bits[at >> 3] >> (at & 7) & 1).astype(bool).tolist(), digest.to_pylist(), strict=True)], pa.bool_())

    told = rows.withColumn("again", may_repeat("digest"))
    alone = told.where("not again").select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("first"))
    judged = alone.unionByName(told.where("again").join(cold, "digest", "left").select("page_id", "url", "payload", "digest", "first"))
    schema = common.fields(INDEX)

    def run(batches):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, n, name = None, 0, ""
        hot = known.value[0]
        for b in common.slices(batches, "payload"):
            cols = {f.name: [] for f in schema}
            for page_id, url, payload, digest, first in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "first")), strict=True):
                if out is None:
                    name = f"{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
                    out, n = Writer(fs, f"{root}/{name}"), n + 1
                first = hot.get(digest, first)
                revisit = first is not None and page_id != first and len(payload) >= least_bytes
                raw = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first if revisit else None, revisit)
                frame, offset = out.add(raw)
                for k, v in zip(cols, (page_id, name, frame, offset, len(raw)), strict=True):
                    cols[k].append(v)
                if out.total >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield common.batch(schema, **cols)
        if out is not None:
            out.close()

    return common.written(judged.mapInArrow(run, INDEX), "warc-index")


def parsed(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record begins) of the record at an offset of a plain frame."""
    stop = raw.index(b"\r\n\r\n", at)
    lines = raw[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    return head, raw[begin:end], end + 4


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, frame int, offset long"


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """RECORD (and payload, null for revisits) of every record that rows of an index name.

    Frames are read alone, by the seek table, and records at the index's offsets; another record there, or a response
    whose payload doesn't have its digest, is an error.
    """
    spark = index.sparkSession
    common.ship(spark)
    # a frame holds about FRAME_BYTES, or one record
    frames = index.groupBy("archive", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "page_id"))).alias("at")).withColumn("run", F.floor(F.col("frame") / RUN))
    dealt = frames.repartition(common.buckets(spark), "archive", "run").sortWithinPartitions("archive", "frame")
    out = RECORD + (", payload binary" if with_payload else "")
    schema = common.fields(out)

    def run(batches):
        fs, root = opened(folder)
        name, file, table = None, None, []
        plain = zstandard.ZstdDecompressor()
        for b in batches:
            for archive, frame, wanted in zip(b.column("archive").to_pylist(), b.column("frame").to_pylist(), b.column("at").to_pylist(), strict=True):
                if archive != name:
                    name, file = archive, fs.open_input_file(f"{root}/{archive}")
                    table = read_seek_table(file)
                start, packed, size = table[frame]
                raw = plain.decompress(file.read_at(packed, start), max_output_size=size)
                cols = {f.name: [] for f in schema}
                for w in wanted:
                    at = w["offset"]
                    head, block, _ = parsed(raw, at)
                    http, payload = block.split(b"\r\n\r\n", 1)
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind, page_id = head["WARC-Type"], page_of(head["WARC-Record-ID"])
                    if page_id != w["page_id"]:
                        raise ValueError(f"{archive}, frame {frame}, offset {at}: not the record that the index names")
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{archive}, frame {frame}, offset {at}: the payload isn't what was written")
                    row = [page_id, size, digest, kind, page_of(head["WARC-Refers-To"]) if kind == "revisit" else None, head.get("WARC-Target-URI"), archive, frame, at]
                    for k, v in zip(cols, row + ([payload if kind == "response" else None] if with_payload else []), strict=True):
                        cols[k].append(v)
                yield common.batch(schema, **cols)

    return dealt.mapInArrow(run, out)


def lookup(index: DataFrame, folder: str, asked: DataFrame, with_payload: bool = True) -> DataFrame:
    """RECORD (and payload) of the pages that asked (page_id) names: only the frames that hold them are read."""
    ids = asked.select(F.col("page_id").cast("long").alias("page_id")).distinct()
    return read_archives(index.join(ids, "page_id", "left_semi"), folder, with_payload)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    folder = common.shared_path(spark, "warc")
    index = write_archives(common.table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS head FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(s, 1 + 10 * (i // 8)::INT, 10))::UBIGINT >> (35 - 5 * (i % 8))::UBIGINT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM f"""
}
