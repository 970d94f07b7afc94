import base64
import hashlib
import io
from collections import Counter

import zstandard
from pyspark.sql import functions as F
from sediment.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def rows():
    big = "x" * 700_000
    out = [(1, "http://a/ b\r\nWARC-Type: x", None), (2, None, ""), (3, "u", "<p>é 中</p>"), (None, "u", "<p>é 中</p>"), (7, "u", "<p>é 中</p>"), (None, "u", "only unnamed"), (None, "u", "only unnamed"), (8, "v", big), (9, "v", big), (3, "u", "<p>é 中</p>")]
    return out + [(100 + i, f"http://h/{i}", f"page\r\n\r\nWARC/1.1 {i % 40} " * (i % 50 + 1)) for i in range(300)]


def brute(data, least=0):
    size = {}
    first = {}
    for i, _, h in data:
        p = (h or "").encode()
        size[p] = len(p)
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in data:
        p = (h or "").encode()
        again = len(p) >= least and first.get(p) is not None and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return Counter(out)


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("digest", F.lit(1)).withColumn("payload", F.lit("clash")).withColumn("first", F.lit(2))
    for least in (0, 20):
        folder = common.shared_path(spark, "warc-test")
        index = warc.write_archives(df, folder, least)
        back = warc.read_archives(index, folder, with_payload=True).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == brute(rows(), least)
        for r in back:
            assert (r.payload is None) == (r.record_type == "revisit")


def test_archives_are_plain_zstandard_and_seekable(spark):
    folder = common.shared_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows(), SCHEMA), folder).collect()
    fs, root = warc.opened(folder)
    for name in {r.archive for r in index}:
        f = fs.open_input_file(f"{root}/{name}")
        table = warc.read_seek_table(f)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_at(f.size(), 0)), read_across_frames=True).read()
        assert len(whole) == sum(d for _, _, d in table)
        mine = [r for r in index if r.archive == name]
        assert sum(r.length for r in mine) == len(whole)
        for r in mine:  # any record alone, from its frame and offset
            start, packed, size = table[r.frame]
            raw = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=size)
            head, _, end = warc.parsed(raw, r.offset)
            assert warc.page_of(head["WARC-Record-ID"]) == r.page_id and end == r.offset + r.length


def test_frames_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 2)
    data = [(i, "u", f"{i} " + "".join(chr(97 + (i * k * k) % 26) for k in range(30_000))) for i in range(400)]
    folder = common.shared_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(data, SCHEMA).repartition(2), folder)
    back = warc.read_archives(index, folder)
    assert back.count() == 400
    tasks = back.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == common.buckets(spark) and back.select("archive", "frame").distinct().count() > 40


def test_lookup_by_record(spark):
    folder = common.shared_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows(), SCHEMA), folder)
    asked = spark.createDataFrame([(9,), (105,), (3,), (12345,), (None,)], "page_id long")
    got = Counter((r.page_id, r.record_type, r.payload and bytes(r.payload)) for r in warc.lookup(index, folder, asked).collect())
    html = {i: h for i, _, h in rows()}
    assert got == Counter({(9, "revisit", None): 1, (105, "response", html[105].encode()): 1, (3, "response", html[3].encode()): 2})


def test_repeated_payloads_hot_and_cold(spark, monkeypatch):
    """Payloads over and under the share that tasks know without a join, and digests told apart by few bits."""
    data = [(i, "u", "hot" if i % 3 == 0 else f"cold {i // 2 % 500}" if i % 3 == 1 else f"once {i}") for i in range(3000)]
    for share, bits in ((1000, 24), (1, 24), (2, 8), (10**9, 24)):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        monkeypatch.setattr(warc, "PREFIX_BITS", bits)
        folder = common.shared_path(spark, "warc-test")
        back = warc.read_archives(warc.write_archives(spark.createDataFrame(data, SCHEMA), folder), folder).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == brute(data)


def test_empty_table(spark):
    folder = common.shared_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert index.count() == 0 and warc.read_archives(index, folder).count() == 0
