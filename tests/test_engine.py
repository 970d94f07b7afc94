import random

import pytest
from pyspark.sql import functions as F
from sediment.operators import generations as gen
from sediment.operators import ring, state, workload
from sediment.sources import files
from sediment.sources.store import Store

LOG = "seq long, key string, op int, value string"


class Model:
    """The same engine as plain dictionaries."""

    def __init__(self, threshold):
        self.t, self.puts, self.gone, self.tables, self.of = threshold, {}, set(), [], []

    def apply(self, key, op, value):
        self.of.append(len(self.tables))
        if op == 1:
            self.puts[key] = value
            self.gone.discard(key)
            full = len(self.puts) >= self.t
        else:
            self.puts.pop(key, None)
            self.gone.add(key)
            full = len(self.puts) + len(self.gone) >= self.t
        if full:
            self.flush()

    def flush(self):
        if self.puts or self.gone:
            self.tables.append({**{k: (1, v) for k, v in self.puts.items()}, **{k: (2, None) for k in self.gone}})
            self.puts, self.gone = {}, set()

    def get(self, key):
        if key in self.gone:
            return None
        if key in self.puts:
            return self.puts[key]
        for t in reversed(self.tables):
            if key in t:
                return t[key][1]
        return None


def random_log(seed, n=400, keys=25):
    r = random.Random(seed)
    return [(i, f"k{r.randrange(keys)}" + r.choice(["", "é"]), 1 if r.random() < 0.7 else 2, f"v{i}") for i in range(n)]


@pytest.mark.parametrize(("seed", "threshold"), [(0, 1), (1, 5), (2, 7), (3, 1000)])
def test_random_logs_against_the_model(spark, seed, threshold):
    rows = [(s, k, o, v if o == 1 else None) for s, k, o, v in random_log(seed)]
    m = Model(threshold)
    for _, k, o, v in rows:
        m.apply(k, o, v)
    log = spark.createDataFrame(rows, LOG).repartition(3)
    runs = gen.numbered(log, threshold).cache()
    assert [r.generation for r in runs.orderBy("seq").collect()] == m.of
    table = gen.records(runs)
    assert {(r.generation, r.key): (r.op, r.value) for r in table.collect()} == {(g, k): x for g, t in enumerate(m.tables) for k, x in t.items()}
    assert {r.key: (r.op, r.value) for r in gen.residual(runs).collect()} == {**{k: (1, v) for k, v in m.puts.items()}, **{k: (2, None) for k in m.gone}}
    want = {k: m.get(k) for k in {k for _, k, _, _ in rows} if m.get(k) is not None}
    assert {r.key: r.value for r in state.live(log).collect()} == want
    assert {r.key: r.value for r in gen.merged(table, gen.residual(runs)).collect()} == want
    asked = spark.createDataFrame([(k,) for k in [*want, "missing"]], "key string")
    assert {r.key: (r.found, r.value) for r in state.multi_get(log, asked).collect()} == {**{k: (True, v) for k, v in want.items()}, "missing": (False, "")}
    nodes = ["a", "b"]
    assert {r.key: (r.found, r.value) for r in ring.sharded_get(log, asked, nodes).collect()} == {**{k: (True, v) for k, v in want.items()}, "missing": (False, "")}
    runs.unpersist()


def test_shards_fold_by_themselves(spark):
    rows = random_log(5)
    log = spark.createDataFrame(rows, LOG).withColumn("node", F.when(F.col("key") < "k15", "a").otherwise("b"))
    got = {r.seq: r.generation for r in gen.numbered(log, 5, shard="node").collect()}
    for side in (True, False):
        m, mine = Model(5), [r for r in rows if (r[1] < "k15") == side]
        for _, k, o, v in mine:
            m.apply(k, o, v)
        assert [got[r[0]] for r in mine] == m.of


def test_threshold_ignores_waiting_deletes_on_put(spark):
    rows = [(0, "a", 2, None), (1, "b", 2, None), (2, "c", 1, "x"), (3, "d", 1, "x"), (4, "e", 1, "x"), (5, "f", 2, None)]
    got = [(r.generation, r.flushed) for r in gen.numbered(spark.createDataFrame(rows, LOG), 3).orderBy("seq").collect()]
    assert got == [(0, True)] * 5 + [(1, False)]


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    runs = gen.numbered(log, 5)
    assert state.live(log).count() == 0 and gen.last_generation(runs).first()["last_seq"] == 0 and gen.manifest(runs).count() == 0


def store(spark, tmp_path, threshold=5):
    return Store(spark, f"file://{tmp_path}/db", threshold)


def test_reopen_without_flush(spark, tmp_path):
    store(spark, tmp_path).put({"key_1": "value_1"})
    assert store(spark, tmp_path).get("key_1") == "value_1"


def test_flush_at_threshold_and_replay(spark, tmp_path):
    store(spark, tmp_path).put({f"key_{i}": f"Value {i}" for i in range(1, 9)})
    again = store(spark, tmp_path)
    assert again.get("key_1") == "Value 1" and again.get("key_8") == "Value 8" and again.get("key_does_not_exist") is None
    assert again.waiting().count() == 3 and [r.filename for r in again.manifest().collect()] == ["000000.sst"]


def test_overwrite_delete_revive(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.get("k") is None
    s.put({"k": "v1"})
    s.put({"k": "v2"})
    assert s.get("k") == "v2"
    s.delete("k", "never_existed")
    assert s.get("k") is None and s.get("never_existed") is None
    s.flush()
    s.flush()  # nothing waits
    assert s.manifest().count() == 1 and s.tables().count() == 2
    s.put({"k": "v3"})
    assert s.get("k") == "v3"
    s.flush()
    assert {r.key: (r.found, r.value) for r in store(spark, tmp_path).multi_get(spark.createDataFrame([("k",), ("never_existed",)], "key string")).collect()} == {"k": (True, "v3"), "never_existed": (False, "")}


def test_crash_before_commit_leaves_nothing_behind(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put({"a": "1", "b": "2"})
    stray = spark.createDataFrame([("a", 1, "stale"), ("z", 1, "stray")], "key string, op int, value string").withColumn("generation", F.lit(0))
    stray.write.partitionBy("generation").parquet(f"{s.folder}/generations")
    assert store(spark, tmp_path).get("a") == "1" and store(spark, tmp_path).get("z") is None
    s.flush()
    assert {r.key: r.value for r in store(spark, tmp_path).live().collect()} == {"a": "1", "b": "2"}


def test_binary_files_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/sst"
    rows = [(0, b"apple", 1, b"red"), (0, b"eggplant", 2, None), (0, b"", 1, b"a\0b"), (1234567, "é".encode(), 1, b""), (1, b"k", 2, None)]
    df = spark.createDataFrame(rows, "generation long, key binary, op int, value binary")
    sizes = {r.generation: (r.filename, r.bytes) for r in files.write_tables(df, folder).collect()}
    assert sizes[1234567][0] == "1234567.sst" and sizes[1] == ("000001.sst", 6 + 13 + 20)
    back = files.read_tables(spark, folder).collect()
    assert sorted((r.generation, bytes(r.key), r.op, None if r.value is None else bytes(r.value)) for r in back) == sorted(rows, key=lambda r: (r[0], r[1]))
    mine = sorted((r.offset, bytes(r.key)) for r in back if r.generation == 0)
    assert [k for _, k in mine] == [b"", b"apple", b"eggplant"] and [o for o, _ in mine] == [0, 12, 29]
    (tmp_path / "sst" / "000009.sst").write_bytes(b"short")
    with pytest.raises(Exception, match="fewer than 20 bytes"):
        files.read_tables(spark, folder).collect()


def test_torn_log_ends_at_the_last_whole_record(spark, tmp_path):
    raw = files.log_record(1, 3, b"a", b"1") + files.log_record(2, 3, b"a", None) + files.log_record(1, 3, b"b", b"22")
    (tmp_path / "000003.log").write_bytes(raw[:-1])
    (tmp_path / "000004.log").write_bytes(raw)
    got = files.read_logs(spark, f"file://{tmp_path}").orderBy("segment", "n").collect()
    assert [(r.segment, r.op, bytes(r.key)) for r in got] == [(3, 1, b"a"), (3, 2, b"a"), (4, 1, b"a"), (4, 2, b"a"), (4, 1, b"b")]
    assert len(files.log_record(1, 3, b"a", b"1")) == 17 + 2 and len(files.log_record(2, 3, b"a", None)) == 13 + 1


def test_manifest(spark, tmp_path):
    (tmp_path / "MANIFEST").write_text("0,000000.sst\nno comma\n1,a,b.sst\n2,000002.sst\n")
    got = files.read_manifest(spark, f"file://{tmp_path}/MANIFEST").orderBy("line").collect()
    assert [(r.generation, r.filename) for r in got] == [(0, "000000.sst"), (1, "a,b.sst"), (2, "000002.sst")]


def test_split_range_with_more_parts_than_numbers(spark):
    assert [(r.start, r.stop) for r in workload.split_range(spark, 2, 4).orderBy("part").collect()] == [(0, 1), (1, 2), (2, 2), (2, 2)]
    assert [(r.start, r.stop) for r in workload.split_range(spark, 10, 4).orderBy("part").collect()] == [(0, 3), (3, 6), (6, 8), (8, 10)]


def test_random_values(spark):
    rows = spark.range(200).select(workload.random_value(F.col("id"), 0, 20).alias("v")).collect()
    assert {len(r.v) for r in rows} == set(range(21)) and all(c in workload.ALPHABET for r in rows for c in r.v)


def test_forced_flushes_count_ops(spark):
    seqs = [3 * i + (i // 7) * 1000 for i in range(103)]
    log = spark.createDataFrame([(s, f"k{s % 5}", 1, "v") for s in seqs], LOG).repartition(3)
    got = {r.seq: (r.generation, r.flushed) for r in gen.forced(log, 10, width=64).collect()}
    assert got == {s: (n // 10, n < 100) for n, s in enumerate(seqs)}
    assert gen.forced(log.limit(0), 10).count() == 0


def test_empty_logs(spark):
    none = spark.createDataFrame([], LOG)
    assert gen.numbered(none).count() == 0 and gen.skips(gen.records(gen.numbered(none)), spark.createDataFrame([("a",)], "key string")).collect()[0].skipped == 0


def test_delete_sample_is_the_smallest_share(spark):
    log = spark.createDataFrame([(i, f"k{i}", 1, "v") for i in range(1000)], LOG)
    for share in (0.0, 0.1, 0.333, 1.0):
        want = sorted(range(1000), key=lambda i: (i * 2654435761 % 4294967296, i))[: int(1000 * share)]
        assert sorted(r.seq for r in workload.delete_sample(log, share).collect()) == sorted(want)


def test_compaction_rewrites_committed_generations(spark, tmp_path):
    s = store(spark, tmp_path, threshold=3)
    s.put({"a": "1", "b": "1", "c": "1"})
    s.put({"a": "2", "d": "1"})
    s.delete("b")
    s.put({"w": "waits"})
    before = {r.key: r.value for r in s.live().collect()}
    assert s.manifest().count() == 2
    s.compact()
    again = store(spark, tmp_path, threshold=3)
    assert again.manifest().count() == 1 and {r.key: r.value for r in again.live().collect()} == before == {"a": "2", "c": "1", "d": "1", "w": "waits"}
    assert {(r.key, r.op) for r in again.tables().collect()} == {("a", 1), ("c", 1), ("d", 1)}
    # later flushes go on from there, and win
    again.put({"a": "3", "x": "1"})
    assert again.manifest().count() == 2 and again.get("a") == "3" and again.get("b") is None
    again.compact()
    assert store(spark, tmp_path, threshold=3).get("a") == "3" and again.manifest().count() == 1
    store(spark, f"{tmp_path}/none").compact()


def test_shared_folder_is_named_or_local(spark):
    from types import SimpleNamespace

    from sediment.shared import shared_dir

    unset = SimpleNamespace(get=lambda *a: None)
    away = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(away)


def test_filters_are_asked_side_by_side(spark):
    """Packed filters over many blocks, several to a byte and to a word, against filters as plain sets; no join of single bits."""
    import numpy as np
    import pyarrow as pa
    from sediment.functions import vectors

    rows = [(g, f"k{(g * 7 + i * 3) % 211}é", 1, "v") for g in range(700) for i in range(3 + g % 9)]
    table = spark.createDataFrame(rows, "generation long, key string, op int, value string")
    asked = [f"k{i}é" for i in range(0, 211, 5)] + [f"miss_{i}" for i in range(60)]
    both = lambda keys: (vectors.fnv(pa.array(keys)), vectors.fnv(pa.array(keys), vectors.SECOND_SEED))
    want = dict.fromkeys(asked, 0)
    for g in range(700):
        mine = [r[1] for r in rows if r[0] == g]
        bits = max(64, 10 * len(mine))
        held = {int(b) for p in vectors.places(*both(mine), bits) for b in p}
        for key, *places in zip(asked, *vectors.places(*both(asked), bits), strict=True):
            want[key] += not all(int(p) in held for p in places)
    for records in (200, 1 << 22):
        got = gen.skips(table, spark.createDataFrame([(k,) for k in [*asked, asked[0]]], "key string"), records)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.key: (r.runs, r.skipped) for r in got.collect()} == {k: (700, np.int64(n)) for k, n in want.items()}


def test_scattered_numbers_never_overflow(spark):
    seqs = [0, 1, 4294967295, 3370000, 8999999 * 1031, 2**62 + 12345, 2**63 - 1, -1, -65537, -(2**40) - 77]
    rows = spark.createDataFrame([(i,) for i in seqs], "i long").select("i", workload.scattered(F.col("i")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: (abs(i) * 2654435761 % 2**32) * (1 if i >= 0 else -1) for i in seqs}
    values = spark.createDataFrame([(8999999,), (4,)], "i long").select("i", workload.random_value(F.col("i"), 0, 64, 5).alias("v")).collect()
    plain = lambda i: i * 2654435761 % 2**32
    assert {r.i: r.v for r in values} == {i: "".join(workload.ALPHABET[(plain(i * 1031 + k * 7 + 5) >> 8) % 62] for k in range(1, plain(i * 31 + 5) % 65 + 1)) for i in (8999999, 4)}


def test_a_flush_is_one_folder_however_many_generations(spark, tmp_path):
    rows = [(s, k, o, v if o == 1 else None) for s, k, o, v in random_log(9, n=600)]
    m = Model(3)
    for _, k, o, v in rows:
        m.apply(k, o, v)
    s = store(spark, tmp_path, threshold=3)
    # what a crash before the commit left, both in this flush's folder and in a folder of a single generation
    for g, more in ((0, {"number": F.lit(1)}), (2, {})):
        spark.createDataFrame([("stray", 1, "stray")], "key string, op int, value string").withColumns(more).write.parquet(f"{s.folder}/generations/generation={g}")
    s.write(spark.createDataFrame(rows[:300], LOG))
    s.write(spark.createDataFrame([(q - 300, k, o, v) for q, k, o, v in rows[300:]], LOG))
    again = store(spark, tmp_path, threshold=3)
    assert {(r.generation, r.key): (r.op, r.value) for r in again.tables().collect()} == {(g, k): x for g, t in enumerate(m.tables) for k, x in t.items()}
    assert len(m.tables) > 100 and len({p.parent for p in (tmp_path / "db" / "generations").rglob("*.parquet")}) <= 3
    again.compact()
    want = {k: m.get(k) for k in {r[1] for r in rows} if m.get(k) is not None}
    assert {r.key: r.value for r in store(spark, tmp_path, threshold=3).live().collect()} == want


def test_a_store_of_folders_of_single_generations_opens(spark, tmp_path):
    s = store(spark, tmp_path)
    spark.createDataFrame([(0, "a", 1, "1"), (1, "b", 1, "1"), (2, "a", 2, None), (3, "w", 1, "waits")], LOG).write.parquet(f"{s.folder}/log")
    spark.createDataFrame([("a", 1, "1", 0), ("b", 1, "1", 0), ("a", 2, None, 1)], "key string, op int, value string, generation long").write.partitionBy("generation").parquet(f"{s.folder}/generations")
    spark.createDataFrame([(0, "000000.sst", 0, 1, None), (1, "000001.sst", 2, 2, None)], "generation long, filename string, first_seq long, last_seq long, replaces long").write.parquet(f"{s.folder}/manifest")
    s.flush()
    assert {r.key: r.value for r in store(spark, tmp_path).live().collect()} == {"b": "1", "w": "waits"} and s.manifest().count() == 3
    s.compact()
    assert {r.key: r.value for r in store(spark, tmp_path).live().collect()} == {"b": "1", "w": "waits"}


@pytest.mark.parametrize(("threshold", "shard"), [(5, False), (60, False), (4, True)])
def test_a_long_log_is_folded_chunk_by_chunk(spark, threshold, shard):
    rows = random_log(11, n=300)
    log = spark.createDataFrame(rows, LOG).withColumn("node", F.when(F.col("key") < "k15", "a").otherwise("b")).repartition(3)
    ends = gen.boundaries(log, threshold, "node" if shard else None, chunk=70)
    got = {r.seq: (r.generation, r.flushed) for r in gen.assigned(log, ends, "node" if shard else None).collect()}
    for side in (True, False) if shard else (None,):
        m, mine = Model(threshold), [r for r in rows if side is None or (r[1] < "k15") == side]
        for _, k, o, v in mine:
            m.apply(k, o, v)
        assert [got[r[0]] for r in mine] == [(g, g < len(m.tables)) for g in m.of]
