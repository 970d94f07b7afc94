import pytest
from pyspark.sql import functions as F
from sediment.functions import bloom, hashing, vectors
from sediment.operators import ring

M = (1 << 64) - 1


def fnv(b: bytes, seed: int = 0) -> int:
    h = 1469598103934665603 ^ seed
    for x in b:
        h = (h ^ x) * 1099511628211 & M
    return h


def mix(h: int) -> int:
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & M
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & M
    return h ^ h >> 33


KEYS = ["", "k", "héllo", "compute-1", "日本", "a" * 300, "\x00\x7f", *(f"key_{i}" for i in range(300))]


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([(k,) for k in KEYS], "key string")


def test_hashes(keys):
    key = F.col("key")
    rows = keys.select("key", hashing.digits(hashing.fnv1a(key)).alias("a"), hashing.digits(hashing.fnv1a(key, hashing.SECOND_SEED)).alias("b"), hashing.digits(hashing.avalanche(hashing.fnv1a(key))).alias("c")).collect()
    for r in rows:
        raw = r.key.encode()
        assert (int(r.a), int(r.b), int(r.c)) == (fnv(raw), fnv(raw, 0x9E3779B97F4A7C15), mix(fnv(raw)))


def test_known_values(keys):
    assert fnv(b"k") == 4953274407327736632 and mix(fnv(b"k")) == 13098074211010441640
    assert fnv("héllo".encode()) == 12315290374884196742 and mix(fnv(b"compute-3")) == 2488380376969712990


@pytest.mark.parametrize("bits", [64, 1000, 999983])
def test_probes(keys, bits):
    for r in keys.select("key", bloom.probes(F.col("key"), F.lit(bits)).alias("p")).collect():
        a, b = fnv(r.key.encode()), fnv(r.key.encode(), 0x9E3779B97F4A7C15)
        assert r.p == [(a + i * b & M) % bits for i in range(5)]


def test_filter_sizes_and_false_positives(spark):
    sizes = spark.createDataFrame([(0,), (1,), (1000,)], "n long").select(bloom.size(F.col("n")).alias("b"))
    assert [r.b for r in sizes.collect()] == [64, 64, 10000]
    n = 3000
    bits = F.lit(10 * n)
    held = spark.range(n).select(F.concat(F.lit("present_"), F.col("id")).alias("key"))
    gone = spark.range(n).select(F.concat(F.lit("absent_"), F.col("id")).alias("key"))
    probes = lambda df: {r.key: set(r.p) for r in df.select("key", bloom.probes(F.col("key"), bits).alias("p")).collect()}
    on = set().union(*probes(held).values())
    assert all(p <= on for p in probes(held).values())
    assert sum(p <= on for p in probes(gone).values()) < 0.05 * n


def test_ring(spark):
    nodes = ["compute-1", "compute-2", "compute-3"]
    asked = spark.range(5000).select(F.concat(F.lit("sample_key_"), F.col("id")).alias("key"))
    found = {r.key: r.node for r in ring.routed(asked, nodes).collect()}
    points = sorted((mix(fnv(n.encode())), n) for n in nodes)
    for key, node in found.items():
        h = mix(fnv(key.encode()))
        assert node == next((n for p, n in points if p >= h), points[0][1])
    assert set(found.values()) == set(nodes)
    assert {r.node for r in ring.routed(asked, []).collect()} == {None}
    assert {r.node for r in ring.routed(asked, ["only"]).collect()} == {"only"}
    counts = {r["node"]: r["keys"] for r in ring.load(spark.range(60).select(F.concat(F.lit("leader_test_key_"), F.col("id")).alias("key")), nodes).collect()}
    assert counts == {"compute-1": 4, "compute-2": 13, "compute-3": 43}


def test_node_lists(spark):
    specs = ["a:h:1,b:h:65537", "a:h:1,b", "a:h:x", "", "a:h:1,,"]
    got = ring.parse_nodes(spark.createDataFrame([(s,) for s in specs], "spec string")).collect()
    assert sorted((r.spec, r.n, r.node, r.host, r.port) for r in got) == [("a:h:1,,", 0, "a", "h", 1), ("a:h:1,b:h:65537", 0, "a", "h", 1), ("a:h:1,b:h:65537", 1, "b", "h", 1)]


def test_vectors_agree_with_expressions(keys, spark):
    key = F.col("key")
    bits = F.lit(999983)
    df = keys.unionByName(spark.createDataFrame([("x" * 5000,), ("",)], "key string")).repartition(2)
    rows = df.select(
        hashing.fnv1a(key).alias("a"), vectors.fnv1a(key).alias("b"),
        hashing.fnv1a(key, hashing.SECOND_SEED).alias("c"), vectors.fnv1a(key, hashing.SECOND_SEED).alias("d"),
        hashing.avalanche(hashing.fnv1a(key)).alias("e"), vectors.position(key).alias("f"),
        bloom.probes(key, bits).alias("g"), vectors.probes(key, bits).alias("h"),
    ).collect()
    assert len(rows) == len(KEYS) + 2 and all((r.a, r.c, r.e, r.g) == (r.b, r.d, r.f, r.h) for r in rows)
