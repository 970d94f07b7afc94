import numpy as np
import pytest
from pyspark.sql import functions as F
from sediment.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(10, d))
    x = centres[r.integers(0, 10, n)] + r.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def exact(ids, x, k):
    out = {}
    x = x.astype(np.float64)
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize(("n", "d"), [(3000, 64), (400, 7)])
def test_recall_and_scores(spark, n, d):
    x, ids = vectors(n, d), np.arange(n)
    got = ann.nearest(spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], SCHEMA), F.col("vec_id") % 20 == 0).collect()
    want = exact(ids, x, 20)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(want) and all(len(v) == 20 for v in by.values())
    hits = sum(len({a for a, _ in by[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    y = x.astype(np.float64)
    for q, v in by.items():
        for a, s in v:
            assert s == pytest.approx(float(y[q] @ y[a]), abs=1e-12)
        assert [(-s, a) for a, s in v] == sorted((-s, a) for a, s in v)


def test_odd_rows(spark):
    x = vectors(60, 4)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(100, None, 0), (120, [0.0] * 4, 0), (140, [1.0, None, 0.0, 0.0], 0), (160, [float("nan"), 0.0, 0.0, 1.0], 0), (180, [float("inf"), 0.0, 0.0, 1.0], 0), (None, [1.0, 0.0, 0.0, 0.0], 0), (200, [1.0], 0), (220, [], 0), (5, x[5].tolist(), 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("query_id", F.lit(1)).withColumn("codes", F.lit(2))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and {r.vec_id for r in got} <= set(range(60))
    assert len({(r.query_id, r.vec_id) for r in got}) == len(got) == 60


def test_ties_go_to_smaller_ids(spark):
    same = [0.6, 0.8]
    got = ann.nearest(spark.createDataFrame([(i, same, 0) for i in range(500)], SCHEMA), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q, v in by.items():
        assert [v[k] for k in range(1, 21)] == [i for i in range(22) if i != q][:20]


def test_few_and_none(spark):
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.0)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_codes_lower_the_anisotropic_loss():
    x = vectors(2000, 64).astype(np.float64)
    model = ann.fit(x, 4)
    part = model.assigned(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def loss(codes, eta):
        back = model.centres[part] + model.book[np.arange(model.pairs), codes].reshape(len(x), -1)
        e = back - x
        return ((e**2).sum(axis=1) + (eta - 1) * (e * unit).sum(axis=1) ** 2).mean()

    plain = ann.code_rows(x, model.centres[part], model.book, 1.0, 0)
    aware = model.coded(x, part)
    assert model.eta > 1 and loss(aware, model.eta) < loss(plain, model.eta)
    q = x[:5]
    back = model.book[np.arange(model.pairs), aware].reshape(len(x), -1)
    assert np.allclose(ann.scanned(model.tables(q), ann.packed(aware)), q @ back.T, atol=1e-4)


def test_recall_in_a_tight_cluster(spark):
    r = np.random.default_rng(7)
    x = vectors(3000, 64, 5)
    x[::3] = x[0] + 0.01 * r.normal(size=x[::3].shape)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(len(x))
    got = {}
    for g in ann.nearest(spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    want = exact(ids, x, 20)
    recall = [len(got[q] & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(recall) >= 0.95 and np.mean([v for q, v in zip(want, recall, strict=True) if q % 3 == 0]) >= 0.95


def test_doubles_are_kept(spark):
    """Components that single precision can't tell apart, or can't hold, decide the order and come out in the scores."""
    rng = np.random.default_rng(8)
    for scale in (1.0, 1e150, 1e-150):
        v = rng.normal(size=(120, 6)) * scale
        v[1::2] = v[::2] * (1 + 1e-10)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
        want = []
        for i in range(0, 120, 20):
            s = (v * v[i]).sum(axis=1)
            others = sorted((j for j in range(120) if j != i), key=lambda j: (-s[j], j))[:5]
            want += [(i, k + 1, j, s[j]) for k, j in enumerate(others)]
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
