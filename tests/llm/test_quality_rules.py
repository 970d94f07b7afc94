import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from sediment.llm import quality_rules as q

from .texts import DOCS, frame, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit), "n_double_words": sum(a == b for a, b in zip(w, w[1:], strict=False))}


def labelled(spark, n=300):
    rows = [(1000 + i, prose(i, 40 + i), "en", "s", 1) for i in range(n)]
    rows += [(5000 + i, re.sub(r"(\w+)", r"\1###", prose(i, 40 + i)), "en", "s", 1) for i in range(60)]
    labels = [(r[0], int(r[0] < 5000), 0) for r in rows] + [(None, 1, 0), (7, None, 0), (999999, 0, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_statistics_match_brute_force(spark):
    rows, labels = labelled(spark)
    rows = odd_rows() + rows[::20]
    got = q.quality_rules(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], tuple(brute(r[1]).values())) for r in rows)
    assert Counter((g.doc_id, tuple(g[k] for k in brute(""))) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert not (g.base_failed and g.kept)


def test_forest_tells_junk_from_clean(spark):
    rows, labels = labelled(spark)
    got = {g.doc_id: g.kept for g in q.quality_rules(frame(spark, rows), labels).collect()}
    clean = [v for k, v in got.items() if k < 5000]
    junk = [v for k, v in got.items() if k >= 5000]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.05


def test_paths_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    trees = [q.grow(x, x.min(0), x.max(0), rng) for _ in range(5)]
    forest = q.Forest(trees, 200, 0.6)

    def walk(tree, row):
        f, cut, left, right, path = tree
        k = 0
        while f[k] >= 0:
            k = left[k] if row[f[k]] < cut[k] else right[k]
        return path[k]

    want = [2 ** (-np.mean([walk(t, r) for t in trees]) / float(q.usual_path(200))) for r in x]
    assert np.allclose(forest.score(x), want)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.quality_rules(spark.createDataFrame([], DOCS), labels).count() == 0
    got = q.quality_rules(spark.createDataFrame([(1, prose(1, 50), "en", "a", 1)], DOCS), labels).collect()
    assert got[0].kept


def test_labels_beyond_twenty_thousand_count(spark):
    n, some = 20_800, [prose(i, 14) for i in range(200)]
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    text = {d: some[d % 200] for d in ids}
    late = ids[-700:]  # good texts of their own kind, the last in the order of hashes
    text |= {d: text[d] + "#" * (12 + d % 5) for d in late}
    junk = range(n, n + 300)
    text |= {d: re.sub(r"(\w+)", r"\1 " + "#" * (5 + d % 7), some[d % 200]) for d in junk}
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in text.items()], DOCS)
    labels = spark.createDataFrame([(d, int(d < n), 0) for d in text], "doc_id long, quality int, toxic int")
    got = {g.doc_id: g for g in q.quality_rules(docs, labels).collect()}
    assert not any(got[d].base_failed for d in late)
    assert np.mean([got[d].kept for d in late]) > 0.97
    assert np.mean([got[d].kept for d in ids]) >= q.KEEP_GOOD
    assert not any(got[d].kept for d in junk)


def test_tasks_grow_the_trees_of_all_rows(spark):
    rng = np.random.default_rng(0)
    stats = pd.DataFrame(rng.integers(0, 40, (400, len(q.NAMES))), columns=q.NAMES).assign(good=rng.integers(0, 3, 400))
    stats["other"] = (stats["good"] == 0).astype(int)
    forest = q.fit(spark.createDataFrame(stats).repartition(7), trees=5)
    x, good, other = q.features(stats), stats["good"].to_numpy(), stats["other"].to_numpy()
    low, high = x.min(0), x.max(0)
    assert forest.sample == good.sum()
    for t, tree in enumerate(forest.trees):
        want = q.grow(x.repeat(good, axis=0), low, high, np.random.default_rng([q.SEED, t]))
        assert all(np.array_equal(a, b) for a, b in zip(tree, want, strict=True))

    without = []
    for i in range(len(x)):
        rest = x.repeat(np.where(np.arange(len(x)) == i, 0, good), axis=0)
        trees = [q.grow(rest, low, high, np.random.default_rng([q.SEED, t])) for t in range(5)]
        without.append(q.Forest(trees, forest.sample, 0).score(x[i : i + 1])[0])
    scores = np.rint(np.array(without) * 1e6)
    values = np.unique(scores)
    cuts = (values[1:] + values[:-1]) / 2e6
    kept = np.array([good[scores / 1e6 < c].sum() / good.sum() for c in cuts])
    caught = np.array([other[scores / 1e6 >= c].sum() / other.sum() for c in cuts])
    best = max((kept + caught)[kept >= q.KEEP_GOOD])
    assert any(abs(forest.threshold - c) < 1e-9 and k >= q.KEEP_GOOD and abs(k + g - best) < 1e-9 for c, k, g in zip(cuts, kept, caught, strict=True))


def test_a_forest_grown_on_other_labels_alone(spark):
    docs = spark.createDataFrame([(i, prose(i, 50), "en", "a", 1) for i in range(20)] + [(5, prose(5, 50), "en", "a", 1)], DOCS)
    labels = spark.createDataFrame([(i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    forest = q.fitted(q.measured(docs), labels)
    assert (forest.sample, forest.threshold) == (11, q.DEFAULT_THRESHOLD)
    assert q.quality_rules(docs, labels).count() == 21


def test_one_giant_word_spoils_no_other_verdict(spark):
    rows, labels = labelled(spark)
    rows = [*rows, (9000, prose(0, 100) + " " + "#" * 300_000, "en", "s", 1)]
    labels = labels.union(spark.createDataFrame([(9000, 0, 0)], labels.schema))
    got = {g.doc_id: g.kept for g in q.quality_rules(frame(spark, rows), labels).collect()}
    assert np.mean([v for k, v in got.items() if k < 5000]) > 0.97
    assert np.mean([v for k, v in got.items() if k >= 5000]) < 0.05
