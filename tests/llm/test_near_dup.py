import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sediment.llm import common
from sediment.llm import near_dup as nd
from sediment.llm.components import components

from .texts import DOCS, frame, odd_rows, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, size, component) of each row, by all pairs."""
    s = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                both = len(s[i] & s[j])
                if 100 * both >= 85 * (len(s[i]) + len(s[j]) - both):
                    parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(s[i]), min(ids) if ids else None))
    return out


def edited(text, seed, n):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.random()}"
    return " ".join(w)


def corpus():
    rows = odd_rows()
    k = 100
    for base in range(25):
        text = prose(base, 80 + 13 * base)
        for j in range(8):  # from copies to texts past the threshold on either side
            rows.append((k, edited(text, k, j if base % 2 else j // 3) if j else text.upper().swapcase(), "en", "s", 1))
            k += 1
    chain = prose(77, 200)
    for _ in range(12):
        chain = edited(chain, k, 1)
        rows.append((k, chain, "en", "s", 1))
        k += 1
    rows += [(k + i, prose(500 + i, 60) + "\nReleased under the MIT License.", "en", "s", 1) for i in range(40)]
    return rows


def test_components_match_all_pairs(spark):
    rows = corpus()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_dup(frame(spark, rows).repartition(3)).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_stage_keeps_one_row_of_each_group(spark):
    rows = corpus()
    docs = frame(spark, rows)
    docs.write.mode("overwrite").parquet(path := nd.common.shared_path(spark, "stage-test"))
    kept = nd.stage(spark, spark.read.parquet(path), None)
    assert kept.columns == docs.columns
    want = {}
    for (i, n, c), row in zip(brute(rows), rows, strict=True):
        group = ("empty", len(want)) if not n else c
        if n and (group not in want or want[group] is None):
            want[group] = i
        elif not n:
            want[group] = i
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    expect = sorted((i is None, i or 0) for i in ([c if c is not None else i for c, i in want.items() if not isinstance(c, tuple)] + [i for c, i in want.items() if isinstance(c, tuple)]))
    assert got == expect


def test_pipeline_drops_copies_from_080(spark):
    """Pairs of 0.80 to under 0.85 go in the pipeline, those under 0.80 stay."""
    from corpus_pipeline import STAGES

    rows, gone, between = [], set(), 0
    for k in range(40):
        one = prose(3000 + k, 120).split(" ")
        two = list(one)
        for j in range(2 + k % 2):
            two[20 + 30 * j] = f"other{j}"
        rows += [(2 * k, " ".join(one), "en", "s", 1), (2 * k + 1, " ".join(two), "en", "s", 1)]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if 100 * len(a & b) >= 80 * len(a | b):
            gone.add(2 * k + 1)
            between += 100 * len(a & b) < 85 * len(a | b)
    assert between >= 15 and len(gone) < 40
    kept = {r.doc_id for r in dict(STAGES)["MinHash near-dedup"](spark, frame(spark, rows), None).collect()}
    assert kept == {r[0] for r in rows} - gone


def test_hot_group_of_near_copies(spark):
    text = prose(9, 300)
    rows = [(i, edited(text, i, i % 4), "en", "s", 1) for i in range(600)] + [(1000 + i, prose(2000 + i, 50), "en", "s", 1) for i in range(300)]
    got = {r.doc_id: r.component_id for r in nd.near_dup(frame(spark, rows)).collect()}
    assert {got[i] for i in range(600)} == {0} and all(got[1000 + i] == 1000 + i for i in range(300))


def test_links_in_a_large_unlinked_region(spark):
    """3000 texts on one template are not linked (overlap 0.76), but planted pairs among them are (0.87)."""
    words = prose(9, 150).split(" ")

    def filled(fields):
        w = list(words)
        for k, f in enumerate(fields):
            w[20 + 36 * k] = f
        return " ".join(w)

    fields = [[f"f{i}x{k}" for k in range(4)] for i in range(3000)]
    for i in range(0, 600, 2):
        fields[i + 1][:2] = fields[i][:2]
    rows = [(i, filled(f), "en", "s", 1) for i, f in enumerate(fields)]
    a, b, c = (shingles(rows[i][1]) for i in (0, 1, 2))
    assert 100 * len(a & b) >= 85 * len(a | b) and 100 * len(a & c) < 80 * len(a | c)
    got = {r.doc_id: r.component_id for r in nd.near_dup(frame(spark, rows)).collect()}
    assert got == {i: i - 1 if i < 600 and i % 2 else i for i in range(3000)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(400, j) for j in range(401, 500)] + [(5, 5)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_empty_table(spark):
    assert nd.near_dup(spark.createDataFrame([], DOCS)).count() == 0
    one = nd.near_dup(spark.createDataFrame([(None, "a b c d e f", None, None, None)], DOCS).withColumn("x", F.lit(1))).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in one] == [(None, 2, None, True)]


def test_sets_of_one_node_are_told_apart(spark):
    rows = [(1, 0, 5, 3, 77, 1, b"a"), (2, 0, 6, 3, 77, 2, b"b"), (3, 0, 5, 3, 77, 1, b"a"), (4, 0, 7, 3, 78, 3, b"c"), (5, 0, 8, 0, 0, 0, None), (6, 0, 9, 0, 0, 4, None)]
    got = {r.doc_id: r.node for r in nd.apart(common.written(spark.createDataFrame(rows, nd.SIGNED), "signed")).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 78 and got[5] == got[6] == 0 and len({got[1], got[2], got[4]}) == 3


def test_hot_regions_join_without_a_shuffle(spark):
    left = common.written(spark.range(4000).selectExpr("case when id % 2 = 0 then -1 else id end as k", "id"), "left")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k < 3000")
    got = Counter((r.k, r.id, r.n) for r in common.hot_join(left, right, "k", "n", 4000).collect())
    assert got == Counter((k, i, 2000 if k < 0 else 1) for i in range(4000) for k in [-1 if i % 2 == 0 else i] if k < 3000)
