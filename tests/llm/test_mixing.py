import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from sediment.llm import mixing as m

from .texts import DOCS, frame, odd_rows


def rows():
    out = odd_rows()
    for k, (source, n) in enumerate({"hot": 300, "b": 40, "c": 41, "d": 7, "=x": 3, None: 20}.items()):
        out += [(1000 * (k + 1) + i, f"t{i}", "en", source, 1) for i in range(n)]
    return out


def brute(data, block, weights=None):
    """The mix by hand: at each slot, of the released blocks that of the earliest deadline. Weights are fractions."""
    by = defaultdict(list)
    for r in data:
        by[r[3]].append(r[0])
    names = sorted(by, key=lambda s: (s is not None, s or ""))
    for s in names:
        by[s].sort(key=lambda i: (hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0))
    w = [Fraction(weights[s] if weights else math.floor(1e6 * len(by[s]) / math.sqrt(math.sqrt(len(by[s]))))) for s in names]
    w = [x / sum(w) for x in w]
    done, out, slot = [0] * len(names), Counter(), 0
    while any(d * block < len(by[s]) for d, s in zip(done, names, strict=True)):
        ready = [(math.ceil((d + 1) / x), i) for i, (d, x) in enumerate(zip(done, w, strict=True)) if math.floor(d / x) <= slot]
        deadline, i = min(ready)
        assert slot < deadline
        for place in range(block):
            at = done[i] * block + place
            own = by[names[i]]
            out[(own[at % len(own)], names[i], at // len(own), slot, place)] += 1
        done[i] += 1
        slot += 1
        for d, x in zip(done, w, strict=True):
            assert abs(d - slot * x) < 1  # less than one block off, at every slot
    return out


@pytest.mark.parametrize("block", [8, 1, 3])
def test_mix_matches_a_plain_schedule(spark, block):
    docs = frame(spark, rows()).repartition(3)
    got = m.mixed(docs, block=block)
    assert got.select("doc.*").columns == docs.columns
    assert Counter((r.doc.doc_id, r.source, r.epoch, r.slot, r.place) for r in got.collect()) == brute(rows(), block)


def test_blocks_grow_so_that_their_number_is_bounded(spark):
    docs = frame(spark, rows()).repartition(3)
    got = m.mixed(docs, block=1, most_blocks=50).collect()
    assert Counter((r.doc.doc_id, r.source, r.epoch, r.slot, r.place) for r in got) == brute(rows(), -(-len(rows()) // 50))


def test_true_weights_over_millions_of_slots():
    """Thirds that differ by under a thousandth, a very small weight, unequal others: under one block off everywhere."""
    third = 1 / 3
    weights = [third, third + 0.0004, third - 0.0004 - 1e-6, 1e-6]
    share = m.exact(weights)
    total = sum(map(Fraction, weights))
    assert [Fraction(s, sum(share)) for s in share] == [Fraction(w) / total for w in weights]
    slots = m.schedule(share, [1, 700_000, 1, 2])
    n = sum(map(len, slots))
    assert n > 1_900_000 and sorted(np.concatenate(slots).tolist()) == list(range(n))
    for s, own in zip(share, slots, strict=True):
        at = np.asarray(own, np.float64)
        j, w = np.arange(len(own)), s / sum(share)
        # before and after each block; a hair for floating point
        assert (np.abs(j - at * w) < 1 + 1e-6).all() and (np.abs(j + 1 - (at + 1) * w) < 1 + 1e-6).all()


def test_given_weights(spark):
    data = [(i, "t", "en", "a" if i < 90 else "b", 1) for i in range(100)]
    got = m.mixed(frame(spark, data), {"a": 1.0, "b": 1.0}, block=1).collect()
    n = Counter(r.source for r in got)
    assert n["a"] == 90 and abs(n["b"] - 90) <= 1 and len({r.doc.doc_id for r in got}) == 100
    with pytest.raises(ValueError, match="no target weight"):
        m.mixed(frame(spark, data), {"a": 1.0})
    with pytest.raises(ValueError, match="positive"):
        m.mixed(frame(spark, data), {"a": 1.0, "b": 0.0})


@pytest.mark.parametrize(("sources", "slots"), [(20, 20_000), (1200, 5_000)])
def test_mix_holds_the_true_weights(spark, sources, slots):
    """Less than one block off the target weights themselves (up to their rounding) at every slot, past any period."""
    w = [1 + 3 * (i == 0) + i % 7 / 9 for i in range(sources)]
    w = [x / math.fsum(w) for x in w]
    data = [(i, "t", "en", f"s{k:04}", 1) for i, k in enumerate([0] * math.ceil(w[0] * slots) + list(range(1, sources)))]
    got = m.mixed(frame(spark, data).select("doc_id", "source"), {f"s{k:04}": x for k, x in enumerate(w)}, block=1).select("source", "slot").collect()
    order = [s for _, s in sorted((r.slot, r.source) for r in got)]
    assert len(order) >= slots - 2 * sources and sorted(r.slot for r in got) == list(range(len(order)))
    done = Counter()
    for slot, s in enumerate(order):
        before = done[s]
        done[s] += 1
        k = int(s[1:])
        assert abs(before - slot * w[k]) < 1 + 1e-6 and abs(done[s] - (slot + 1) * w[k]) < 1 + 1e-6


def test_stage_keeps_columns_and_every_document(spark):
    docs = frame(spark, rows()).withColumn("slot", F.lit("clash"))
    got = m.stage(spark, docs, None)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r[0] for r in rows()}


def test_empty_table(spark):
    assert m.mixed(spark.createDataFrame([], DOCS)).count() == 0 and m.stage(spark, spark.createDataFrame([], DOCS), None).columns == DOCS.names
