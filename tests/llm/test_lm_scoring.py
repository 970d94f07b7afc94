import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from sediment.llm import common
from sediment.llm import lm_scoring as lm

from .texts import DOCS, frame, odd_rows, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rest(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 7


class Ppm:
    """Plain prediction by partial matching with exclusion, one symbol at a time."""

    def __init__(self, texts):
        self.c = defaultdict(Counter)
        for t in texts:
            s = (0,) * lm.ORDER + tuple(b + 1 for b in t) + (lm.END,)
            for i in range(lm.ORDER, len(s)):
                for k in range(lm.ORDER + 1):
                    self.c[s[i - k : i]][s[i]] += 1

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(lm.ORDER, -1, -1):
            seen = self.c.get(context[len(context) - k :], {})
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out * left[symbol] / total
            if total:
                out *= len(left) / total
            excluded = set(seen)
        return out / max(lm.ALPHABET - len(excluded), 1)

    def score(self, t):
        s = (0,) * lm.ORDER + tuple(b + 1 for b in t) + (lm.END,)
        return sum(math.log10(self.p(s[i - lm.ORDER : i], s[i])) for i in range(lm.ORDER, len(s)))


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    train = [t for i, t in raw if rest(i) not in (None, 2)]
    counts = Counter(w for t in train for w in WORD.findall(t.lower()))
    counts[None] = len(train)
    counts += Counter()
    n, v = sum(counts.values()), len(counts)
    ppm = Ppm(train)
    out = []
    for i, t in raw:
        tokens = [*WORD.findall(t.lower()), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, rest(i) == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6), round(ppm.score(t), 6)))
    return out


def scored(df, **more):
    r = common.crc_mod("doc_id", 7)
    got = lm.lm_scoring(df, r != 2, r == 2, **more).collect()
    return [(g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), round(g.score, 6)) for g in got]


def near(a, b):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:], abs=1e-4)


def test_matches_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 9] + [(100 + i, prose(i, 30) + " ÀÉ中 ", "en", "a", 1) for i in range(30)]
    want = brute(rows)
    near(scored(frame(spark, rows), chunk_bytes=2000), want)
    near(scored(frame(spark, rows), chunk_bytes=2000, most_tasks=2), want)


def test_probabilities_add_up():
    ppm = Ppm([b"abracadabra", b"banana band"])
    for context in ((0, 0, 0, 0), (98, 99, 115, 98), (1, 2, 3, 4), (98, 111, 98, 111)):
        assert sum(ppm.p(context, s) for s in range(1, 258)) == pytest.approx(1, abs=0.02)


def test_nothing_to_learn_from(spark):
    rows = [(1, "abc", "en", "a", 3), (2, None, "en", "a", 0)]
    got = lm.lm_scoring(frame(spark, rows), F.lit(False), F.lit(True)).collect()
    assert {(g.doc_id, g.n_tokens, g.n_known, g.train_tokens) for g in got} == {(1, 2, 0, 0), (2, 1, 0, 0)}
    assert {round(g.score, 6) for g in got} == {round(-4 * math.log10(257), 6), round(-math.log10(257), 6)}
    assert scored(spark.createDataFrame([], DOCS)) == []
