import random
import zlib

import numpy as np
from sediment.llm import language_id as li

from .texts import DOCS, frame, odd_rows

PARTS = {
    "en": "the of and to ing tion er re on at th wh sh ou ha".split(),
    "es": "el de la ción mente ado que os as es ña ía rr ll co".split(),
    "ru": "и не на что он как это по но они мы ст пр ов ен".split(),
}


def text(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows(n=120):
    return [(i, text(lang, i), lang, "s", 1) for i, lang in enumerate(list(PARTS) * (n // 3))]


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows() + [(1000 + r[0] if r[0] else None, r[1], None, r[3], r[4]) for r in odd_rows()]
    got = li.language_id(frame(spark, data)).collect()
    assert len(got) == len(data)
    truth = {r[0]: r[2] for r in rows()}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert held and np.mean([g.lang_pred == truth[g.doc_id] for g in held]) > 0.97
    for g in got:
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
        assert 0 <= g.score <= 1
    by = {g.doc_id: g.lang_pred for g in got}
    assert by[1001] == by[1002] == by[1003] == "und" and by[1004] != "und"


def test_spans_of_mixed_text(spark):
    first, second = text("en", 900, 40), text("ru", 901, 40)
    mixed = f"{first}\n{second}"
    got = li.language_id(frame(spark, rows() + [(5, mixed, None, "s", 1)]), with_spans=True).where("doc_id = 5 and size(spans) > 1").collect()
    spans = [(s.start, s.stop, s.lang) for s in got[0].spans]
    assert [x[2] for x in spans] == ["en", "ru"]
    assert mixed[spans[0][0] : spans[0][1]] == first and mixed[spans[1][0] : spans[1][1]] == second


def test_short_cut_agrees_with_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(size=(rng.integers(1, 7), 3)) * 3
        path = li.best_path(s, 2.0)

        def value(p):
            return sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))

        best = max(value(p) for p in np.ndindex(*[3] * len(s)))
        assert abs(value(path) - best) < 1e-9
        whole = li.one_language(s, 2.0)
        if whole is not None:
            assert abs(value([whole] * len(s)) - best) < 1e-9


def test_nothing_to_learn_from(spark):
    got = li.language_id(spark.createDataFrame([(1, "some text", None, "a", 1)], DOCS)).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)
    assert li.language_id(spark.createDataFrame([], DOCS)).count() == 0


def test_letters_decide_on_und(spark):
    texts = {1: "123 ... !?", 2: "\u0967\u0968 \u060c", 3: "\u05d0", 4: "\u02b0", 5: "\u0e01\u0e02", 6: "a", 7: "\U0001f600", 8: "\u0301"}
    got = {g.doc_id: g.lang_pred for g in li.language_id(frame(spark, rows() + [(100000 + k, t, None, "s", 1) for k, t in texts.items()])).where("doc_id > 100000").collect()}
    for k, t in texts.items():
        assert (got[100000 + k] != "und") == any(c.isalpha() for c in t), t


def test_documents_together_as_each_alone():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5):
        docs = [rng.normal(size=(n, k)) * 3 for n in [0, 1, 7, 300, 2, 2, 0, 41, 7]]
        for got, s in zip(li.best_paths(docs, 4.0), docs, strict=True):
            best = s[0].copy() if len(s) else None
            for row in s[1:]:
                best = np.maximum(best, best.max() - 4.0) + row
            assert len(got) == len(s)
            if len(s):
                value = sum(s[i, x] for i, x in enumerate(got)) - 4.0 * (np.diff(got) != 0).sum()
                assert abs(value - best.max()) < 1e-9


def test_word_scores_by_hand():
    """A word's score: the mean over n of its n-grams' log probabilities, its ends marked; other scripts are no candidates."""
    rng = np.random.default_rng(2)
    model = li.Model(["aa", "bb", "cc"], rng.normal(size=(li.BUCKETS, 3)), np.array([1 << 1, 1 << 1, 1 << 3]))
    text = "Ab cde \u0434\u0430 42 ab"
    data = np.frombuffer(text.encode(), np.uint8)
    t = li.Text.read(data, np.array([0, len(data)]))
    got = model.word_scores(t)[t.codes]
    for word, row in zip(text.split(), got, strict=True):
        raw = b" " + word.encode().lower() + b" "
        want = np.zeros(3)
        for n in range(1, li.ORDERS + 1):
            for i in range(len(raw) - n + 1):
                gram = raw[i : i + n]
                if gram == b" ":
                    continue
                h = 0
                for c in gram:
                    h = (h * 0x100000001B3 + c + 1) % (1 << 64)
                bucket = int(li.words.mix(np.array([(h + n) % (1 << 64)], np.uint64))[0]) % li.BUCKETS
                want += model.table[bucket] / li.ORDERS
        if word == "42":
            want[:] = 0
        else:
            fits = np.array([True, True, False]) if word.isascii() else np.array([False, False, True])
            want = np.where(fits, want, want.min() + li.NO_CANDIDATE)
            want -= want.max()
        assert np.allclose(row, want), word


def test_stage_keeps_text_in_several_languages(spark):
    mixed = "\n".join(text(lang, 700 + i, 30) for i, lang in enumerate(PARTS))
    docs = frame(spark, rows() + [(50_001, mixed, None, "s", 1), (50_002, "1 2 3", None, "s", 1)])
    got = {r.doc_id for r in li.stage(spark, docs, None).where("doc_id > 50000").collect()}
    assert got == {50_001}
