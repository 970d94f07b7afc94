"""Language ID (operator 8): script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

Model: for every learned language, log probabilities of hashed byte n-grams of words (n = 1 to 4, the word's ends
marked) and the scripts that its letters come from. A word's score is the sum over its n-grams; a language that
doesn't use the word's script is no candidate for it. The best path over the words pays SWITCH for each change of
language; a document's language is the one that labels most of its letters' bytes.

Nulls and odd rows: a null text, or one without a letter, is `und` with score 0 and has no spans; a null doc_id
is neither held out nor learned from; a null lang is not learned from; without anything to learn from, every text
is `und`; repeated rows give repeated results; ties go to the language that sorts first. Whole texts are read.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: First code points of script ranges, and each range's script; 0 is no script (digits, signs).
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "ethiopic", "khmer", "kana", "han", "other")
RANGES = (
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1),
    (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x660, 0), (0x66E, 6), (0x780, 15), (0x900, 7), (0xE00, 8), (0xE80, 15), (0x10A0, 9),
    (0x1100, 10), (0x1200, 11), (0x13A0, 15), (0x1780, 12), (0x1800, 15), (0x1C80, 3), (0x1C90, 9), (0x1CC0, 0), (0x1D00, 1), (0x1DC0, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x2C60, 1), (0x2C80, 15), (0x2DE0, 3), (0x2E00, 0), (0x3041, 13), (0x3100, 14), (0x3130, 10), (0x3190, 0), (0x3400, 14), (0x4DC0, 0), (0x4E00, 14), (0xA000, 15),
    (0xA640, 3), (0xA6A0, 15), (0xA720, 1), (0xA800, 15), (0xAC00, 10), (0xD800, 0), (0xF900, 14), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0),
    (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 13), (0xFFA0, 10), (0xFFE0, 0), (0x10000, 15), (0x1F000, 0), (0x20000, 14), (0xE0000, 0),
)
_FROM = np.array([a for a, _ in RANGES])
_WHICH = np.array([b for _, b in RANGES])
#: Hashed n-grams; a model is BUCKETS x languages.
BUCKETS = 1 << 16
ORDERS = 4
#: Labelled rows of each language that are learned from, at most, taken by hash.
FIT_DOCS = 4_000
#: What a change of language costs, in nats.
SWITCH = 16.0
#: A script counts for a language if it has this share of the language's letters.
SCRIPT_SHARE = 0.001
NO_CANDIDATE = -40.0
#: Bytes of text that are looked at together: every distinct word's n-grams are in memory at once.
SLICE_BYTES = 256 << 10


def letters(data: np.ndarray) -> np.ndarray:
    """At each byte that begins a code point, the letter's script; elsewhere 0."""
    out = np.zeros(len(data), np.uint8)
    ascii_letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    out[ascii_letter] = 1
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        d = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (d[lead + k] for k in range(4))
        point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        out[lead] = _WHICH[np.searchsorted(_FROM, point, "right") - 1]
    return out


@dataclass
class Text:
    """The words of some documents: distinct words' n-grams and scripts, and which word stands where."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    codes: np.ndarray  # of each word: which distinct word
    grams: np.ndarray  # buckets of all distinct words' n-grams, word by word
    gram_first: np.ndarray
    scripts: np.ndarray  # bits, of each distinct word
    n_letters: np.ndarray  # of each distinct word, by script

    @classmethod
    def read(cls, data: np.ndarray, off: np.ndarray) -> Text:
        starts, ends, first = words.spans(data, off)
        codes, uniques = pd.factorize(words.hashes(data, starts, ends))
        at = np.zeros(len(uniques), np.int64)
        at[codes] = np.arange(len(codes))
        s, e = starts[at], ends[at]
        size = e - s + 2  # with a mark on either side
        begin = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        padded = np.full(begin[-1], 0x20, np.uint8)
        real = (inside > 0) & (inside < np.repeat(size, size) - 1)
        place = (np.repeat(s, size) + inside - 1)[real]
        padded[real] = words.LOWER[data[place]]
        script = np.zeros(begin[-1], np.uint8)
        script[real] = letters(data)[place]
        word = np.repeat(np.arange(len(uniques)), size)
        counts = np.bincount(word * len(SCRIPTS) + script, minlength=len(uniques) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
        counts[:, 0] = 0
        bits = ((counts > 0) * (1 << np.arange(len(SCRIPTS)))).sum(axis=1)
        h, grams, owner = np.zeros(len(padded), np.uint64), [], []
        for n in range(1, ORDERS + 1):
            # the hash of n bytes from here on, and only where they stay within one word; single marks say nothing
            h = h[: len(padded) - n + 1] * np.uint64(0x100000001B3) + padded[n - 1 :].astype(np.uint64) + np.uint64(1)
            ok = word[: len(h)] == word[n - 1 :]
            if n == 1:
                ok &= padded != 0x20
            grams.append((words.mix(h[ok] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
            owner.append(word[: len(h)][ok])
        owner_all = np.concatenate(owner)
        order = np.argsort(owner_all, kind="stable")
        return cls(starts, ends, first, codes, np.concatenate(grams)[order], np.searchsorted(owner_all[order], np.arange(len(uniques) + 1)), bits, counts)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # bits of each language

    def word_scores(self, t: Text) -> np.ndarray:
        """Scores of distinct words; 0 for all languages where the word has no letter or no language has its scripts."""
        out = np.zeros((len(t.scripts), len(self.langs)))
        if not len(t.scripts):
            return out
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.table[:, k][t.grams], t.gram_first[:-1]) / ORDERS
        fits = (t.scripts[:, None] & ~self.scripts[None, :]) == 0
        none = (t.scripts == 0) | ~fits.any(axis=1)
        out = np.where(fits, out, out.min(axis=1, keepdims=True) + NO_CANDIDATE)
        out -= out.max(axis=1, keepdims=True)
        out[none] = 0
        return out


def best_paths(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Viterbi: the language of each word that maximises the scores' sum less `switch` for each change, for each document.

    All documents take a step together, the longest first, so that a step is one operation on those not yet at their end.
    """
    order = sorted(range(len(scores)), key=lambda d: -len(scores[d]))
    size = np.array([len(scores[d]) for d in order])
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(scores)
    if not len(size) or not size[0]:
        return [np.zeros(len(s), np.int32) for s in scores]
    k = scores[0].shape[1]
    flat = np.concatenate([scores[d] for d in order])
    begin = np.cumsum(size) - size
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # of each step, how many documents have a word there
    best = flat[begin[: live[0]]].copy()
    back = np.zeros((len(flat), k), np.int32)
    stay = np.arange(k, dtype=np.int32)
    for i in range(1, size[0]):
        n = live[i]
        now = best[:n]
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top] - switch
        move = jump[:, None] > now
        at = begin[:n] + i
        back[at] = np.where(move, top[:, None], stay)
        best[:n] = np.where(move, jump[:, None], now) + flat[at]
    # the ends, and from there back
    path = np.zeros(len(flat), np.int32)
    path[(begin + size - 1)[size > 0]] = best[size[: len(best)] > 0].argmax(axis=1)
    for i in range(size[0] - 1, 0, -1):
        at = begin[: live[i]] + i
        path[at - 1] = back[at, path[at]]
    for d, a, n in zip(order, begin, size, strict=True):
        out[d] = path[a : a + n]
    return out


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    return best_paths([scores], switch)[0]


def one_language(scores: np.ndarray, switch: float) -> int | None:
    """The language of all words, if no change can pay: else None.

    A path's runs in other languages gain at most the largest sum of any run, and k of them cost k changes (k - 1 if
    they fill the path); so nothing can be gained where no run gains more than half a change.
    """
    total = np.cumsum(scores, axis=0)
    top = int(total[-1].argmax())
    gain = total - total[:, top : top + 1]
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain]), axis=0)[:-1], 0)
    return top if (gain - low).max() <= switch / 2 else None


def runs(path: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(path)) + 1
    return list(zip(np.concatenate([[0], edge]).tolist(), np.concatenate([edge, [len(path)]]).tolist(), strict=True))


OUT = "struct<lang:string,score:double,sure:double,spans:array<struct<start:long,stop:long,lang:string>>>"
_OUT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("sure", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])))])


def predict(model: Model, data: np.ndarray, off: np.ndarray, switch: float = SWITCH, with_spans: bool = False) -> list[dict]:
    """Of each document its language, score, how sure its labels are and (start, stop, language) spans in code points.

    score: the share of the letters that the language labels, times how sure it is of them; sure: how sure all
    labels are, each language's by its share, so that a text in several languages isn't taken for an unclear one.
    """
    t = Text.read(data, off)
    per_word = model.word_scores(t) if model.langs else np.zeros((len(t.scripts), 0))
    size = t.n_letters.sum(axis=1)
    plain = np.concatenate([[0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))])
    plain = plain[off[1:]] > plain[off[:-1]]
    docs = len(off) - 1
    out: list[dict] = [{} for _ in range(docs)]
    paths: dict[int, np.ndarray] = {}
    hard = []
    for d in range(docs):
        codes = t.codes[t.first[d] : t.first[d + 1]]
        # the script ranges are coarse: without a letter of A to Z, each character's category decides
        if not model.langs or not plain[d] and not any(c.isalpha() for c in bytes(data[off[d] : off[d + 1]]).decode()):
            out[d] = {"lang": "und", "score": 0.0, "sure": 0.0, "spans": []}
        elif not size[codes].any():  # only letters of no listed script
            out[d] = {"lang": model.langs[0], "score": 1 / len(model.langs), "sure": 1 / len(model.langs), "spans": []}
        elif (whole := one_language(per_word[codes], switch)) is not None:
            paths[d] = np.full(len(codes), whole, np.int32)
        else:
            hard.append(d)
    paths.update(zip(hard, best_paths([per_word[t.codes[t.first[d] : t.first[d + 1]]] for d in hard], switch), strict=True))
    for d, path in paths.items():
        a, b = t.first[d], t.first[d + 1]
        codes = t.codes[a:b]
        weight, s = size[codes], per_word[codes]
        share = np.bincount(path, weights=weight, minlength=len(model.langs))
        lang = int(share.argmax())
        # of each language that labels words: how sure it is of them, against the others
        sure = {}
        for k in np.flatnonzero(share).tolist():
            mine = s[path == k].sum(axis=0)
            sure[k] = 1 / np.exp(np.clip(mine - mine[k], -700, 700)).sum()
        total = weight.sum()
        spans = []
        if with_spans:
            lead = np.cumsum((data[off[d] : off[d + 1]] & 0xC0) != 0x80)
            for i, j in runs(path):
                s0, e0 = t.starts[a + i] - off[d], t.ends[a + j - 1] - off[d]
                spans.append({"start": int(lead[s0]) - 1, "stop": int(lead[e0 - 1]), "lang": model.langs[path[i]]})
        out[d] = {"lang": model.langs[lang], "score": float(share[lang] / total * sure[lang]), "sure": float(sum(share[k] * v for k, v in sure.items()) / total), "spans": spans}
    return out


def held_out():
    return F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False))


def fitted(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model from at most about fit_docs labelled rows of each language that aren't held out.

    The rows are taken by a hash of doc_id and text below a threshold for each language; counts are added up by
    Spark, so that the driver gets languages x (BUCKETS + scripts) numbers at most.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.picked(docs, doc_id="long", text="string", lang="string").where((common.crc_mod("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not have:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0, np.int64))
    langs = sorted(have)
    parts = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, fit_docs / have[k])))])
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11)).cast("double") / float(1 << 53)
    some = rows.where(u < parts[F.col("lang")])
    schema = common.fields("lang string, bucket long, n long")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in common.slices(batches, "text", SLICE_BYTES):
            data, off = common.arrow_bytes(b.column("text"))
            langs_here = b.column("lang").to_pylist()
            for lang in dict.fromkeys(langs_here):
                keep = [i for i, x in enumerate(langs_here) if x == lang]
                part = np.concatenate([data[off[i] : off[i + 1]] for i in keep])
                t = Text.read(part, np.concatenate([[0], np.cumsum([off[i + 1] - off[i] for i in keep])]))
                times = np.bincount(t.codes, minlength=len(t.scripts))
                sums = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                sums[:BUCKETS] += np.bincount(t.grams, weights=np.repeat(times, np.diff(t.gram_first)), minlength=BUCKETS).astype(np.int64)
                sums[BUCKETS:] += (t.n_letters * times[:, None]).sum(axis=0)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield common.batch(schema, lang=[lang] * len(at), bucket=at, n=sums[at])

    got = some.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table, scripts = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs), np.int64)
    for k, lang in enumerate(langs):
        mine = got[got["lang"] == lang]
        c = np.zeros(BUCKETS + len(SCRIPTS))
        c[mine["bucket"].to_numpy(np.int64)] = mine["n"].to_numpy(np.float64)
        total, by_script = max(c[:BUCKETS].sum(), 1), c[BUCKETS:]
        table[:, k] = np.log((c[:BUCKETS] / total + 0.2 / BUCKETS) / 1.2)
        scripts[k] = int(sum(1 << i for i in np.flatnonzero(by_script >= SCRIPT_SHARE * max(by_script.sum(), 1))))
    return Model(langs, table, scripts)


def labeller(spark, model: Model, switch: float = SWITCH, with_spans: bool = False):
    """A column function: OUT of a whole text. The model is at most BUCKETS x languages numbers."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(OUT)
    def run(text: pa.Array) -> pa.Array:
        found = []
        for at, to in common.cuts(text, SLICE_BYTES):
            found += predict(shared.value, *common.arrow_bytes(text.slice(at, to - at)), switch, with_spans)
        return pa.array(found, _OUT)

    return run


def language_id(docs: DataFrame, fit_docs: int = FIT_DOCS, switch: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and spans) for every row of docs."""
    model = fitted(docs, fit_docs)
    rows = common.picked(docs, doc_id="long", text="string")
    found = rows.select("doc_id", labeller(docs.sparkSession, model, switch, with_spans)("text").alias("r"))
    out = found.select("doc_id", held_out().alias("held_out"), F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), *([F.col("r.spans").alias("spans")] if with_spans else []))
    return out


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(common.table(spark, sf_dir, "documents"))


#: The pipeline rejects a document whose language is unknown, or whose labels are less sure than this.
LEAST_SURE = 0.5


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the documents whose language, or each of several, is known, with all their columns."""
    model = fitted(docs)
    name = common.unused(docs, "language")
    judged = docs.withColumn(name, labeller(spark, model)(F.col("text").cast("string")))
    return judged.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.sure") >= LEAST_SURE)).drop(name)


QUERIES = {"op8_language_id": op8_language_id}
