"""Quality rules (operator 5): an isolation forest on rule statistics.

Every text gets rule statistics in one vectorised pass; a base rule rejects short and repetitive texts. Trees of
random splits count the statistics of all good labelled rows; a text that few random splits separate from them has a
short path and is an anomaly. The threshold on the anomaly score is calibrated on all labelled rows, each scored as if
the trees had been grown without it. Labelled rows that fail the base rule take part in neither.

Splits are uniform in the box of all labelled rows and look at no row below it, so that every task draws the same ones
and counts its own rows; only counts of cells (at most TREES x 2^DEPTH) and of scores (in millionths) reach the driver.

Nulls and odd rows: a null or empty text has no words and fails the base rule; a null doc_id is kept as null;
repeated rows give repeated results; labels with null doc_id, null quality or for unknown documents are not used;
a document that has several labels counts once for each. Without both kinds of label, the threshold is
DEFAULT_THRESHOLD; without any statistics to fit on, nothing but the base rule rejects. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: A tree has at most DEPTH levels of splits; how many rows share a last cell is counted, and lengthens its path.
TREES, DEPTH, SEED = 100, 14, 5
#: The usual cut of an isolation score, where there are no labels to calibrate on.
DEFAULT_THRESHOLD = 0.6
#: Good labelled rows that the threshold must keep.
KEEP_GOOD = 0.995
#: What random splits are drawn on: the base statistics and doubled words, each for its text's words.
FEATURES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_double_words")
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_double_words")
RULES = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_double_words:long,score:double>"


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The rule statistics of each of the documents that lie one after another in data."""
    docs = len(off) - 1
    out = {"n_symbols": per_doc(SYMBOLS[data], off)}
    starts, ends, first = words.spans(data, off)
    n_words = np.diff(first)
    out["n_words"] = n_words
    point = (data & 0xC0) != 0x80
    out["word_chars"] = per_doc(point & ~words.SPACE[data], off)
    own = np.repeat(np.arange(docs), n_words)
    salt = words.mix(np.arange(1, docs + 1, dtype=np.uint64))

    # lines: cut at \n and at document ends; only those with a word count
    cuts = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([off[:-1], cuts + 1]), kind="stable")
    line_doc = np.searchsorted(off[1:], line_start, "right")
    stop = np.concatenate([line_start[1:] - 1, [len(data)]]) if len(line_start) else line_start
    last = np.append(line_doc[1:] != line_doc[:-1], True) if len(line_start) else np.zeros(0, bool)
    ok = line_doc < docs
    line_start, line_doc, stop, last = line_start[ok], line_doc[ok], stop[ok], last[ok]
    stop = np.where(last, off[1:][line_doc], stop)
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, line_start)
    line_start, line_doc, stop = line_start[has], line_doc[has], stop[has]
    key = words.hashes(data, line_start, stop) ^ salt[line_doc]
    codes, uniques = pd.factorize(key)
    owner = np.zeros(len(uniques), np.int64)
    owner[codes] = line_doc
    out["n_dup_lines"] = np.bincount(line_doc, minlength=docs) - np.bincount(owner, minlength=docs)

    h = words.hashes(data, starts, ends)
    w = words.windows(h, 5)
    inside = np.flatnonzero(own[: len(w)] == own[4 : 4 + len(w)]) if len(w) else np.zeros(0, np.int64)
    codes, uniques = pd.factorize(w[inside] ^ salt[own[inside]])
    again = inside[np.bincount(codes, minlength=len(uniques))[codes] > 1]
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 5, -1)
    covered = np.cumsum(edge)[: len(h)] > 0
    out["n_repeat_words"] = np.bincount(own[covered], minlength=docs)
    double = (h[1:] == h[:-1]) & (own[1:] == own[:-1]) if len(h) else np.zeros(0, bool)
    out["n_double_words"] = np.bincount(own[1:][double], minlength=docs)
    return out


def rules(model: Forest | None = None):
    """A column function: the statistics of a whole text, and its isolation score under a model (else 0)."""

    @F.arrow_udf(RULES)
    def run(text: pa.Array) -> pa.Array:
        parts = []
        for at, to in common.cuts(text):
            stats = statistics(*common.arrow_bytes(text.slice(at, to - at)))
            score = model.score(features(pd.DataFrame({k: stats[k] for k in NAMES}))) if model else np.zeros(to - at)
            parts.append(pa.StructArray.from_arrays([*(pa.array(stats[k], pa.int64()) for k in NAMES), pa.array(score)], [*NAMES, "score"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([*((k, pa.int64()) for k in NAMES), ("score", pa.float64())]))

    return run


def features(stats: pd.DataFrame) -> np.ndarray:
    """s / (1 + s) of the square root s of each statistic per word; ten words more keep the rates of short texts from jumping.

    As all are under 1, no row, however odd, makes a box in which the others lie in one corner.
    """
    n = stats["n_words"].to_numpy(np.float64) + 10
    roots = np.sqrt(np.stack([stats[c].to_numpy(np.float64) / n for c in FEATURES], axis=1))
    return roots / (1 + roots)


def usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """trees: arrays (feature or -1 at a leaf, cut, left, right, path length at the leaf).

    leaves, for left_out: arrays (rows at the node, its level, the level at which a row that is all there would be missed).
    """

    trees: list[tuple[np.ndarray, ...]]
    sample: int
    threshold: float
    leaves: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def ends(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of each row, tree by tree."""
        rows = np.arange(len(x))
        for feature, cut, left, right, _ in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                at = np.where(inner, np.where(x[rows, feature[at]] < cut[at], left[at], right[at]), at)
            yield at

    def anomaly(self, total: np.ndarray) -> np.ndarray:
        return np.exp2(-total / len(self.trees) / max(float(usual_path(self.sample)), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / usual path): near 1 for anomalies, under 0.5 for ordinary rows."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for (*_, path), at in zip(self.trees, self.ends(x), strict=True):
            total += path[at]
        return self.anomaly(total)

    def left_out(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The score of each row by trees that had not counted it; own: how many times they have."""
        total = np.zeros(len(x))
        for (count, level, missed), at in zip(self.leaves, self.ends(x), strict=True):
            others = count[at] - own
            total += np.where((others > 0) | (own == 0), level[at] + usual_path(others), missed[at])
        return self.anomaly(total)


def levels(rows: int, low: np.ndarray, high: np.ndarray) -> int:
    """Levels of splits for so many rows in a box."""
    return min(DEPTH, int(np.ceil(np.log2(max(rows, 2)))) + 2) if (high > low).any() else 0


def splits(low: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Features and cuts of all nodes above the last level: at each a random feature, and a uniform cut of the node's box.

    Node 1 is the root, nodes 2k and 2k + 1 lie below and above the cut of node k.
    """
    feature, cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    wide = np.flatnonzero(high > low)
    low, high = low[None], high[None]
    for level in range(depth):
        k = 1 << level
        i, f = np.arange(k), rng.choice(wide, k)
        c = rng.uniform(low[i, f], high[i, f])
        feature[k : 2 * k], cut[k : 2 * k] = f, c
        low, high = low.repeat(2, axis=0), high.repeat(2, axis=0)
        high[2 * i, f] = low[2 * i + 1, f] = c
    return feature, cut


def cells(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The place of each row among the nodes of the last level."""
    at, rows = np.ones(len(x), np.int64), np.arange(len(x))
    for _ in range(len(cut).bit_length() - 1):
        at = 2 * at + (x[rows, feature[at]] >= cut[at])
    return at - len(cut)


def pruned(feature: np.ndarray, cut: np.ndarray, counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """A tree and its leaves, as a forest holds them, from splits and the rows in each cell: nodes without rows are not split."""
    k, depth = len(counts), len(counts).bit_length() - 1
    total = np.concatenate([np.zeros(k, np.int64), counts.astype(np.int64)])
    level = np.concatenate([[0], np.repeat(np.arange(depth + 1), 1 << np.arange(depth + 1))])
    for d in reversed(range(depth)):
        total[1 << d : 2 << d] = total[2 << d : 4 << d].reshape(-1, 2).sum(axis=1)
    missed = level.copy()
    for d in range(1, depth + 1):
        here = np.arange(1 << d, 2 << d)
        missed[here] = np.where(total[here] == total[here // 2], missed[here // 2], d)
    inner = (total > 0) & (np.arange(2 * k) < k)
    inner[0] = False
    there = np.concatenate([[False, True], inner[1:k].repeat(2)])
    number, nodes = np.cumsum(there) - 1, np.flatnonzero(there)
    split = inner[nodes]
    up = np.where(split, nodes, 0)
    left, right = np.where(split, number[2 * up], 0), np.where(split, number[2 * up + 1], 0)
    path = np.where(split, 0, level[nodes] + usual_path(total[nodes]))
    tree = np.where(split, feature[up], -1).astype(np.int8), np.where(split, cut[up], 0), left.astype(np.int32), right.astype(np.int32), path
    return tree, (total[nodes], level[nodes], missed[nodes])


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One isolation tree over rows x.

    low and high bound the root's box: it may reach beyond x, so that a value that good rows never take is cut off
    near the root.
    """
    drawn = splits(low, high, levels(len(x), low, high), rng)
    return pruned(*drawn, np.bincount(cells(x, *drawn), minlength=len(drawn[1])))[0]


def counted(low: np.ndarray, high: np.ndarray, depth: int, trees: int, seed: int, weight: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows of `weight` in each cell of each tree."""
    out = common.fields("tree int, cell int, rows long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = [splits(low, high, depth, np.random.default_rng([seed, t])) for t in range(trees)]
        found = np.zeros((trees, 1 << depth), np.int64)
        for b in batches:
            stats = b.to_pandas()
            x, n = features(stats), stats[weight].to_numpy()
            for t, s in enumerate(drawn):
                np.add.at(found[t], cells(x, *s), n)
        tree, cell = np.nonzero(found)
        yield common.batch(out, tree=tree.astype(np.int32), cell=cell.astype(np.int32), rows=found[tree, cell])

    return run


def rated(forest: Forest, weight: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: labels of both kinds by the score, in millionths, that a row has where it is left out of the trees."""
    out = common.fields("score long, good long, other long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = b.to_pandas()
            stats["score"] = np.rint(forest.left_out(features(stats), stats[weight].to_numpy()) * 1e6).astype(np.int64)
            found = stats.groupby("score", as_index=False)[["good", "other"]].sum()
            yield common.batch(out, **{c: found[c].to_numpy() for c in found})

    return run


def threshold(scores: pd.DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """What best tells the labels apart, of the cuts that keep `keep_good` of the good rows: from labels of both kinds by score in millionths."""
    scores = scores.sort_values("score")
    good, other = scores["good"].to_numpy(), scores["other"].to_numpy()
    if len(scores) > 1 and good.sum() and other.sum():
        values = scores["score"].to_numpy() / 1e6
        kept, caught = np.cumsum(good)[:-1] / good.sum(), 1 - np.cumsum(other)[:-1] / other.sum()
        if (allowed := kept >= keep_good).any():
            gain = np.where(allowed, kept + caught, -1)
            best = np.flatnonzero(gain == gain.max())
            return float((values[1:] + values[:-1])[best[len(best) // 2]] / 2)
    return DEFAULT_THRESHOLD


def fit(rows: DataFrame, trees: int = TREES, keep_good: float = KEEP_GOOD, seed: int = SEED) -> Forest:
    """Trees and threshold from all rows: statistics, and numbers of labels `good` and `other`. Reads rows several times: pass a written table.

    Without good labels, the trees count the others.
    """
    roots = [F.sqrt(F.col(c) / (F.col("n_words") + 10)) for c in FEATURES]
    x = [r / (1 + r) for r in roots]
    box = rows.agg(F.sum("good"), F.sum("other"), *map(F.min, x), *map(F.max, x)).head()
    if box[0] is None:
        return Forest([], 0, DEFAULT_THRESHOLD)
    weight, n = ("good", box[0]) if box[0] else ("other", box[1])
    low, high = np.array(box[2:], np.float64).reshape(2, -1)
    depth = levels(n, low, high)
    found = rows.mapInArrow(counted(low, high, depth, trees, seed, weight), "tree int, cell int, rows long").groupBy("tree", "cell").agg(F.sum("rows").alias("rows")).toArrow().to_pandas()
    counts = np.zeros((trees, 1 << depth), np.int64)
    counts[found["tree"], found["cell"]] = found["rows"]
    grown = [pruned(*splits(low, high, depth, np.random.default_rng([seed, t])), counts[t]) for t in range(trees)]
    forest = Forest([t for t, _ in grown], n, DEFAULT_THRESHOLD, [leaves for _, leaves in grown])
    scores = rows.mapInArrow(rated(forest, weight), "score long, good long, other long").groupBy("score").agg(F.sum("good").alias("good"), F.sum("other").alias("other")).toArrow().to_pandas()
    return replace(forest, threshold=threshold(scores, keep_good), leaves=[])


def base_failed(r: str = ""):
    """Of the statistics in columns, or in the fields of r."""
    n, repeated = (F.col(f"{r}.{k}" if r else k) for k in ("n_words", "n_repeat_words"))
    return (n < 10) | (100 * repeated > 20 * n)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of docs, as a written table."""
    common.ship(docs.sparkSession)
    judged = common.picked(docs, doc_id="long", text="string").select("doc_id", rules()("text").alias("r"))
    return common.written(judged.select("doc_id", *[F.col(f"r.{k}").alias(k) for k in NAMES]), "statistics")


def fitted(stats: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD, seed: int = SEED) -> Forest:
    """A forest and threshold from all labelled rows of `measured` that pass the base rule."""
    wanted = common.picked(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null")
    kinds = wanted.groupBy("doc_id").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("other"))
    rows = common.written(stats.where(~base_failed()).join(kinds, "doc_id").select(*NAMES, "good", "other"), "labelled")
    forest = fit(rows, keep_good=keep_good, seed=seed)
    common.drop(rows)
    return forest


def quality_rules(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD, seed: int = SEED) -> DataFrame:
    """doc_id, the statistics, base_failed, score (the isolation score), kept for every row of docs."""
    stats = measured(docs)
    forest = fitted(stats, labels, keep_good, seed)

    @F.arrow_udf("double")
    def score(*cols: pa.Array) -> pa.Array:
        return pa.array(forest.score(features(pd.DataFrame({k: c.to_numpy() for k, c in zip(NAMES, cols, strict=True)}))))

    failed = base_failed()
    judged = stats.withColumn("score", score(*NAMES))
    return judged.select("doc_id", *NAMES, failed.alias("base_failed"), "score", (~failed & (F.col("score") < forest.threshold)).alias("kept"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the documents that the rules keep, with all their columns. Texts are measured twice, the first time to fit the forest."""
    stats = measured(docs)
    forest = fitted(stats, common.table(spark, sf_dir, "labels"))
    common.drop(stats)
    name = common.unused(docs, "rules")
    judged = docs.withColumn(name, rules(forest)(F.col("text").cast("string")))
    return judged.where(~base_failed(name) & (F.col(f"{name}.score") < forest.threshold)).drop(name)


QUERIES = {"op5_quality_rules": op5_quality_rules}
