"""Approximate nearest neighbours (operator 4): score-aware anisotropic quantisation for largest inner products.

Vectors are dealt to partitions (k-means); what a vector has beyond its partition's centre is coded in four bits for
each pair of dimensions. Codes and codebooks minimise a loss that weighs the error parallel to a vector ETA times
the error across it, as only the former moves large inner products. A query looks at the partitions whose centres
have the largest inner products with it (as many as hold nearly all neighbours within the sample: few where vectors lie in
clusters, most where they don't), scans their codes with a table of its products with all code words, and
reranks the best of each block, and all that the codes' error may hide among them, with exact products in double
precision.

The model is fitted on at most FIT_ROWS rows, taken by hash; every row is indexed. Rows of a partition are cut into
blocks and its queries into groups, so that a partition that holds a third of all rows is many tasks' work, and each
task holds one block and one group. Queries against all rows go block by block; results are merged by rank.

Vectors are kept as they come, in single or double precision, and scores are products of these in double precision.
The index works on vectors divided by one power of two near the table's largest component, so that no norm overflows.

Nulls and odd rows: a null vec_id or vector, a null or non-finite component, a zero vector, or another number of
dimensions than most vectors have, takes no part; rows that repeat a vec_id count once, with the vector that sorts
first; equal scores go to the smaller vec_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

NEAREST = 20
#: Rows that centres and codebooks may be fitted on.
FIT_ROWS = 16_384
#: A query looks at as many partitions as hold this share of the neighbours of CALIBRATE of the sample's rows.
HELD, CALIBRATE = 0.985, 512
#: Of each block, so many at least are reranked for each wanted neighbour.
RERANK = 4
BLOCK, GROUP = 8192, 2048
#: The share of a vector's norm from which a product counts as large; it gives ETA.
THRESHOLD = 0.2
WORDS = 16


@dataclass
class Model:
    centres: np.ndarray  # partitions x dimensions
    book: np.ndarray  # pairs of dimensions x WORDS x 2
    eta: float

    @property
    def pairs(self) -> int:
        return len(self.book)

    def assigned(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row."""
        return np.argmax(x @ self.centres.T - (self.centres**2).sum(axis=1) / 2, axis=1)

    def coded(self, x: np.ndarray, part: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Code words of rows: coordinate descent on the anisotropic loss."""
        return code_rows(x, self.centres[part], self.book, self.eta, sweeps)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries with all code words: queries x pairs x WORDS."""
        return np.einsum("qmd,mwd->qmw", padded(q).reshape(len(q), -1, 2), self.book)


def padded(x: np.ndarray) -> np.ndarray:
    return x if x.shape[1] % 2 == 0 else np.concatenate([x, np.zeros((len(x), 1), x.dtype)], axis=1)


def code_rows(x: np.ndarray, centre: np.ndarray, book: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    n, m = len(x), len(book)
    xs, rs = padded(x).reshape(n, m, 2), padded(x - centre).reshape(n, m, 2)
    unit = xs / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    codes = np.empty((n, m), np.uint8)
    for k in range(m):
        codes[:, k] = ((book[k][None] - rs[:, k, None, :]) ** 2).sum(axis=2).argmin(axis=1)
    error = book[np.arange(m)[None], codes] - rs
    along = (error * unit).sum(axis=2)
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for k in range(m):
            e = book[k][None] - rs[:, k, None, :]
            p = (e * unit[:, k, None, :]).sum(axis=2)
            rest = total - along[:, k]
            loss = (e**2).sum(axis=2) + (eta - 1) * (rest[:, None] + p) ** 2
            codes[:, k] = loss.argmin(axis=1)
            along[:, k] = p[np.arange(n), codes[:, k]]
            total = rest + along[:, k]
    return codes


def fit_centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def fit(x: np.ndarray, partitions: int, threshold: float = THRESHOLD, rounds: int = 5, seed: int = 4) -> Model:
    """Centres by k-means, then codebooks by turns: codes for fixed words, and the words' normal equations for fixed codes."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    centres = fit_centres(x, min(partitions, len(x)), rng)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    model = Model(centres, np.zeros((0, WORDS, 2)), eta)
    part = model.assigned(x)
    r = padded(x - centres[part]).reshape(len(x), -1, 2)
    m = r.shape[1]
    model.book = np.stack([r[rng.choice(len(x), WORDS), k] for k in range(m)]) + rng.normal(scale=1e-6, size=(m, WORDS, 2))
    unit = padded(x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), m, 2)
    for _ in range(rounds):
        codes = model.coded(x, part, 1).astype(np.int64)
        # minimise sum |B c - r|^2 + (eta - 1) (unit . (B c - r))^2 over all words c at once
        at = (np.arange(m)[None] * WORDS + codes)[:, :, None] * 2 + np.arange(2)  # rows x pairs x 2: unknowns
        size = m * WORDS * 2
        a = np.diag(np.bincount(at.ravel(), minlength=size) + 1e-6)
        b = np.bincount(at.ravel(), weights=r.ravel(), minlength=size)
        for i in range(0, len(x), 1024):
            s = np.zeros((len(x[i : i + 1024]), size), np.float32)
            np.put_along_axis(s, at[i : i + 1024].reshape(len(s), -1), unit[i : i + 1024].reshape(len(s), -1).astype(np.float32), axis=1)
            a += (eta - 1) * (s.T @ s).astype(np.float64)
            b += (eta - 1) * (s.T @ (unit[i : i + 1024] * r[i : i + 1024]).sum(axis=(1, 2)).astype(np.float32)).astype(np.float64)
        model.book = np.linalg.solve(a, b).reshape(m, WORDS, 2)
    return model


def probes_needed(model: Model, x: np.ndarray, k: int, share: float) -> int:
    """How many partitions, by the product of query and centre, hold this share of the k best products within a sample."""
    q = x[:CALIBRATE]
    part = model.assigned(x)
    rank = np.argsort(np.argsort(-(q @ model.centres.T), axis=1, kind="stable"), axis=1)
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(model.centres)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    depth = np.sort(rank[np.arange(len(q))[:, None], part[near]].ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(share * len(depth))) - 1)]) + 1


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, ::2] << 4 | codes[:, 1::2]


def scanned(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate products, queries x rows, from four-bit codes packed two to a byte."""
    q, m, w = tables.shape
    if m % 2:
        tables = np.concatenate([tables, np.zeros((q, 1, w))], axis=1)
    both = (tables[:, ::2, :, None] + tables[:, 1::2, None, :]).reshape(q, -1, w * w).astype(np.float32)
    out = np.zeros((q, len(codes)), np.float32)
    for k in range(codes.shape[1]):
        out += both[:, k, :][:, codes[:, k]]
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, the first of equal ones."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    more = np.flatnonzero(scores > least)
    return np.concatenate([more, np.flatnonzero(scores == least)[: k - len(more)]])


def kind_of(rows: DataFrame) -> str:
    """The precision that vectors are kept in: single if they come in it, else double."""
    return "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    picked = rows.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").cast(f"array<{kind_of(rows)}>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = picked.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0))
    most = finite.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not most:
        return finite.where(F.lit(False))
    return finite.where(F.size("embedding") == most[0]["d"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


FOUND = "query_id long, vec_id long, score double"


def matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def nearest(rows: DataFrame, is_query, k: int = NEAREST, fit_rows: int = FIT_ROWS, held_share: float = HELD, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which is_query holds, the k other rows with the largest products that were found."""
    spark = rows.sparkSession
    common.ship(spark)
    table, kind = common.written(usable(rows), "vectors"), kind_of(rows)
    largest = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("m")).first()
    n = largest["n"]
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("embedding").toArrow()
    unit = 2.0 ** -np.frexp(largest["m"])[1] if kind == "double" else 1.0
    x = matrix(sample.column("embedding")).astype(np.float64) * unit
    x = x[(x != 0).any(axis=1)]  # a vector may be too small for the unit
    if not len(x):
        x = np.ones((1, len(sample.column("embedding")[0])))
    model = fit(x, max(1, min(len(x) // 32, round(n**0.5 / 8))))
    shared = spark.sparkContext.broadcast(model)  # at most fit_rows / 32 centres

    def code(batches):
        schema = common.fields(f"part int, salt long, vec_id long, codes binary, embedding array<{kind}>")
        m, salt = shared.value, 0
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("embedding")).astype(np.float64) * unit
                part = m.assigned(v)
                codes = packed(m.coded(v, part))
                yield common.batch(schema, part=part, salt=np.arange(salt, salt + len(v)), vec_id=b.column("vec_id"), codes=[c.tobytes() for c in codes], embedding=b.column("embedding"))
                salt += len(v)

    index = common.written(table.mapInArrow(code, f"part int, salt long, vec_id long, codes binary, embedding array<{kind}>"), "codes")
    rows_in = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one for each centre
    held = np.array([rows_in.get(p, 0) for p in range(len(model.centres))])
    probes = probes_needed(model, x, k, held_share)

    def route(batches):
        schema = common.fields(f"part int, query_id long, query array<{kind}>, salt long")
        m, salt = shared.value, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                v = matrix(part.column("embedding")).astype(np.float64) * unit
                order = np.argsort(-(v @ m.centres.T), axis=1, kind="stable")
                # enough partitions for k neighbours besides the query itself
                before = np.cumsum(held[order], axis=1) - held[order]
                take = ((np.arange(len(held))[None] < probes) | (before < k + 1)) & (held[order] > 0)
                i, j = np.nonzero(take)
                yield common.batch(schema, part=order[i, j], query_id=part.column("vec_id").to_numpy()[i], query=part.column("embedding").take(pa.array(i)), salt=np.arange(salt, salt + len(i)))
                salt += len(i)

    asked = common.written(table.where(is_query).mapInArrow(route, f"part int, query_id long, query array<{kind}>, salt long"), "asked")
    groups = {r["part"]: -(-r["count"] // GROUP) for r in asked.groupBy("part").count().collect()}
    if not groups:
        return spark.createDataFrame([], result)

    def per_part(values: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(v) for kv in sorted(values.items()) for v in kv]), F.col("part"))

    blocks = {p: -(-c // BLOCK) for p, c in rows_in.items()}
    wanted = index.where(F.col("part").isin(list(groups)))
    left = wanted.withColumn("block", F.pmod("salt", per_part(blocks).cast("long"))).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), per_part(groups).cast("long") - 1))).drop("salt")
    right = asked.withColumn("grp", F.pmod("salt", per_part(groups).cast("long"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), per_part(blocks).cast("long") - 1))).drop("salt")
    schema = common.fields(FOUND)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        m = shared.value
        a = a.sort_by("vec_id")
        ids, v = a.column("vec_id").to_numpy(), matrix(a.column("embedding")).astype(np.float64)
        codes = np.frombuffer(b"".join(a.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        centre = m.centres[a.column("part")[0].as_py()]
        names, q = b.column("query_id").to_numpy(), matrix(b.column("query")).astype(np.float64)
        whole_v, whole_q = v, q
        v, q = v * unit, q * unit
        out = []
        for i in range(0, len(names), 64):
            near = scanned(m.tables(q[i : i + 64]), codes) + (q[i : i + 64] @ centre)[:, None]
            for j in range(len(near)):
                s = near[j]
                own = np.flatnonzero(ids == names[i + j])
                s[own] = -np.inf
                some = best(s, k * rerank)
                some = some[ids[some] != names[i + j]]
                exact = (v[some] * q[i + j]).sum(axis=1)
                if len(some) > k:
                    # whatever may reach the k-th best exact product, by twice what codes were off so far, is reranked too
                    least = np.partition(exact, len(exact) - k)[len(exact) - k]
                    some = np.flatnonzero(s >= least - 2 * np.abs(exact - s[some]).max())
                with np.errstate(over="ignore"):
                    exact = (whole_v[some] * whole_q[i + j]).sum(axis=1)
                order = np.lexsort((ids[some], -exact))[:k]
                out.append((np.full(len(order), names[i + j]), ids[some][order], exact[order]))
        return pa.Table.from_batches([common.batch(schema, query_id=np.concatenate([x[0] for x in out]), vec_id=np.concatenate([x[1] for x in out]), score=np.concatenate([x[2] for x in out]))])

    found = left.groupBy("part", "block", "grp").cogroup(right.groupBy("part", "block", "grp")).applyInArrow(search, FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op4_ann": op4_ann}
