"""Mixing sources to target weights (operator 6): Pfair scheduling of blocks, earliest deadline first.

Each source is the endless repetition of its documents in the order of a hash of doc_id, cut into blocks of `block`
documents; a use of a document in the n-th repetition is epoch n. A source of weight w gets its j-th block (from 1)
released at slot floor((j - 1) / w), with the deadline ceil(j / w); each slot goes to the released block of the
earliest deadline (ties: the source that sorts first). As the weights add up to one, every deadline is met: at any
slot, a source has had less than one block more or fewer than its weight times the slot's number. Weights are exact
fractions (a floating point number is one), so nothing is rounded, however long the mix or small a weight.

Nothing is dropped: the mix ends when every document has come once; a source that its weight brings in faster goes on
from its first document.

The schedule is worked out on the driver and has a number for each slot. So that this is bounded, a block holds
BLOCK documents, or more where there would be over MOST_BLOCKS blocks otherwise: the mix of a larger corpus is as fine
in proportion. (Weights much smaller than a source's size make a mix that much longer than the corpus.)

Nulls and odd rows: a null source is a source of its own, which sorts first; a null doc_id comes first in its source;
repeated rows are mixed each by itself; an empty table gives no rows; extra columns are ignored. Sources given no
target weight, or one that isn't a positive number, are an error. The driver holds a row for each source.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, MOST_BLOCKS = 8, 1 << 20


def tempered(counts: dict[str | None, int]) -> dict[str | None, float]:
    """Weights as the power 3/4 of the sources' sizes, in whole millionths: small sources come up, large ones go down."""
    return {k: math.floor(1e6 * n / math.sqrt(math.sqrt(n))) for k, n in counts.items()}


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    if any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("target weights must be positive numbers")
    parts = [Fraction(w) for w in weights]
    scale = math.lcm(*[f.denominator for f in parts])
    whole = [int(f * scale) for f in parts]
    common_part = math.gcd(*whole)
    return [w // common_part for w in whole]


def schedule(share: list[int], blocks: list[int]) -> list[array]:
    """The slots of each source's blocks, in order, until every source has had that many blocks."""
    period, left, slot = sum(share), sum(b > 0 for b in blocks), 0
    waiting = [(0, i, 1) for i in range(len(share))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = [array("q") for _ in share]
    while left:
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // share[i]), i, j))
        _, i, j = heapq.heappop(ready)
        out[i].append(slot)
        left -= j == blocks[i]
        heapq.heappush(waiting, (j * period // share[i], i, j + 1))
        slot += 1
    return out


MIXED = ("doc", "source", "epoch", "slot", "place")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """MIXED: a row for each use of a document; doc holds all its columns, place is its place within the slot."""
    spark = docs.sparkSession
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), source.alias("source"), doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("name"), F.md5(text).alias("hash"))
    keyed = keyed.withColumn("bucket", F.substring("hash", 1, 3))
    counts = {r["name"]: r["count"] for r in keyed.groupBy("name").count().collect()}
    names = sorted(counts)
    given = {(k[1:] if k else None): counts[k] for k in names}
    targets = tempered(given) if weights is None else weights
    if missing := [k for k in given if k not in targets]:
        raise ValueError(f"no target weight for {missing}")
    if not names:
        return keyed.select("doc", "source", F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("place"))
    block = max(block, -(-sum(counts.values()) // most_blocks))
    slots = schedule(exact([targets[k] for k in given]), [-(-counts[k] // block) for k in names])
    n = [len(s) for s in slots]
    sources = spark.createDataFrame([(k, i, counts[k], n[i] * block) for i, k in enumerate(names)], "name string, i long, docs long, uses long")
    table = spark.createDataFrame(pa.table({"i": np.repeat(np.arange(len(n)), n), "nth": np.concatenate([np.arange(k) for k in n]), "slot": np.concatenate([np.asarray(s, np.int64) for s in slots])}))
    rows = common.ranked(keyed, ["name"], "bucket", ["hash", "doc_id"], "rank").join(sources, "name")
    used = rows.where("rank < uses").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("uses") - 1 - F.col("rank")) / F.col("docs")))))
    at = F.col("rank") + F.col("epoch") * F.col("docs")
    turn = used.withColumn("nth", F.floor(at / block)).withColumn("place", (at % block).cast("int"))
    return turn.join(table, ["i", "nth"]).select("doc", "source", "epoch", "slot", "place")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.picked(common.table(spark, sf_dir, "documents"), doc_id="long", source="string")
    return mixed(docs).select("doc.doc_id", "source", "epoch", "slot", "place")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix uses them, in its order from file to file and row to row; a row for each use of a document."""
    docs = common.on_file(docs)
    file, row, name = (common.unused(docs, k) for k in ("file_key", "file_row", "row_number"))
    numbered = common.located(docs, file, row).withColumn(name, F.xxhash64(file, row)).drop(file, row)
    # the schedule is made without the texts, which meet it once
    uses = mixed(numbered.select("doc_id", "source", name)).select(F.col(f"doc.{name}").alias(f"{name}_used"), F.col("doc.doc_id").alias(f"{name}_of"), "slot", "place")
    slot, place = common.unused(docs, "slot"), common.unused(docs, "place")
    uses = uses.withColumnRenamed("slot", slot).withColumnRenamed("place", place)
    rows = numbered.join(uses, (F.col(name) == F.col(f"{name}_used")) & F.col("doc_id").eqNullSafe(F.col(f"{name}_of")))
    ordered = rows.repartitionByRange(common.buckets(spark), slot, place).sortWithinPartitions(slot, place)
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op6_mixing": op6_mixing}

ORACLE_SQL = {
    "op6_mixing": f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS c, floor(1e6 * count(*) / sqrt(sqrt(count(*))))::HUGEINT AS a, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM documents GROUP BY source),
p AS (SELECT sum(a)::HUGEINT AS period, greatest({BLOCK}, -(-sum(c) // {MOST_BLOCKS}))::BIGINT AS block FROM n),
z AS (SELECT n.*, period, block, (c + block - 1) // block AS blocks FROM n, p),
l AS (SELECT list(a ORDER BY i) AS a, any_value(period) AS period, max((blocks * period + a - 1) // a) AS most FROM z),
s AS (
  SELECT 0::BIGINT AS t, 0::BIGINT AS pick, list_transform(a, lambda v: 0::HUGEINT) AS done FROM l
  UNION ALL
  SELECT t + 1, pick, list_transform(done, lambda v, j: v + (j = pick)::HUGEINT) FROM (
    SELECT t, done, list_position(d, list_min(d))::BIGINT AS pick FROM (
      SELECT t, done, list_transform(done, lambda v, j: CASE WHEN v * period // a[j] <= t THEN ((v + 1) * period + a[j] - 1) // a[j] ELSE 1000000000000000 END) AS d
      FROM s, l WHERE t < most))
),
slots AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM s WHERE t > 0),
last AS (SELECT max(slot) AS finish FROM z JOIN slots ON z.i = slots.i AND nth = blocks - 1),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents)
SELECT d.doc_id, d.source, ((nth * block + k - r) // c)::BIGINT AS epoch, slot::BIGINT AS slot, k::INT AS place
FROM slots JOIN last ON slot <= finish JOIN z ON z.i = slots.i, unnest(range(0, block)) AS u(k)
JOIN d ON d.source IS NOT DISTINCT FROM z.source AND d.r = (nth * block + k) % c"""
}
