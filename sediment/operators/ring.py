"""Consistent-hash routing: a key belongs to the first node point at or after its hash, or to the smallest point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, vectors
from . import state


def position(text: Column) -> Column:
    return vectors.position(text)


def points(spark: SparkSession, nodes: list[str]) -> DataFrame:
    """(node, point): the ring in ascending order; of nodes at one point, the last named stays."""
    rows = spark.createDataFrame(list(enumerate(nodes)), "n long, node string").withColumn("w", position(F.col("node")))
    return rows.groupBy("w").agg(F.max_by("node", "n").alias("node")).select("node", hashing.number(F.col("w")).alias("point")).orderBy("point")


def routed(keys: DataFrame, nodes: list[str], key: str = "key", node: str = "node") -> DataFrame:
    """keys with the node of each; null if there are no nodes.

    The ring's points are a handful of constants, so that routing is a column of the scan: no join, no shuffle.
    """
    if not nodes:
        return keys.withColumn(node, F.lit(None).cast("string"))
    ring = [(int(r["point"]), r["node"]) for r in points(keys.sparkSession, nodes).collect()]

    def choose(h: Column) -> Column:
        found = None
        for point, name in ring:
            hi, lo = point >> 32, point & 0xFFFFFFFF
            ahead = (h["hi"] < hi) | ((h["hi"] == hi) & (h["lo"] <= lo))
            found = F.when(ahead, F.lit(name)) if found is None else found.when(ahead, F.lit(name))
        return found.otherwise(F.lit(ring[0][1]))

    placed = keys.withColumn("_position", position(F.col(key)))
    return placed.withColumn(node, choose(F.col("_position"))).drop("_position")


def load(keys: DataFrame, nodes: list[str]) -> DataFrame:
    return routed(keys, nodes).groupBy("node").agg(F.count(F.lit(1)).alias("keys"))


def sharded_get(log: DataFrame, keys: DataFrame, nodes: list[str]) -> DataFrame:
    """(key, node, found, value): each asked key looked up in its node's own state."""
    asked = routed(keys.select("key").distinct(), nodes)
    mine = log.join(asked.select("key"), "key", "left_semi")
    held = state.last_ops(routed(mine, nodes), "node").where(F.col("op") == state.PUT).select("node", "key", "value")
    return asked.join(held, ["node", "key"], "left").select("key", "node", F.col("value").isNotNull().alias("found"), F.coalesce("value", F.lit("")).alias("value"))


def parse_nodes(specs: DataFrame) -> DataFrame:
    """(spec, n, node, host, port) of each entry of id:host:port lists; a list with any malformed entry has none."""
    entries = specs.select("spec", F.posexplode(F.filter(F.split("spec", ","), lambda e: e != "")).alias("n", "entry"))
    parts = F.split("entry", ":", 3)
    read = entries.select("spec", F.col("n").cast("long").alias("n"), F.get(parts, F.lit(0)).alias("node"), F.get(parts, F.lit(1)).alias("host"), F.regexp_extract(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), r"^\s*\+?(\d{1,18})", 1).alias("digits"))
    bad = (F.coalesce("node", F.lit("")) == "") | (F.coalesce("host", F.lit("")) == "") | (F.col("digits") == "")
    wrong = read.groupBy("spec").agg(F.max(bad.cast("int")).alias("wrong")).where("wrong = 1").select("spec")
    good = read.join(wrong, "spec", "left_anti")
    return good.select("spec", "n", "node", "host", (F.col("digits").cast("long") % 65536).cast("long").alias("port"))
