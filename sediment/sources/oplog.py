"""Op logs (seq, key, op, value) over the driver's tables, and the probe keys that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, DELETE = 1, 2
RING = ("compute-1", "compute-2", "compute-3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """Overwrites, deletes and revivals: each event is an op on its user."""
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), op.alias("op"), F.when(op == PUT, F.col("props")).alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk load of unique keys."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("key_"), F.col("o_orderkey").cast("string")).alias("key"), F.lit(PUT).alias("op"), F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("value"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's key, and a guaranteed miss for each sixth user."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    hits = users.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"))
    return hits.unionByName(users.where("user_id % 6 = 0").select(F.concat(F.lit("miss_"), F.col("user_id").cast("string")).alias("key")))
