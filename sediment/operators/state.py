"""Current state of an op log (seq, key, op, value): the last op of each key decides, whatever run it lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DELETE = 1, 2


def last_ops(log: DataFrame, *more: str) -> DataFrame:
    """The last op of each key (and `more` columns), as (key, seq, op, value).

    One aggregate on the key with a partial maximum before the shuffle, so a hot key sends one row a task.
    """
    keys = [*more, "key"]
    return log.groupBy(*keys).agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("_last")).select(*keys, "_last.seq", "_last.op", "_last.value")


def live(log: DataFrame) -> DataFrame:
    """(key, value) of keys whose last op is a put."""
    return last_ops(log).where(F.col("op") == PUT).select("key", "value")


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """The state after the op numbered seq."""
    return live(log.where(F.col("seq") <= seq))


def middle(log: DataFrame) -> int:
    """The number half way between the log's first op and its last."""
    ends = log.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    return 0 if ends["low"] is None else (ends["low"] + ends["high"]) // 2


def get(log: DataFrame, key: str) -> DataFrame:
    """No row or one: the filter on the key comes before the aggregate, and reaches the scan."""
    return live(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, value) of each asked key; an absent one has the empty value.

    The log is cut down to asked keys before its aggregate; Spark broadcasts the asked keys if they are few.
    """
    asked = keys.select("key").distinct()
    state = live(log.join(asked, "key", "left_semi"))
    return asked.join(state, "key", "left").select("key", F.col("value").isNotNull().alias("found"), F.coalesce("value", F.lit("")).alias("value"))


def overwrites(log: DataFrame) -> DataFrame:
    """Of each key: how often it was put, and the first and last value put."""
    puts = log.where(F.col("op") == PUT)
    return puts.groupBy("key").agg(F.count(F.lit(1)).alias("puts"), F.min_by("value", "seq").alias("first_value"), F.max_by("value", "seq").alias("last_value"))


def tombstones(log: DataFrame) -> DataFrame:
    """(key, seq) of keys whose last op is a delete."""
    return last_ops(log).where(F.col("op") == DELETE).select("key", "seq")


def revived(log: DataFrame) -> DataFrame:
    """Of each key that a put brought back from a delete: how often, and when last."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("seq"))
    back = log.withColumn("_before", before).where((F.col("op") == PUT) & (F.col("_before") == DELETE))
    return back.groupBy("key").agg(F.count(F.lit(1)).alias("revivals"), F.max("seq").alias("last_seq"))


def newest_first(keys: list[str], order: Column):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order))
