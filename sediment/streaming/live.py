"""The live state of an op log that arrives as a stream: the same aggregate, kept by the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..shared import shared_path
from ..sources import oplog


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return oplog.from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def live_table(log: DataFrame) -> DataFrame:
    """Runs the stream over what has arrived and gives its live state.

    Each batch's changed keys are appended with the batch's number (update mode), so that a batch writes what
    changed and no more; the newest row of each key is its state. A batch that runs again after a crash writes its
    own folder anew.
    """
    spark = log.sparkSession
    folder = shared_path(spark, "stream")
    last = log.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("last"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.select("key", "last.seq", "last.op", "last.value").write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = last.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.live(spark.read.parquet(f"{folder}/rows").select("key", "seq", "op", "value"))
