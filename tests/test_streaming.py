import random

from pyspark.sql import functions as F
from sediment.operators import generations as gen
from sediment.operators import state
from sediment.streaming import generations as folded
from sediment.streaming import live

LOG = "seq long, key string, op int, value string"


def batches(spark, folder, n=6, size=60):
    """A folder of op files, to be read one a batch; and the whole log."""
    r = random.Random(3)
    rows = [(i, f"k{r.randrange(20)}", 1 if r.random() < 0.7 else 2, f"v{i}") for i in range(n * size)]
    for b in range(n):
        spark.createDataFrame(rows[b * size : (b + 1) * size], LOG).coalesce(1).write.mode("append").parquet(folder)
    return rows, spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_live_state_over_batches(spark, tmp_path):
    rows, stream = batches(spark, f"file://{tmp_path}/ops")
    got = {r.key: r.value for r in live.live_table(stream).collect()}
    assert got == {r.key: r.value for r in state.live(spark.createDataFrame(rows, LOG)).collect()}


def test_fold_over_batches(spark, tmp_path):
    rows, stream = batches(spark, f"file://{tmp_path}/ops")
    with_shard = lambda df: df.withColumn("node", F.when(F.col("key") < "k15", "a").otherwise("b"))
    out = folded.numbered(with_shard(stream), 5, "node")
    query = out.writeStream.outputMode("append").format("memory").queryName("fold_test").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.seq: r.generation for r in spark.table("fold_test").collect()}
    want = {r.seq: r.generation for r in gen.numbered(with_shard(spark.createDataFrame(rows, LOG)), 5, shard="node").collect()}
    assert got == want and len(got) == len(rows)
