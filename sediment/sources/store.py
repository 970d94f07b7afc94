"""A durable store over Parquet: an op log, generations, and a manifest that is written last.

Put and delete append to the log; flush writes what waits as one generation, sorted by key, and then commits it with
a manifest row; opening reads what is committed and replays the log after it. Compaction writes the newest record of
each key, without deletes, as one more generation, whose manifest row replaces all before it. A crash before a commit leaves files
that nothing reads, the log still holds their ops, and the next flush writes that generation's folder anew. One writer at a time; readers see committed snapshots.

The generations of one flush lie in one folder, named by the first of them, in files of about ROWS records sorted by
(generation, key): however many runs a bulk load closes, it writes and later readers list as many files as its size asks for.
Folders of a single generation, as stores had them before, are read as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generations, state
from ..shared import drop

OPS = "seq long, key string, op int, value string"
#: folder is the first generation of the flush (null: a folder of this generation alone).
MANIFEST = "generation long, filename string, first_seq long, last_seq long, replaces long, folder long"
ROWS = 1 << 19


class Store:
    def __init__(self, spark: SparkSession, folder: str, threshold: int = 5, files: int = 1) -> None:
        """files: Parquet files of a flush at least, by range of (generation, key); larger ones have more."""
        self.spark, self.folder, self.threshold, self.files = spark, folder.rstrip("/"), threshold, files

    # what is on disk
    def _rows(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def log(self) -> DataFrame:
        return self._rows("log", OPS)

    def manifest(self) -> DataFrame:
        """Committed generations that no compaction has replaced: replaces is the last generation that a compacted one stands for."""
        rows = self._rows("manifest", MANIFEST)
        replaced = rows.agg(F.max("replaces").alias("r")).first()["r"]
        return rows if replaced is None else rows.where(F.col("generation") > replaced)

    def tables(self) -> DataFrame:
        """Records of committed generations only."""
        rows = self._rows("generations", "number long, key string, op int, value string, generation long")
        named = rows.select(F.col("generation").alias("folder"), F.coalesce("number", "generation").alias("generation"), "key", "op", "value")
        held = self.manifest().select(F.coalesce("folder", "generation").alias("folder"), "generation")
        return named.join(held, ["folder", "generation"], "left_semi")

    def committed(self) -> tuple[int, int]:
        """(next generation, last committed seq)."""
        r = self.manifest().agg(F.max("generation").alias("g"), F.max("last_seq").alias("s")).first()
        return (0, -1) if r["g"] is None else (r["g"] + 1, r["s"])

    def waiting(self) -> DataFrame:
        """Ops that no committed generation holds: what a restart replays."""
        return self.log().where(F.col("seq") > self.committed()[1])

    # writes
    def write(self, ops: DataFrame) -> None:
        """Append (key, op, value) rows that carry an order column `seq`; then flush every run that is full."""
        end = self.log().agg(F.max("seq").alias("s")).first()["s"]
        first = ops.agg(F.min("seq").alias("s")).first()["s"]
        if first is None:
            return
        base = 0 if end is None else end + 1 - first
        ops.select((F.col("seq") + base).alias("seq"), "key", F.col("op").cast("int").alias("op"), F.when(F.col("op") == state.PUT, F.col("value")).alias("value")).write.mode("append").parquet(f"{self.folder}/log")
        self._flush(force=False)

    def put(self, pairs: dict[str, str]) -> None:
        self.write(self.spark.createDataFrame([(i, k, state.PUT, v) for i, (k, v) in enumerate(pairs.items())], OPS))

    def delete(self, *keys: str) -> None:
        self.write(self.spark.createDataFrame([(i, k, state.DELETE, None) for i, k in enumerate(keys)], OPS))

    def flush(self) -> None:
        """Whatever waits becomes a generation; nothing happens if nothing does."""
        self._flush(force=True)

    def _flush(self, force: bool) -> None:
        begin, _ = self.committed()
        waiting = self.waiting()
        found = generations.boundaries(waiting, self.threshold)
        ends = found if force else found.where("flushed")
        if not ends.isEmpty():
            runs = generations.assigned(waiting, ends)
            rows = state.last_ops(runs, "generation").select((F.col("generation") + begin).alias("generation"), "key", F.col("op").cast("int").alias("op"), "value")
            self._write(rows, begin, waiting.count())
            self._commit(ends.select((F.col("generation") + begin).alias("generation"), "first_seq", "last_seq", F.lit(None).cast("long").alias("replaces"), F.lit(begin).cast("long").alias("folder")))
        drop(found)

    def compact(self) -> None:
        """All committed generations become one, without deletes and what they or later puts have replaced."""
        now = self.manifest().agg(F.count(F.lit(1)).alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max("generation").alias("g")).first()
        if not now["n"]:
            return
        none = self.spark.createDataFrame([], "key string, op int, value string")
        tables, g = self.tables(), now["g"] + 1
        self._write(generations.merged(tables, none).select(F.lit(g).cast("long").alias("generation"), "key", F.lit(state.PUT).alias("op"), "value"), g, tables.count())
        self._commit(self.spark.createDataFrame([(g, now["first_seq"], now["last_seq"], now["g"], g)], "generation long, first_seq long, last_seq long, replaces long, folder long"))

    def _write(self, rows: DataFrame, first: int, most: int) -> None:
        """The folder of a flush whose first generation is `first`; there are at most `most` records."""
        files = max(self.files, -(-most // ROWS))
        rows.select(F.col("generation").alias("number"), "key", "op", "value").repartitionByRange(files, "number", "key").sortWithinPartitions("number", "key").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.folder}/generations/generation={first}")

    def _commit(self, ends: DataFrame) -> None:
        ends.select("generation", F.format_string("%06d.sst", "generation").alias("filename"), "first_seq", "last_seq", "replaces", "folder").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    # reads
    def live(self) -> DataFrame:
        return generations.merged(self.tables(), state.last_ops(self.waiting()).select("key", "op", "value"))

    def get(self, key: str) -> str | None:
        """The filter on the key reaches the scans of sorted files."""
        mine = generations.merged(self.tables().where(F.col("key") == key), state.last_ops(self.waiting().where(F.col("key") == key)).select("key", "op", "value"))
        r = mine.first()
        return r["value"] if r else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        asked = keys.select("key").distinct()
        held = generations.merged(self.tables().join(asked, "key", "left_semi"), state.last_ops(self.waiting().join(asked, "key", "left_semi")).select("key", "op", "value"))
        return asked.join(held, "key", "left").select("key", F.col("value").isNotNull().alias("found"), F.coalesce("value", F.lit("")).alias("value"))
