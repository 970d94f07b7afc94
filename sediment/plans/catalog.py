"""Every query of the key-value engine by name, and the SQL that must give the same rows.

Each query applies one operator to the op log of `events` (overwrites, deletes, revivals) or of `orders` (a bulk load
of unique keys), over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, codec, hashing, vectors
from ..operators import generations as gen
from ..operators import ring, state, workload
from ..shared import shared_path
from ..sources import oplog
from ..sources.store import Store
from ..streaming import live as streaming

T = gen.THRESHOLD
NODES = list(oplog.RING)
FORCE_EVERY = 1000
LOAD_THRESHOLD = 1000
PARTS = 4
READS, MISS_RATE = 5000, 0.15
VALUE_SIZES, SEED = (0, 64), 5
DELETE_SHARE = 0.1
FILTER_BITS = 1000
ASKED = ["user_0", "user_1", "user_2", "user_3", "user_7", "miss_0"]
SPECS = ["compute-1:host1:7001,compute-2:host2:7002", "a:b:1,,c:d:70000", "a:b:1,broken", "a:b:x", ":b:1", "a::1", "", "n:h: 80z,m:h:+9", "a:b:1:2"]
PAYLOADS = ["", "01050000", "77", "0102000000414203000000610062", "0200000000", "03010000006BFF", "8101", "8100FF", "81", "820100000000", "820003000000616263", "82010500000061", "8301", "FF040000006F6F7073", "FF05000000", "010100000061FFFFFF7F"]


def _events(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(oplog.events(spark, d))


def _runs(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(gen.numbered(oplog.events(spark, d), T))


def _tables(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(gen.records(gen.numbered(oplog.events(spark, d), T)))


def _orders(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(oplog.orders(spark, d))


def merge_on_read(runs: DataFrame) -> DataFrame:
    return gen.merged(gen.records(runs), gen.residual(runs))


def force_flush(log: DataFrame) -> DataFrame:
    rows = state.last_ops(gen.forced(log, FORCE_EVERY).where("flushed"), "generation")
    return rows.groupBy("generation").agg(F.count(F.lit(1)).alias("records"), F.sum((F.col("op") == state.DELETE).cast("long")).alias("tombstones"))


def reopened(spark: SparkSession, d: str) -> Store:
    """A store that took the event log, with committed generations and ops that wait, opened anew from its files."""
    folder = shared_path(spark, "store")
    Store(spark, folder, T).write(oplog.events(spark, d))
    return Store(spark, folder, T)


def compacted(spark: SparkSession, d: str) -> DataFrame:
    store = reopened(spark, d)
    store.compact()
    return Store(spark, store.folder, T).live()


def random_values(log: DataFrame) -> DataFrame:
    return log.select("key", workload.random_value(F.col("seq"), *VALUE_SIZES, seed=SEED).alias("value"))


def record_sizes(log: DataFrame) -> DataFrame:
    op, key, value = F.col("op"), F.col("key"), F.col("value")
    return log.select("seq", codec.log_bytes(op, key, value).alias("wal_bytes"), codec.table_bytes(op, key, value).alias("sst_bytes"))


def hash_fnv1a(log: DataFrame) -> DataFrame:
    key = F.col("key")
    return log.select("key", hashing.digits(vectors.fnv1a(key)).alias("h1"), hashing.digits(vectors.fnv1a(key, hashing.SECOND_SEED)).alias("h2"))


def hash_avalanche(log: DataFrame) -> DataFrame:
    return log.select("key", hashing.digits(ring.position(F.col("key"))).alias("h"))


def bloom_probes(spark: SparkSession, d: str) -> DataFrame:
    places = vectors.probes(F.col("key"), F.lit(FILTER_BITS))
    return oplog.probes(spark, d).select("key", F.posexplode(places).alias("probe", "bit"))


def bloom_build(table: DataFrame) -> DataFrame:
    return gen.filter_bits(table).groupBy("generation").agg(F.count(F.lit(1)).alias("set_bits"))


def bloom_membership(spark: SparkSession, d: str) -> DataFrame:
    """A filter over the live keys, asked for every probe key."""
    held = state.live(oplog.events(spark, d)).select("key")
    bits = held.agg(bloom.size(F.count(F.lit(1))).alias("bits"))
    places = held.crossJoin(F.broadcast(bits)).select(F.explode(vectors.probes(F.col("key"), F.col("bits"))).alias("bit")).distinct()
    asked = oplog.probes(spark, d)
    need = asked.crossJoin(F.broadcast(bits)).select("key", F.explode(F.array_distinct(vectors.probes(F.col("key"), F.col("bits")))).alias("bit"))
    hit = need.join(places.withColumn("is_set", F.lit(1)), "bit", "left").groupBy("key").agg(F.min(F.coalesce("is_set", F.lit(0))).alias("all_set"))
    return hit.join(held.withColumn("held", F.lit(True)), "key", "left").select("key", (F.col("all_set") == 1).alias("maybe"), F.coalesce("held", F.lit(False)).alias("present"))


def frames(keys: DataFrame) -> DataFrame:
    key, value = F.col("key"), F.concat(F.lit("v_"), F.col("key"))
    hit = key.startswith("user_")
    return keys.select(
        "key",
        codec.put_request(key, value).alias("put_request"),
        codec.get_request(key).alias("get_request"),
        codec.delete_request(key).alias("delete_request"),
        codec.put_response(F.lit(True)).alias("put_response"),
        codec.get_response(hit, value).alias("get_response"),
        codec.delete_response(F.lit(False)).alias("delete_response"),
        codec.error_response(F.concat(F.lit("compute node "), key, F.lit(" unreachable"))).alias("error_response"),
    )


def payloads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS)], "case_id int, payload string")


def wire_decode(spark: SparkSession, d: str) -> DataFrame:
    read = payloads(spark).select("case_id", codec.decode(F.col("payload")).alias("m"))
    return read.select("case_id", F.col("m").isNotNull().alias("ok"), F.coalesce("m.msg_type", F.lit(0)).alias("msg_type"), "m.key_hex", "m.value_hex", "m.flag", "m.message_hex")


def wire_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Each request's answer from a node, and what the leader answers by itself."""
    keys = oplog.probes(spark, d)
    key = F.col("key")
    requests = keys.select("key", F.explode(F.array(codec.get_request(key), codec.put_request(key, F.lit("x")), codec.delete_request(key), codec.put_response(F.lit(True)), F.lit("0100000077"))).alias("frame"))
    read = requests.withColumn("m", codec.decode(F.substring("frame", 9, 1 << 30)))
    held = state.multi_get(oplog.events(spark, d), keys)
    kind = F.col("m.msg_type")
    routed = read.join(held.withColumnRenamed("key", "held_key"), key == F.col("held_key"), "left")
    answer = (
        F.when(kind == codec.GET_REQUEST, codec.get_response(F.col("found"), F.col("value")))
        .when(kind == codec.PUT_REQUEST, codec.put_response(F.lit(True)))
        .when(kind == codec.DELETE_REQUEST, codec.delete_response(F.lit(True)))
        .when(kind.isNotNull(), codec.error_response(F.lit(codec.UNEXPECTED)))
    )
    alone = F.when(kind.isin(codec.PUT_REQUEST, codec.GET_REQUEST, codec.DELETE_REQUEST), F.lit(None)).otherwise(codec.error_response(F.lit(codec.MALFORMED)))
    return routed.select("frame", "key", F.when(kind.isin(1, 2, 3), key).alias("routing_key"), answer.alias("node_answer"), alone.alias("leader_answer"))


def bench_read_stats(spark: SparkSession, d: str) -> DataFrame:
    log = oplog.orders(spark, d)
    n = log.count()
    gone = workload.delete_sample(log, DELETE_SHARE).select((F.col("seq") + n).alias("seq"), "key", F.lit(state.DELETE).alias("op"), F.lit(None).cast("string").alias("value"))
    return workload.read_stats(log.unionByName(gone), workload.read_plan(spark, n, READS, MISS_RATE))


def bench_report(spark: SparkSession, d: str) -> DataFrame:
    return workload.report(workload.write_stats(oplog.orders(spark, d)), bench_read_stats(spark, d))


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SPECS], "spec string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kv_live_state": _events(state.live),
    "kv_get_point": _events(lambda log: state.get(log, "user_7")),
    "kv_multi_get": lambda spark, d: state.multi_get(oplog.events(spark, d), oplog.probes(spark, d)),
    "kv_overwrites": _events(state.overwrites),
    "kv_tombstones": _events(state.tombstones),
    "kv_revived_keys": _events(state.revived),
    "kv_flush_generations": _runs(lambda r: r.select("seq", "generation", "flushed")),
    "kv_sstable_records": _tables(lambda t: t),
    "kv_sstable_index": _tables(gen.index),
    "kv_sstable_layout": _tables(gen.layout),
    "kv_manifest": _runs(gen.manifest),
    "kv_last_seq": _runs(gen.last_generation),
    "kv_search_result": _tables(lambda t: gen.search(t, ASKED)),
    "kv_merge_on_read": _runs(merge_on_read),
    "kv_read_amplification": _runs(gen.read_amplification),
    "kv_wal_recover": _runs(gen.residual),
    "kv_recover_state": lambda spark, d: reopened(spark, d).live(),
    "kv_wal_bytes": _runs(gen.log_bytes),
    "kv_record_sizes": _events(record_sizes),
    "kv_force_flush": _events(force_flush),
    "hash_fnv1a": _orders(hash_fnv1a),
    "hash_avalanche": _orders(hash_avalanche),
    "bloom_sizing": _tables(gen.filter_sizes),
    "bloom_probes": bloom_probes,
    "kv_bloom_build": _tables(bloom_build),
    "bloom_membership": bloom_membership,
    "kv_bloom_skips": lambda spark, d: gen.skips(gen.records(gen.numbered(oplog.events(spark, d), T)), oplog.probes(spark, d)),
    "ring_points": lambda spark, d: ring.points(spark, NODES).select("node", F.col("point").cast("string").alias("point")),
    "ring_route": lambda spark, d: ring.routed(oplog.orders(spark, d).select("key"), NODES),
    "ring_load": lambda spark, d: ring.load(oplog.orders(spark, d).select("key"), NODES),
    "kv_sharded_get": lambda spark, d: ring.sharded_get(oplog.events(spark, d), oplog.probes(spark, d), NODES),
    "parse_nodes": lambda spark, d: ring.parse_nodes(specs(spark)),
    "wire_encode": lambda spark, d: frames(oplog.probes(spark, d)),
    "wire_decode": wire_decode,
    "wire_dispatch": wire_dispatch,
    "bench_keys": _orders(lambda log: log.select("seq", workload.present_key(F.col("seq")).alias("hit"), workload.absent_key(F.col("seq")).alias("miss"))),
    "bench_random_values": _orders(random_values),
    "split_range": lambda spark, d: workload.split_range(spark, oplog.orders(spark, d).count(), PARTS),
    "bench_write_stats": _orders(workload.write_stats),
    "bench_generations": _orders(lambda log: workload.expected_generations(log, LOAD_THRESHOLD)),
    "bench_delete_sample": _orders(lambda log: workload.delete_sample(log, DELETE_SHARE).select("key")),
    "bench_read_plan": lambda spark, d: workload.read_plan(spark, oplog.orders(spark, d).count(), READS, MISS_RATE),
    "bench_read_stats": bench_read_stats,
    "bench_report": bench_report,
    "kv_stream_live_state": lambda spark, d: streaming.live_table(streaming.stream_events(spark, d)),
    # beyond the reference: its roadmap's compaction and snapshots
    "kv_compact": compacted,
    "kv_snapshot": _events(lambda log: state.snapshot(log, state.middle(log))),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.oracle_sql()
