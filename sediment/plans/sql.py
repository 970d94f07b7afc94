"""DuckDB SQL for the queries of the catalog, written apart from their Spark plans."""

from __future__ import annotations

from . import catalog as c

OPS = """ops AS (SELECT event_id AS seq, 'user_' || user_id AS key, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events)"""
LAST = "last AS (SELECT key, arg_max(op, seq) AS op, arg_max(struct_pack(v := value), seq).v AS value, max(seq) AS seq FROM ops GROUP BY key)"
LIVE = f"{OPS}, {LAST}, live AS (SELECT key, value FROM last WHERE op = 1)"
PROBES = """probes AS (SELECT DISTINCT 'user_' || user_id AS key FROM events
  UNION SELECT DISTINCT 'miss_' || user_id FROM events WHERE user_id % 6 = 0)"""
LOAD = "load AS (SELECT o_orderkey AS seq, 'key_' || o_orderkey AS key, o_orderstatus || ':' || o_orderpriority AS value FROM orders)"
# the flush fold, one op a step: m and d are the keys and deletes that wait
RUNS = f"""{OPS}, numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM ops),
fold AS (
  SELECT 0::BIGINT AS rn, 0::BIGINT AS g, []::VARCHAR[] AS m, []::VARCHAR[] AS d, 0::BIGINT AS following
  UNION ALL
  SELECT rn, g, CASE WHEN hit THEN [] ELSE m END, CASE WHEN hit THEN [] ELSE d END, CASE WHEN hit THEN g + 1 ELSE g END
  FROM (SELECT *, CASE WHEN op = 1 THEN len(m) >= {c.T} ELSE len(m) + len(d) >= {c.T} END AS hit FROM (
    SELECT n.rn, f.following AS g, n.op,
      CASE WHEN n.op = 1 THEN CASE WHEN list_contains(f.m, n.key) THEN f.m ELSE list_append(f.m, n.key) END ELSE list_filter(f.m, lambda x: x <> n.key) END AS m,
      CASE WHEN n.op = 2 THEN CASE WHEN list_contains(f.d, n.key) THEN f.d ELSE list_append(f.d, n.key) END ELSE list_filter(f.d, lambda x: x <> n.key) END AS d
    FROM fold f JOIN numbered n ON n.rn = f.rn + 1))
),
runs AS (SELECT n.seq, n.key, n.op, n.value, f.g AS generation, f.g < (SELECT arg_max(following, rn) FROM fold) AS flushed FROM numbered n JOIN fold f ON n.rn = f.rn)"""
TABLES = f"""{RUNS}, tables AS (SELECT generation, key, arg_max(op, seq) AS op, arg_max(struct_pack(v := value), seq).v AS value FROM runs WHERE flushed GROUP BY generation, key),
rest AS (SELECT key, arg_max(op, seq) AS op, arg_max(struct_pack(v := value), seq).v AS value FROM runs WHERE NOT flushed GROUP BY key)"""


def size(x: str) -> str:
    return f"coalesce(octet_length(encode({x})), 0)"


SST = f"CASE WHEN op = 1 THEN 9 + {size('key')} + {size('value')} ELSE 5 + {size('key')} END"
WAL = f"CASE WHEN op = 1 THEN 17 + {size('key')} + {size('value')} ELSE 13 + {size('key')} END"
_WORD = "18446744073709551616::UHUGEINT"


def fnv(x: str, seed: int = 0) -> str:
    basis = 1469598103934665603 ^ seed
    byte = f"('0x' || substr(hex(encode({x})), 2 * i::INT + 1, 2))::UTINYINT::UHUGEINT"
    return f"list_reduce(list_transform(range(octet_length(encode({x}))), lambda i: {byte}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_WORD}, {basis}::UHUGEINT)"


def mixed(h: str) -> str:
    """The finaliser, in nested one-column steps."""
    step = f"SELECT (xor(h, h >> 33) * {0xFF51AFD7ED558CCD}::UHUGEINT) % {_WORD} AS h FROM (SELECT {h} AS h)"
    step = f"SELECT (xor(h, h >> 33) * {0xC4CEB9FE1A85EC53}::UHUGEINT) % {_WORD} AS h FROM ({step})"
    return f"(SELECT xor(h, h >> 33) FROM ({step}))"


def probe(h1: str, h2: str, i: str, bits: str) -> str:
    return f"((({h1} + {i}::UHUGEINT * {h2}) % {_WORD}) % {bits}::UHUGEINT)::BIGINT"


NODE_LIST = ", ".join(f"('{n}')" for n in c.NODES)
RING = f"ring AS (SELECT node, {mixed(fnv('node'))} AS point FROM (VALUES {NODE_LIST}) AS t(node))"


def routed(rows: str) -> str:
    """routes: key, node for rows (a relation with a key)."""
    return f"""{RING}, hashed AS (SELECT key, {mixed(fnv('key'))} AS h FROM (SELECT DISTINCT key FROM {rows})),
routes AS (SELECT key, coalesce((SELECT arg_min(node, point) FROM ring WHERE point >= h), (SELECT arg_min(node, point) FROM ring)) AS node FROM hashed)"""


def u32(n: str) -> str:
    return f"printf('%02X%02X%02X%02X', ({n}) & 255, (({n}) >> 8) & 255, (({n}) >> 16) & 255, (({n}) >> 24) & 255)"


def counted(x: str) -> str:
    return f"{u32(size(x))} || hex(encode({x}))"


def frame(kind: int, *parts: str) -> str:
    body = " || ".join([f"'{kind:02X}'", *parts])
    return f"({u32(f'length({body}) // 2')} || {body})"


def values(xs: list[str]) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in xs)


def number(at: str) -> str:
    return f"('0x' || substr(p, {at} + 6, 2) || substr(p, {at} + 4, 2) || substr(p, {at} + 2, 2) || substr(p, {at}, 2))::BIGINT"


def field(at: str) -> str:
    """Hex of counted bytes at a place, or null."""
    return f"CASE WHEN length(p) >= {at} + 7 AND length(p) >= {at} + 7 + 2 * {number(at)} THEN substr(p, {at} + 8, 2 * {number(at)}) END"


DECODE = f"""d AS (SELECT *, CASE WHEN length(p) >= 2 THEN ('0x' || substr(p, 1, 2))::INT END AS kind, {field('3')} AS first, {field('5')} AS behind FROM src),
d2 AS (SELECT *, CASE WHEN first IS NOT NULL THEN {field("(11 + length(first))")} END AS second FROM d),
decoded AS (SELECT *, CASE WHEN kind = 1 THEN first IS NOT NULL AND second IS NOT NULL WHEN kind IN (2, 3) THEN first IS NOT NULL WHEN kind IN (129, 131) THEN length(p) >= 4
  WHEN kind = 130 THEN length(p) >= 4 AND behind IS NOT NULL WHEN kind = 255 THEN first IS NOT NULL ELSE false END AS ok FROM d2)"""

SPEC_ENTRIES = f"""specs AS (SELECT spec FROM (VALUES {values(c.SPECS)}) AS t(spec)),
e AS (SELECT spec, unnest(list_filter(string_split(spec, ','), lambda x: x <> '')) AS entry, generate_subscripts(list_filter(string_split(spec, ','), lambda x: x <> ''), 1) - 1 AS n FROM specs),
f AS (SELECT spec, n, string_split(entry, ':') AS parts FROM e),
g AS (SELECT spec, n, parts[1] AS node, parts[2] AS host, regexp_extract(coalesce(parts[3], ''), '^\\s*\\+?(\\d{{1,18}})', 1) AS digits FROM f),
bad AS (SELECT DISTINCT spec FROM g WHERE coalesce(node, '') = '' OR coalesce(host, '') = '' OR digits = '')"""

MISSES = int(c.READS * c.MISS_RATE + 0.5)
HITS = c.READS - MISSES
PLAN = f"""n AS (SELECT count(*) AS n FROM orders),
plan AS (SELECT i AS n, CASE WHEN i < {HITS} THEN 'key_' || (((i * 7 + 42) * 2654435761) % 4294967296 % n.n) ELSE 'miss_' || (i - {HITS}) END AS key FROM range({c.READS}) AS r(i), n)"""
GONE = f"gone AS (SELECT key FROM load ORDER BY (seq * 2654435761) % 4294967296, seq LIMIT (SELECT floor(count(*) * {c.DELETE_SHARE})::BIGINT FROM orders))"
WRITES = f"SELECT count(*) AS write_ops, coalesce(sum({size('value')}), 0)::BIGINT AS total_value_bytes, CASE WHEN count(*) > 0 THEN sum({size('value')})::DOUBLE / count(*)::DOUBLE ELSE 0.0 END AS avg_value_bytes FROM load"
READS = f"""SELECT count(*) AS read_ops, sum(hit)::BIGINT AS read_hits, (count(*) - sum(hit))::BIGINT AS read_misses, (count(*) - sum(hit))::DOUBLE / count(*)::DOUBLE AS miss_rate_observed
FROM (SELECT (p.key IN (SELECT key FROM load) AND p.key NOT IN (SELECT key FROM gone))::BIGINT AS hit FROM plan p)"""


def oracle_sql() -> dict[str, str]:
    live = f"WITH {LIVE} SELECT key, value FROM live"
    rec = f"WITH RECURSIVE {TABLES} "
    filters = f"""sizes AS (SELECT generation, greatest(count(*) * 10, 64) AS bits FROM tables GROUP BY generation),
kh AS (SELECT key, {fnv('key')} AS h1, {fnv('key', 0x9E3779B97F4A7C15)} AS h2 FROM (SELECT DISTINCT key FROM tables)),
setbits AS (SELECT DISTINCT t.generation, {probe('h1', 'h2', 'i', 'bits')} AS bit FROM tables t JOIN sizes USING (generation) JOIN kh USING (key), range(5) AS r(i))"""
    asked = f"ph AS (SELECT key, {fnv('key')} AS h1, {fnv('key', 0x9E3779B97F4A7C15)} AS h2 FROM probes)"
    message = lambda text: f"'{frame_of(0xFF, text)}'"
    return {
        "kv_live_state": live,
        "kv_get_point": f"WITH {LIVE} SELECT key, value FROM live WHERE key = 'user_7'",
        "kv_multi_get": f"WITH {LIVE}, {PROBES} SELECT p.key, l.key IS NOT NULL AS found, coalesce(l.value, '') AS value FROM probes p LEFT JOIN live l USING (key)",
        "kv_overwrites": f"WITH {OPS} SELECT key, count(*) AS puts, arg_min(value, seq) AS first_value, arg_max(value, seq) AS last_value FROM ops WHERE op = 1 GROUP BY key",
        "kv_tombstones": f"WITH {OPS}, {LAST} SELECT key, seq FROM last WHERE op = 2",
        "kv_revived_keys": f"WITH {OPS}, b AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS before FROM ops) SELECT key, count(*) AS revivals, max(seq) AS last_seq FROM b WHERE op = 1 AND before = 2 GROUP BY key",
        "kv_flush_generations": f"WITH RECURSIVE {RUNS} SELECT seq, generation, flushed FROM runs",
        "kv_sstable_records": rec + "SELECT generation, key, op, value FROM tables",
        "kv_sstable_index": rec + f"SELECT generation, key, coalesce(sum({SST}) OVER (PARTITION BY generation ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM tables".replace(" AS offset", ' AS "offset"'),
        "kv_sstable_layout": rec + f"SELECT generation, count(*) AS records, sum((op = 2)::BIGINT)::BIGINT AS tombstones, sum({SST})::BIGINT AS data_bytes, sum(12 + {size('key')})::BIGINT AS index_bytes, (sum({SST}) + sum(12 + {size('key')}) + 20)::BIGINT AS file_bytes FROM tables GROUP BY generation",
        "kv_manifest": rec + "SELECT DISTINCT generation, printf('%06d.sst', generation) AS filename, generation || ',' || printf('%06d.sst', generation) AS line FROM runs WHERE flushed",
        "kv_last_seq": rec + "SELECT coalesce(max(generation), 0)::BIGINT AS last_seq FROM runs WHERE flushed",
        "kv_search_result": rec + f"SELECT g.generation, k.key, t.op IS NOT NULL AS found, coalesce(t.op = 2, false) AS is_tombstone, coalesce(t.value, '') AS value FROM (SELECT DISTINCT generation FROM tables) g CROSS JOIN (VALUES {values(c.ASKED)}) AS k(key) LEFT JOIN tables t ON t.generation = g.generation AND t.key = k.key",
        "kv_merge_on_read": live,
        "kv_read_amplification": rec + ", newest AS (SELECT max(generation) AS m FROM tables) SELECT key, CASE WHEN bool_or(NOT flushed) THEN 0 ELSE any_value(m) - max(generation) + 1 END::BIGINT AS runs_visited FROM runs, newest GROUP BY key",
        "kv_wal_recover": rec + "SELECT key, op, value FROM rest",
        "kv_recover_state": live,
        "kv_wal_bytes": rec + f"SELECT generation, count(*) AS ops, sum({WAL})::BIGINT AS wal_bytes FROM runs GROUP BY generation",
        "kv_record_sizes": f"WITH {OPS} SELECT seq, ({WAL})::BIGINT AS wal_bytes, ({SST})::BIGINT AS sst_bytes FROM ops",
        "kv_force_flush": f"WITH {OPS}, g AS (SELECT seq // {c.FORCE_EVERY} AS generation, key, arg_max(op, seq) AS op FROM ops WHERE seq // {c.FORCE_EVERY} < (SELECT count(*) // {c.FORCE_EVERY} FROM ops) GROUP BY ALL) SELECT generation, count(*) AS records, sum((op = 2)::BIGINT)::BIGINT AS tombstones FROM g GROUP BY generation",
        "hash_fnv1a": f"WITH {LOAD} SELECT key, ({fnv('key')})::VARCHAR AS h1, ({fnv('key', 0x9E3779B97F4A7C15)})::VARCHAR AS h2 FROM load",
        "hash_avalanche": f"WITH {LOAD} SELECT key, {mixed(fnv('key'))}::VARCHAR AS h FROM load",
        "bloom_sizing": rec + "SELECT generation, count(*) AS keys, greatest(count(*) * 10, 64)::BIGINT AS bits FROM tables GROUP BY generation",
        "bloom_probes": f"WITH {PROBES}, {asked} SELECT key, i::INT AS probe, {probe('h1', 'h2', 'i', str(c.FILTER_BITS))} AS bit FROM ph, range(5) AS r(i)",
        "kv_bloom_build": rec + f", {filters} SELECT generation, count(*) AS set_bits FROM setbits GROUP BY generation",
        "bloom_membership": f"""WITH {LIVE}, {PROBES}, {asked}, b AS (SELECT greatest(count(*) * 10, 64) AS bits FROM live),
lh AS (SELECT {fnv('key')} AS h1, {fnv('key', 0x9E3779B97F4A7C15)} AS h2 FROM live),
setbits AS (SELECT DISTINCT {probe('h1', 'h2', 'i', 'bits')} AS bit FROM lh, b, range(5) AS r(i))
SELECT key, bool_and({probe('h1', 'h2', 'i', 'bits')} IN (SELECT bit FROM setbits)) AS maybe, bool_or(key IN (SELECT key FROM live)) AS present FROM ph, b, range(5) AS r(i) GROUP BY key""",
        "kv_bloom_skips": rec + f""", {PROBES}, {asked}, {filters},
hits AS (SELECT p.key, s.generation, bool_and(b.bit IS NOT NULL) AS maybe FROM ph p CROSS JOIN sizes s CROSS JOIN range(5) AS r(i)
  LEFT JOIN setbits b ON b.generation = s.generation AND b.bit = {probe('h1', 'h2', 'i', 's.bits')} GROUP BY p.key, s.generation)
SELECT p.key, (SELECT count(*) FROM sizes) AS runs, (SELECT count(*) FROM hits h WHERE h.key = p.key AND NOT h.maybe) AS skipped FROM ph p""",
        "ring_points": f"WITH {RING} SELECT node, point::VARCHAR AS point FROM ring",
        "ring_route": f"WITH {LOAD}, {routed('load')} SELECT key, node FROM routes",
        "ring_load": f"WITH {LOAD}, {routed('load')} SELECT node, count(*) AS keys FROM routes GROUP BY node",
        "kv_sharded_get": f"WITH {LIVE}, {PROBES}, {routed('probes')} SELECT r.key, r.node, l.key IS NOT NULL AS found, coalesce(l.value, '') AS value FROM routes r LEFT JOIN live l USING (key)",
        "parse_nodes": f"WITH {SPEC_ENTRIES} SELECT spec, n::BIGINT AS n, node, host, (digits::BIGINT % 65536)::BIGINT AS port FROM g WHERE spec NOT IN (SELECT spec FROM bad)",
        "wire_encode": f"""WITH {PROBES} SELECT key, {frame(1, counted('key'), counted("('v_' || key)"))} AS put_request, {frame(2, counted('key'))} AS get_request, {frame(3, counted('key'))} AS delete_request,
{frame(0x81, "'01'")} AS put_response, CASE WHEN key LIKE 'user%' THEN {frame(0x82, "'01'", counted("('v_' || key)"))} ELSE {frame(0x82, "'00'", counted("''"))} END AS get_response,
{frame(0x83, "'00'")} AS delete_response, {frame(0xFF, counted("('compute node ' || key || ' unreachable')"))} AS error_response FROM probes""",
        "wire_decode": f"""WITH src AS (SELECT (row_number() OVER () - 1)::INT AS case_id, p FROM (VALUES {values(c.PAYLOADS)}) AS t(p)), {DECODE}
SELECT case_id, ok, CASE WHEN ok THEN kind ELSE 0 END AS msg_type, CASE WHEN ok AND kind IN (1, 2, 3) THEN first END AS key_hex, CASE WHEN ok AND kind = 1 THEN second WHEN ok AND kind = 130 THEN behind END AS value_hex,
CASE WHEN ok AND kind IN (129, 130, 131) THEN substr(p, 3, 2) <> '00' END AS flag, CASE WHEN ok AND kind = 255 THEN first END AS message_hex FROM decoded""",
        "wire_dispatch": f"""WITH {LIVE}, {PROBES}, requests AS (SELECT key, unnest([{frame(2, counted('key'))}, {frame(1, counted('key'), counted("'x'"))}, {frame(3, counted('key'))}, {frame(0x81, "'01'")}, '0100000077']) AS frame, unnest([2, 1, 3, 129, NULL]) AS kind FROM probes)
SELECT frame, r.key, CASE WHEN kind < 4 THEN r.key END AS routing_key,
CASE kind WHEN 2 THEN CASE WHEN l.key IS NULL THEN {frame(0x82, "'00'", counted("''"))} ELSE {frame(0x82, "'01'", counted('l.value'))} END WHEN 1 THEN {frame(0x81, "'01'")} WHEN 3 THEN {frame(0x83, "'01'")} WHEN 129 THEN {message('unexpected message type for a request')} END AS node_answer,
CASE WHEN kind < 4 THEN NULL ELSE {message('malformed or non-request message')} END AS leader_answer FROM requests r LEFT JOIN live l USING (key)""",
        "bench_keys": "SELECT o_orderkey AS seq, 'key_' || o_orderkey AS hit, 'miss_' || o_orderkey AS miss FROM orders",
        "bench_random_values": f"""WITH {LOAD}, s AS (SELECT key, seq, {c.VALUE_SIZES[0]} + ((seq * 31 + {c.SEED}) * 2654435761 % 4294967296) % {c.VALUE_SIZES[1] - c.VALUE_SIZES[0] + 1} AS size FROM load)
SELECT key, coalesce(array_to_string(list_transform(range(1, size + 1), lambda k: substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',
  (1 + (((seq * 1031 + k * 7 + {c.SEED}) * 2654435761 % 4294967296) >> 8) % 62)::INT, 1)), ''), '') AS value FROM s""",
        "split_range": f"WITH n AS (SELECT count(*) AS n FROM orders) SELECT p AS part, (p * (n // {c.PARTS}) + least(p, n % {c.PARTS}))::BIGINT AS start, ((p + 1) * (n // {c.PARTS}) + least(p + 1, n % {c.PARTS}))::BIGINT AS stop FROM n, range({c.PARTS}) AS r(p)",
        "bench_write_stats": f"WITH {LOAD} {WRITES}",
        "bench_generations": f"SELECT (o_orderkey // {c.LOAD_THRESHOLD})::BIGINT AS generation, count(*) AS records FROM orders GROUP BY ALL",
        "bench_delete_sample": f"WITH {LOAD}, {GONE} SELECT key FROM gone",
        "bench_read_plan": f"WITH {PLAN} SELECT n, key FROM plan",
        "bench_read_stats": f"WITH {LOAD}, {GONE}, {PLAN} {READS}",
        "bench_report": f"""WITH {LOAD}, {GONE}, {PLAN}, w AS ({WRITES}), r AS ({READS})
SELECT upper(metric) AS metric, value::DOUBLE AS value FROM (UNPIVOT (SELECT write_ops::DOUBLE AS write_ops, total_value_bytes::DOUBLE AS total_value_bytes, avg_value_bytes, read_ops::DOUBLE AS read_ops, read_hits::DOUBLE AS read_hits, read_misses::DOUBLE AS read_misses, miss_rate_observed FROM w, r) ON COLUMNS(*) INTO NAME metric VALUE value)""",
        "kv_stream_live_state": live,
        "kv_compact": live,
        "kv_snapshot": f"WITH {LIVE.replace('FROM events)', 'FROM events WHERE event_id <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events))')} SELECT key, value FROM live",
    }


def frame_of(kind: int, text: str) -> str:
    body = bytes([kind]) + len(text).to_bytes(4, "little") + text.encode()
    return (len(body).to_bytes(4, "little") + body).hex().upper()
