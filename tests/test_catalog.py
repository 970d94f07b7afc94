"""Every query of the catalog against its SQL, at the smallest scale; and the frames against a plain encoder."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sediment.functions import codec
from sediment.plans import catalog, sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = sql.oracle_sql()


def normal(frame):
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(([cell(v) for v in r] for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


def test_every_query_has_sql():
    assert set(ORACLES) == set(catalog.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def plain(kind, *parts):
    body = bytes([kind]) + b"".join(len(p).to_bytes(4, "little") + p if isinstance(p, bytes) else bytes([p]) for p in parts)
    return (len(body).to_bytes(4, "little") + body).hex().upper()


def test_frames(spark):
    df = spark.createDataFrame([("hello", "world"), ("", "a\0b"), ("é", "x" * 70000)], "key string, value string")
    k, v = F.col("key"), F.col("value")
    for r in df.select("key", "value", codec.put_request(k, v).alias("a"), codec.get_request(k).alias("b"), codec.delete_request(k).alias("c"), codec.get_response(F.lit(True), v).alias("d"), codec.get_response(F.lit(False), v).alias("e"), codec.error_response(v).alias("f")).collect():
        key, value = r.key.encode(), r.value.encode()
        assert (r.a, r.b, r.c) == (plain(1, key, value), plain(2, key), plain(3, key))
        assert (r.d, r.e, r.f) == (plain(0x82, 1, value), plain(0x82, 0, b""), plain(0xFF, value))
    back = df.select("key", "value", codec.decode(F.substring(codec.put_request(k, v), 9, 1 << 30)).alias("m")).collect()
    assert [(bytes.fromhex(r.m.key_hex).decode(), bytes.fromhex(r.m.value_hex).decode()) for r in back] == [(r.key, r.value) for r in back]


def test_point_get_filters_the_scan(spark):
    plan = catalog.queries()["kv_get_point"](spark, SF)._jdf.queryExecution().toString()
    assert "user_7" in plan.split("Physical Plan")[-1].split("Aggregate")[-1]
