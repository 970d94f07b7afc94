"""Every query of this subpackage at the smallest scale: its contract's columns, and its SQL where there is one."""

import os

import duckdb
import pytest
from sediment.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op2_near_dup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op5_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_mixing": {"doc_id": "bigint", "source": "string", "epoch": "bigint", "slot": "bigint", "place": "int"},
    "op7_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_ten_queries():
    assert set(queries.queries()) == set(COLUMNS) and set(queries.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {k: kinds.get(k) for k in COLUMNS[name]} == COLUMNS[name]
    got = df.toPandas()
    assert len(got)
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        cells = lambda f: sorted(tuple(None if v is None or v != v else v if isinstance(v, str) else int(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
        rows = lambda f: sorted(map(repr, cells(f)))
        assert rows(got.fillna(-1)) == rows(want.fillna(-1))
