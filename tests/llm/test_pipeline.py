"""The pipeline over a small folder, each stage against a plain version of it on its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from sediment.llm import common

from . import test_mixing, test_near_dup, test_packing, test_quality_rules
from .test_language_id import text as spoken
from .texts import DOCS, odd_rows


@pytest.fixture(scope="module")
def folder(spark):
    r = random.Random(0)
    rows = []
    for i in range(240):
        lang = ("en", "es", "ru")[i % 3]
        rows.append((100 + i, spoken(lang, i, 40 + i), lang, f"s{r.randrange(4)}", 1))
    rows += [(1000 + i, rows[i][1], rows[i][2], "copies", 1) for i in range(40)]  # exact copies
    rows += [(2000 + i, test_near_dup.edited(rows[200 + i][1], i, 1), rows[200 + i][2], "copies", 1) for i in range(30)]  # near copies
    rows += [(3000 + i, re.sub(r"(\w+)", r"\1###", spoken("en", 900 + i, 50)), "en", "s0", 1) for i in range(40)]  # junk
    rows += [(4000 + i, "1 2 3 4 5 6 7 8 9 10 11 12", None, "s1", 1) for i in range(3)]  # no letters
    rows += odd_rows()
    path = common.shared_path(spark, "pipeline-test")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(x[0], 0 if 3000 <= x[0] < 4000 else 1, 0) for x in rows if x[0] is not None and x[0] >= 100 and x[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def in_file_order(df):
    rows = df.select("*", "_metadata.file_path", "_metadata.row_index").collect()
    return sorted(rows, key=lambda r: (r.file_path, r.row_index))


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    docs = common.table(spark, folder, "documents")
    inputs = []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(as_rows(docs) if "text" in docs.columns else None)
        out = stage(spark, docs, folder)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == DOCS.names
        docs = common.written(out, "pipeline-test")
        if stage is corpus_pipeline.STAGES[-2][1]:
            ordered = in_file_order(docs)
    start, judged, spoken_, unique, mix = inputs

    def failed(t):
        b = test_quality_rules.brute(t)
        return b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"]

    assert not any(failed(r[1]) for r in judged)
    kept = Counter(judged)
    clean = [r for r in start if r[0] is not None and (100 <= r[0] < 3000) and not failed(r[1])]
    assert sum(kept[r] > 0 for r in clean) >= 0.98 * len(clean)
    assert not any(3000 <= (r[0] or 0) < 4000 for r in judged)
    assert {r[0] for r in judged} - {r[0] for r in spoken_} <= {4000, 4001, 4002, None, *range(1, 13)}
    assert not any(4000 <= (r[0] or 0) for r in spoken_)

    groups = {c: i for i, _, c in sorted(test_near_dup.brute(spoken_), key=lambda x: (x[0] is None, x[0] or 0), reverse=True)}
    assert sorted(r[0] for r in unique if r[0] is not None) == sorted(c for c in groups if c is not None)

    schedule = test_mixing.brute(unique, corpus_pipeline.mixing.BLOCK)
    times = Counter()
    for (doc_id, *_), n in schedule.items():
        times[doc_id] += n
    assert Counter(r[0] for r in mix) == times
    assert [r[0] for r in ordered] == [doc_id for _, _, doc_id in sorted(((slot, place, doc_id) for doc_id, _, _, slot, place in schedule), key=lambda x: x[:2])]

    result = docs.collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(test_packing.p.tokenizer_path())
    want = test_packing.brute_pieces(mix, lambda x: t.encode(x, add_special_tokens=False).ids, test_packing.p.CAPACITY)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in result) == want
    # the mix's order reaches the sequences: each row's number in it
    assert sorted({r.position for r in result}) == list(range(len(mix)))
    assert [i for _, i in sorted({(r.position, r.doc_id) for r in result}, key=lambda x: x[0])] == [r[0] for r in ordered]
    total = sum(k[3] * n for k, n in want.items())
    assert test_packing.checked(result, test_packing.p.CAPACITY) <= -(-total // test_packing.p.CAPACITY) + 1


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "position", "sequence_id", "offset"] and out.count() > 200
