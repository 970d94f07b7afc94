"""The corpus pipeline: quality rules, language ID, MinHash near-dedup, mixing sources, best-fit packing.

Each stage takes all that its predecessor kept. All but the last return the columns of documents; the mix repeats a
document's row for each epoch that uses it, in the order of the mix.
"""

from __future__ import annotations

from sediment.llm import common, language_id, mixing, near_dup, packing, quality_rules

STAGES = [
    ("quality rules", quality_rules.stage),
    ("language ID", language_id.stage),
    ("MinHash near-dedup", near_dup.pipeline_stage),
    ("mixing sources to target weights", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: An isolation forest and a learned language model are no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over documents; what each stage keeps is a written table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
