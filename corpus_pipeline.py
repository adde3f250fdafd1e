"""A training corpus from documents, in five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontaminate, jaccard, lines, packing, quality
from spindrift.llm.common import drop, made, table, written

def _in_turn(stage):
    """The stage, after the tables of the one before have gone: its result has been written when the next one begins."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, *made.last)
        made.last, before = [], list(made.paths)
        try:
            return stage(spark, docs, sf_dir)
        finally:  # also of a stage that fails
            made.last = [p for p in made.paths if p not in before]

    return run_stage


#: (name, function); a function takes (spark, docs, sf_dir).  All but the last return the columns of documents.
STAGES = [
    ("quality_classifier", _in_turn(quality.stage)),
    ("line_dedup", _in_turn(lines.stage)),
    ("ngram_jaccard_join", _in_turn(jaccard.stage)),
    ("benchmark_decontamination", _in_turn(decontaminate.stage)),
    ("packing", _in_turn(packing.stage)),
]

#: The stages are not expressible in SQL; tests/llm/test_pipeline.py compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Of the stages' tables the last one stays; a run that fails leaves none."""
    before, docs = list(made.paths), table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES:
            done, docs = docs, written(stage(spark, docs, sf_dir), name)
            if hasattr(done, "_scratch"):
                drop(spark, done)
    except BaseException:
        drop(spark, *(p for p in made.paths if p not in before))
        raise
    return docs
