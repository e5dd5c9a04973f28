"""The corpus pipeline: STAGES, each a function of (spark, docs, sf_dir) over what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdant.llm import decontaminate, line_dedup, mixture, ngram_join, quality_rules
from verdant.llm._shared import Scratch

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mix_sources", mixture.stage),
]

#: The first stage's posterior comes from expectation-maximisation, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
