"""A corpus pipeline: five stages over ``documents``, each a thin call of an operator in seriesloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next stage's docs. All but the last return the columns they were given; the last adds the place in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import decontaminate, mixing, near_dedup, quality, secret_scan
from seriesloom.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the thresholds of their language and source go."""
    judged = quality.judge(materialise(quality.measure(docs), "figures"))
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word shingle similarity of 0.8 or more stays, the least doc_id."""
    return near_dedup.deduplicate(docs, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    model = secret_scan.fit_forest(secret_scan.labelled_findings(spark))
    return secret_scan.redact(docs, model)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix of sources."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secrets),
    ("source_mix", source_mix),
]

#: Bit-parallel matching and the random forest can't be said in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
