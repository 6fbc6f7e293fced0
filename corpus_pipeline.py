"""From raw documents to packed sequences: classify, drop repeated lines and near duplicates, decontaminate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import stages
from marginalia.llm.common import materialise, table

STAGES = [
    ("quality", stages.keep_good),
    ("lines", stages.drop_lines),
    ("near_duplicates", stages.keep_first),
    ("decontaminate", stages.drop_leaks),
    ("pack", stages.pack),
]

#: A classifier's scores have no SQL form; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the Parquet that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
