"""From documents to training tokens: stages in order, each over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packaudit.llm.common import stored
from packaudit.llm.stages import STAGES

#: SQL cannot express the stages (fitted classifier, span mapping, tokenizer): tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the last stage; what every stage before it returns is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
