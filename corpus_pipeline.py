"""The corpus pipeline: stages over documents, each one operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silkmill.llm import stages

#: (name, function); a function takes (spark, docs, sf_dir), its result is the next one's docs.
STAGES = stages.STAGES

#: Language models, fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    return stages.run(spark, sf_dir)
