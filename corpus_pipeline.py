"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import pipeline
from lumenfold.llm.common import settle, table

STAGES = [
    ("language", pipeline.language),
    ("near_dedup", pipeline.near_dedup),
    ("decontamination", pipeline.decontaminate),
    ("mixing", pipeline.mixture),
    ("tokens", pipeline.tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows settled before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
