"""The training-data pipeline over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import Scratch, read_table
from plumbline.llm.stages import STAGES

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each to the written result of the one before."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
