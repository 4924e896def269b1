"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontamination, mixing, sharding, simhash, toxicity
from tessella.llm.common import drop_tables, made, materialise, release, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash", simhash.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: The toxicity classifier and SimHash can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote for itself goes once its result is written, and its input too."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = made()
        result = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = docs, materialise(result, f"pipeline-{name}")
            release(spark, mark, keep=(docs,))
            drop_tables(before)
        else:
            docs = result
    return docs
