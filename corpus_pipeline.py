"""The corpus pipeline: whole-table stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's rows to the shared folder and gives them to the next one. All stages but the
last return the columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolecall.llm.bagminhash import near_duplicate_stage
from rolecall.llm.decontaminate import decontamination_stage
from rolecall.llm.langid import language_stage
from rolecall.llm.lpf_dedup import repeats_stage
from rolecall.llm.packing import packing_stage
from rolecall.llm.rows import table
from rolecall.session import fresh_dir, staging

STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("suffix_dedup", repeats_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Best-fit packing depends on every earlier placement, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what a stage has stored on its way goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
