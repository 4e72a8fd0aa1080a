"""Resume files: intake rules and text assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise

# Accepted file types and the size limit.
EXTENSIONS = r"(?i)\.(pdf|docx)$"
MAX_BYTES = 5 * 1024 * 1024


def list_uploads(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def reject_reason(path: Column, length: Column) -> Column:
    """NULL for an accepted file; checked in the order missing, name, type, size."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(path.isNull(), "No file uploaded")
        .when(name == "", "No file selected")
        .when(~name.rlike(EXTENSIONS), "Only PDF or DOCX files are allowed")
        .when(length > MAX_BYTES, "File size should be less than 5MB")
    )


def route_uploads(files: DataFrame) -> DataFrame:
    """Adds ``status`` (accepted or rejected) and ``reason``."""
    reason = reject_reason(F.col("path"), F.col("length"))
    return files.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    )


def assemble_text(
    parts: DataFrame, key: str, order: str, text: str, out: str = "text", keep_empty: bool = False
) -> DataFrame:
    """One lower-cased, trimmed text per document from its parts in order.

    Empty paragraphs are left out; ``keep_empty`` keeps an empty page as an empty
    line. A document without text gives "". The parts of one document become one
    value, so they meet in one row whatever the plan.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    part = F.when(F.lit(keep_empty) | (filled != ""), F.struct(F.col(order).alias("o"), filled.alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n")
    return parts.groupBy(key).agg(normalise(joined).alias(out))
