"""Dropping rows that a stage rejects, with every other row and column left as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm import rows
from rolecall.session import staged


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row, and that column: the id if it can, or a stored row number."""
    if rows.names_rows(docs, id_col):
        return docs, id_col
    name = next(c for c in ("_row", "_row_no", "_row_number", "_row_of_stage") if c not in docs.columns)
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without(docs: DataFrame, id_col: str, rejected: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
    """Rows whose key ``rejected(keyed)`` doesn't return; ``keyed`` has ``_key`` and ``text``."""
    named, name = numbered(docs, id_col)
    out = rejected(named.select(F.col(name).cast("long").alias("_key"), F.col(text_col).alias("text"))).select(F.col("_key").alias(name)).distinct()
    return named.join(out, name, "left_anti").select(*docs.columns)
