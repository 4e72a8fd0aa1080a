"""Row identity, staging and sizing shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.session import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names_rows(rows: DataFrame, id_col: str) -> bool:
    """True if the ids are whole numbers, never null and never repeated, so that they can be keys."""
    if not isinstance(rows.schema[id_col].dataType, T.IntegralType):
        return False
    ids = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col(id_col)).alias("d")).first()
    return ids.n == ids.d


def keyed(rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``columns`` with ``_key``, a long that names each row, and the id as ``_id``.

    Whole numbers that are unique and never null are the key themselves. With other ids
    (texts, repeated ones, nulls) the rows are written to the shared folder with a number
    each: a lost executor reads the same numbers again, so every row stays a row of its own.
    Other columns of ``rows`` don't take part, whatever their names.
    """
    picked = [F.col(c) for c in columns]
    if names_rows(rows, id_col):
        return rows.select(F.col(id_col).cast("long").alias("_key"), F.col(id_col).alias("_id"), *picked)
    numbered = rows.select(F.monotonically_increasing_id().alias("_key"), F.col(id_col).alias("_id"), *picked)
    return staged(numbered, "keyed")


def parts(rows: DataFrame) -> int:
    """Partitions of the input as read; grows with its size."""
    return max(1, rows.rdd.getNumPartitions())


def shards(count: int, most: int) -> int:
    """Groups needed for ``count`` rows of about ``most`` each."""
    return max(1, math.ceil(count / most))


def training(id_col: str, modulus: int, held: int) -> F.Column:
    """True where crc32 of the id as text leaves another remainder than ``held``; a null id trains."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus != held, F.lit(True))
