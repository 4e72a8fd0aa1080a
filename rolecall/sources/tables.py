"""The posting table: reading and writing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..schema import POSTING_SCHEMA


def read_postings(
    spark: SparkSession, path: str, sources: list[str] | None = None, since: dt.date | str | None = None
) -> DataFrame:
    """Postings stored as Parquet, with the fixed schema; nothing is inferred.

    ``sources`` (in any case; "" for postings without one) opens only the folders of these sources of a table
    that ``write_postings`` has written; ``since`` keeps postings of that day and later and skips
    row groups that end before it.
    """
    if sources is None:
        stored = spark.read.schema(POSTING_SCHEMA).parquet(path)
    else:
        schema = T.StructType([*POSTING_SCHEMA, T.StructField("source_key", T.StringType())])
        wanted = [s.lower() for s in sources]
        # an empty key is written as the null partition
        key = F.coalesce("source_key", F.lit("")) if "" in wanted else F.col("source_key")
        stored = spark.read.schema(schema).parquet(path).filter(key.isin(wanted))
    if since is not None:
        stored = stored.filter(F.col("posted_date") >= F.lit(str(since)).cast("date"))
    return stored.select(*POSTING_SCHEMA.names)


def read_postings_jdbc(spark: SparkSession, **options: str) -> DataFrame:
    """Postings from a relational table; the caller passes every connection option.

    Vectors are stored there as JSON text; an unreadable one becomes NULL. Give
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to
    read a large table in parallel.
    """
    return typed(spark.read.format("jdbc").options(**options).load())


def typed(df: DataFrame) -> DataFrame:
    """Columns cast to the posting schema, JSON vectors parsed."""
    if dict(df.dtypes).get("embedding") == "string":
        df = df.withColumn("embedding", vectors.from_json(F.col("embedding")))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in POSTING_SCHEMA])


def write_postings(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by source, newest together, so that date filters skip row groups."""
    stored = df.withColumn("source_key", F.coalesce(F.lower("source"), F.lit("")))
    stored.sortWithinPartitions("source_key", F.desc("posted_date")).write.mode(mode).partitionBy(
        "source_key"
    ).parquet(path)
