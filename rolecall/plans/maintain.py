"""Maintenance of the posting table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import normalise_level
from ..operators.filters import clean_invalid
from ..operators.ids import renumber


def normalise_levels(postings: DataFrame) -> DataFrame:
    return postings.withColumn("experience_level", normalise_level(F.col("source"), F.col("experience_level")))


def normalise_levels_by_table(postings: DataFrame, levels: DataFrame) -> DataFrame:
    """``normalise_levels`` with the labels in a table ``source, label, band``."""
    wanted = levels.select(
        F.lower("source").alias("_source"), F.lower("label").alias("_label"), F.col("band").alias("_band")
    )
    keyed = postings.withColumn("_source", F.lower("source")).withColumn("_label", F.lower("experience_level"))
    return (
        keyed.join(wanted, ["_source", "_label"], "left")
        .withColumn("experience_level", F.coalesce("_band", "experience_level"))
        .drop("_source", "_label", "_band")
    )


def maintain(postings: DataFrame) -> DataFrame:
    """Invalid postings dropped, levels normalised, ids 1..N. Write it as a new version."""
    return renumber(normalise_levels(clean_invalid(postings)))
