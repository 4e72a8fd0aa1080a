"""Join of two tables on bands of years that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band_bins


def overlapping_bands(left: DataFrame, right: DataFrame) -> DataFrame:
    """``low, high, other_low, other_high`` of the distinct bands (``low, high``) of both sides that share a year.

    An equi-join on bins: each band goes to at most two bins of the size of its own
    length and of every larger size in use, and a pair counts in the larger band's first
    shared bin only. A band of any length makes few rows, and no pair is compared twice.
    """
    bands = lambda df: df.select(F.col("low").cast("long"), F.col("high").cast("long")).filter("low <= high").distinct()
    a, b = bands(left), bands(right).toDF("other_low", "other_high")
    length = lambda df, low, high: df.agg(F.max(F.expr(f"{high} - {low}")).alias("n")).first().n or 0
    levels = max(length(a, "low", "high"), length(b, "other_low", "other_high")).bit_length()
    bins = lambda df, low, high: df.withColumn("at", F.explode(band_bins(F.col(low), F.col(high), levels)))
    level = lambda low, high: F.ceil(F.log2((F.col(high) - F.col(low) + 1).cast("double"))).cast("int")
    pairs = bins(a, "low", "high").join(bins(b, "other_low", "other_high"), "at")
    shared = F.greatest(F.col("low"), F.col("other_low"))  # the first shared year lies in the first shared bin
    counts = (F.col("at.level") == F.greatest(level("low", "high"), level("other_low", "other_high"))) & (
        F.col("at.bin") == F.expr("shiftright(greatest(low, other_low), at.level)")
    )
    return pairs.filter(counts & (shared <= F.least("high", "other_high"))).select("low", "high", "other_low", "other_high")


def band_join(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """All pairs of rows of ``left`` and ``right`` whose bands (``low, high``, in years) overlap; other names must differ.

    ``on`` names columns that must be equal as well. Bands are joined once per distinct
    pair; rows then meet on equal bands and keys. Rows with a NULL or reversed band have no partner.
    Who wants totals of the pairs groups each side by key and band first: the pairs grow with the
    product of both sides, the groups don't.
    """
    pairs = overlapping_bands(left, right)
    other = right.withColumnsRenamed({"low": "other_low", "high": "other_high"})
    return left.join(pairs, ["low", "high"]).join(other, [*(on or []), "other_low", "other_high"])
