"""Append that ignores rows whose unique key is already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schema import UNIQUE_KEY, WIDTHS, accepted, clip_to_schema
from .ids import with_ids


_Spec = tuple[str, ...]


def _lowered(keys: _Spec) -> dict[str, Column]:
    return {f"_k{i}": F.lower(F.col(k)) for i, k in enumerate(keys)}


def _has_null(names: list[str]) -> Column:
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    return missing


def first_per_key(batch: DataFrame, order: str, keys: _Spec = UNIQUE_KEY) -> DataFrame:
    """The first row per key in ``order`` (unique); keys compare clipped and without case.

    A row with a NULL in its key never collides. Copies of a key are cut to one
    per task before the shuffle.
    """
    lowered = _lowered(keys)
    keyed = clip_to_schema(batch).withColumns(lowered)
    keyed = keyed.withColumn("_own", F.when(_has_null(list(lowered)), F.col(order)))
    arrival = Window.partitionBy(*lowered, "_own").orderBy(order)
    first = keyed.withColumn("_rn", F.row_number().over(arrival)).filter(F.col("_rn") == 1)
    return first.drop(*lowered, "_own", "_rn")


def new_rows(existing: DataFrame, batch: DataFrame, order: str, keys: _Spec = UNIQUE_KEY) -> DataFrame:
    """Rows of ``batch`` to insert: clipped, the first per key, none of them in ``existing``."""
    return not_stored(existing, first_per_key(batch, order, keys), order, keys)


def not_stored(existing: DataFrame, first: DataFrame, order: str, keys: _Spec = UNIQUE_KEY) -> DataFrame:
    """Rows of ``first``, unique per key, whose key is not in ``existing``."""
    lowered = _lowered(keys)
    names = list(lowered)
    stored = existing.select(*[c.alias(f"{n}_stored") for n, c in lowered.items()])
    # A row with a NULL key matches nothing; a hash of its order spreads such rows.
    loose = _has_null(names)
    spread = F.when(loose, F.xxhash64(order).cast("string")).otherwise(F.col(names[0]))
    first = first.withColumns(lowered).withColumn("_loose", loose)
    first = first.withColumn(names[0], spread)
    same = ~F.col("_loose")
    for name in names:
        same = same & (F.col(name) == F.col(f"{name}_stored"))
    return first.join(stored, same, "left_anti").drop(*names, "_loose")


def key_columns(keys: _Spec = UNIQUE_KEY) -> list[Column]:
    """The key as it is compared: clipped and without case."""
    return [F.lower(F.left(F.col(k), F.lit(WIDTHS[k])) if k in WIDTHS else F.col(k)) for k in keys]


def insertable(
    existing: DataFrame, batch: DataFrame, order: str, keys: _Spec = UNIQUE_KEY, scraped_at=None
) -> DataFrame:
    """The rows an insert adds: complete, new, with an id and a time of arrival.

    Rows that miss a required column are refused (``rejected_postings`` lists them).
    ``scraped_at`` is the time for rows that have none.
    """
    fresh = with_ids(existing, new_rows(existing, accepted(batch), order, keys), order)
    if "scraped_at" in fresh.columns and scraped_at is not None:
        fresh = fresh.withColumn("scraped_at", F.coalesce("scraped_at", F.lit(scraped_at).cast("timestamp")))
    return fresh


def append_ignore(
    existing: DataFrame, batch: DataFrame, order: str, keys: _Spec = UNIQUE_KEY, scraped_at=None
) -> DataFrame:
    """The table after the insert."""
    return existing.unionByName(insertable(existing, batch, order, keys, scraped_at), allowMissingColumns=True)
