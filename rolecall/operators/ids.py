"""Dense sequential ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from ..session import read_if_present, staged

#: Ids that differ only in their last ``BLOCK_BITS`` bits form a block, so a block
#: holds at most 65,536 ids however the ids are spread.
BLOCK_BITS = 16
#: The blocks of rows without an id start here, after all others.
LAST_BLOCK = 1 << 48
#: ``monotonically_increasing_id`` counts inside a part with its low bits.
PLACE_BITS = 33
# Fixed value: rows per update batch.
BATCH_ROWS = 1000


def _offsets(counts: DataFrame, levels: int) -> DataFrame:
    """``block, before``: rows in all earlier blocks, from ``block, rows``.

    Running sums are taken inside blocks of blocks, level by level, so that no
    window is larger than a block. After three levels of 64-bit ids at most 65,536
    rows are left for the unpartitioned window.
    """
    earlier = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if levels == 0:
        return counts.withColumn("before", earlier(Window.orderBy("block"))).drop("rows")
    grouped = counts.withColumn("upper", F.shiftright("block", BLOCK_BITS))
    above = _offsets(grouped.groupBy(F.col("upper").alias("block")).agg(F.sum("rows").alias("rows")), levels - 1)
    within = Window.partitionBy("upper").orderBy("block")
    return (
        grouped.withColumn("within", earlier(within))
        .join(above.withColumnRenamed("block", "upper"), "upper")
        .select("block", (F.col("before") + F.col("within")).alias("before"))
    )


def renumber(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Replaces the ids by 1..N in their order; ``batch`` counts thousands.

    Rows without an id come last, in the order of a hash of their plain columns.
    ``row_number`` runs per block of old ids and the blocks' offsets come from
    their sizes, which are stored once, so no task sees more than one block and the
    table is read twice: its ids, then its rows.
    """
    plain = [F.col(f.name) for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    rest = F.lit(LAST_BLOCK) + F.pmod(F.xxhash64(*plain), F.lit(1 << BLOCK_BITS))
    blocks = df.withColumn("block", F.coalesce(F.shiftright(F.col(id_col).cast("long"), BLOCK_BITS), rest))
    sizes = staged(blocks.groupBy("block").agg(F.count("*").alias("rows")), "blocks")
    offsets = _offsets(sizes, levels=2)
    order = Window.partitionBy("block").orderBy(id_col, F.xxhash64(*plain))
    numbered = blocks.withColumn("_rn", F.row_number().over(order)).join(offsets, "block")
    new_id = (F.col("before") + F.col("_rn")).cast("long")
    return (
        numbered.withColumn(id_col, new_id)
        .withColumn("batch", (F.floor((F.col(id_col) - 1) / BATCH_ROWS) + 1).cast("long"))
        .drop("block", "before", "_rn")
    )


def next_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: ``rows`` and the ``next_id`` to hand out."""
    return df.agg(
        F.count("*").alias("rows"), (F.coalesce(F.max(id_col), F.lit(0)) + 1).cast("long").alias("next_id")
    )


def ranked(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 1, in ``order``; the same in any layout of the rows.

    Rows are dealt by ranges of ``order``, sorted and stored; a row's place is its place
    in its part plus the rows of all earlier parts (one count per part). Rows of equal
    ``order`` are placed by a hash of their plain columns.
    """
    plain = [F.col(f.name) for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    tie = [F.xxhash64(*plain)] if plain else []
    placed = df.repartitionByRange(order).sortWithinPartitions(order, *tie)
    placed = staged(placed.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", PLACE_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    found = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, place)
    return found.drop("_part", "_place", "_before")


def with_ids(existing: DataFrame, fresh: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """``fresh`` with an id for every row that has none, in ``order``; given ids stay.

    The new ids follow the largest id of both tables without gaps. ``fresh`` is stored
    once, so what made it doesn't run again for its largest id, and the same rows get
    the same ids whatever their layout.
    """
    if id_col not in fresh.columns:
        fresh = fresh.withColumn(id_col, F.lit(None).cast("long"))
    fresh = staged(fresh, "fresh")
    top = lambda df: F.coalesce(df.agg(F.max(id_col).alias("top")).scalar(), F.lit(0)).cast("long")
    return numbered(fresh, order, F.greatest(top(existing), top(fresh)) + 1, id_col)


def numbered(fresh: DataFrame, order: str, start: Column, id_col: str = "id") -> DataFrame:
    """``fresh``, which is read twice, with ids from ``start`` on in ``order`` where none is given."""
    new = ranked(fresh.filter(F.col(id_col).isNull()), order, "_rank")
    named = new.withColumn(id_col, (start + F.col("_rank") - 1).cast("long")).drop("_rank")
    return fresh.filter(F.col(id_col).isNotNull()).unionByName(named)


def claim(spark: SparkSession, ledger: str, batch_id: int, rows: int, floor: int) -> int:
    """First id of the range of ``rows`` ids that ``batch_id`` holds in ``ledger``.

    The range is taken and stored at the first call, above ``floor`` and all ranges
    given out; a replay or retry of the batch gets the same one. One row per batch.
    """
    columns = "batch_id long, first long, rows long"
    claims = read_if_present(spark, ledger, columns)
    taken = claims.agg(
        F.max(F.when(F.col("batch_id") == batch_id, F.struct("first", "rows"))).alias("own"),
        F.max(F.col("first") + F.col("rows") - 1).alias("last"),
    ).first()
    if taken.own:
        if taken.own.rows < rows:
            raise ValueError(f"batch {batch_id} has claimed {taken.own.rows} ids and now needs {rows}")
        return taken.own.first
    first = max(floor, taken.last or 0) + 1
    row = spark.createDataFrame([(first, rows)], "first long, rows long")
    row.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")
    return first
