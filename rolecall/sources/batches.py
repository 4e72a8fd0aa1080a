"""Tables that grow batch by batch, cut by the hash of a key.

A batch is the folder ``batch_id=<n>`` and holds one folder per bucket of the key's
hash. Writing a batch again replaces it, so a replay changes nothing; readers name the
buckets that concern them and the rest is never opened (partition pruning). Compaction
rewrites old batches as one; the newest batch stays as it is, because only that one
can be replayed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import file_system, read_if_present

#: Buckets of a table; a table keeps the number it has been written with.
BUCKETS = 64
_BATCH = re.compile(r"batch_id=(\d+)$")


def bucket(*key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key; equal keys share one."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write ``df`` (with ``bucket``) as a batch, one file per bucket, in place of an earlier try."""
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows with ``bucket`` and ``batch_id``; an empty table where nothing has been written."""
    finish_compaction(spark, path)
    places = [T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())]
    return read_if_present(spark, path, T.StructType([*schema, *places]))


def others(spark: SparkSession, path: str, schema: T.StructType, batch_id: int, asking: DataFrame) -> DataFrame:
    """The rows of all other batches in the buckets that ``asking`` (with ``bucket``) touches."""
    touched = [row.bucket for row in asking.select("bucket").distinct().collect()]  # at most the number of buckets
    return read_batches(spark, path, schema).filter(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id))


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches, in order, from the folders' names."""
    return sorted(int(m[1]) for name in _folders(spark, path) if (m := _BATCH.match(name)))


def compact(spark: SparkSession, path: str, schema: T.StructType) -> int | None:
    """Rewrite all batches but the newest as one; returns its number, None if there is nothing to join.

    The joined batch takes the largest number of those it replaces. It is written beside the
    table, and only a complete one takes their place; a job that ends in between is finished
    by the next reader.
    """
    finish_compaction(spark, path)
    old = batch_ids(spark, path)[:-1]
    if len(old) < 2:
        return None
    joined = read_batches(spark, path, schema).filter(F.col("batch_id") <= old[-1]).drop("batch_id")
    target = f"{path}/_joined-{old[-1]}"
    joined.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    finish_compaction(spark, path)
    return old[-1]


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Put a complete joined batch in the place of those it replaces; remove an incomplete one."""
    files, root = file_system(spark, path)
    place = lambda name: file_system(spark, f"{path}/{name}")[1]
    for name in _folders(spark, path):
        if not name.startswith("_joined-"):
            continue
        upto = int(name.removeprefix("_joined-"))
        if not files.exists(place(f"{name}/_SUCCESS")):
            files.delete(place(name), True)
            continue
        for n in [int(m[1]) for other in _folders(spark, path) if (m := _BATCH.match(other))]:
            if n <= upto:
                files.delete(place(f"batch_id={n}"), True)
        files.rename(place(name), place(f"batch_id={upto}"))


def _folders(spark: SparkSession, path: str) -> list[str]:
    files, root = file_system(spark, path)
    return [status.getPath().getName() for status in files.listStatus(root)] if files.exists(root) else []
