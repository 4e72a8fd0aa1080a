"""Incremental posting ingest.

Every micro-batch goes to a folder of its own, cut by the hash of the key
(``sources.batches``): a replayed batch replaces itself, also for rows with a NULL in
their key, which nothing else could recognise, and gets the ids it had. Duplicates are
found against the other batches of the table, in the buckets that the batch touches, so
there is no state to grow and no late row is lost. ``compact_table`` joins old batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import key_columns, new_rows
from ..operators.ids import claim, numbered
from ..schema import POSTING_SCHEMA, UNIQUE_KEY, accepted
from ..session import staged, staging
from ..sources.batches import BUCKETS, bucket, compact, others, read_batches, write_batch


def posting_stream(spark, path: str, order: T.StructField | None = None, **options: str) -> DataFrame:
    """Posting files as a stream, optionally with an extra arrival column."""
    schema = T.StructType([*POSTING_SCHEMA, *([order] if order else [])])
    return spark.readStream.schema(schema).options(**options).parquet(path)


def append_batch(batch: DataFrame, batch_id: int, table: str, order: str, buckets: int = BUCKETS) -> None:
    """Write the new rows of one micro-batch; stored keys are read in the buckets that it touches."""
    spark = batch.sparkSession
    with staging(spark):
        keyed = batch.withColumn("bucket", bucket(*key_columns(), buckets=buckets))
        stored = others(spark, table, batch.schema, batch_id, keyed)
        fresh = staged(new_rows(stored, accepted(keyed), order, ("bucket", *UNIQUE_KEY)), "fresh")
        write_numbered(fresh, batch_id, table, batch.schema, order)


def write_numbered(fresh: DataFrame, batch_id: int, table: str, schema: T.StructType, order: str) -> None:
    """Write a batch of stored new rows; those without an id get one from the range that the batch claims."""
    spark = fresh.sparkSession
    unnamed, top = fresh.agg(F.count_if(F.col("id").isNull()), F.max("id")).first()
    if unnamed:
        known = read_batches(spark, table, schema).filter(F.col("batch_id") != batch_id).agg(F.max("id")).first()[0]
        first = claim(spark, f"{table}/_ids", batch_id, unnamed, max(known or 0, top or 0))
        fresh = numbered(fresh, order, F.lit(first))
    write_batch(fresh, table, batch_id)


def stream_ingest(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    order: str = "id",
    mode: str = "exact",
    delay: str = "7 days",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Start appending new postings to ``table``; runs until the input is used up.

    ``mode="bounded"`` adds stateful deduplication in front: it drops repeats within
    ``delay`` early, and it also drops rows older than the watermark, so it is only
    for sources that deliver in time.
    """
    if mode == "bounded":
        keys: list[Column] = [F.lower(F.col(k)) for k in UNIQUE_KEY]
        names = [f"_u{i}" for i in range(len(keys))]
        loose = F.concat(*keys).isNull()
        own = F.when(loose, F.col(order).cast("string"))
        stream = (
            stream.withColumns(dict(zip(names, keys)) | {"_own": own})
            .withWatermark("scraped_at", delay)
            .dropDuplicatesWithinWatermark([*names, "_own"])
            .drop(*names, "_own")
        )
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, table, order, buckets))
        .start()
    )


def compact_table(spark, table: str, schema: T.StructType = POSTING_SCHEMA) -> int | None:
    """Join all batches but the newest, the only one that a restart can replay; run it between streams."""
    return compact(spark, table, schema)
