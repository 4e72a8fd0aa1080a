"""The crawl frontier: every link a crawl has seen, stored by the hash of its address.

A batch of search pages looks its links up in the buckets that they fall in, so a crawl
of few pages reads little of a large frontier. What a batch has seen first is written
with the place of the sighting and whether the crawl quota took it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from ..sources.batches import BUCKETS, bucket, others, read_batches, write_batch
from ..sources.pages import LINK, LINK_CARD, discover_links
from .quota import crawl_quota

FRONTIER_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("page", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("taken", T.BooleanType()),
    ]
)


def visit(
    searches: DataFrame,
    frontier: str,
    batch_id: int,
    limits: tuple[int, int],
    card: tuple[str, str] | None = LINK_CARD,
    link: tuple[str, str | None] = LINK,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Links to follow of search pages (``page_id, role, page, html``); all new links go to ``frontier``.

    A link belongs to its first sighting, by page and place. Of the links that no other
    batch has seen, each role takes the first ``limits[0]`` of its first ``limits[1]`` pages;
    the others are stored as not taken. Links are looked up and counted before any page
    behind them is read. Visiting a batch again gives the same links.
    """
    spark = searches.sparkSession
    found = discover_links(searches, None, card, link, carry=("role", "page"))
    found = staged(found.withColumn("bucket", bucket(F.col("url"), buckets=buckets)), "links")
    seen = others(spark, frontier, FRONTIER_SCHEMA, batch_id, found).select("bucket", "url")
    new = staged(found.join(seen, ["bucket", "url"], "left_anti"), "new-links")
    took = crawl_quota(new.withColumn("_place", F.struct("page_id", "pos")), "role", *limits, place="_place").select("url", F.lit(True).alias("_took"))
    marked = new.join(took, "url", "left").withColumn("taken", F.coalesce("_took", F.lit(False)))
    fields = [F.col(f.name).cast(f.dataType) for f in FRONTIER_SCHEMA]
    write_batch(marked.select(*fields, "bucket"), frontier, batch_id)
    return seen_links(spark, frontier).filter((F.col("batch_id") == batch_id) & F.col("taken"))


def seen_links(spark, frontier: str) -> DataFrame:
    """All links of the frontier with their sightings."""
    return read_batches(spark, frontier, FRONTIER_SCHEMA)
