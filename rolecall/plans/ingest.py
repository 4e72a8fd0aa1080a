"""Raw pages -> postings to insert."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_AVAILABLE
from ..operators.dedupe import first_per_key, key_columns, not_stored
from ..operators.frontier import seen_links, visit
from ..operators.ids import claim, ranked, with_ids
from ..operators.quota import crawl_quota
from ..operators.reports import counted, crawl_report
from ..schema import POSTING_SCHEMA, UNIQUE_KEY, clip_to_schema
from ..session import staged, staging
from ..sources.batches import BUCKETS, bucket, others, read_batches, write_batch
from ..sources.pages import DETAIL_SOURCE, detail_keys, extract_cards, extract_detail_pages, with_card_details
from .recommend import write_features

# Fixed values: (postings per title, pages per title) of the two page sources.
DETAIL_LIMITS = (10, 5)
LISTING_LIMITS = (30, 3)

#: Arrival order: detail pages, then listing cards, each in page order.
_ARRIVAL = "struct<kind:int,page_id:bigint,pos:int>"


def detail_postings(
    pages: DataFrame, skills: DataFrame, as_of, limits: tuple[int, int] | None = None
) -> DataFrame:
    """Postings of detail pages (``page_id, url, role, html``), with ``arrival``.

    ``limits`` = (postings, pages) per role applies a crawl quota; it needs the
    ``page`` and ``pos`` of the search page a link was found on.
    """
    if limits:
        pages = crawl_quota(pages, "role", *limits)
    arrival = F.struct(F.lit(0), F.col("page_id"), F.lit(0)).cast(_ARRIVAL)
    return extract_detail_pages(pages, skills, as_of).withColumn("arrival", arrival)


def listing_postings(
    listings: DataFrame, details: DataFrame, as_of, limits: tuple[int, int] | None = None
) -> DataFrame:
    """Postings of listing pages (``page_id, role, page, html``), with ``arrival``.

    ``details`` (``url, html``) are the cards' own pages. Only the first card of a
    key can be inserted, so the others leave before the details are joined; a
    posting listed on very many pages does not make its link a hot join key.
    """
    cards = extract_cards(listings, as_of)
    if limits:
        cards = crawl_quota(cards, "role", *limits)
    arrival = F.struct(F.lit(1), F.col("page_id"), F.col("pos")).cast(_ARRIVAL)
    return with_card_details(first_per_key(cards.withColumn("arrival", arrival), "arrival"), details)


def as_postings(
    df: DataFrame, scraped_at, embed: Callable[[DataFrame, str], DataFrame] | None = None, name: str = "arrival"
) -> DataFrame:
    """Extracted rows in the posting schema, with the column ``name`` in place of an id.

    ``embed(df, text)`` adds the column ``embedding``; rows without a description
    keep none.
    """
    if embed is not None:
        described = F.col("job_description") != NOT_AVAILABLE
        df = embed(df, "job_description").withColumn("embedding", F.when(described, F.col("embedding")))
    df = df.withColumn("scraped_at", F.lit(scraped_at))
    have = set(df.columns)
    value = lambda f: F.col(f.name) if f.name in have else F.lit(None)
    columns = [value(f).cast(f.dataType).alias(f.name) for f in POSTING_SCHEMA if f.name != "id"]
    return df.select(*columns, name)


def _arrived(kind: int, *place: str) -> Column:
    page, pos = (*(F.col(c) for c in place), F.lit(0))[:2]
    return F.struct(F.lit(kind), page, pos).cast(_ARRIVAL)


def first_arrivals(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """``arrival`` and the key of pages and cards, the first per key.

    Only the two fields of the key are read of a page; texts, skills and vectors wait
    until it is known that the page brings something new.
    """
    detail = detail_keys(pages).withColumn("arrival", _arrived(0, "page_id"))
    listed = cards.withColumn("arrival", _arrived(1, "page_id", "pos"))
    keys = detail.select("arrival", *UNIQUE_KEY).unionByName(listed.select("arrival", *UNIQUE_KEY))
    return first_per_key(keys, "arrival")


def extract_arrivals(
    chosen: DataFrame, pages: DataFrame, cards: DataFrame, listing_details: DataFrame, skills: DataFrame, as_of, scraped_at, embed
) -> DataFrame:
    """The postings of ``chosen`` (``arrival, id``), read whole; ``page_id`` names a page."""
    one = chosen.filter("arrival.kind = 0").select(F.col("arrival.page_id").alias("page_id"), F.col("id").alias("_id"))
    detail = detail_postings(pages.join(one, "page_id"), skills, as_of)
    place = [F.col("arrival.page_id").alias("page_id"), F.col("arrival.pos").alias("pos"), F.col("id").alias("_id")]
    listed = cards.join(chosen.filter("arrival.kind = 1").select(*place), ["page_id", "pos"])
    listed = with_card_details(listed.withColumn("arrival", _arrived(1, "page_id", "pos")), listing_details)
    both = as_postings(detail, scraped_at, embed, "_id").unionByName(as_postings(listed, scraped_at, embed, "_id"))
    return clip_to_schema(both).withColumnRenamed("_id", "id").select(*POSTING_SCHEMA.names)


def ingest(
    existing: DataFrame,
    pages: DataFrame,
    listings: DataFrame,
    listing_details: DataFrame,
    skills: DataFrame,
    as_of,
    scraped_at=None,
    detail_limits: tuple[int, int] | None = None,
    listing_limits: tuple[int, int] | None = None,
    embed: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """The rows to append to ``existing``: extracted, clipped, first per key, not yet stored, with ids in order of arrival."""
    if detail_limits:
        pages = crawl_quota(pages, "role", *detail_limits)
    cards = _limited_cards(listings, as_of, listing_limits)
    fresh = not_stored(existing, first_arrivals(pages, cards), "arrival").select("arrival")
    chosen = with_ids(existing, fresh, "arrival").select("id", "arrival")
    return extract_arrivals(chosen, pages, cards, listing_details, skills, as_of, scraped_at, embed)


def _limited_cards(listings: DataFrame, as_of, limits: tuple[int, int] | None) -> DataFrame:
    cards = extract_cards(listings, as_of)
    return staged(crawl_quota(cards, "role", *limits) if limits else cards, "cards")


def discover_and_ingest(
    table: str,
    frontier: str,
    batch_id: int,
    searches: DataFrame,
    pages: DataFrame,
    listings: DataFrame,
    listing_details: DataFrame,
    skills: DataFrame,
    as_of,
    scraped_at=None,
    detail_limits: tuple[int, int] = DETAIL_LIMITS,
    listing_limits: tuple[int, int] = LISTING_LIMITS,
    embed: Callable[[DataFrame, str], DataFrame] | None = None,
    buckets: int = BUCKETS,
    features: str | None = None,
) -> DataFrame:
    """One crawl, whole: links, quota, new postings with ids in ``table``, and the report of the run.

    ``searches`` (``page_id, role, page, html``) are the pages that links are found on; the
    ``frontier`` names the new ones, and the quota of first sightings says which of ``pages``
    (``page_id, url, html``) are followed, with the link's role. ``listings`` and
    ``listing_details`` are the other source. The batch is written to ``table``, cut by
    the hash of its keys; stored keys are read in the buckets it touches only. Running a batch
    again replaces it, with the same ids. Failed pages are those that ``pages`` lacks. With
    ``features``, what single requests need of the new postings (``recommend.posting_features``) is stored there, by batch as well.
    """
    spark = searches.sparkSession
    began = time.monotonic()
    with staging(spark):
        links = visit(searches, frontier, batch_id, detail_limits, buckets=buckets)
        followed = pages.drop("role").join(links.select("url", "role"), "url")
        cards = _limited_cards(listings, as_of, listing_limits)
        keyed = first_arrivals(followed, cards).withColumn("bucket", bucket(*key_columns(), buckets=buckets))
        keyed = staged(keyed, "first-arrivals")
        stored = others(spark, table, POSTING_SCHEMA, batch_id, keyed).select("bucket", *UNIQUE_KEY)
        fresh = staged(not_stored(stored, keyed, "arrival", ("bucket", *UNIQUE_KEY)).select("arrival"), "fresh-arrivals")
        known = read_batches(spark, table, POSTING_SCHEMA).filter(F.col("batch_id") != batch_id).agg(F.max("id")).first()[0]
        first = claim(spark, f"{table}/_ids", batch_id, fresh.count(), known or 0)
        chosen = ranked(fresh, "arrival").withColumn("id", (F.lit(first) + F.col("rank") - 1).cast("long"))
        rows = extract_arrivals(chosen, followed, cards, listing_details, skills, as_of, scraped_at, embed)
        rows, seen = counted(rows.withColumn("bucket", bucket(*key_columns(), buckets=buckets)), f"ingest-{batch_id}")
        write_batch(rows, table, batch_id)
    inserted = seen.get["rows"]
    seconds = time.monotonic() - began
    batch = read_batches(spark, table, POSTING_SCHEMA).filter(F.col("batch_id") == batch_id)
    if features:
        write_features(batch, f"{features}/batch_id={batch_id}", skills, mode="overwrite")
    looked = seen_links(spark, frontier).filter(F.col("batch_id") == batch_id).withColumn("source", F.lit(DETAIL_SOURCE))
    report = crawl_report(looked, batch, seconds)
    return report.withColumn("written", F.lit(inserted))
