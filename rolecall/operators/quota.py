"""Quotas: balanced ranking over sources, and crawl limits per title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Fixed value: postings in a recommendation list.
TOTAL = 40


def source_key() -> Column:
    """``source`` as a grouping key in which NULL is a value of its own."""
    return F.to_json(F.array("source"))


def source_order(scored: DataFrame, key: str, total: int = TOTAL) -> DataFrame:
    """``key, source_key, source_ord, quota``: first fetch rank and places of each source."""
    per_source = (
        scored.withColumn("source_key", source_key())
        .groupBy(key, "source_key")
        .agg(F.min("fetch_rank").alias("source_ord"))
    )
    places = per_source.groupBy(key).agg(F.ceil(F.lit(total) / F.count("*")).cast("int").alias("quota"))
    return per_source.join(places, key)


def quota_rank(scored: DataFrame, total: int = TOTAL, key: str = "candidate_id") -> DataFrame:
    """Adds ``position`` and keeps ``total`` rows per ``key``, balanced over sources.

    ``scored`` has ``key, source, score`` and ``fetch_rank``, unique per key. Each
    source first gets ``ceil(total / sources)`` places, sources in order of their
    first fetch rank; free places go to the best of the rest. The list is one
    block per source followed by the fill.

    A source contributes at most ``total`` rows, so rows beyond that rank leave
    before the shuffle and a group of any size is sorted in bounded pieces.
    """
    best = Window.partitionBy(key, "source_key").orderBy(F.desc("score"), "fetch_rank")
    named = scored.withColumn("source_key", source_key())
    kept = named.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= total)
    return _placed(kept.join(source_order(scored, key, total), [key, "source_key"]), total, key)


def quota_order(items: Column, sources: Column, total: int = TOTAL) -> Column:
    """``quota_rank`` of one bounded list, inside the row.

    ``items`` is an array of ``(neg_score, fetch_rank, source_ord, at)``, where
    ``source_ord`` is the place of the item's source in the array ``sources``.
    """
    quota = F.ceil(F.lit(total) / F.size(sources)).cast("int")
    best = F.array_sort(items)
    per_source = F.transform(sources, lambda _, i: F.filter(best, lambda x: x["source_ord"] == i + 1))
    head = F.flatten(F.transform(per_source, lambda a: F.slice(a, F.lit(1), quota)))
    rest = F.flatten(F.transform(per_source, lambda a: F.slice(a, quota + 1, F.size(a))))
    fields = ("neg_score", "source_ord", "fetch_rank", "at")
    fill = F.array_sort(F.transform(rest, lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    pick = lambda array: F.transform(array, lambda x: F.struct(x["neg_score"], x["at"]))
    return F.slice(F.concat(pick(head), pick(fill)), 1, total)


def _placed(ranked: DataFrame, total: int, key: str) -> DataFrame:
    in_quota = F.col("rn") <= F.col("quota")
    place = Window.partitionBy(key).orderBy(
        F.when(in_quota, 0).otherwise(1),
        F.when(in_quota, F.col("source_ord")),
        F.when(~in_quota, -F.col("score")),
        "source_ord",
        "rn",
    )
    return (
        ranked.withColumn("position", F.row_number().over(place))
        .filter(F.col("position") <= total)
        .drop("source_key", "rn", "source_ord", "quota")
    )


def crawl_quota(df: DataFrame, by: str, limit: int, max_page: int, page: str = "page", place: str = "pos") -> DataFrame:
    """The first ``limit`` rows per ``by`` from its first ``max_page`` pages."""
    order = Window.partitionBy(by).orderBy(page, place)
    return (
        df.filter(F.col(page) <= max_page)
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= limit)
        .drop("_rn")
    )
