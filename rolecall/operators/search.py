"""Newest matching postings for every candidate.

What a candidate asks for is a *request*: location text, level classes and
roles. Many candidates share one, so the search runs once per distinct request.
The filters only look at a posting's location, title and level class, and "the
newest n" of a union is the newest n of the parts' newest n. So the search cuts
to n at every step: per (location, title, class), per (wanted location, title,
class), per (wanted location, role, class), and per request. No step pairs
candidates with postings, and the LIKE conditions are decided on distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.bands import allowed_classes, level_class
from ..functions.text import normalise
from ..schema import SEARCH_COLUMNS, require
from ..session import staged
from .filters import experience_filter, has_location, location_like, title_matches_any
from .joins import fetch_by_id, like_pairs, spread_join

# Fixed value: postings fetched per request.
FETCH_LIMIT = 100


def newest_ids(postings: DataFrame, location: str, category: str | None, roles: list[str], limit: int) -> list[int]:
    """The at most ``limit`` ids of one request, newest first: a distributed top-n over narrow columns."""
    if not location.strip():
        return []
    wanted = F.array(*map(F.lit, roles)) if roles else F.array().cast("array<string>")
    found = (
        postings.filter(location_like(F.col("location"), F.lit(location.strip())))
        .filter(experience_filter(F.col("experience_level"), F.lit(category)))
        .filter(title_matches_any(F.col("job_title"), wanted))
        .select("id", "posted_date")
        .orderBy(F.desc_nulls_last("posted_date"), "id")
        .limit(limit)
    )
    return [r.id for r in found.collect()]


def search_one(
    postings: DataFrame, location: str, category: str | None, roles: list[str], limit: int = FETCH_LIMIT
) -> DataFrame:
    """One request: the newest ids, then their few rows.

    The ids reach the driver, so that the wide columns are read with a filter on ids
    that Parquet can use.
    """
    ids = newest_ids(postings, location, category, roles, limit)
    found = postings.filter(F.col("id").isin(ids)).select(*SEARCH_COLUMNS)
    return found.orderBy(F.desc_nulls_last("posted_date"), "id").limit(limit)


def newest(by: list[str], limit: int, df: DataFrame) -> DataFrame:
    """The newest ``limit`` rows per ``by``; cut before the shuffle as well as after."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("posted_date"), "id")
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn")


def with_request(candidates: DataFrame) -> DataFrame:
    """Adds ``request``: JSON of the location text, category group and sorted roles.

    Expects ``pref_location``, ``category`` and ``best_job_roles``. Candidates
    without a location have no request (NULL).
    """
    require(candidates, ["candidate_id", "pref_location", "category", "best_job_roles"])
    group = F.lower("category")
    roles = F.coalesce(F.col("best_job_roles"), F.array().cast("array<string>"))
    key = F.to_json(
        F.struct(
            normalise(F.col("pref_location")).alias("pref"),
            F.when(group.isin("fresher", "experienced"), group).otherwise("any").alias("level"),
            F.array_sort(F.array_distinct(F.transform(roles, F.lower))).alias("roles"),
        )
    )
    return candidates.withColumn("request", F.when(has_location(F.col("pref_location")), key))


def request_counts(asking: DataFrame) -> DataFrame:
    """``request, n``: the distinct requests and how many candidates have each."""
    return asking.filter("request is not null").groupBy("request").agg(F.count("*").alias("n"))


def _asks(requests: DataFrame) -> DataFrame:
    """One row per distinct request, role and level class; role '' accepts all titles."""
    parsed = F.from_json("request", "pref string, level string, roles array<string>")
    return (
        requests.select("request", parsed.alias("r"))
        .select("request", F.col("r.pref").alias("pref"), F.col("r.level").alias("level"), "r.roles")
        .withColumn("role", F.explode(F.when(F.size("roles") > 0, F.col("roles")).otherwise(F.array(F.lit("")))))
        .withColumn("class", F.explode(allowed_classes(F.col("level"))))
        .select("request", "pref", "role", "class")
    )


def _newest_first() -> Column:
    """Ascending key of "newest first, no date last, then id"."""
    age = F.coalesce(-F.unix_date("posted_date"), F.lit(2**31 - 1))
    return F.struct(age.alias("age"), F.col("id"), F.col("posted_date"))


def search_requests(postings: DataFrame, requests: DataFrame, limit: int = FETCH_LIMIT) -> DataFrame:
    """``request, fetch_rank, id, posted_date`` for every request (see ``request_counts``)."""
    asks = _asks(requests)
    rows = postings.select(
        "id",
        "posted_date",
        F.lower("location").alias("location"),
        F.lower("job_title").alias("title"),
        level_class(F.col("experience_level")).alias("class"),
    )
    at_location = like_pairs(
        rows.select(F.col("location").alias("value")).filter("value is not null").distinct(),
        asks.select(F.col("pref").alias("pattern")).distinct(),
    ).select(F.col("value").alias("location"), F.col("pattern").alias("pref"))
    for_role = like_pairs(
        rows.select(F.col("title").alias("value")).filter("value is not null").distinct(),
        asks.select(F.col("role").alias("pattern")).distinct(),
    ).select(F.col("value").alias("title"), F.col("pattern").alias("role"))

    cells = newest(["location", "title", "class"], limit, rows.filter("location is not null and title is not null"))
    per = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n"))
    # only locations and titles that many rows hold are cut into pieces
    wanted = newest(
        ["pref", "title", "class"], limit, spread_join(cells, at_location, "location", per(cells, "location"), "id")
    )
    titles = per(rows.select("title"), "title")  # at least as many rows as are left of a title
    offered = newest(["pref", "role", "class"], limit, spread_join(wanted, for_role, "title", titles, "id"))
    # At most ``limit`` entries per key, so the lists are bounded.
    lists = offered.groupBy("pref", "role", "class").agg(F.collect_list(_newest_first()).alias("found"))
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, limit)
    keys = ["pref", "role", "class"]
    per_key = asks.groupBy(*keys).agg(F.count("*").alias("n"))
    return (
        spread_join(asks, lists, keys, per_key, "request")
        .groupBy("request")
        .agg(best.alias("found"))
        .select("request", F.posexplode("found").alias("pos", "hit"))
        .select("request", (F.col("pos") + 1).alias("fetch_rank"), "hit.id", "hit.posted_date")
    )


def request_bundles(found: DataFrame, details: DataFrame) -> DataFrame:
    """One row per request: its postings with their details, in fetch order.

    At most ``FETCH_LIMIT`` entries per request, so the list is bounded. ``found``
    is read twice and should be stored.
    """
    names = [c for c in details.columns if c != "id"]
    per_id = found.groupBy("id").agg(F.count("*").alias("n"))
    return (
        spread_join(found.select("request", "fetch_rank", "id"), details, "id", per_id, "request")
        .groupBy("request")
        # The sort compares fetch_rank, which is unique within a request.
        .agg(F.array_sort(F.collect_list(F.struct("fetch_rank", "id", *names))).alias("bundle"))
    )


def search_postings(postings: DataFrame, candidates: DataFrame, limit: int = FETCH_LIMIT) -> DataFrame:
    """``candidate_id, fetch_rank`` and the search columns of each candidate's postings."""
    asking = with_request(candidates).select("candidate_id", "request").filter("request is not null")
    requests = staged(request_counts(asking), "requests")
    found = staged(search_requests(postings, requests, limit), "found")
    details = fetch_by_id(postings.select(*SEARCH_COLUMNS), found)
    keyed = details.select("id", F.struct(*[c for c in SEARCH_COLUMNS if c != "id"]).alias("row"))
    return (
        spread_join(asking, request_bundles(found, keyed), "request", requests, "candidate_id")
        .select("candidate_id", F.inline("bundle"))
        .select("candidate_id", "fetch_rank", "id", "row.*")
    )
