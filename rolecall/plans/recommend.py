"""Recommendations for a table of candidates."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions import dates, vectors
from ..functions.bands import CLASSES, bands_overlap, chosen_category, level_class
from ..functions.embed import one_model
from ..operators.joins import fetch_by_id, spread_join
from ..operators.quota import TOTAL, quota_order, source_key
from ..operators.search import (
    FETCH_LIMIT,
    newest_ids,
    request_bundles,
    request_counts,
    search_one,
    search_requests,
    with_request,
)
from ..operators.skills import bounded_dictionary, extract_skills_by_join, matched_skills, skill_counts, skills_in
from ..schema import DISPLAY_COLUMNS
from ..session import staged
from .profile import profile

# Messages of the status ladder.
MESSAGES = {
    "no_text": "Failed to extract data from resume",
    "no_jobs": "No jobs found matching your criteria. Try broadening your search.",
    "none_matched": "No jobs matched your resume.",
    "mismatch": "Experience levels don't match closely. Consider adjusting your experience level.",
}

_SHOWN = [c for c in DISPLAY_COLUMNS if c != "id"]


def asking(candidates: DataFrame) -> DataFrame:
    """Candidates with their effective ``category`` and ``request``.

    Expects ``candidate_id, pref_location, form_level, parsed_level, best_job_roles``.
    """
    category = chosen_category(F.col("form_level"), F.col("parsed_level"))
    return with_request(candidates.withColumn("category", category))


def searched(candidates: DataFrame, postings: DataFrame, limit: int = FETCH_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The stored requests of ``candidates`` and what each found; lists and status can share them."""
    requests = staged(request_counts(asking(candidates).select("request")), "requests")
    return requests, staged(search_requests(postings, requests, limit), "found")


def _posting_details(postings: DataFrame, found: DataFrame, skills: DataFrame) -> DataFrame:
    """``id``, usable vector and norm, counted description skills and shown columns.

    Computed once per posting that any request fetched, not once per pair.
    """
    wide = fetch_by_id(postings.select("id", *_SHOWN, "job_description", "embedding"), found)
    return _described(wide.filter(vectors.is_usable(F.col("embedding"))), skills)


def _described(wide: DataFrame, skills: DataFrame, *keep: str) -> DataFrame:
    phrases = bounded_dictionary(skills)
    if phrases is None:
        wide = extract_skills_by_join(wide, skills, "job_description", "id", "_skills")
    else:
        wide = wide.withColumn("_skills", skills_in(F.col("job_description"), phrases))
    return wide.select(
        "id",
        *keep,
        F.col("embedding").alias("vector"),
        vectors.norm(F.col("embedding")).alias("vector_norm"),
        skill_counts(F.col("job_description"), F.col("_skills")).alias("skill_counts"),
        source_key().alias("source_key"),
        F.struct(*_SHOWN).alias("shown"),
    )


def recommend(
    candidates: DataFrame,
    postings: DataFrame,
    as_of,
    skills: DataFrame,
    total: int = TOTAL,
    limit: int = FETCH_LIMIT,
    search: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Ranked postings per candidate. ``search`` is ``searched`` of the same arguments, where it is at hand.

    ``candidates`` has ``candidate_id, pref_location, form_level, parsed_level,
    best_job_roles, skills, embedding``. If both tables name the model of their vectors
    (``embedding_model``), more than one is an error. Returns one row per place in a list:
    ``candidate_id, position``, the shown columns, ``match_score``,
    ``matched_skills`` and ``days_since_posted``.
    """
    if all("embedding_model" in df.columns for df in (candidates, postings)):
        one_model(candidates, postings)
    mine = F.col("embedding")
    people = (
        asking(candidates)
        .filter("request is not null")
        .select("candidate_id", "request", "skills", mine.cast("array<double>").alias("embedding"), vectors.norm(mine).alias("my_norm"))
    )
    requests, found = search or searched(candidates, postings, limit)
    details = staged(_posting_details(postings, found, skills), "details")
    bundles = request_bundles(found, details)
    pairs = spread_join(people.filter(vectors.is_usable(mine)), bundles, "request", requests, "candidate_id")
    return _ranked(pairs, as_of, total)


def recommend_one(
    candidate: DataFrame,
    postings: DataFrame,
    as_of,
    skills: DataFrame,
    location: str,
    category: str | None,
    roles: list[str],
    total: int = TOTAL,
    limit: int = FETCH_LIMIT,
) -> DataFrame:
    """``recommend`` for one request known to the caller, in a single pass.

    ``candidate`` is the one row with ``candidate_id, skills, embedding``. The
    search is a filtered scan with a distributed top-n; the at most ``limit``
    postings left travel with the candidate.
    """
    mine = F.col("embedding")
    newest = search_one(postings, location, category, roles, limit)
    arrival = Window.orderBy(F.desc_nulls_last("posted_date"), "id")
    ranked = newest.withColumn("fetch_rank", F.row_number().over(arrival))
    details = _described(ranked.filter(vectors.is_usable(mine)), skills, "fetch_rank")
    names = [c for c in details.columns if c not in ("id", "fetch_rank")]
    bundle = details.agg(F.array_sort(F.collect_list(F.struct("fetch_rank", "id", *names))).alias("bundle"))
    person = candidate.filter(vectors.is_usable(mine)).select(
        "candidate_id", "skills", mine.cast("array<double>").alias("embedding"), vectors.norm(mine).alias("my_norm"), F.lit(1).alias("one")
    )
    return _ranked(person.join(bundle.withColumn("one", F.lit(1)), "one"), as_of, total)


def posting_features(postings: DataFrame, skills: DataFrame) -> DataFrame:
    """What a single request needs of each posting, computed once: shown columns, level class, norm, counted skills.

    ``vector`` is NULL where a posting has no usable one; such postings are fetched but not ranked.
    """
    known = postings.select("id", *_SHOWN, "job_description", "embedding")
    described = _described(known, skills, *_SHOWN).drop("shown")
    return described.withColumns(
        {
            "class": level_class(F.col("experience_level")),
            "vector": F.when(vectors.is_usable(F.col("vector")), F.col("vector")),
        }
    )


def write_features(postings: DataFrame, path: str, skills: DataFrame, mode: str = "append") -> None:
    """Features of ``postings``, by level class, newest together; the ingest job appends those of its new rows."""
    stored = posting_features(postings, skills)
    stored.sortWithinPartitions("class", F.desc("posted_date")).write.mode(mode).partitionBy("class").parquet(path)


def recommend_from_features(
    candidate: DataFrame,
    features: DataFrame,
    as_of,
    location: str,
    category: str | None,
    roles: list[str],
    total: int = TOTAL,
    limit: int = FETCH_LIMIT,
) -> DataFrame:
    """``recommend_one`` over the stored features: no text is searched and no norm computed.

    Two reads: the narrow columns of the request's level classes for the newest ``limit`` ids, then those
    rows by id. Only the at most ``limit`` rows meet in one task.
    """
    ids = newest_ids(_of_classes(features, category), location, category, roles, limit)
    mine = F.col("embedding")
    listed = ", ".join(map(str, ids)) or "NULL"  # one expression: building it value by value would cost more than reading
    rows = _of_classes(features, category).filter(f"id IN ({listed}) AND vector IS NOT NULL")
    rank = F.expr(f"array_position(CAST(array({listed}) AS array<bigint>), id)")
    shown = F.struct(*_SHOWN).alias("shown")
    names = ["vector", "vector_norm", "skill_counts", "source_key"]
    bundle = rows.select(F.struct(rank.alias("fetch_rank"), "id", *names, shown).alias("p"))
    bundle = bundle.agg(F.array_sort(F.collect_list("p")).alias("bundle"))
    person = candidate.filter(vectors.is_usable(mine)).select(
        "candidate_id", "skills", mine.cast("array<double>").alias("embedding"), vectors.norm(mine).alias("my_norm")
    )
    return _ranked(person.coalesce(1).join(F.broadcast(bundle)), as_of, total)


def _of_classes(features: DataFrame, category: str | None) -> DataFrame:
    """The features of the level classes that ``category`` accepts; the other folders stay closed."""
    accepted = CLASSES.get((category or "").lower())
    return features if accepted is None else features.filter(F.col("class").isin(accepted))


@lru_cache(maxsize=16)
def _ranking(application: str, total: int) -> dict[str, Column]:
    """The expressions of ``_ranked``; made once per application, as making them costs more than a single request takes."""
    score = lambda p: vectors.cosine_percent(p["vector"], F.col("embedding"), p["vector_norm"], F.col("my_norm"))
    item = lambda p, i: F.struct(
        (-score(p)).alias("neg_score"),
        p["fetch_rank"].alias("fetch_rank"),
        F.array_position("sources", p["source_key"]).alias("source_ord"),
        (i + 1).alias("at"),
    )
    entry = lambda x: F.struct(
        (-x["neg_score"]).alias("score"),
        F.element_at("bundle", x["at"])["id"].alias("id"),
        F.element_at("bundle", x["at"])["skill_counts"].alias("skill_counts"),
        F.element_at("bundle", x["at"])["shown"].alias("shown"),
    )
    return {
        "bundle": F.filter("bundle", lambda p: F.size(p["vector"]) == F.size("embedding")),
        "sources": F.array_distinct(F.transform("bundle", lambda p: p["source_key"])),
        "scored": F.transform("bundle", item),
        "placed": quota_order(F.col("items"), F.col("sources"), total),
        "listed": F.transform("items", entry),
        "matched": matched_skills(F.col("p.skill_counts"), F.col("skills")),
        "match_score": vectors.with_bonus(F.bround("p.score", 2), F.size("matched_skills")),
    }


def _ranked(pairs: DataFrame, as_of, total: int) -> DataFrame:
    """Scores the bundle of every row and keeps its balanced list.

    A bundle is bounded, so scoring and ranking stay inside the row: nothing is
    shuffled, and only the places of the final list leave it. Each step is a column
    of its own so that no step is evaluated twice.
    """
    by = _ranking(pairs.sparkSession.sparkContext.applicationId, total)
    listed = (
        pairs.withColumn("bundle", by["bundle"])
        .withColumn("sources", by["sources"])
        .filter(F.size("sources") > 0)
        .withColumn("items", by["scored"])
        .withColumn("items", by["placed"])
        .withColumn("items", by["listed"])
        .select("candidate_id", "skills", F.posexplode_outer("items").alias("pos", "p"))
        .withColumn("matched_skills", by["matched"])
    )
    shown = listed.schema["p"].dataType["shown"].dataType
    age = dates.date_age if isinstance(shown["posted_date"].dataType, T.DateType) else dates.days_since
    return listed.select(
        "candidate_id",
        (F.col("pos") + 1).alias("position"),
        "p.id",
        "p.shown.*",
        by["match_score"].alias("match_score"),
        "matched_skills",
        age(F.col("p.shown.posted_date"), as_of).alias("days_since_posted"),
    )


def _request_flags(found: DataFrame, postings: DataFrame) -> DataFrame:
    """Per request: postings fetched, those with a usable vector, any in the experience band.

    The band belongs to the request, so it is checked once per request.
    """
    flags = fetch_by_id(postings.select("id", "experience_level", "embedding"), found).select(
        "id", "experience_level", vectors.is_usable(F.col("embedding")).alias("usable")
    )
    level = F.get_json_object("request", "$.level")
    per_id = found.groupBy("id").agg(F.count("*").alias("n"))
    return (
        spread_join(found.select("request", "id"), flags, "id", per_id, "request")
        .groupBy("request")
        .agg(
            F.count("*").cast("int").alias("fetched"),
            F.count_if("usable").alias("usable"),
            F.bool_or(F.coalesce(bands_overlap(F.col("experience_level"), level), F.lit(False))).alias("any_match"),
        )
    )


def mismatch_flags(candidates: DataFrame, postings: DataFrame, limit: int = FETCH_LIMIT) -> DataFrame:
    """``candidate_id, mismatch`` for candidates with fetched postings.

    Looks at everything fetched, before vectors are checked.
    """
    people = asking(candidates).filter("request is not null")
    stated = F.coalesce(F.col("category"), F.lit("")) != ""
    asked = people.select("candidate_id", "request", stated.alias("stated"))
    requests, found = searched(candidates, postings, limit)
    flags = _request_flags(found, postings)
    return spread_join(asked, flags, "request", requests, "candidate_id").select(
        "candidate_id", (F.col("stated") & ~F.col("any_match")).alias("mismatch")
    )


def candidate_status(
    candidates: DataFrame,
    postings: DataFrame,
    limit: int = FETCH_LIMIT,
    search: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``candidate_id, status, message, fetched``; also needs ``resume_text``."""
    people = asking(candidates).select(
        "candidate_id",
        "request",
        (F.coalesce(F.col("resume_text"), F.lit("")) == "").alias("no_text"),
        vectors.is_usable(F.col("embedding")).alias("scorable"),
        (F.coalesce(F.col("category"), F.lit("")) != "").alias("stated"),
    )
    requests, found = search or searched(candidates, postings, limit)
    flags = _request_flags(found, postings)
    # Candidates without a request meet nobody; their own id spreads them.
    keyed = people.withColumn("request", F.coalesce("request", F.col("candidate_id").cast("string")))
    fetched = F.coalesce("fetched", F.lit(0))
    status = (
        F.when(F.col("no_text"), "no_text")
        .when(fetched == 0, "no_jobs")
        .when(~F.col("scorable") | (F.col("usable") == 0), "none_matched")
        .when(F.col("stated") & ~F.col("any_match"), "mismatch")
        .otherwise("ok")
    )
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return (
        spread_join(keyed, flags, "request", requests, "candidate_id", "left")
        .withColumn("status", status)
        .select("candidate_id", "status", F.try_element_at(message, F.col("status")).alias("message"), fetched.alias("fetched"))
    )


def recommend_resumes(
    resumes: DataFrame,
    preferences: DataFrame,
    postings: DataFrame,
    as_of,
    skills: DataFrame,
    role_skills: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    total: int = TOTAL,
    limit: int = FETCH_LIMIT,
) -> DataFrame:
    """Resume texts to ranked lists with the status and message of every candidate, in one search.

    ``resumes`` has ``candidate_id, text``, ``preferences`` has ``candidate_id,
    pref_location, form_level``; ``embed(df, text)`` adds ``embedding`` in the postings'
    vector space. A candidate without a list has one row whose ``position`` is NULL.
    """
    read = profile(resumes, as_of, skills, role_skills).select(
        "candidate_id", "skills", "best_job_roles", F.col("experience_category").alias("parsed_level"), "resume_text"
    )
    asked = preferences.select("candidate_id", "pref_location", "form_level").join(read, "candidate_id", "left")
    text = F.coalesce("resume_text", F.lit(""))
    people = embed(asked.withColumn("resume_text", text), "resume_text")
    people = staged(people.withColumn("embedding", F.when(F.col("resume_text") != "", F.col("embedding"))), "people")
    search = searched(people, postings, limit)
    lists = recommend(people, postings, as_of, skills, total, limit, search)
    return candidate_status(people, postings, limit, search).join(lists, "candidate_id", "left")
