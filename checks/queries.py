"""Registered queries: each runs one operator or job over whole tables.

Results use plain columns (dates and lists as text) so that they compare with
the SQL in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall import dims, fixtures as fx
from rolecall.fixtures import AS_OF
from rolecall.functions import bands, dates, text as t, vectors
from rolecall.functions.embed import embed_text as embed, model_name, refresh_vectors, stale_vectors as find_stale
from rolecall.operators import filters, ids, reports, roles as ro, skills as sk
from rolecall.operators.bands import band_join as join_bands
from rolecall.operators.dedupe import append_ignore as append_rows
from rolecall.operators.frontier import seen_links, visit
from rolecall.operators.quota import crawl_quota as quota_per_title, quota_rank as rank_by_quota
from rolecall.operators.search import search_one as search_newest, search_postings as search
from rolecall.plans import ingest as ing, present, profile as prof, recommend as rec
from rolecall.plans.maintain import maintain as maintain_table, normalise_levels as levels, normalise_levels_by_table
from rolecall.schema import POSTING_SCHEMA, rejected_postings, validate_postings
from rolecall.session import file_versions, fresh_dir, staged
from rolecall.sources import pages as pg, uploads
from rolecall.sources.batches import read_batches
from rolecall.sources.tables import read_postings, write_postings
from rolecall.streaming.ingest import append_batch, compact_table, posting_stream, stream_ingest as start_ingest

SPLIT_DATE = "1998-04-01"


def _joined(col, sep: str = "|"):
    return F.array_join(col, sep)


def _skills(spark: SparkSession) -> DataFrame:
    return dims.skills_frame(spark, fx.skill_list())


# Search ---------------------------------------------------------------------


def _asking(spark, sf):
    return rec.asking(fx.candidates(spark, sf))


def search_postings(spark: SparkSession, sf: str) -> DataFrame:
    found = search(fx.postings(spark, sf), _asking(spark, sf))
    return found.withColumn("posted_date", F.col("posted_date").cast("string")).withColumn(
        "embedding", F.size("embedding").cast("int")
    ).withColumn("embedding", F.when(F.col("embedding") > 0, F.col("embedding")).otherwise(0))


def recent_postings(spark: SparkSession, sf: str) -> DataFrame:
    return filters.recent(fx.postings(spark, sf), AS_OF, 60).select(
        "id", F.col("posted_date").cast("string").alias("posted_date")
    )


# Maintenance ----------------------------------------------------------------


def clean_invalid(spark: SparkSession, sf: str) -> DataFrame:
    return filters.clean_invalid(fx.postings(spark, sf)).select("id", "skills_required", "job_type", "applicants")


def invalid_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.invalid_reason_counts(fx.postings(spark, sf))


def normalise_levels(spark: SparkSession, sf: str) -> DataFrame:
    return levels(fx.postings(spark, sf)).select("id", "source", "experience_level")


def normalise_levels_table(spark: SparkSession, sf: str) -> DataFrame:
    found = normalise_levels_by_table(fx.postings(spark, sf), dims.level_frame(spark))
    return found.select("id", "source", "experience_level")


def renumber_ids(spark: SparkSession, sf: str) -> DataFrame:
    valid = filters.clean_invalid(fx.postings(spark, sf)).select("id", F.col("id").alias("old_id"))
    return ids.renumber(valid).select("old_id", "id", "batch")


def next_id(spark: SparkSession, sf: str) -> DataFrame:
    return ids.next_id(filters.clean_invalid(fx.postings(spark, sf)))


def maintain(spark: SparkSession, sf: str) -> DataFrame:
    return maintain_table(fx.postings(spark, sf)).select("id", "job_link", "experience_level", "batch")


def append_ignore(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.postings(spark, sf).drop("posted_text", "embedding")
    early = F.col("posted_date") < F.lit(SPLIT_DATE).cast("date")
    existing = posts.filter(early)
    batch = posts.filter(~early).withColumn("source", F.when(F.col("id") % 10 != 0, F.col("source")))
    return append_rows(existing, batch, "id").select("id", "job_title", "company", "source", "location")


def insert_then_maintain(spark: SparkSession, sf: str) -> DataFrame:
    """New postings come without ids; per source and role what the insert and the maintenance did."""
    posts = fx.postings(spark, sf).drop("posted_text", "embedding").withColumn("arrival", F.col("id"))
    early = F.col("posted_date") < F.lit(SPLIT_DATE).cast("date")
    existing = posts.filter(early)
    batch = posts.filter(~early).withColumn("id", F.lit(None).cast("long"))
    # each eleventh row misses a required column and is refused
    batch = batch.withColumn("company", F.when(F.col("arrival") % 11 != 0, F.col("company")))
    table = staged(append_rows(existing, batch, "arrival", scraped_at="2001-09-01 00:00:00"), "inserted")
    kept = maintain_table(table)
    dense = kept.agg((F.max("id") == F.count(F.lit(1))).alias("dense"), F.countDistinct("id").alias("n"))
    counts = kept.groupBy("source", "role").agg(F.count(F.lit(1)).alias("maintained"))
    return (
        reports.run_report(existing, table)
        .join(counts, ["source", "role"], "left")
        .withColumn("maintained", F.coalesce("maintained", F.lit(0)))
        .crossJoin(F.broadcast(dense))
        .withColumn("timed", F.lit(table.filter("id is null or scraped_at is null").count() == 0))
    )


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.postings(spark, sf)
    return reports.run_report(posts, filters.clean_invalid(posts))


# Dates, bands, levels -------------------------------------------------------


def parse_posted_date(spark: SparkSession, sf: str) -> DataFrame:
    day = dates.parse_posted(F.col("posted_text"), AS_OF)
    return fx.postings(spark, sf).select("id", "posted_text", day.cast("string").alias("posted_date"))


def days_since(spark: SparkSession, sf: str) -> DataFrame:
    return fx.postings(spark, sf).select("id", dates.days_since(F.col("posted_date"), AS_OF).alias("days"))


def age_label(spark: SparkSession, sf: str) -> DataFrame:
    days = dates.days_since(F.col("posted_date"), "2001-08-03")
    return fx.postings(spark, sf).select("id", dates.age_label(days).alias("label"))


def parse_bands(spark: SparkSession, sf: str) -> DataFrame:
    found = fx.postings(spark, sf).withColumn("band", bands.parse_band(F.col("experience_level")))
    return found.select("id", F.col("band.min").alias("min_years"), F.col("band.max").alias("max_years"))


def band_overlap(spark: SparkSession, sf: str) -> DataFrame:
    fits = lambda c: F.coalesce(bands.bands_overlap(F.col("experience_level"), F.lit(c)), F.lit(False))
    return fx.postings(spark, sf).select(
        "id", fits("Fresher").alias("fresher"), fits("Experienced").alias("experienced"), fits("Any").alias("other")
    )


def band_join(spark: SparkSession, sf: str) -> DataFrame:
    """Free bands on both sides: per customer the orders of the same nation whose band shares a year."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    customers = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = fx.table(spark, sf, "orders").join(customers, F.col("o_custkey") == c)
    low = F.when(k % 50 != 0, (k % 40).cast("int"))
    wanted = orders.select(k.alias("order"), "nation", low.alias("low"), (low + k % 7 + F.when(k % 500 == 1, 900).otherwise(0)).alias("high"))
    offered = customers.select(c.alias("customer"), "nation", (c % 25).alias("low"), (c % 25 + c % 4 - 1).alias("high"))
    # orders of a nation with equal bands meet the same customers, so they are counted before they are paired
    place = ["nation", "low", "high"]
    asked = wanted.groupBy(*place).agg(F.count("*").alias("n"), F.sum("order").alias("orders"))
    pairs = join_bands(asked, offered.select(*place).distinct(), ["nation"])
    met = pairs.groupBy("nation", "other_low", "other_high").agg(F.sum("n").alias("n"), F.sum("orders").alias("orders"))
    mine = offered.withColumnsRenamed({"low": "other_low", "high": "other_high"}).join(met, ["nation", "other_low", "other_high"])
    return mine.groupBy("customer").agg(F.sum("n").alias("n"), F.sum("orders").alias("orders"))


def candidate_status(spark: SparkSession, sf: str) -> DataFrame:
    return rec.candidate_status(fx.candidates(spark, sf), fx.postings(spark, sf))


def mismatch_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose fetched postings all miss their experience band."""
    return rec.mismatch_flags(fx.candidates(spark, sf), fx.postings(spark, sf))


# Skills and roles -----------------------------------------------------------


def extract_skills(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    found = sk.extract_skills(docs, _skills(spark), "text", "doc_id")
    return found.select("doc_id", _joined("skills").alias("skills"))


def extract_skills_join(spark: SparkSession, sf: str) -> DataFrame:
    """The join form on the texts of the row form, with repeated and NULL keys."""
    key = F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") % 50)
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", key.alias("key"))
    found = sk.extract_skills_by_join(docs, _skills(spark), "text", "key", "skills")
    return found.select("doc_id", _joined("skills").alias("skills"))


def skill_frequency(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.postings(spark, sf).select("id", "job_description")
    found = sk.extract_skills(posts, _skills(spark), "job_description")
    counts = found.withColumn("counts", sk.skill_counts(F.col("job_description"), F.col("skills")))
    shown = _joined(F.transform("counts", lambda c: F.concat(c["skill"], F.lit("="), c["n"].cast("string"))))
    return counts.select("id", shown.alias("counts"), _joined(sk.by_frequency(F.col("counts"))).alias("by_frequency"))


def skills_joined(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.postings(spark, sf).select("id", "job_description")
    found = sk.extract_skills(posts, _skills(spark), "job_description")
    return found.select("id", t.joined_skills(F.col("skills")).alias("skills_required"))


def skill_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Skills a customer shares with each posting of that customer's company."""
    posts = fx.postings(spark, sf).select("id", "company", "job_description")
    mine = fx.table(spark, sf, "customer").select(
        F.col("c_name").alias("company"), fx.candidate_skills(F.col("c_custkey")).alias("mine")
    )
    wanted = sk.extract_skills(posts, _skills(spark), "job_description")
    counted = wanted.withColumn("counts", sk.skill_counts(F.col("job_description"), F.col("skills")))
    pairs = counted.join(mine, "company").withColumn("matched", sk.matched_skills(F.col("counts"), F.col("mine")))
    return pairs.select(
        "id",
        _joined(sk.overlap(F.col("mine"), F.col("skills"))).alias("shared"),
        _joined(F.slice("matched", 1, 2)).alias("top"),
        t.overflow_label(F.col("matched"), 2).alias("more"),
    )


def skill_bonus(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.postings(spark, sf).select("id", "company", "applicants", "job_description")
    mine = fx.table(spark, sf, "customer").select(
        F.col("c_name").alias("company"), fx.candidate_skills(F.col("c_custkey")).alias("mine")
    )
    wanted = sk.extract_skills(posts, _skills(spark), "job_description").join(mine, "company")
    matched = F.size(F.array_intersect("mine", "skills"))
    score = (F.coalesce("applicants", F.lit(0)) * 3 - 45).cast("double")
    return wanted.select("id", matched.alias("matched"), vectors.with_bonus(score, matched).alias("match_score"))


def _skilled(spark, sf):
    return fx.candidates(spark, sf).select("candidate_id", "skills")


def best_roles(spark: SparkSession, sf: str) -> DataFrame:
    few = sk.with_default_skills(F.col("skills"), dims.DEFAULT_SKILLS)
    found = ro.best_roles(_skilled(spark, sf).withColumn("skills", few), dims.role_skills_frame(spark))
    return found.select("candidate_id", _joined(F.array_sort("skills")).alias("skills"), _joined("best_job_roles").alias("roles"))


def best_roles_join(spark: SparkSession, sf: str) -> DataFrame:
    """The join form on the candidates of the row form, with repeated and NULL keys."""
    few = sk.with_default_skills(F.col("skills"), dims.DEFAULT_SKILLS)
    key = F.when(F.col("candidate_id") % 10 != 0, F.col("candidate_id") % 50)
    people = _skilled(spark, sf).withColumn("skills", few).withColumn("key", key)
    found = ro.best_roles_by_join(people, dims.role_skills_frame(spark), "key", "best_job_roles")
    return found.select("candidate_id", _joined(F.array_sort("skills")).alias("skills"), _joined("best_job_roles").alias("roles"))


def role_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = ro.role_scores(_skilled(spark, sf), dims.role_skills_frame(spark))
    return found.select("candidate_id", "role", "matched", F.round("score", 6).alias("score"))


# Resume text ----------------------------------------------------------------


def contact_info(spark: SparkSession, sf: str) -> DataFrame:
    body = t.normalise(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", t.email(body).alias("email"), t.phone(body).alias("phone"))


def resume_contacts(spark: SparkSession, sf: str) -> DataFrame:
    body = t.normalise(F.col("text"))
    return fx.resumes(spark, sf).select(
        "candidate_id", t.person_name(body).alias("name"), t.email(body).alias("email"), t.phone(body).alias("phone")
    )


def role_phrases(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_sort(t.role_phrases(F.col("text")))
    return fx.resumes(spark, sf).select("candidate_id", _joined(found).alias("roles"), _joined(F.transform(found, t.slug)).alias("slugs"))


def experience_years(spark: SparkSession, sf: str) -> DataFrame:
    spans = fx.resumes(spark, sf).withColumn("spans", dates.month_spans(F.col("text"), AS_OF))
    years = dates.total_months(F.col("spans")) / 12
    details = F.transform(
        dates.experience_details(F.col("spans")),
        lambda d: F.concat_ws("/", d["start_date"], d["end_date"], d["duration"]),
    )
    return spans.select(
        "candidate_id",
        dates.total_months(F.col("spans")).alias("months"),
        F.bround(years, 2).alias("years"),
        bands.categorise(years).alias("category"),
        _joined(details).alias("details"),
    )


def education(spark: SparkSession, sf: str) -> DataFrame:
    found = F.transform(t.education(F.col("text")), lambda e: F.concat_ws(":", e["degree"], e["field"]))
    return fx.resumes(spark, sf).select("candidate_id", _joined(found).alias("education"))


def profile(spark: SparkSession, sf: str) -> DataFrame:
    found = prof.profile(fx.resumes(spark, sf), AS_OF, _skills(spark), dims.role_skills_frame(spark))
    return found.select(
        "candidate_id",
        F.col("personal_info.name").alias("name"),
        F.col("personal_info.email").alias("email"),
        F.col("personal_info.phone").alias("phone"),
        _joined(F.array_sort("roles")).alias("roles"),
        _joined(F.array_sort("skills")).alias("skills"),
        F.col("total_experience_years").alias("years"),
        F.size("experience_details").alias("jobs"),
        _joined("education.degree").alias("degrees"),
        F.col("experience_category").alias("category"),
        _joined("best_job_roles").alias("best_roles"),
        F.length("resume_text").alias("chars"),
    )


# Pages and files ------------------------------------------------------------


def applicant_count(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Over "), F.format_number(F.col("applicants") * 37, 0), F.lit(" applicants"))
    return fx.postings(spark, sf).select("id", t.first_number(text).alias("applicants"))


def job_type(spark: SparkSession, sf: str) -> DataFrame:
    labelled = F.col("job_description")
    plain = F.concat_ws(" ", F.lit("a"), F.lower("job_type"), F.lit("role"))
    return fx.postings(spark, sf).select(
        "id", t.job_type_from_text(labelled).alias("labelled"), t.job_type_from_text(plain).alias("named")
    )


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "pages").withColumn("role", F.lit("any"))
    found = pg.extract_detail_pages(pages, _skills(spark), AS_OF)
    return found.select(
        "page_id", "job_link", "job_title", "company", "location", "salary", "applicants", "job_type",
        "experience_level", F.col("posted_date").cast("string").alias("posted_date"),
    )


def posting_page_fields(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.posting_pages(fx.postings(spark, sf))
    found = pg.extract_detail_pages(pages, _skills(spark), AS_OF)
    return found.withColumn("posted_date", F.col("posted_date").cast("string")).select(
        "page_id", "job_link", "role", "job_title", "company", "location", "salary", "applicants", "job_type",
        "experience_level", "posted_date", "job_description", "skills_required", "source",
    )


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all pages, less those that lead to a seen address."""
    pages = fx.table(spark, sf, "pages")
    seen = pages.select(F.concat(F.lit("/"), F.element_at(F.split("url", "/"), -1)).alias("url")).distinct()
    return pg.discover_links(pages, seen, card=None, link=("a", None)).select("url", "page_id")


def page_cards(spark: SparkSession, sf: str) -> DataFrame:
    found = pg.extract_cards(fx.listing_pages(fx.postings(spark, sf)), AS_OF)
    return found.select(
        "job_link", "role", "page", "pos", "job_title", "company", "location", "salary", "experience_level",
        "skills_required", F.col("posted_date").cast("string").alias("posted_date"),
    )


def card_details(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.postings(spark, sf)
    cards = pg.extract_cards(fx.listing_pages(posts), AS_OF)
    found = pg.with_card_details(cards, fx.listing_details(posts))
    return found.select("job_link", "job_description", "job_type", "applicants")


def crawl_quota(spark: SparkSession, sf: str) -> DataFrame:
    cards = pg.extract_cards(fx.listing_pages(fx.postings(spark, sf)), AS_OF)
    # Listing pages are numbered from 0; the quota counts pages from 1.
    numbered = cards.withColumn("page", F.col("page") + 1)
    return quota_per_title(numbered, "role", *ing.LISTING_LIMITS).select("role", "page", "pos", "job_link")


def ingest_pages(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.postings(spark, sf)
    early = F.col("posted_date") < F.lit(SPLIT_DATE).cast("date")
    found = ing.ingest(
        posts.filter(early).drop("posted_text"),
        fx.posting_pages(posts.filter(~early)),
        fx.listing_pages(posts.filter(~early)),
        fx.listing_details(posts.filter(~early)),
        _skills(spark),
        AS_OF,
    )
    return found.select(
        "job_link", "job_title", "company", "source", "location", "applicants", "job_type", "skills_required"
    )


def discover_and_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Three crawls, the second run twice and the third over the pages of the second: the table they leave."""
    folder = fresh_dir(spark, "crawl")
    posts = staged(fx.postings(spark, sf), "posts")
    searches, pages = fx.search_pages(posts), fx.posting_pages(posts)
    listings, details = fx.listing_pages(posts).withColumn("page", F.col("page") + 1), fx.listing_details(posts)
    for batch_id, last in ((0, 2), (1, 10**9), (1, 10**9), (2, 10**9)):
        ing.discover_and_ingest(
            f"{folder}/table", f"{folder}/frontier", batch_id, searches.filter(F.col("page") <= last), pages, listings, details,
            _skills(spark), AS_OF,
        )
    found = read_batches(spark, f"{folder}/table", POSTING_SCHEMA)
    return found.select("batch_id", "id", "job_link", "job_title", "company", "source", "role", "applicants", "skills_required")


def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Links of two crawls with their first sighting, and which the quota took."""
    folder = fresh_dir(spark, "frontier")
    searches = staged(fx.search_pages(fx.postings(spark, sf)), "searches")
    for batch_id, last in ((0, 2), (1, 10**9)):
        visit(searches.filter(F.col("page") <= last), folder, batch_id, ing.DETAIL_LIMITS)
    return seen_links(spark, folder).select("batch_id", "url", "role", "page", "page_id", "pos", "taken")


def upload_routing(spark: SparkSession, sf: str) -> DataFrame:
    return uploads.route_uploads(fx.files(spark, sf)).select("doc_id", "status", "reason")


def assemble_text(spark: SparkSession, sf: str) -> DataFrame:
    return uploads.assemble_text(fx.table(spark, sf, "conversations"), "conv_id", "turn", "text")


def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    found = embed(fx.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 3).alias("norm"))


def stale_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that are missing, of another model or of an earlier text are made again, the others stay."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    model, k = model_name(), F.col("doc_id")
    stored = embed(docs.filter(k % 3 != 0), "text").select(
        "doc_id",
        F.xxhash64(F.when(k % 7 == 0, "an earlier text").otherwise(F.coalesce("text", F.lit("")))).alias("text_hash"),
        F.when(k % 5 == 0, "hashed:64").otherwise(model).alias("embedding_model"),
        "embedding",
    )
    stale = find_stale(docs, stored, model, "doc_id").select("doc_id", F.lit(True).alias("made"))
    whole = refresh_vectors(docs, stored, model, embed, "doc_id")
    return whole.join(stale, "doc_id", "left").select("doc_id", "embedding_model", F.coalesce("made", F.lit(False)).alias("made"))


# Ranking --------------------------------------------------------------------


def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of every posting to the customer it belongs to, through JSON text."""
    posts = fx.postings(spark, sf)
    stored = vectors.to_json(F.col("embedding"), F.col("job_description"))
    read = posts.select("id", "company", stored.alias("json")).withColumn("vector", vectors.from_json(F.col("json")))
    mine = fx.candidates(spark, sf).join(fx.table(spark, sf, "customer"), F.col("candidate_id") == F.col("c_custkey"))
    mine = mine.select(F.col("c_name").alias("company"), F.col("embedding").alias("mine"))
    a, b = F.col("vector"), F.col("mine")
    score = vectors.cosine_percent(a, b, vectors.norm(a), vectors.norm(b))
    pairs = read.filter(vectors.is_usable(a)).join(mine, "company")
    return pairs.select("id", F.round(score, 6).alias("score"))


def quota_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Postings per nation, balanced over the ten vector labels as sources."""
    labels = fx.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    n_vectors = labels.count()
    orders = fx.table(spark, sf, "orders").join(
        fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    scored = orders.join(labels, F.col("o_orderkey") % n_vectors == F.col("vec_id")).select(
        F.col("c_nationkey").alias("nation"),
        F.col("o_orderkey").alias("fetch_rank"),
        F.col("label").cast("string").alias("source"),
        F.floor("o_totalprice").cast("double").alias("score"),
    )
    return rank_by_quota(scored, key="nation").select("nation", "position", "fetch_rank", "source", "score")


_STORED: dict[tuple[str, str], tuple[DataFrame, list, list]] = {}


def _recommend(spark, sf):
    return rec.recommend(fx.candidates(spark, sf), fx.postings(spark, sf), AS_OF, _skills(spark))


def _recommended(spark, sf):
    """The stored recommendation lists that the views read; made anew if the tables have changed or stored files are gone."""
    key = (spark.sparkContext.applicationId, sf)
    read = file_versions(spark, *(fx.table(spark, sf, name) for name in ("orders", "customer", "nation", "embeddings")))
    if key in _STORED:
        lists, of, files = _STORED[key]
        if of == read and files == file_versions(spark, lists):
            return lists
    lists = staged(_recommend(spark, sf), "results")
    _STORED[key] = lists, read, file_versions(spark, lists)
    return lists


def _shown(results: DataFrame) -> DataFrame:
    return (
        results.withColumn("posted_date", F.col("posted_date").cast("string"))
        .withColumn("matched_skills", _joined("matched_skills"))
        .withColumn("match_score", F.round("match_score", 4))
    )


def recommend(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_recommend(spark, sf))


#: The candidate whose single request is asked; the first one with location, roles and vector at any scale.
ASKING = 7


def _one(spark, sf):
    person = fx.candidates(spark, sf).filter(F.col("candidate_id") == ASKING)
    category = bands.chosen_category(F.col("form_level"), F.col("parsed_level"))
    row = person.select("pref_location", category.alias("category"), "best_job_roles").first()
    return person, row.pref_location, row.category, row.best_job_roles


def recommend_one(spark: SparkSession, sf: str) -> DataFrame:
    """One request over the stored features of all postings."""
    person, *request = _one(spark, sf)
    folder = fresh_dir(spark, "features")
    rec.write_features(fx.postings(spark, sf), folder, _skills(spark))
    return _shown(rec.recommend_from_features(person, spark.read.parquet(folder), AS_OF, *request))


def search_one(spark: SparkSession, sf: str) -> DataFrame:
    _, *request = _one(spark, sf)
    found = search_newest(fx.postings(spark, sf), *request)
    return found.select("id", "job_title", "location", "experience_level", F.col("posted_date").cast("string").alias("posted_date"))


def resume_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """From resume texts, every thirteenth empty, to lists and messages; the vectors are the candidates' own."""
    people = fx.candidates(spark, sf).select("candidate_id", "pref_location", "form_level", "embedding")
    texts = fx.resumes(spark, sf).withColumn("text", F.when(F.col("candidate_id") % 13 != 0, F.col("text")).otherwise(""))
    found = rec.recommend_resumes(
        texts, people, fx.postings(spark, sf), AS_OF, _skills(spark), dims.role_skills_frame(spark),
        lambda df, _: df.join(people.select("candidate_id", "embedding"), "candidate_id"),
    )
    return found.select(
        "candidate_id", "status", "message", "fetched", "position", "id", F.round("match_score", 4).alias("match_score"),
        _joined("matched_skills").alias("matched_skills"),
    )


# Views ----------------------------------------------------------------------

_CARD = ["candidate_id", "place", "page", "position", "id"]


def views_all(spark: SparkSession, sf: str) -> DataFrame:
    shown = present.present(_recommended(spark, sf), "all", pages=2)
    return shown.select(
        *_CARD, "job_title", "applicants", "age_label", "score_label", "skills_count",
        _joined("skills_shown").alias("skills_shown"), "skills_more", "source_key",
    )


def views_recent(spark: SparkSession, sf: str) -> DataFrame:
    return present.view_recent(_recommended(spark, sf)).select(*_CARD, "days_since_posted")


def views_high(spark: SparkSession, sf: str) -> DataFrame:
    return present.view_high(_recommended(spark, sf)).select(*_CARD, F.round("match_score", 4).alias("match_score"))


def views_source(spark: SparkSession, sf: str) -> DataFrame:
    return present.view_source(_recommended(spark, sf), "naukri").select(*_CARD, "source")


def paging(spark: SparkSession, sf: str) -> DataFrame:
    results = _recommended(spark, sf)
    return reports.visible_counts(results, present.view_high(results))


def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return reports.source_list(_recommended(spark, sf))


# Streaming ------------------------------------------------------------------


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Postings arrive as files, one per year; the table equals one insert in that order."""
    folder = fresh_dir(spark, "stream")
    posts = fx.postings(spark, sf).drop("posted_text", "embedding")
    posts = posts.withColumn("embedding", F.lit(None).cast("array<float>"))
    posts = posts.withColumn("source", F.when(F.col("id") % 10 != 0, F.col("source")))
    posts.write.parquet(f"{folder}/in")
    stream = posting_stream(spark, f"{folder}/in", maxFilesPerTrigger="2")
    start_ingest(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    keys = spark.read.parquet(f"{folder}/table")
    # Which copy of a key comes first depends on file order, so compare keys.
    return keys.groupBy("job_title", "company", "source").agg(F.count("*").alias("rows"))


def stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of postings without ids, the last one replayed, the others joined, and all keys once more."""
    table = fresh_dir(spark, "batches")
    posts = fx.postings(spark, sf).drop("posted_text", "embedding")
    posts = posts.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("arrival", F.col("id"))
    posts = posts.withColumn("source", F.when(F.col("id") % 10 != 0, F.col("source"))).withColumn("id", F.lit(None).cast("long"))
    posts = staged(posts, "arrivals")
    part = F.when(F.col("posted_date") < F.lit("1994-01-01"), 0).when(F.col("posted_date") < F.lit(SPLIT_DATE), 1).otherwise(2)
    for batch_id in (0, 1, 2, 2):
        append_batch(posts.filter(part == batch_id), batch_id, table, "arrival")
    compact_table(spark, table, posts.schema)
    append_batch(posts.filter("source is not null"), 3, table, "arrival")
    found = read_batches(spark, table, posts.schema)
    return found.select("batch_id", "id", "arrival", "job_title", "company", "source")


def read_source(spark: SparkSession, sf: str) -> DataFrame:
    """The stored postings of one source and of none, from one day on."""
    folder = fresh_dir(spark, "by-source")
    posts = fx.postings(spark, sf).drop("posted_text")
    write_postings(posts.withColumn("source", F.when(F.col("id") % 10 != 0, F.col("source"))), folder)
    found = read_postings(spark, folder, ["NAUKRI", ""], "1996-01-01")
    return found.select("id", "source", F.col("posted_date").cast("string").alias("posted_date"))


def run_report_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What cleaning and level normalisation delete and update, per source and role and in totals."""
    posts = fx.postings(spark, sf)
    return reports.change_report(posts, levels(filters.clean_invalid(posts)))


def checked_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted and refused rows per source, where every eleventh posting misses its company."""
    posts = fx.postings(spark, sf).drop("posted_text")
    posts = posts.withColumn("company", F.when(F.col("id") % 11 != 0, F.col("company")))
    good = validate_postings(posts).select("source", F.lit(1).alias("a"), F.lit(0).alias("r"))
    refused = rejected_postings(posts).select("source", F.lit(0).alias("a"), F.lit(1).alias("r"))
    return good.unionByName(refused).groupBy("source").agg(F.sum("a").alias("accepted"), F.sum("r").alias("refused"))


def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Random ids for every tenth posting: how many ids there are, how many differ, how many stayed."""
    posts = fx.postings(spark, sf).select(F.col("id").alias("old"), F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"))
    named = filters.with_id(posts)
    return named.agg(
        F.count("id").alias("n"), F.countDistinct("id").alias("distinct_ids"), F.count_if(F.col("id") == F.col("old").cast("string")).alias("kept")
    )


def fetch_time(spark: SparkSession, sf: str) -> DataFrame:
    return fx.postings(spark, sf).select("id", dates.fetch_time(F.col("scraped_at")).alias("fetched"))


QUERIES = {
    f.__name__: f
    for f in (
        search_postings, recent_postings, clean_invalid, invalid_reason_counts, normalise_levels,
        normalise_levels_table, renumber_ids, next_id, maintain, append_ignore, insert_then_maintain, run_report, parse_posted_date,
        days_since, age_label, parse_bands, band_overlap, candidate_status, mismatch_flag, extract_skills,
        extract_skills_join, skill_frequency, skills_joined, skill_overlap, skill_bonus, best_roles,
        best_roles_join, role_scores, contact_info, resume_contacts, role_phrases, experience_years, education,
        profile, applicant_count, job_type, page_fields, posting_page_fields, page_links, page_cards,
        card_details, crawl_quota, ingest_pages, upload_routing, assemble_text, embed_text, cosine_scores,
        quota_rank, recommend, resume_recommendations, views_all, views_recent, views_high, views_source, paging, source_list,
        stream_ingest, discover_and_ingest, crawl_frontier, stream_batches, read_source, run_report_totals, checked_postings,
        missing_ids, fetch_time, recommend_one, search_one, band_join, stale_vectors,
    )
}
