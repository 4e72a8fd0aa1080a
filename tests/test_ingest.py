import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall import dims, fixtures as fx
from rolecall.functions.embed import embed_text
from rolecall.operators.dedupe import new_rows
from rolecall.plans import ingest
from rolecall.session import fresh_dir, staged
from rolecall.sources import pages
from rolecall.streaming.ingest import append_batch, posting_stream, stream_ingest

SF = "/root/testdata/sf0.001"
KEYS = ["job_title", "company", "source"]


def first(df):
    return df.first().asDict()


def detail(spark, html):
    df = spark.createDataFrame([(1, "u", "r", html)], "page_id long, url string, role string, html string")
    return first(pages.extract_detail_pages(df, dims.skills_frame(spark), "2001-09-01"))


def test_detail_page_defaults_and_fallbacks(spark):
    empty = detail(spark, "<p>nothing</p>")
    assert (empty["job_title"], empty["company"], empty["salary"]) == ("Not Available", "Not Available", "Not disclosed")
    assert (empty["applicants"], empty["job_type"], empty["skills_required"]) == (0, "Not Available", "Not Available")
    page = (
        '<h1>T</h1><span class="topcard__flavor">C</span><p>25 applied today</p>'
        '<div class="jobs-description__content">Python <div>and</div> sql</div>'
        '<li class="jobs-unified-top-card__job-insight"><span>Seniority</span></li>'
        '<li class="jobs-unified-top-card__job-insight"><h3 class="description__job-criteria-subheader">Employment type</h3>'
        "<span>Contract</span></li>"
    )
    row = detail(spark, page)
    assert (row["job_title"], row["company"], row["applicants"], row["job_type"]) == ("T", "C", 25, "Contract")
    assert row["job_description"] == "Python and sql" and row["skills_required"] == "python, sql"


def test_cards_without_title_link_or_age_are_skipped(spark):
    card = lambda inner: f'<div class="srp-jobtuple-wrapper">{inner}</div>'
    day = '<span class="job-post-day">today</span>'
    html = "\n".join(
        [
            card(f'<a class="title" href="/1"> One </a>{day}<li class="tag-li">B</li><li class="tag-li">a</li><li class="tag-li">b </li>'),
            card(f'<a class="title">no link</a>{day}'),
            card('<a class="title" href="/3">no age</a>'),
            card(day),
            card(f'<div><a class="title" href="/5?a=1&amp;b=2">Five</a></div>{day}'),
        ]
    ) + '<a class="title" href="/footer">x</a>'
    df = spark.createDataFrame([(1, "data-engineer", 1, html)], "page_id long, role string, page int, html string")
    rows = pages.extract_cards(df, "2001-09-01").orderBy("pos").collect()
    assert [(r.pos, r.job_title, r.job_link) for r in rows] == [(0, "One", "/1"), (4, "Five", "/5?a=1&b=2")]
    assert rows[0].skills_required == "b, a" and rows[0].company == "Unknown" and rows[0].role == "data_engineer"


def test_card_details(spark):
    html = '<section class="styles_job-desc-container__txpYf">Part Time work</section><label>Applicants: </label><i></i><span>1,200</span>'
    df = spark.createDataFrame([("/1", html), ("/1", html)], "url string, html string")
    cards = spark.createDataFrame([("/1",), ("/2",)], "job_link string")
    got = {r.job_link: (r.job_type, r.applicants) for r in pages.with_card_details(cards, df).collect()}
    assert got == {"/1": ("Part Time", 1200), "/2": ("Not Available", 0)}


def test_discover_links(spark):
    card = lambda href: f'<div class="base-card"><a class="base-card__full-link" href="{href}">x</a></div>'
    rows = [(1, card("/a") + card("") + card("/b")), (2, card("/b") + card("/c"))]
    df = spark.createDataFrame(rows, "page_id long, html string")
    seen = spark.createDataFrame([("/a",)], "url string")
    got = sorted((r.url, r.page_id) for r in pages.discover_links(df, seen).collect())
    assert got == [("/b", 1), ("/c", 2)]


def test_ingest_twice_adds_nothing(spark):
    posts = staged(fx.postings(spark, SF), "posts")
    none = posts.drop("posted_text").limit(0)
    args = (fx.posting_pages(posts), fx.listing_pages(posts), fx.listing_details(posts), dims.skills_frame(spark), fx.AS_OF)
    added = staged(ingest.ingest(none, *args), "added")
    assert added.count() > 0 and added.groupBy(*[F.lower(k) for k in KEYS]).count().filter("count > 1").count() == 0
    assert ingest.ingest(added, *args).count() == 0
    numbered = added
    assert numbered.agg(F.min("id") > 0, F.count_distinct("id")).first() == (True, added.count())


def test_quotas_limit_pages_and_postings(spark):
    posts = fx.postings(spark, SF)
    listed = fx.listing_pages(posts).withColumn("page", F.col("page") + 1)
    some = ingest.listing_postings(listed, fx.listing_details(posts), fx.AS_OF, (3, 1))
    assert some.groupBy("role").count().agg(F.max("count")).first()[0] <= 3


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string")
    rows = {r.id: r.embedding for r in embed_text(df, "text").collect()}
    assert rows[1] == rows[2] and len(rows[3]) == len(rows[1])

    def encoder():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    assert {r.id: r.embedding for r in embed_text(df, "text", encoder).collect()} == {1: [3.0, 1.0], 2: [3.0, 1.0], 3: [0.0, 1.0]}


@pytest.fixture(scope="module")
def arrivals(spark):
    posts = fx.postings(spark, SF).drop("posted_text", "embedding")
    posts = posts.withColumn("embedding", F.lit(None).cast("array<float>"))
    return staged(posts.withColumn("source", F.when(F.col("id") % 10 != 0, F.col("source"))), "arrivals")


def test_stream_equals_batch(spark, arrivals):
    folder = fresh_dir(spark, "stream")
    arrivals.repartition(5).write.parquet(f"{folder}/in")
    for _ in range(2):  # the second start finds nothing new
        stream = posting_stream(spark, f"{folder}/in", maxFilesPerTrigger="2")
        stream_ingest(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    table = spark.read.parquet(f"{folder}/table")
    once = new_rows(arrivals.limit(0), arrivals, "id")
    keys = lambda df: sorted(map(str, df.select(*KEYS).collect()))
    assert keys(table) == keys(once)
    assert table.select("batch_id").distinct().count() > 1


def test_replayed_batch_replaces_itself(spark, arrivals):
    table = fresh_dir(spark, "replay")
    early, late = arrivals.filter("id < 700"), arrivals.filter("id >= 700")
    append_batch(early, 0, table, "id")
    append_batch(late, 1, table, "id")
    before = spark.read.parquet(table).count()
    append_batch(late, 1, table, "id")
    assert spark.read.parquet(table).count() == before
    assert os.path.isdir(f"{table}/batch_id=1")


def test_bounded_stream_drops_repeats_and_late_rows(spark, arrivals):
    folder = fresh_dir(spark, "bounded")
    base = arrivals.filter("source is not null").limit(1)
    at = lambda day: base.withColumn("scraped_at", F.lit(f"2001-01-{day:02d}").cast("timestamp"))
    rename = lambda df, name: df.withColumn("company", F.lit(name))
    batches = [rename(at(20), "a"), rename(at(20), "a"), rename(at(1), "late"), rename(at(21), "b")]
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = posting_stream(spark, f"{folder}/in", T.StructField("extra", T.StringType()))
        stream_ingest(stream, f"{folder}/table", f"{folder}/check", mode="bounded", delay="2 days").awaitTermination()
    assert sorted(r.company for r in spark.read.parquet(f"{folder}/table").collect()) == ["a", "b"]
