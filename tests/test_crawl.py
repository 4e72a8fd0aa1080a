"""Ids, tables cut by key hash, the crawl frontier, pruned reads and reports."""

import os

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall import dims, fixtures as fx
from rolecall.operators import ids, reports
from rolecall.operators.dedupe import append_ignore, first_per_key, key_columns, not_stored
from rolecall.operators.filters import by_source, recent
from rolecall.operators.frontier import seen_links, visit
from rolecall.plans.ingest import discover_and_ingest, ingest
from rolecall.schema import POSTING_SCHEMA, UNIQUE_KEY
from rolecall.session import fresh_dir, read_if_present, staged, staging
from rolecall.sources import batches
from rolecall.sources.tables import read_postings, write_postings
from rolecall.streaming.ingest import append_batch, compact_table

SF = "/root/testdata/sf0.001"
ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


@pytest.fixture(scope="module")
def posts(spark):
    plain = fx.postings(spark, SF).drop("posted_text", "embedding")
    return staged(plain.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("arrival", F.col("id")), "posts")


def test_ids_do_not_depend_on_the_layout(spark, posts):
    early = F.col("id") < 2000
    existing = posts.filter(early).drop("arrival")
    batch = posts.filter(~early).withColumn("id", F.lit(None).cast("long"))
    found = []
    for layout in (batch.repartition(1), batch.repartition(7), batch.repartitionByRange(5, F.desc("arrival"))):
        table = append_ignore(existing, layout, "arrival").filter("arrival is not null")
        found.append({r.arrival: r.id for r in table.select("arrival", "id").collect()})
    assert found[0] == found[1] == found[2]
    top = existing.agg(F.max("id")).first()[0]
    by_arrival = [found[0][k] for k in sorted(found[0])]
    assert by_arrival == list(range(top + 1, top + 1 + len(by_arrival)))


def test_ranks_of_structs_ties_and_nothing(spark):
    rows = [(2, "b", 1), (1, "z", 2), (2, "a", 3), (1, "z", 4)]
    df = spark.createDataFrame(rows, "x int, y string, n int").withColumn("o", F.struct("x", "y")).repartition(4)
    got = {r.n: r["rank"] for r in ids.ranked(df, "o").collect()}
    assert sorted((got[2], got[4])) == [1, 2] and got[3] == 3 and got[1] == 4
    assert ids.ranked(df.limit(0), "o").count() == 0


def test_a_batch_claims_its_ids_once(spark, tmp_path):
    ledger = f"{tmp_path}/ids"
    assert ids.claim(spark, ledger, 0, 10, 0) == 1
    assert ids.claim(spark, ledger, 1, 5, 0) == 11
    assert ids.claim(spark, ledger, 0, 10, 99) == 1  # a replay
    assert ids.claim(spark, ledger, 2, 1, 100) == 101
    with pytest.raises(ValueError):
        ids.claim(spark, ledger, 1, 6, 0)


def rows_of(spark, path, schema=ROW):
    return sorted((r.batch_id, r.id) for r in batches.read_batches(spark, path, schema).collect())


def test_batches_replace_join_and_finish(spark, tmp_path):
    path = f"{tmp_path}/table"
    frame = lambda values: spark.createDataFrame([(v, str(v)) for v in values], ROW).withColumn("bucket", batches.bucket(F.col("v"), buckets=4))
    assert rows_of(spark, path) == [] and batches.compact(spark, path, ROW) is None
    for n in range(3):
        batches.write_batch(frame(range(10 * n, 10 * n + 5)), path, n)
    batches.write_batch(frame(range(20, 25)), path, 2)  # replayed
    everything = [v for n in range(3) for v in range(10 * n, 10 * n + 5)]
    assert [v for _, v in rows_of(spark, path)] == everything
    assert batches.compact(spark, path, ROW) == 1 and batches.batch_ids(spark, path) == [1, 2]
    assert rows_of(spark, path) == [(1, v) for v in everything[:10]] + [(2, v) for v in everything[10:]]
    assert batches.compact(spark, path, ROW) is None
    # a job that ended before the exchange: an incomplete joined batch goes, a complete one replaces the old
    batches.write_batch(frame([90]), path, 3)
    os.makedirs(f"{path}/_joined-9/bucket=0")
    assert len(rows_of(spark, path)) == 16 and not os.path.exists(f"{path}/_joined-9")
    joined = batches.read_batches(spark, path, ROW).filter("batch_id <= 2").drop("batch_id")
    joined.write.partitionBy("bucket").parquet(f"{path}/_joined-2")
    assert [v for _, v in rows_of(spark, path)] == [*everything, 90] and batches.batch_ids(spark, path) == [2, 3]


def scan_of(plan: str, column: str) -> str:
    return next(line for line in plan.splitlines() if "FileScan" in line and f"{column}#" in line)


def test_a_batch_reads_only_its_buckets(spark, posts, tmp_path):
    table = f"{tmp_path}/table"
    append_batch(posts, 0, table, "arrival")
    one = posts.limit(1).withColumn("bucket", batches.bucket(*key_columns()))
    stored = batches.others(spark, table, posts.schema, 1, one)
    wanted = one.first().bucket
    plan = plan_of(not_stored(stored, first_per_key(one, "arrival", ("bucket", *UNIQUE_KEY)), "arrival", ("bucket", *UNIQUE_KEY)))
    scan = scan_of(plan, "batch_id")
    filters = scan.split("PartitionFilters: ")[1]
    assert f"(bucket#" in filters and f"= {wanted})" in filters.split("]")[0] and "batch_id" in filters
    assert "job_description" not in scan.split("ReadSchema")[-1]
    assert len(stored.inputFiles()) >= 1
    assert stored.filter(F.col("bucket") != wanted).count() == 0


def test_stream_of_batches_with_replay_and_compaction(spark, posts, tmp_path):
    table = f"{tmp_path}/table"
    batch = posts.withColumn("id", F.lit(None).cast("long"))
    part = F.col("arrival") % 3
    for n in (0, 1, 2):
        append_batch(batch.filter(part == n), n, table, "arrival")
    read = lambda: sorted(map(tuple, batches.read_batches(spark, table, posts.schema).select("arrival", "id").collect()))
    before = read()
    assert [i for _, i in sorted(before, key=lambda r: r[1])] == list(range(1, len(before) + 1))
    append_batch(batch.filter(part == 2).repartition(9), 2, table, "arrival")
    assert read() == before
    assert compact_table(spark, table, posts.schema) == 1 and read() == before
    append_batch(batch.filter(part == 2), 2, table, "arrival")  # a replay after the others were joined
    assert read() == before
    append_batch(batch, 3, table, "arrival")
    assert read() == before


def card(href):
    return f'<div class="base-card"><a class="base-card__full-link" href="{href}">x</a></div>'


SEARCH = "page_id long, role string, page long, html string"


def test_frontier_keeps_first_sightings(spark, tmp_path):
    frontier = f"{tmp_path}/frontier"
    pages = [(5, "a", 1, card("/1") + card("") + card("/2") + card("/1")), (7, "b", 1, card("/2") + card("/3") + card("/4")), (9, "b", 6, card("/9"))]
    df = spark.createDataFrame(pages, SEARCH)
    taken = lambda links: sorted((r.url, r.role, r.page, r.pos) for r in links.collect())
    assert taken(visit(df, frontier, 0, (2, 5))) == [("/1", "a", 1, 0), ("/2", "a", 1, 2), ("/3", "b", 1, 1), ("/4", "b", 1, 2)]
    assert taken(visit(df, frontier, 0, (2, 5))) == [("/1", "a", 1, 0), ("/2", "a", 1, 2), ("/3", "b", 1, 1), ("/4", "b", 1, 2)]
    more = spark.createDataFrame([*pages, (11, "a", 1, card("/9") + card("/3") + card("/10"))], SEARCH)
    assert taken(visit(more, frontier, 1, (2, 5))) == [("/10", "a", 1, 2)]  # /9 was seen, on a page beyond the cap
    assert sorted((r.url, r.taken) for r in seen_links(spark, frontier).filter("not taken").collect()) == [("/9", False)]
    assert visit(df.limit(0), frontier, 2, (2, 5)).count() == 0


def test_crawl_is_whole_and_repeats_nothing(spark, tmp_path):
    posts = staged(fx.postings(spark, SF), "posts")
    searches, pages = staged(fx.search_pages(posts), "searches"), staged(fx.posting_pages(posts), "pages")
    listings = staged(fx.listing_pages(posts).withColumn("page", F.col("page") + 1), "listings")
    args = (pages, listings, fx.listing_details(posts), dims.skills_frame(spark), fx.AS_OF)
    run = lambda n, s=searches: discover_and_ingest(f"{tmp_path}/t", f"{tmp_path}/f", n, s, *args, features=f"{tmp_path}/features")
    read = lambda: sorted((r.batch_id, r.id, r.job_link, r.role) for r in batches.read_batches(spark, f"{tmp_path}/t", POSTING_SCHEMA).collect())
    total = lambda report: report.filter("scope = 'total'").first()
    first = total(run(0))
    table = read()
    assert first.inserted == first.written == len(table) > 0 and first.links > first.taken > 0
    assert first.seconds_per_row > 0
    assert [i for _, i, *_ in table] == list(range(1, len(table) + 1))
    again = total(run(0, searches.repartition(5)))
    assert read() == table and again.inserted == first.inserted
    later = total(run(1))
    assert read() == table and later is None  # nothing found, nothing to report
    features = spark.read.parquet(f"{tmp_path}/features")
    assert sorted(r.id for r in features.collect()) == [i for _, i, *_ in table]
    assert {"batch_id", "class", "skill_counts", "vector_norm"} <= set(features.columns)


def test_ingest_extracts_only_new_pages(spark):
    posts = staged(fx.postings(spark, SF), "posts")
    args = (fx.posting_pages(posts), fx.listing_pages(posts), fx.listing_details(posts), dims.skills_frame(spark), fx.AS_OF)
    found = ingest(posts.drop("posted_text").limit(0), *args)
    scans = [line for line in plan_of(found).split("== Initial Plan ==")[-1].splitlines() if "FileScan" in line]
    assert sum("max(" in line for line in scans) == 0
    added = staged(found, "added")
    order = added.select("id", F.when(F.col("source") == "LinkedIn", 0).otherwise(1).alias("kind")).orderBy("id").collect()
    assert [r.id for r in order] == list(range(1, len(order) + 1))
    assert [r.kind for r in order] == sorted(r.kind for r in order)


def test_reads_of_one_source_open_its_folder_only(spark, tmp_path):
    posts = fx.postings(spark, SF).drop("posted_text")
    posts = staged(posts.withColumn("source", F.when(F.col("id") % 10 != 0, F.col("source"))), "posts")
    path = f"{tmp_path}/posts"
    write_postings(posts, path)
    whole, some = read_postings(spark, path), read_postings(spark, path, ["naukri"], "1996-01-01")
    assert whole.count() == posts.count() and some.columns == POSTING_SCHEMA.names
    wanted = by_source(posts, "Naukri").filter("posted_date >= '1996-01-01'")
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in wanted.collect())
    scan = scan_of(plan_of(some), "job_title")
    assert "source_key#" in scan.split("PartitionFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(posted_date" in scan
    assert 0 < len(some.inputFiles()) and {"source_key=naukri"} == {f.split("/")[-2] for f in _opened(some)}
    assert read_postings(spark, path, [""]).count() == posts.filter("source is null").count()
    assert "GreaterThanOrEqual(posted_date" in scan_of(plan_of(recent(whole, "2001-09-01", 60)), "job_title")


def _opened(df):
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


def test_change_report(spark):
    columns = "id long, source string, role string, v string, w array<int>"
    before = [(1, "s", "r", "x", [1]), (2, "s", "r", "x", [1]), (3, "s", "q", "x", None), (4, "t", "q", "x", [2]), (None, "t", None, "x", None)]
    after = [(1, "s", "r", "x", [1]), (2, "s", "r", "y", [1]), (4, "t", "r", "x", [2]), (9, "t", "q", "x", [2]), (None, "t", None, "z", None), (None, "t", None, "z", None)]
    report = reports.change_report(spark.createDataFrame(before, columns), spark.createDataFrame(after, columns), 6.0)
    got = {(r.scope, r.source, r["role"]): (r.rows_before, r.rows_after, r.inserted, r.deleted, r.updated) for r in report.collect()}
    assert got["total", None, None] == (5, 6, 2, 1, 2)
    assert got["source", "s", None] == (3, 2, 0, 1, 1) and got["source", "t", None] == (2, 4, 2, 0, 1)
    assert got["source and role", "t", "r"] == (1, 1, 0, 0, 1) and got["source and role", "t", None] == (1, 2, 1, 0, 0)
    assert got["role", None, "q"] == (1, 1, 1, 1, 0) or got["role", None, "q"] == (2, 1, 1, 1, 0)
    assert report.filter("scope = 'total'").first().seconds_per_row == 3.0
    plan = plan_of(report)
    assert plan.split("== Initial Plan ==")[-1].count("Expand") == 1


def test_staging_deletes_what_it_staged(spark):
    kept = staged(spark.range(3), "kept")
    with staging(spark):
        gone = staged(spark.range(5), "gone")
        assert gone.count() == 5
        files = gone.inputFiles()
    assert kept.count() == 3
    assert not os.path.exists(files[0].removeprefix("file://"))
    assert read_if_present(spark, fresh_dir(spark, "none"), ROW).count() == 0
