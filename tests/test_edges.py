"""Rows and pages that are not as they should be, and switches that must not change an answer."""

import datetime as dt
import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rolecall import dims, fixtures as fx
from rolecall.functions import dates, embed, html, vectors
from rolecall.operators import dedupe, ids, joins, reports, roles, search, skills as sk
from rolecall.plans.maintain import maintain
from rolecall.schema import rejected_postings
from rolecall.session import drop_staged, staged

SF = "/root/testdata/sf0.001"


def test_renumber_keeps_rows_without_an_id(spark):
    rows = [(5, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "d"), (70_000, "e")]
    got = ids.renumber(spark.createDataFrame(rows, "id long, v string")).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5, 6]
    assert {r.id: r.v for r in got if r.id < 4} == {1: "c", 2: "a", 3: "e"}
    assert sorted(r.v for r in got) == sorted(v for _, v in rows)


def test_renumber_reads_the_table_twice(spark, tmp_path):
    fx.postings(spark, SF).drop("posted_text").write.parquet(f"{tmp_path}/posts")
    plan = plan_of(maintain(spark.read.parquet(f"{tmp_path}/posts"))).split("== Initial Plan ==")[-1]
    # known by a column, as long locations are cut in the plan's text
    scans = [line for line in plan.splitlines() if "FileScan" in line and "job_title#" in line]
    assert len(scans) == 1  # the other pass has read the ids and stored their blocks


def test_insert_gives_ids_and_refuses_incomplete_rows(spark):
    columns = "id long, job_title string, company string, source string, skills_required string, scraped_at timestamp"
    at = dt.datetime(2001, 1, 1)
    old = spark.createDataFrame([(7, "t", "c", "s", "x", at)], columns)
    batch = spark.createDataFrame(
        [(None, "t", "c", "s", "x", None), (None, "u", "c", "s", "x", None), (9, "v", "c", None, "x", at), (None, None, "c", "s", "x", None), (None, "w", "c", "s", None, None)],
        columns,
    ).withColumn("n", F.monotonically_increasing_id())
    table = dedupe.append_ignore(old, batch, "n", scraped_at="2001-09-01 00:00:00")
    got = {r.job_title: r for r in table.collect()}
    assert set(got) == {"t", "u", "v"} and got["v"].id == 9 and got["u"].id > 9
    assert all(r.scraped_at for r in got.values())
    assert rejected_postings(batch).count() == 2


def test_report_counts_rows_without_an_id(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, source string, role string")
    before, after = frame([(1, "s", "r"), (None, "s", "r")]), frame([(1, "s", "r")] + [(None, "s", "r")] * 4)
    row = reports.run_report(before, after).first()
    assert (row.rows_before, row.rows_after, row.inserted, row.deleted) == (2, 5, 3, 0)


@pytest.mark.parametrize("seed", range(3))
def test_skills_are_the_same_on_both_paths(spark, seed):
    draw = random.Random(seed)
    phrases = ["sql", "++", "c++", "python", "#", "a b", ".net", "net", "é", " "]
    signs = [*phrases, ",", "(", "x", "\n"]
    rows = [(None if i % 3 == 0 else i % 4, " ".join(draw.choices(signs, k=8)) if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    table = spark.createDataFrame([(p, i) for i, p in enumerate(phrases)], "skill string, ord int")
    rows_of = lambda d: sorted((r.id is None, r.id or 0, r.text or "", r.skills) for r in d.collect())
    by_pattern = df.withColumn("skills", sk.skills_in(F.col("text"), sk.bounded_dictionary(table)))
    assert rows_of(by_pattern) == rows_of(sk.extract_skills_by_join(df, table, "text", "id", "skills"))


def test_roles_count_a_repeated_requirement_once(spark):
    table = spark.createDataFrame([("a", 0, "x"), ("a", 0, "x"), ("a", 0, "y"), ("b", 1, "x"), ("b", 1, "z")], "role string, role_ord int, skill string")
    people = spark.createDataFrame([(None, ["X"]), (None, ["z", "q"]), (1, []), (1, ["y", "x"])], "candidate_id long, skills array<string>")
    rows_of = lambda d: sorted((r.skills, r.best_job_roles) for r in d.collect())
    assert rows_of(roles.best_roles(people, table)) == rows_of(roles.best_roles_by_join(people, table, "candidate_id", "best_job_roles"))
    score = {r.role: r.matched for r in roles.role_scores(people.filter("candidate_id = 1"), table).collect()}
    assert score == {"a": 2, "b": 1}


def test_ages_and_dates_that_cannot_be(each):
    got = each(lambda x: dates.parse_posted(x, "2001-09-01"), ["99999999 months ago", "200000000 days ago", "9" * 40 + " days ago", "3 days ago", None])
    assert [str(d) for d in got] == ["2001-09-01"] * 3 + ["2001-08-29", "2001-09-01"]
    texts = ["March 5, 2001", "5 Mar 2001", "Mar 5th, 2001", "03/05/2001", "2001-03-05", "May 40, 2001", "Marble 5, 2001", "soon", None]
    assert each(lambda x: dates.days_since(x, "2001-03-15"), texts) == [10] * 5 + [0] * 4


def test_fetch_time(spark):
    stamp = dates.fetch_time(dt.datetime(2001, 9, 1, 7, 8, 9))
    assert spark.range(1).select(stamp.alias("t")).first().t == "2001-09-01 07:08:09"


def test_references_that_are_no_characters(each):
    got = each(html.decode_entities, ["&#9999999;", "&#xFFFFFF;", "&#0;", "&#xD800;", "&#0000000000065;", "&#x00000041;", "&#8364;", "&#;&amp;", "&#" + "9" * 50 + ";"])
    assert got == ["�"] * 4 + ["A", "A", "€", "&#;&", "�"]


def test_class_attributes(spark):
    page = '<span data-class="salary">no</span><span class=salary>bare</span><span id=x class="big salary">quoted</span>'
    df = spark.createDataFrame([(page,)], "html string")
    assert html.read_texts(df, "html", {"s": [("span", "salary")]}).first().s == "bare"
    assert df.select(html.elements(F.col("html"), "span", "salary").alias("e")).first().e[0].startswith("bare")


def test_infinite_vectors_are_not_usable(spark):
    df = spark.createDataFrame([([1.0, float("inf")],), ([1.0, float("-inf")],), ([1.0, 2.0],)], "v array<double>")
    assert [r.u for r in df.select(vectors.is_usable(F.col("v")).alias("u")).collect()] == [False, False, True]


def test_one_space_for_all_batches(spark, tmp_path):
    some = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma")], "id long, text string")
    more = spark.createDataFrame([(3, "alpha beta"), (4, "delta")], "id long, text string")
    vector = lambda d, **k: {r.id: r.embedding for r in embed.embed_text(d, "text", **k).collect()}
    assert vector(some)[1] == vector(more)[3]
    model = embed.fit_weights(some, "text")
    model.save(f"{tmp_path}/model")
    loaded = embed.IDFModel.load(f"{tmp_path}/model")
    assert vector(some, weights=model)[1] == vector(more, weights=loaded)[3] != vector(some)[1]


@pytest.mark.parametrize("few", [100, 0])
def test_wildcards_only(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "OPEN_PATTERNS", few)
    values = spark.createDataFrame([("abc",), ("",), ("x",)], "value string")
    patterns = spark.createDataFrame([("",), ("%",), ("_",), ("___",), ("b",)], "pattern string")
    got = {(r.value, r.pattern) for r in joins.like_pairs(values, patterns).collect()}
    assert got == {(v, p) for v in ("abc", "", "x") for p in ("", "%")} | {("abc", "_"), ("x", "_"), ("abc", "___"), ("abc", "b")}


def test_search_one_reads_wide_columns_by_id(spark, tmp_path):
    fx.postings(spark, SF).drop("posted_text").write.parquet(f"{tmp_path}/posts")
    found = search.search_one(spark.read.parquet(f"{tmp_path}/posts"), "nation_1", None, [], 20)
    assert found.count() == 20 and "In(id" in plan_of(found).replace("In(id,", "In(id")


def test_seed_tables_have_the_odd_cases():
    known = {s.lower() for s in dims.seed_skills()}
    needs = dict(dims.role_skills())
    assert any(s not in known for skills in needs.values() for s in skills)
    assert any(len(set(skills)) < len(skills) for skills in needs.values())
    assert any(not any(c.isalnum() for c in s) for s in known)


def test_staged_tables_can_be_dropped(spark, tmp_path):
    df = staged(spark.range(3), "drop")
    place = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    drop_staged(spark)
    import os

    assert not os.path.exists(place)
