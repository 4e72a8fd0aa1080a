import random
import re
from datetime import date, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rolecall import dims, fixtures as fx
from rolecall.operators import dedupe, filters, ids, joins, quota, reports, roles, search, skills as sk
from rolecall.plans import maintain, present, profile, recommend
from rolecall.schema import POSTING_SCHEMA, PROFILE_SCHEMA, require, require_table, validate_postings
from rolecall.session import fresh_dir, shared_dir, staged
from rolecall.sources import tables, uploads

SF = "/root/testdata/sf0.001"
PYTHON = re.compile("EvalPython|PythonUDF|InPandas|InArrow")


@pytest.fixture(scope="module")
def posts(spark):
    return staged(fx.postings(spark, SF), "posts")


@pytest.fixture(scope="module")
def people(spark):
    return staged(fx.candidates(spark, SF), "people")


# Skills ----------------------------------------------------------------------

WORDS = ["c", "c++", "java", "javascript", "r", "react", "react.js", ".net", "machine learning", "learning to learn", "sql"]


def brute_force_skills(text):
    edge = lambda p: rf"(?<!\w){re.escape(p)}(?!\w)"
    return sorted(p for p in WORDS if re.search(edge(p), text.lower()))


def skill_texts():
    rng = random.Random(5)
    parts = WORDS + ["ré", "x", ",", " ", " ", "_", "3", "/", "\n", "asp", "Machine  learning", "learning to learn to learn"]
    fixed = ["I use C++, react.js and Java", "javascript", "ré", "sql sql Sql,sql_ c", "asp.net .net", ""]
    return fixed + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(12)) for _ in range(150)]


def test_skills_equal_brute_force_on_both_paths(spark):
    texts = skill_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = dims.skills_frame(spark, WORDS + ["JAVA"])
    want = {i: brute_force_skills(t) for i, t in enumerate(texts)}
    for found in (sk.extract_skills(df, known), sk.extract_skills_by_join(df, known, "text", "id", "skills")):
        assert {r.id: r.skills for r in found.select("id", "skills").collect()} == want


def test_skill_counts_equal_findall(spark):
    texts = [t for t in skill_texts() if brute_force_skills(t)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = sk.extract_skills(df, dims.skills_frame(spark, WORDS))
    rows = found.select("id", sk.skill_counts(F.col("text"), F.col("skills")).alias("c")).collect()
    for r in rows:
        for c in r.c:
            assert c["n"] == len(re.findall(rf"(?<!\w){re.escape(c['skill'])}(?!\w)", texts[r.id].lower()))


def test_large_dictionary_takes_the_join(spark, monkeypatch):
    monkeypatch.setattr(sk, "PATTERN_SKILLS", 3)
    df = spark.createDataFrame([(1, "java and c++"), (2, None)], "id long, text string")
    found = sk.extract_skills(df, dims.skills_frame(spark, WORDS))
    assert {r.id: r.skills for r in found.collect()} == {1: ["c", "c++", "java"], 2: []}


def test_matched_skills_by_frequency(spark):
    df = spark.createDataFrame([("go sql sql java", ["sql", "java", "go", "x"])], "text string, mine array<string>")
    found = sk.extract_skills(df, dims.skills_frame(spark, ["go", "java", "sql"]))
    counts = sk.skill_counts(F.col("text"), F.col("skills"))
    assert found.select(sk.matched_skills(counts, F.col("mine")).alias("m")).first().m == ["sql", "go", "java"]


def test_default_skills_and_roles(spark):
    df = spark.createDataFrame([(1, ["go"]), (2, ["a", "b", "c"])], "candidate_id long, skills array<string>")
    filled = df.withColumn("skills", sk.with_default_skills(F.col("skills"), dims.DEFAULT_SKILLS))
    assert [len(r.skills) for r in filled.orderBy("candidate_id").collect()] == [7, 3]
    arrays = spark.createDataFrame([([],), (["java_developer"],), (["a", "b"],)], "r array<string>")
    got = [r.x for r in arrays.select(roles.with_default_roles(F.col("r")).alias("x")).collect()]
    assert got == [dims.DEFAULT_ROLES, ["java_developer", *dims.DEFAULT_ROLES], ["a", "b"]]


def test_best_roles_same_on_both_paths(spark, people):
    table = dims.role_skills_frame(spark)
    some = people.select("candidate_id", "skills")
    rows = lambda df: {r.candidate_id: r.best_job_roles for r in df.collect()}
    assert rows(roles.best_roles(some, table)) == rows(roles.best_roles_by_join(some, table, "candidate_id", "best_job_roles"))


# Search ----------------------------------------------------------------------


def like(value, pattern):
    out = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.search(out, value, re.DOTALL) is not None


def test_like_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    values = sorted({"".join(rng.choice("abc d") for _ in range(rng.randint(0, 9))) for _ in range(120)})
    patterns = sorted({"".join(rng.choice("abcd%_") for _ in range(rng.randint(0, 5))) for _ in range(120)} | {"%", "_", "", "zzzz"})
    pairs = joins.like_pairs(
        spark.createDataFrame([(v,) for v in values], "value string"),
        spark.createDataFrame([(p,) for p in patterns], "pattern string"),
    )
    got = sorted((r.value, r.pattern) for r in pairs.collect())
    assert got == sorted((v, p) for v in values for p in patterns if like(v, p))
    assert "NestedLoop" not in plan_of(pairs) and "Cartesian" not in plan_of(pairs)


def brute_force_search(posts, person, limit):
    pref = person.pref_location.strip().lower()
    if not pref:
        return []
    low = lambda level: level is not None and level[:2] in ("0-", "1-")
    level_ok = {
        "fresher": low,
        "experienced": lambda level: level is not None and not low(level),
    }.get((person.category or "").lower(), lambda level: True)
    hits = [
        p
        for p in posts
        if like(p.location.lower(), pref)
        and level_ok(p.experience_level)
        and (not person.best_job_roles or any(like(p.job_title.lower(), r.lower()) for r in person.best_job_roles))
    ]
    hits.sort(key=lambda p: (p.posted_date is None, -(p.posted_date or date.min).toordinal(), p.id))
    return [p.id for p in hits[:limit]]


def test_search_equals_brute_force(spark, posts, people):
    asking = recommend.asking(people).orderBy("candidate_id").limit(60)
    wild = spark.createDataFrame(
        [(9001, "%", "Any", []), (9002, "nation__", None, ["%developer", "sales_manager"]), (9003, " ", "Fresher", [])],
        "candidate_id long, pref_location string, category string, best_job_roles array<string>",
    )
    asking = asking.select("candidate_id", "pref_location", "category", "best_job_roles").unionByName(wild)
    rows = posts.select("id", "location", "job_title", "experience_level", "posted_date").collect()
    for limit in (5, 100):
        found = search.search_postings(posts, asking, limit).select("candidate_id", "fetch_rank", "id").collect()
        got = {}
        for r in sorted(found):
            got.setdefault(r.candidate_id, []).append(r.id)
        want = {p.candidate_id: brute_force_search(rows, p, limit) for p in asking.collect()}
        assert got == {k: v for k, v in want.items() if v}


def test_search_one_equals_search_many(spark, posts):
    asking = spark.createDataFrame(
        [(1, "nation_1", "Experienced", ["data_engineer"])],
        "candidate_id long, pref_location string, category string, best_job_roles array<string>",
    )
    many = search.search_postings(posts, asking).orderBy("fetch_rank")
    single = search.search_one(posts, " Nation_1 ", "Experienced", ["data_engineer"])
    assert [r.id for r in many.collect()] == [r.id for r in single.collect()]
    assert search.search_one(posts, " ", "Fresher", []).count() == 0


def test_search_plan_has_no_cross_join_and_prunes_before_the_shuffle(spark, posts, people):
    requests = staged(search.request_counts(recommend.asking(people)), "requests")
    plan = plan_of(search.search_requests(posts, requests))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and not PYTHON.search(plan)
    assert plan.count("Partial") >= 3 and "WindowGroupLimit" in plan
    assert "job_description" not in plan and "embedding" not in plan


def test_hot_keys_are_cut_and_the_result_is_whole(spark):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    assert joins.hot_keys(counts, "k", 100).collect() == [("hot", 20)]
    cut = joins.spread_join(big, small, "k", counts, "id", rows=100)
    assert sorted(cut.collect()) == sorted(big.join(small, "k").select("k", "id", "v").collect())
    salted = joins.salted_join(big, small, ["k"], F.col("id"))
    assert sorted(salted.select("k", "id", "v").collect()) == sorted(cut.collect())


def test_fetch_by_id_same_with_and_without_broadcast(spark, posts, monkeypatch):
    wanted = posts.filter("id % 7 = 0").select("id")
    direct = sorted(r.id for r in joins.fetch_by_id(posts, wanted).select("id").collect())
    monkeypatch.setattr(joins, "BROADCAST_IDS", 0)
    assert sorted(r.id for r in joins.fetch_by_id(posts, wanted).select("id").collect()) == direct
    assert len(direct) == 215


# Quota -----------------------------------------------------------------------


def brute_force_quota(rows, total):
    """rows: (fetch_rank, source, score) -> fetch ranks in list order."""
    rows = sorted(rows)
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    if not by_source:
        return []
    share = -(-total // len(by_source))
    final = []
    for group in by_source.values():
        group.sort(key=lambda r: r[2], reverse=True)
        final += group[:share]
    if len(final) < total:
        rest = sorted((r for g in by_source.values() for r in g), key=lambda r: r[2], reverse=True)
        final += [r for r in rest if r not in final][: total - len(final)]
    return [r[0] for r in final[:total]]


@pytest.fixture(scope="module")
def quota_cases():
    rng = random.Random(11)
    cases = {}
    for c in range(60):
        n, sources = rng.choice([0, 1, 5, 39, 40, 41, 55, 100]), rng.choice([1, 2, 3, 7, 39, 45, 60])
        ranks = rng.sample(range(1, 500), n)
        names = [None, *map(str, range(1, sources))]
        cases[c] = [(r, rng.choice(names), float(rng.randint(-3, 12))) for r in ranks]
    cases[100] = [(i, str(i % 3), float(i % 17)) for i in range(60)]
    cases[101] = [(i, "a", float(-i)) for i in range(50)]
    cases[102] = [(i, "a" if i < 50 else "b", float(i % 9)) for i in range(55)]
    return cases


def test_quota_rank_equals_brute_force(spark, quota_cases):
    rows = [(c, *r) for c, case in quota_cases.items() for r in case]
    df = spark.createDataFrame(rows, "candidate_id long, fetch_rank int, source string, score double")
    got = {}
    for r in quota.quota_rank(df).orderBy("candidate_id", "position").collect():
        got.setdefault(r.candidate_id, []).append(r.fetch_rank)
    assert got == {c: brute_force_quota(case, 40) for c, case in quota_cases.items() if case}


def test_quota_order_equals_brute_force(spark, quota_cases):
    rows = [
        (c, list(dict.fromkeys(str(s) for _, s, _ in sorted(case))), [(r, str(s), x) for r, s, x in sorted(case)])
        for c, case in quota_cases.items()
        if case
    ]
    df = spark.createDataFrame(rows, "c long, sources array<string>, rows array<struct<r:int,s:string,x:double>>")
    items = F.transform(
        "rows",
        lambda p, i: F.struct(
            (-p["x"]).alias("neg_score"), p["r"].alias("fetch_rank"),
            F.array_position("sources", p["s"]).alias("source_ord"), (i + 1).alias("at"),
        ),
    )
    ranked = df.withColumn("items", items).select("c", "rows", quota.quota_order(F.col("items"), F.col("sources")).alias("o"))
    for row in ranked.collect():
        assert [row.rows[x["at"] - 1]["r"] for x in row.o] == brute_force_quota(quota_cases[row.c], 40)


def test_quota_rank_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0)], "candidate_id long, fetch_rank int, source string, score double")
    assert "Partial" in plan_of(quota.quota_rank(df))


def test_crawl_quota(spark):
    df = spark.createDataFrame([("t", p, i) for p in range(1, 6) for i in range(4)], "role string, page int, pos int")
    kept = quota.crawl_quota(df, "role", 10, 2)
    assert sorted((r.page, r.pos) for r in kept.collect()) == [(p, i) for p in (1, 2) for i in range(4)]
    assert quota.crawl_quota(df, "role", 10, 5).count() == 10


# Table jobs --------------------------------------------------------------------


def test_clean_invalid(spark):
    rows = [(0, "a", "b", "c"), (None, "a", "b", "c"), (5, "a", "b", "c"), (5, "", "b", "c"), (5, "a", "not available", "c")]
    df = spark.createDataFrame(rows, "applicants int, skills_required string, job_type string, job_description string")
    kept = filters.clean_invalid(df)
    assert [r.applicants for r in kept.collect()] == [None, 5]
    assert filters.clean_invalid(kept).count() == 2
    assert sorted(map(tuple, reports.invalid_reason_counts(df).collect())) == [
        ("applicants", 1), ("job_type", 1), ("skills_required", 1),
    ]


def test_renumber_is_dense_for_any_spread_of_ids(spark):
    rng = random.Random(2)
    values = sorted({3, 7, 1002, 5000, 0, -5, 2**62, 2**40, 65535, 65536} | {rng.randint(0, 2**62) for _ in range(500)} | set(range(200000, 200900)))
    df = spark.createDataFrame([(v, v) for v in values], "id long, old long")
    got = sorted((r.id, r.old, r.batch) for r in ids.renumber(df).collect())
    assert [g[1] for g in got] == values
    assert [g[0] for g in got] == list(range(1, len(values) + 1))
    assert all(g[2] == (g[0] - 1) // 1000 + 1 for g in got)
    assert ids.next_id(df.filter("id < 0 and id > 0")).first() == (0, 1)


def batch(spark, rows):
    df = spark.createDataFrame(rows, "id long, job_title string, company string, source string")
    return df.withColumn("location", F.lit("")).withColumn("job_link", F.lit("x" * 600))


def test_append_ignore(spark):
    old = batch(spark, [(1, "A", "b", "s")])
    new = batch(spark, [(2, "a", "B", "S"), (3, "n", "b", "s"), (4, "N", "b", "s"), (5, "n", "b", None), (6, "n", "b", None)])
    added = dedupe.new_rows(old, new, "id")
    assert sorted(r.id for r in added.collect()) == [3, 5, 6]
    row = added.first()
    assert row.location is None and len(row.job_link) == 500
    table = dedupe.append_ignore(old, new, "id")
    keyed = new.filter("source is not null")
    assert dedupe.new_rows(table, keyed, "id").count() == 0


def test_keys_compare_clipped(spark):
    new = batch(spark, [(1, "t" * 100 + "x", "c", "s"), (2, "t" * 100 + "y", "c", "s")])
    assert [r.id for r in dedupe.first_per_key(new, "id").collect()] == [1]


def test_copies_are_cut_before_the_shuffle(spark):
    new = batch(spark, [(1, "t", "c", "s")])
    plan = plan_of(dedupe.new_rows(new, new, "id"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_maintain(spark, posts):
    table = maintain.maintain(posts.drop("posted_text"))
    rows = table.select("id", "source", "experience_level").collect()
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
    assert not {r.experience_level for r in rows if r.source == "LinkedIn"} & set(dims.LEVEL_BANDS)
    assert not PYTHON.search(plan_of(table))


def test_run_report(spark):
    schema = "id long, source string, role string"
    before = spark.createDataFrame([(1, "a", "r"), (2, "a", "r"), (3, "b", "r")], schema)
    after = spark.createDataFrame([(1, "a", "r"), (4, "b", "r"), (3, "b", "r")], schema)
    got = sorted(map(tuple, reports.run_report(before, after, 3.0).collect()))
    assert got == [("a", "r", 2, 1, 0, 1, None), ("b", "r", 1, 2, 1, 0, 3.0)]


def test_counted(spark):
    df, seen = reports.counted(spark.range(7), "rows")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7}


def test_schema_checks(spark, posts):
    rows = posts.drop("posted_text").withColumn("skills_required", F.nullif("skills_required", F.lit("")))
    assert validate_postings(rows).filter("skills_required is null").count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        require(rows, ["nope"])
    with pytest.raises(ValueError, match="wrong column types"):
        validate_postings(rows.withColumn("applicants", F.lit("x")))
    with pytest.raises(ValueError, match="does not exist"):
        require_table(spark, "no_such_table", [])
    spark.range(1).createOrReplaceTempView("ids_view")
    assert require_table(spark, "ids_view", ["id"]).count() == 1


def test_write_and_read_postings(spark, posts):
    path = fresh_dir(spark, "table")
    tables.write_postings(posts.drop("posted_text"), path)
    back = tables.read_postings(spark, path)
    assert back.schema.names == POSTING_SCHEMA.names and back.count() == posts.count()
    text = posts.withColumn("embedding", F.to_json("embedding"))
    assert tables.typed(text).schema["embedding"].dataType == POSTING_SCHEMA["embedding"].dataType


class FakeSession:
    """The parts of a session that ``shared_dir`` reads."""

    def __init__(self, master, setting=None, checkpoint=None):
        self.conf = {"spark.checkpoint.dir": setting}
        self.sparkContext = self
        self.master = master
        self.checkpoint = checkpoint

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, path):
        self.checkpoint = path


def test_shared_dir_reads_the_session_setting():
    assert shared_dir(FakeSession("spark://x", "hdfs://shared")) == "hdfs://shared"
    assert shared_dir(FakeSession("spark://x", None, "hdfs://set")) == "hdfs://set"
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession("spark://x"))
    local = FakeSession("local[2]")
    assert shared_dir(local) == local.checkpoint == shared_dir(local)


@pytest.mark.parametrize("named", ["/tmp/checkpoints", "file:///tmp/checkpoints", "/mnt/shared", "file:/var/tmp/x"])
def test_shared_dir_takes_the_named_folder_on_a_cluster(named):
    assert shared_dir(FakeSession("spark://x", named)) == named
    assert shared_dir(FakeSession("spark://x", None, named)) == named


def test_uploads(spark, tmp_path):
    rows = [("a.PDF", 1024), ("a.doc", 1), ("a.docx", 6 * 1024 * 1024), ("", 1), (None, None), ("dir/b.docx", 5)]
    df = spark.createDataFrame(rows, "path string, length long")
    got = [(r.status, r.reason) for r in uploads.route_uploads(df).collect()]
    assert [g[0] for g in got] == ["accepted", "rejected", "rejected", "rejected", "rejected", "accepted"]
    assert got[2][1].startswith("File size") and got[3][1] == "No file selected" and got[4][1] == "No file uploaded"
    (tmp_path / "x.pdf").write_bytes(b"12345")
    assert [r.length for r in uploads.list_uploads(spark, str(tmp_path)).collect()] == [5]


def test_assemble_text(spark):
    df = spark.createDataFrame([(1, 2, "B "), (1, 1, " A"), (1, 3, ""), (1, 4, "C"), (2, 1, None)], "k long, o int, t string")
    assert dict(uploads.assemble_text(df, "k", "o", "t").collect()) == {1: "a\nb \nc", 2: ""}
    assert dict(uploads.assemble_text(df, "k", "o", "t", keep_empty=True).collect())[1] == "a\nb \n\nc"


# Plans -------------------------------------------------------------------------


def test_profile(spark):
    text = "Jane Doe - x\njane@mail.example.com 9876543210\nsenior data engineer\nskills: python, sql\nwork experience jan 2000 - present"
    rows = spark.createDataFrame([(1, text), (2, "  ")], "candidate_id long, text string")
    found = profile.profile(rows, "2001-09-01", dims.skills_frame(spark), dims.role_skills_frame(spark))
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [
        (f.name, f.dataType.simpleString()) for f in PROFILE_SCHEMA
    ]
    (row,) = found.collect()
    assert row.personal_info == ("jane doe", "jane@mail.example.com", "9876543210")
    assert row.total_experience_years == 1.67 and row.experience_category == "Experienced"
    assert {"python", "sql", "html"} <= set(row.skills)
    assert "Exchange" not in plan_of(found) and not PYTHON.search(plan_of(found))


def test_recommend(spark, posts, people):
    known = dims.skills_frame(spark)
    results = staged(recommend.recommend(people, posts, fx.AS_OF, known), "results")
    rows = results.collect()
    assert rows and max(r.position for r in rows) <= 40
    assert max(r.match_score for r in rows) <= 100 and min(r.days_since_posted for r in rows) >= 0
    per = {}
    for r in rows:
        per.setdefault(r.candidate_id, []).append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in per.values())
    person = people.filter("candidate_id = 11")
    p = recommend.asking(person).first()
    single = recommend.recommend_one(person, posts, fx.AS_OF, known, p.pref_location, p.category, p.best_job_roles)
    order = lambda df: [tuple(r) for r in df.orderBy("position").collect()]
    assert order(single) == order(results.filter("candidate_id = 11")) != []


def test_results_do_not_depend_on_how_keys_are_cut(spark, posts, people, monkeypatch):
    known = dims.skills_frame(spark)
    columns = ["candidate_id", "position", "id", "match_score"]
    whole = sorted(recommend.recommend(people, posts, fx.AS_OF, known).select(*columns).collect())
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    monkeypatch.setattr(joins, "BROADCAST_IDS", 0)
    assert sorted(recommend.recommend(people, posts, fx.AS_OF, known).select(*columns).collect()) == whole


def test_wrong_vectors_are_dropped(spark, posts, people):
    short = posts.withColumn("embedding", F.when(F.col("id") % 2 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    found = recommend.recommend(people, short, fx.AS_OF, dims.skills_frame(spark))
    assert {r.odd for r in found.select((F.col("id") % 2).alias("odd")).distinct().collect()} == {1}


def results(spark):
    rows = [(1, i, i, "A" if i % 2 else "b", float(i * 2), i % 4, ["x"] * i) for i in range(1, 24)]
    return spark.createDataFrame(
        rows, "candidate_id long, position int, id long, source string, match_score double, days_since_posted int, matched_skills array<string>"
    )


def test_views(spark):
    df = results(spark)
    assert present.view_all(df).count() == 10 and present.view_all(df, 3).count() == 23
    recent = [r.days_since_posted for r in present.view_recent(df).orderBy("place").collect()]
    assert recent == sorted(recent) and recent[0] == 0
    high = [r.match_score for r in present.view_high(df).orderBy("place").collect()]
    assert high == sorted(high, reverse=True) and min(high) == 20
    assert present.present(df, "source-a").count() == 12
    row = present.present(df, "all").filter("position = 7").first()
    assert (row.skills_more, len(row.skills_shown), row.score_label, row.page) == ("+2 more", 5, "14.00", 1)
    with pytest.raises(ValueError):
        present.present(df, "bookmarked")
    shown = reports.visible_counts(df, df.filter("position > 99")).first()
    assert (shown.total, shown.visible, shown.none_found) == (23, 0, True)
    listed = reports.source_list(df).orderBy("first_position").collect()
    assert [(r.source, r.first_position) for r in listed] == [("A", 1), ("b", 2)]


def test_defaults_and_ids(spark):
    df = spark.createDataFrame([(0, " ", None, None), (5, "t", 3, 1.5)], "id long, job_title string, applicants int, match_score double")
    first = filters.with_defaults(df).first()
    assert (first.job_title, first.applicants, first.match_score) == ("Untitled Job", 0, 0.0)
    made = [r.id for r in filters.with_id(df).collect()]
    assert len(made[0]) == 36 and made[1] == "5"


def test_recent_filter_reaches_the_scan(spark, posts):
    plan = plan_of(filters.recent(posts, date(2001, 9, 1) - timedelta(0)).select("id"))
    assert "GreaterThanOrEqual(posted_date" in plan and "embedding" not in plan
