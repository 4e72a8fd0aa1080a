"""Band joins, large dictionaries, stored features and model versions."""

import random
import re

import pytest
from conftest import plan_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolecall import dims, fixtures as fx
from rolecall.functions.embed import embed_text, model_name, one_model, refresh_vectors, stale_vectors, stamped
from rolecall.operators import skills as sk
from rolecall.operators.bands import band_join
from rolecall.plans import recommend as rec
from rolecall.session import staged

SF = "/root/testdata/sf0.001"


def test_band_join_equals_comparing_all_pairs(spark):
    draw = random.Random(2)
    band = lambda: (lo := draw.randint(-5, 60), lo + draw.choice([0, 0, 1, 2, 7, 30, 10**6, -1]))
    left = [(i, draw.choice("xy"), *band()) for i in range(150)] + [(900, "x", None, 5), (901, "x", 5, None)]
    right = [(i, draw.choice("xy"), *band()) for i in range(120)]
    a = spark.createDataFrame(left, "a int, k string, low int, high int").repartition(4)
    b = spark.createDataFrame(right, "b int, k string, low int, high int").repartition(3)
    fits = lambda x, y: None not in x[2:] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    got = sorted((r.a, r.b) for r in band_join(a, b.withColumnRenamed("k", "other")).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if fits(x, y))
    keyed = sorted((r.a, r.b) for r in band_join(a, b, ["k"]).collect())
    assert keyed == sorted((x[0], y[0]) for x in left for y in right if fits(x, y) and x[1] == y[1])
    plan = plan_of(band_join(a, b, ["k"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert band_join(a.limit(0), b, ["k"]).count() == 0


def in_text(phrase, text):
    return re.search(rf"(?<!\w){re.escape(phrase)}(?!\w)", text.lower()) is not None


@given(phrases=st.lists(st.text("ab+. #", min_size=1, max_size=6).filter(str.strip), min_size=1, max_size=25, unique=True), texts=st.lists(st.text("ab+. #", max_size=30), min_size=5, max_size=5))
@settings(max_examples=12, deadline=None)
def test_a_factored_pattern_finds_what_single_searches_find(spark, phrases, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.withColumn("skills", sk.skills_in(F.col("text"), phrases)).collect():
        assert row.skills == sorted({p for p in phrases if in_text(p, row.text)})


def test_two_thousand_phrases(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdeé", k=draw.randint(1, 5)))
    phrases = list(dict.fromkeys(" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(2500)))[:2000]
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.withColumn("skills", sk.skills_in(F.col("text"), phrases)).collect():
        assert row.skills == sorted(p for p in phrases if in_text(p, row.text))
    assert len(sk._longest_phrase(phrases)) < sum(map(len, phrases)) * 2


def test_features_answer_like_the_table(spark, tmp_path):
    posts = staged(fx.postings(spark, SF).repartition(3), "posts")
    people = staged(fx.candidates(spark, SF), "people")
    skills = dims.skills_frame(spark, fx.skill_list())
    rec.write_features(posts, f"{tmp_path}/features", skills)
    features = spark.read.parquet(f"{tmp_path}/features")
    some = 0
    for location, category, roles in (("nation_1", "Experienced", ["data_engineer"]), ("nation", "Fresher", []), ("nation_2", None, ["analyst", "x"]), (" ", None, [])):
        one = people.filter("candidate_id = 7")
        wanted = rec.recommend_one(one, posts, fx.AS_OF, skills, location, category, roles) if location.strip() else None
        got = rec.recommend_from_features(one, features, fx.AS_OF, location, category, roles)
        rows = [tuple(r) for r in got.orderBy("position").collect()]
        assert rows == ([tuple(r) for r in wanted.select(*got.columns).orderBy("position").collect()] if wanted else [])
        some += len(rows)
    assert some
    plan = plan_of(rec.recommend_from_features(people.filter("candidate_id = 7"), features, fx.AS_OF, "nation_1", "Experienced", []))
    assert "regexp_count" not in plan and "regexp_extract" not in plan and "job_description" not in plan
    assert "class#" in plan.split("PartitionFilters: ")[1].split("]")[0] or "class" in plan


def test_vectors_know_their_model(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "d")], "id long, text string")
    calls = []

    def embed(df, text):
        calls.append(sorted(r.id for r in df.collect()))
        return embed_text(df, text)

    none = spark.createDataFrame([], "id long, text_hash long, embedding_model string, embedding array<float>")
    first = staged(refresh_vectors(texts, none, "m1", embed), "vectors")
    assert calls == [[1, 2, 3, 4]] and first.count() == 4
    changed = spark.createDataFrame([(1, "a b"), (2, "new"), (5, "e"), (3, None)], "id long, text string")
    second = staged(refresh_vectors(changed, first, "m1", embed), "vectors")
    assert calls[-1] == [2, 5] and sorted(r.id for r in second.collect()) == [1, 2, 3, 5]
    assert stale_vectors(changed, second, "m1").count() == 0 and stale_vectors(changed, second, "m2").count() == 4
    assert model_name() != model_name(dim=64) and model_name(encoder="x") == "encoder:x"
    assert one_model(second, second.limit(0)) == "m1"
    with pytest.raises(ValueError):
        one_model(second, stamped(texts.withColumn("embedding", F.array(F.lit(1.0))), "m2"))


def test_lists_refuse_vectors_of_two_models(spark):
    people = stamped(fx.candidates(spark, SF), "m1")
    posts = stamped(fx.postings(spark, SF).drop("posted_text"), "m2")
    with pytest.raises(ValueError):
        rec.recommend(people, posts, fx.AS_OF, dims.skills_frame(spark))


def test_band_join_pairs_bands_not_rows(spark, tmp_path, monkeypatch):
    """Orders with equal bands are counted before they meet customers; repeated and NULL keys count as before."""
    from checks import queries
    from rolecall import fixtures

    customers = [(k, "c", n, 0.0, "") for k, n in [(1, 1), (2, 1), (2, 2), (3, 2), (26, 1), (None, 1), (7, None), (30, 3)]]
    orders = [(k, c, "", 0.0, None, "") for k in [*range(1, 3000, 40), 50, 501, 501, None] for c in (1, 2, 26, 7, 99, None)]
    for name, rows in (("customer", customers), ("orders", orders)):
        spark.createDataFrame(rows, fixtures.TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    asked, join = [], queries.join_bands
    monkeypatch.setattr(queries, "join_bands", lambda left, *more: asked.append(left) or join(left, *more))
    got = {r.customer: (r.n, r.orders) for r in queries.band_join(spark, str(tmp_path)).collect()}
    want: dict = {}
    for o, _, nation in [(o, c, n) for o, c, *_ in orders for k, _, n, *_ in customers if c is not None and c == k]:
        if o is None or o % 50 == 0 or nation is None:
            continue
        low, high = o % 40, o % 40 + o % 7 + (900 if o % 500 == 1 else 0)
        for c, _, n, *_ in customers:
            if c is not None and n == nation and max(low, c % 25) <= min(high, c % 25 + c % 4 - 1):
                a, b = want.get(c, (0, 0))
                want[c] = (a + 1, b + o)
    assert got == want and len(got) > 2
    assert asked[0].count() == asked[0].select("nation", "low", "high").distinct().count()


def test_resumes_of_one_file_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    rows = [(k % 19 or None, f"Name#{k}", 1, 0.0, "") for k in range(40)]
    spark.createDataFrame(rows, fx.TABLES["customer"]).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    whole = sorted((r.candidate_id or 0, r.text or "") for r in fx.resumes(spark, str(tmp_path)).collect())
    monkeypatch.setattr(fx.dealt, "__defaults__", (10,))
    found = fx.resumes(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4
    assert sorted((r.candidate_id or 0, r.text or "") for r in found.collect()) == whole and len(whole) == 40
