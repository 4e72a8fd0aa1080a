"""Ids that are texts, fractions, repeated or missing name rows in every operator that needs keys."""

import pytest
from pyspark.sql import functions as F

from rolecall.llm import rows
from rolecall.llm.bagminhash import near_duplicate_stage, op9_bagminhash
from rolecall.llm.decontaminate import decontamination_stage
from rolecall.llm.lpf_dedup import op4_lpf_dedup, repeats_stage
from rolecall.llm.packing import op10_packing

from .conftest import prose


@pytest.fixture
def named(make_docs):
    texts = {1: prose(1, 80), 2: prose(1, 80), 3: prose(2, 90), 4: prose(2, 90), 5: prose(3, 50)}
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    name = {1: "a7", 2: "1", 3: "01", 4: "x", 5: None}
    return docs.withColumn("doc_id", F.element_at(F.create_map(*[x for k, v in name.items() for x in (F.lit(k), F.lit(v).cast("string"))]), F.col("doc_id").cast("int")))


def test_keys_of_other_ids_are_row_numbers(spark, named):
    got = rows.keyed(named, "doc_id", "text").collect()
    assert len({r["_key"] for r in got}) == 5 and {r["_id"] for r in got} == {"a7", "1", "01", "x", None}
    plain = rows.keyed(spark.createDataFrame([(3, "x"), (4, "y")], "i int, text string"), "i", "text")
    assert sorted(r["_key"] for r in plain.collect()) == [3, 4]


def test_operators_take_text_ids(spark, named, sf):
    sf.write("documents", named)
    groups = {r.doc_id: (r.class_id, r.group_id) for r in op9_bagminhash(spark, sf).collect()}
    assert groups == {"a7": ("1", "1"), "1": ("1", "1"), "01": ("01", "01"), "x": ("01", "01"), None: (None, None)}
    removed = {r.doc_id: r.n_removed > 0 for r in op4_lpf_dedup(spark, sf).collect()}
    assert removed == {"a7": True, "1": True, "01": True, "x": True, None: False}
    assert sum(r["size"] for r in op10_packing(spark, sf).collect()) == 390
    assert near_duplicate_stage(spark, named, sf).count() == 3
    assert repeats_stage(spark, named, sf).count() == 5
    spark.createDataFrame([(1, prose(2, 90))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert {r.doc_id for r in decontamination_stage(spark, named, sf).collect()} == {"a7", "1", None}
