import corpus_pipeline
import __spark_entry__ as registry
from rolecall.llm.queries import QUERIES, SQL

from .conftest import prose


def test_registered():
    names = set(registry.queries())
    assert {*QUERIES, "pipeline"} <= names and set(SQL) <= set(registry.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_each_stage_decides(spark, make_docs, sf):
    item, passage = prose(70, 40), prose(71, 80)
    base = prose(72, 150)
    rows = [(i, prose(i, 80), "en", f"s{i % 3}") for i in range(20)]
    rows += [
        (100, "1234 5678 !!!", "en", "s0"),
        (101, base, "en", "s0"),
        (102, base, "en", "s1"),
        (103, base.replace(base.split()[40], "changed", 1), "en", "s2"),
        (104, f"{prose(80, 60)} {passage} {prose(81, 60)}", "en", "s0"),
        (105, f"{prose(82, 60)} {passage} {prose(83, 60)}", "en", "s1"),
        (106, f"{prose(84, 200)} {item} {prose(85, 200)}", "en", "s1"),
    ]
    sf.write("documents", make_docs(rows)).write("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 100 not in left["language_id"] and len(left["language_id"]) == len(rows) - 1
    assert {101, 102, 103} & left["near_dedup"].keys() == {101}
    assert passage in left["suffix_dedup"][104] and passage not in left["suffix_dedup"][105]
    assert 106 not in left["decontamination"]
    whole = corpus_pipeline.run(spark, sf)
    words = {i: len(t.split()) for i, t in left["decontamination"].items()}
    packed = whole.groupBy("doc_id").sum("size").collect()
    assert {r.doc_id: r[1] for r in packed} == words
    assert whole.groupBy("shard", "bin").sum("size").filter("`sum(size)` > 2048").count() == 0


def test_odd_and_empty_tables(spark, odd_docs, sf, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    sf.write("documents", odd_docs).write("benchmark", none)
    assert corpus_pipeline.run(spark, sf).count() > 0
    for name, frame in (("documents", odd_docs.limit(0)), ("benchmark", none)):
        frame.write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
