import re

import pytest

from checks.compare import compare, connect
from rolecall.llm import decontaminate
from rolecall.llm.decontaminate import OP1_SQL, contained, decontamination_stage, op1_decontaminate

from .conftest import prose


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, op1_decontaminate, OP1_SQL) is None


def brute(docs, items, threshold):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()] for i in range(len(w) - 4)}
    sets = {k: shingles(t) for k, t in docs}
    out = set()
    for item, text in items:
        own = shingles(text)
        out |= {(k, item, len(own & s), len(own)) for k, s in sets.items() if own and len(own & s) >= threshold * len(own)}
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_size_and_share(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_SKETCHES", 0)
    items = [(n, prose(n, n)) for n in [3, 4, 5, 6, 7, 9, 14, 20, 33, 64, 90]]
    docs = []
    for n, text in items:
        words = text.split()
        for drop in range(0, 8):  # the front of the item is missing
            docs.append((n * 100 + drop, prose(n * 7 + drop, 300) + " " + " ".join(words[drop:]).upper() + " " + prose(drop, 50)))
        docs.append((n * 100 + 50, re.sub(" ", "\t\n ", text)))
    frame = spark.createDataFrame(docs, "_key long, text string")
    got = contained(frame, spark.createDataFrame(items, "item long, text string"))
    assert {tuple(r) for r in got.select("_key", "item", "shared", "size").collect()} == brute(docs, items, 0.8)


def test_stage_and_odd_rows(spark, odd_docs, make_docs, sf):
    item = prose(40, 30)
    sf.write("benchmark", spark.createDataFrame([(1, item), (2, None), (3, ""), (None, prose(1, 120)), (4, "too short")], "item_id long, text string"))
    leak = f"{prose(41, 500)} {item} {prose(42, 500)}"
    docs = odd_docs.unionByName(make_docs([(50, leak, "en", "a"), (None, leak, "en", "a"), (51, " ".join(item.split()[:12]), "en", "a")]))
    kept = decontamination_stage(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert kept.filter("doc_id = 50").count() == 0 and kept.filter("doc_id = 51").count() == 1
    sf.write("documents", docs)
    assert sorted((r.doc_id or 0, r.item_id) for r in op1_decontaminate(spark, sf).collect()) == [(0, 1), (50, 1)]
    assert decontamination_stage(spark, docs.limit(0), sf).count() == 0


def test_no_items(spark, odd_docs):
    none = spark.createDataFrame([], "item long, text string")
    keyed = odd_docs.select(odd_docs.n.cast("long").alias("_key"), "text")
    assert contained(keyed, none).count() == 0


def test_stays_in_the_engine(spark, sf):
    plan = op1_decontaminate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
