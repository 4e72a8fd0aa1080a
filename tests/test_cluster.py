"""Queries that store tables, on a cluster whose shared folder has a plain path below the folder for temporary files."""

import datetime as dt

import duckdb
import pytest
from pyspark import SparkContext

from checks import queries as q
from checks.compare import compare
from checks.oracle import SQL
from rolecall import fixtures as fx
from rolecall.session import shared_dir

ROWS = {
    "nation": [(n, f"NATION_{n}", 0) for n in range(2)],
    "customer": [(c, f"Customer#{c}", c % 2, 1.0, "A") for c in range(20)],
    "embeddings": [(v, [1.0 + v, 2.0, float(v)], v) for v in range(5)],
    "orders": [(k, k % 20, "O", 100.0 + k, dt.datetime(1992 + k % 10, 1 + k % 12, 1 + k % 28), "1") for k in range(300)],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, fx.TABLES[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def cluster(spark, tmp_path, monkeypatch):
    read = type(spark.conf).get
    named = lambda self, key, *default: str(tmp_path) if key == "spark.checkpoint.dir" else read(self, key, *default)
    monkeypatch.setattr(type(spark.conf), "get", named)
    monkeypatch.setattr(SparkContext, "master", property(lambda self: "spark://driver:7077"), raising=False)
    assert shared_dir(spark) == str(tmp_path)
    return spark


STORING = [
    "renumber_ids", "read_source", "maintain", "insert_then_maintain", "mismatch_flag", "search_postings", "crawl_frontier",
    "recommend_one", "stream_ingest", "stream_batches", "recommend", "resume_recommendations", "ingest_pages",
]


@pytest.mark.parametrize("name", STORING)
def test_a_query_stores_its_tables_in_the_named_folder(cluster, tables, tmp_path, name):
    con = duckdb.connect()
    for table in ROWS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    assert compare(cluster, con, tables, q.QUERIES[name], SQL[name]) is None
    assert list(tmp_path.glob("rolecall-*"))


def test_all_crawls_of_discover_and_ingest_share_the_named_folder(cluster, tables, tmp_path, monkeypatch):
    # the crawls themselves are tested in test_ingest; their places are at stake here
    crawls = []
    monkeypatch.setattr(q.ing, "discover_and_ingest", lambda table, frontier, batch_id, *rest: crawls.append((table, frontier, batch_id)))
    assert q.discover_and_ingest(cluster, tables).count() == 0
    assert [batch_id for *_, batch_id in crawls] == [0, 1, 1, 2] and len({crawl[:2] for crawl in crawls}) == 1
    assert crawls[0][0].startswith(f"{tmp_path}/rolecall-crawl-")
