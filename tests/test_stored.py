"""Results that queries store and read again."""

import datetime as dt
import os

from checks import queries as q
from rolecall import fixtures as fx
from rolecall.session import fresh_dir, shared_dir, staging


def write_tables(spark, folder, orders):
    rows = {
        "nation": [(n, f"NATION_{n}", 0) for n in range(2)],
        "customer": [(c, f"Customer#{c}", c % 2, 1.0, "A") for c in range(20)],
        "embeddings": [(v, [1.0 + v, 2.0, float(v)], v) for v in range(5)],
        "orders": [(k, k % 20, "O", 100.0 + k, dt.datetime(2001, 8, 1 + k % 28), "1") for k in orders],
    }
    for name, of in rows.items():
        spark.createDataFrame(of, fx.TABLES[name]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_views_are_right_once_the_stored_lists_are_gone(spark, tmp_path):
    write_tables(spark, tmp_path, range(400))
    views = ["views_all", "views_high", "views_recent", "views_source", "paging", "source_list"]
    seen = lambda: {view: rows_of(q.QUERIES[view](spark, str(tmp_path))) for view in views}
    with staging(spark):
        before = seen()
    assert all(before.values()) and seen() == before


def test_views_follow_their_tables(spark, tmp_path, monkeypatch):
    # the lists themselves are not at stake here: the ids of the orders stand for them
    monkeypatch.setattr(q, "_recommend", lambda spark, sf: fx.table(spark, sf, "orders").select("o_orderkey"))
    write_tables(spark, tmp_path, range(100))
    first = q._recommended(spark, str(tmp_path))
    assert first.count() == 100 and q._recommended(spark, str(tmp_path)) is first  # unchanged lists are read again
    write_tables(spark, tmp_path, range(100, 130))
    assert q._recommended(spark, str(tmp_path)).agg({"o_orderkey": "min"}).first()[0] == 100


def test_nothing_lies_between_the_shared_folder_and_a_stored_table(spark):
    one, other = fresh_dir(spark, "x"), fresh_dir(spark, "x")
    assert one != other and os.path.dirname(one) == os.path.dirname(other) == shared_dir(spark).rstrip("/")
