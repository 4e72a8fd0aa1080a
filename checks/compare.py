"""Run registered queries on Spark and DuckDB and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def _value(v):
    if isinstance(v, float) and v.is_integer() and not math.isinf(v):
        return int(v)
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both sides give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got_rows = df.collect()
    relation = con.sql(sql)
    want_rows = relation.fetchall()
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} / {sorted(relation.columns)}"
    got, want = bag(df.columns, got_rows), bag(relation.columns, want_rows)
    if got == want:
        return None
    only = [list((a - b).elements())[:2] for a, b in ((got, want), (want, got))]
    return f"{len(got_rows)} / {len(want_rows)} rows; only Spark {only[0]}; only SQL {only[1]}"


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from checks.oracle import SQL
    from checks.queries import QUERIES
    from rolecall.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in SQL:
                diff = compare(spark, con, sf_dir, QUERIES[name], SQL[name])
            else:
                diff = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        bad += diff is not None
        print(f"{'same' if diff is None else 'DIFF'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
