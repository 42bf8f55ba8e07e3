"""Run registered queries and their SQL twins side by side.

usage: python tools/check_queries.py SF_DIR [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from isobar.plans.catalogue import QUERIES
from isobar.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as text with columns by name, in a fixed order."""
    df = df[sorted(df.columns)]

    def cell(v):
        return "NULL" if v is None or v is pd.NaT or v is pd.NA or v != v else str(v)

    def column(s):
        if s.dtype.kind in "iu":
            return s.astype("Int64")
        return s

    cols = [[cell(v) for v in column(df[c]).tolist()] for c in df.columns]
    return sorted(zip(*cols)) if cols else []


def same(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    kinds = [
        f"{c}: {spark_df[c].dtype} != {sql_df[c].dtype}"
        for c in sorted(spark_df.columns)
        if spark_df[c].dtype != sql_df[c].dtype and len(spark_df)
    ]
    a, b = canonical(spark_df), canonical(sql_df)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}"
    return "kinds " + "; ".join(kinds) if kinds else None


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in names:
        q = QUERIES[name]
        start = time.time()
        try:
            got = q.run(spark, sf_dir).toPandas()
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                if len(names) < 6:
                    print(got.to_string())
                continue
            want = con.execute(q.sql).df()
            problem = same(got, want)
        except Exception as e:  # noqa: BLE001
            took = time.time() - start
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        if problem and not problem.startswith("kinds"):
            failed += 1
            print(f"FAIL  {name} ({took:.1f}s): {problem}", flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows, {took:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
