"""Run registered queries against their DuckDB SQL.

    python tests/check_oracles.py [--sf DIR] [name ...]
"""
from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows),
                  key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(df, con, sql: str):
    """None when equal, else a description of the first difference."""
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"\n  got  {g}\n  want {w}"
    return None


def main():
    import __spark_entry__ as entry
    from lexloom.session import build_session
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        t = time.time()
        try:
            df = queries[name](spark, args.sf)
            diff = compare(df, con, oracles[name]) if name in oracles else f"rows {df.count()}"
        except Exception as e:                                   # report and go on
            diff = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += diff is not None
        print(f"{name:28s} {'ok' if diff is None else 'DIFF ' + str(diff)[:1500]}  {time.time()-t:.1f}s",
              flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
