"""Runs a registered query beside its SQL. As a script: python tests/compare.py SF NAME..."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in data], key=repr)


def same(spark, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    want = duck(sf_dir).sql(sql)
    expect = rows(want.columns, want.fetchall())
    if sorted(df.columns) != sorted(want.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    if got != expect:
        a, b = set(map(repr, got)), set(map(repr, expect))
        return False, f"{len(got)} and {len(expect)} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(e.queries())
    for name in names:
        t = time.time()
        try:
            if name in e.oracle_sql():
                print(name, *same(spark, f"/root/testdata/{sys.argv[1]}", e.queries()[name], e.oracle_sql()[name]), f"{time.time() - t:.1f}s", flush=True)
            else:
                df = e.queries()[name](spark, f"/root/testdata/{sys.argv[1]}")
                r = df.collect()
                print(name, "no SQL", len(r), r[:2], f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(name, "ERROR", str(x)[:1500], flush=True)
