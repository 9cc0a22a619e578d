"""Runs the registered queries next to their SQL and reports differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    cols = sorted(got.columns)

    def rows(df: pd.DataFrame) -> list[tuple]:
        plain = df[cols].astype(object).where(df[cols].notna(), None)
        return [tuple(r) for r in plain.itertuples(index=False)]

    from collections import Counter

    a, b = Counter(rows(got)), Counter(rows(want))
    if a == b:
        return []
    only_a, only_b = list((a - b).items()), list((b - a).items())
    out = [f"rows {len(got)} vs {len(want)}; only Spark {len(only_a)}, only SQL {len(only_b)}; columns {cols}"]
    out += [f"  spark {str(r)[:400]}" for r in sorted(map(str, only_a))[:3]]
    out += [f"  sql   {str(r)[:400]}" for r in sorted(map(str, only_b))[:3]]
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = set(argv[1:])
    spark, con = session(), duck(sf_dir)
    sql, bad = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            took = time.time() - start
            want = con.execute(sql[name]).df()
            diff = differences(got, want)
        except Exception as err:  # report and go on with the other queries
            took, got, diff = time.time() - start, [], [f"{type(err).__name__}: {str(err)[:600]}"]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok':4} {name:24} {len(got):8} rows {took:6.1f} s", flush=True)
        for line in diff:
            print("     ", line, flush=True)
    print(f"{bad} failed", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
