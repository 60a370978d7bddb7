"""Compare registered queries with their SQL: python tests/oracle_check.py [sf_dir] [query ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(rows: list, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(found.fetchall(), names)
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        pairs = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(pairs)} rows differ, first: {pairs[:2]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con, bad = session(), oracle(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            problems = differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n     " if problems else "", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} match")
    return bad


if __name__ == "__main__":
    sys.exit(main())
