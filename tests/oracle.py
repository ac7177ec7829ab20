"""Runs a named query on Spark and its SQL on DuckDB and compares the rows as multisets.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import collections
import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, build, sql, folder) -> str:
    """Empty text when both agree, else what differs."""
    df = build(spark, folder)
    ours = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    theirs = rows_of(columns, found.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if ours != theirs:
        more, less = ours - theirs, theirs - ours
        return f"rows {sum(ours.values())} vs {sum(theirs.values())}; only spark {list(more)[:3]}; only sql {list(less)[:3]}"
    kinds = {c: t for c, t in df.dtypes}
    wide = [c for c, t in zip(columns, found.description) if str(t[1]) == "HUGEINT" or kinds[c].startswith("decimal")]
    return f"types {wide}" if wide else ""


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, built, sql, bad = connect(folder), queries(), oracle_sql(), 0
    for name in names or built:
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, name, built[name], sql[name], folder)
            else:
                problem, n = "", built[name](spark, folder).count()
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in sql else "rows")
        print(f"{mark:5}{name:28}{time.time() - start:7.2f}s {problem}", flush=True)
    print("failed:", bad)
    return bool(bad)


if __name__ == "__main__":
    raise SystemExit(main())
