"""Compare registered Spark queries with their SQL text in DuckDB.

Usage: python tests/compare.py SF_DIR [name-part ...]
"""
from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, [tuple(plain(v) for v in row) for row in df.select(
        *[f"`{c}`" for c in columns]).collect()]


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(row[i]) for i in order) for row in result.fetchall()]
    return [names[i] for i in order], rows


def differences(df, con, sql):
    """(message or None, row count)."""
    columns, ours = spark_rows(df)
    other_columns, theirs = duck_rows(con, sql)
    if columns != other_columns:
        return f"columns {columns} != {other_columns}", len(ours)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}", len(ours)
    ours, theirs = sorted(ours, key=repr), sorted(theirs, key=repr)
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b or repr(a) != repr(b)]
    if bad:
        a, b = bad[0]
        where = [c for c, x, y in zip(columns, a, b) if repr(x) != repr(y)]
        return f"{len(bad)} rows differ, first in {where}: {a} / {b}", len(ours)
    return None, len(ours)


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, parts = argv[0], argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                message, rows = differences(df, con, oracle[name])
            else:
                message, rows = None, len(df.collect())
        except Exception as error:  # report and go on with the next query
            message, rows = f"{type(error).__name__}: {str(error)[:700]}", -1
        mark = "ok  " if message is None else "FAIL"
        failed += message is not None
        kind = "sql" if name in oracle else "rows"
        print(f"{mark} {name:34s} {kind:4s} {rows:7d} {time.time() - start:6.2f}s {message or ''}",
              flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
