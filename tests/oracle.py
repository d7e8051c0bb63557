"""Compare registered queries with their SQL: ``python -m tests.oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a description of the difference; the row count; the seconds."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return None if got else "no rows", len(got), took
    result = con.sql(sql)
    want = result.fetchall()
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} != {sorted(result.columns)}", len(got), took
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    other = {c: str(t) for c, t in zip(result.columns, result.types)}
    if kinds != other:
        return f"types {[(c, kinds[c], other[c]) for c in kinds if kinds[c] != other[c]]}", len(got), took
    a, b = rows_of(df.columns, got), rows_of(result.columns, want)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return (f"{len(a)} vs {len(b)} rows; only here {[x for x in a if repr(x) not in sb][:3]}; "
                f"only in SQL {[x for x in b if repr(x) not in sa][:3]}"), len(got), took
    return (None if got else "no rows"), len(got), took


def main(argv):
    from pyspark.sql import SparkSession

    from harvestry.catalog import ORACLE, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in [n for n in QUERIES if any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]:
        try:
            diff, n, took = compare(spark, con, sf_dir, name, QUERIES[name], ORACLE.get(name))
        except Exception as exc:  # noqa: BLE001
            diff, n, took = f"{type(exc).__name__}: {str(exc)[:700]}", 0, 0.0
            if "-v" in argv:
                traceback.print_exc()
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:28s} {n:7d} rows {took:6.2f}s "
              f"{'' if name in ORACLE else '(rows only)'} {diff or ''}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
