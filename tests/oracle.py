"""Runs registered queries beside their DuckDB forms. As a script: python tests/oracle.py FOLDER [NAME PART ...]."""

import decimal
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(d, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql):
    """None, or what differs."""
    want = con.sql(sql)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows and {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b or list(map(type, a)) != list(map(type, b))]
    return f"{len(wrong)} of {len(ours[1])} rows, first {wrong[0]}" if wrong else None


def main(d, *parts):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file:///tmp/brightloom-oracle").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, oracle, bad = connect(d), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if parts and not any(p in name for p in parts) or not parts and name.startswith(("op", "pipeline")):
            continue
        began = time.time()
        try:
            wrong = compare(f(spark, d), con, oracle[name]) if name in oracle else f(spark, d).count() and None
        except Exception:
            wrong = "".join(x for x in traceback.format_exc().splitlines(True) if not x.lstrip().startswith("at "))[-700:]
        bad += bool(wrong)
        if wrong or time.time() - began > 15:
            print(name, f"{time.time() - began:.1f}s", wrong or "ok", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
