"""Run a query in Spark and its SQL in DuckDB and compare rows, columns sorted by name."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from tabwright.plans.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql) -> str | None:
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"{len(sr)} rows != {len(dr)} rows; first spark {sr[:2]} duck {dr[:2]}"
    if not sr:
        return "no rows at all"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    return f"{len(bad)} of {len(sr)} rows differ: {bad[:2]}" if bad else None


def main(argv):
    """python -m tests.compare SF_DIR [name prefix ...]"""
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    sf_dir, prefixes = argv[0], argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), entry.oracle_sql()
    failed = []
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                problem = difference(df, con, oracle[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as e:  # keep going, report at the end
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
