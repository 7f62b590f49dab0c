"""Side-by-side comparison of the queries with their SQL in DuckDB, as the driver does it."""

from __future__ import annotations

import datetime
import math
import sys
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return str(v)


def rows_of(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def compare(spark, con, d: str, name: str, query, sql: str | None) -> str:
    """Empty if all is well, else what differs."""
    df = query(spark, d)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return ""
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"{len(got)} rows != {len(want)}; only Spark {list(a - b)[:2]}; only SQL {list(b - a)[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else ""


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    d = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not sys.argv[2:] or n in sys.argv[2:]]
    failed = 0
    for n in names:
        t = time.time()
        try:
            why = compare(spark, con, d, n, qs[n], sqls.get(n))
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {n} {time.time() - t:.1f}s {'' if n in sqls else '(rows only)'} {why[:900]}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
