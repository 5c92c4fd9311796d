"""Run queries against their SQL over the same tables.

    python tests/check.py SF_DIR [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("idsift")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def kind(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "integer", "bigint"):
        return "integer"
    return {"string": "varchar", "timestamp_ntz": "timestamp"}.get(t, t)


def compare(spark, con, fn, sql, sf_dir):
    """None when rows, names and kinds of types agree, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(norm(r[n]) for n in names) for r in df.collect()]
    if sql is None:
        return None, len(got)
    desc = con.execute(f"DESCRIBE {sql}").fetchall()
    types = {r[0]: kind(r[1]) for r in desc}
    mine = {n: kind(t) for n, t in df.dtypes}
    if types != mine:
        return f"schema: spark {mine} duck {types}", len(got)
    cols = ", ".join(f'"{n}"' for n in names)
    want = [tuple(norm(v) for v in r) for r in con.execute(f"SELECT {cols} FROM ({sql}) q").fetchall()]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        return None, len(got)
    a, b = set(got), set(want)
    return (
        f"rows spark {len(got)} duck {len(want)} cols {names}\n   only spark {sorted(a - b, key=key)[:3]}\n   only duck {sorted(b - a, key=key)[:3]}",
        len(got),
    )


def main() -> int:
    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        took = time.time() - start
        state = "FAIL" if problem else ("ok" if name in sqls else "ran")
        print(f"{state:5}{name:32}{n:8} rows {took:6.1f}s", flush=True)
        if problem:
            failed += 1
            print("   " + problem, flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
