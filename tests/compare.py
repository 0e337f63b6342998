"""Run queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from verdigate.sources.ingest import TABLES  # noqa: E402


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _key(value):
    return "~" if value is None else (f"{value:.5f}" if isinstance(value, float) else str(value))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-6)
    return a == b and type(a) is type(b)


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str:
    """Empty string when equal, otherwise the first difference."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    left = [tuple(r[spark_cols.index(c)] for c in order) for r in spark_rows]
    right = [tuple(r[duck_cols.index(c)] for c in order) for r in duck_rows]
    if len(left) != len(right):
        return f"row count {len(left)} vs {len(right)}"
    left.sort(key=lambda r: tuple(map(_key, r)))
    right.sort(key=lambda r: tuple(map(_key, r)))
    exact = 0
    for a, b in zip(left, right):
        for c, x, y in zip(order, a, b):
            if not _same(x, y):
                return f"{c}: {x!r} vs {y!r}\n  spark {dict(zip(order, a))}\n  duck  {dict(zip(order, b))}"
        exact += a == b
    return "" if exact == len(left) else f"~{len(left) - exact} of {len(left)} rows differ below 1e-6"


def check(spark, name, fn, sql, directory, con) -> tuple[str, float, float, int]:
    start = time.time()
    df = fn(spark, directory)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "no oracle", took, 0.0, len(rows)
    start = time.time()
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    expected = result.fetchall()
    return compare(rows, df.columns, expected, cols), took, time.time() - start, len(rows)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(patterns: list[str], directory: str) -> None:
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), duck(directory)
    for name, fn in queries.items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        try:
            verdict, s, d, n = check(spark, name, fn, oracles.get(name), directory, con)
            print(f"{'ok  ' if not verdict else 'DIFF' if verdict != 'no oracle' else '--  '} {name} rows={n} spark={s:.2f}s duck={d:.2f}s {verdict}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    main(args, f"/root/testdata/{sf}")
