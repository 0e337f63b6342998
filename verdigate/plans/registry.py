"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.sources.ingest import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def result_table(df: DataFrame) -> DataFrame:
    """Result doubles rounded to six digits, without negative zero."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in doubles})


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query.  `sql` is its oracle; `doubles` are the columns the
    oracle rounds the way `result_table` does."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, directory: str) -> DataFrame:
            return result_table(fn(configure(spark), directory))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded(sql, doubles)
        return fn

    return register


def rounded(sql: str, doubles: Sequence[str]) -> str:
    if not doubles:
        return sql
    replaced = ", ".join(
        f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0e0 AS {c}" for c in doubles
    )
    return f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS result"
