"""Readers.  Schemas are declared, doubles are cleaned at the border, and no
reader infers types from the data."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.functions.columns import null_if_not_finite

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the results depend on (time zone) and AQE."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # The JVM leaves methods above 8,000 bytes interpreted; split code is faster.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{directory}/{name}.parquet"))


def spread(df: DataFrame, min_bytes: int = 1 << 20) -> DataFrame:
    """Deal out a scan that has fewer splits than the session has cores.

    A table in one row group would keep one core busy and leave the rest idle.
    A table with enough splits, which is every large one, is left alone, so no
    shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < min_bytes or size > cores * (128 << 20):
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def clean_doubles(df: DataFrame) -> DataFrame:
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({name: null_if_not_finite(F.col(name)) for name in floating})


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Reader chosen by suffix: csv, json/jsonl (plain or gzip) or parquet."""
    base = path.removesuffix(".gz").removesuffix("/")
    if base.endswith(".csv"):
        if schema is None:
            raise ValueError("csv input needs a declared schema")
        df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    elif base.endswith((".json", ".jsonl")):
        if schema is None:
            raise ValueError("json input needs a declared schema")
        df = spark.read.schema(schema).json(path)
    else:
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if columns is not None:
        names = list(columns)
        df = require_columns(df, names).select(*names)
    return clean_doubles(df)


def read_split(df: DataFrame, split: str, required: Iterable[str]) -> DataFrame:
    """Rows of one split, only the required columns; an empty split is an error."""
    names = list(dict.fromkeys(["split", *required]))
    chosen = require_columns(df, names).select(*names).filter(F.col("split") == split)
    if chosen.isEmpty():
        raise ValueError(f"split is empty: {split}")
    return chosen


BAR_COLUMNS = ("open_time", "open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars from headed or headless CSV.  Every field is read as text, so
    a header row fails the numeric cast and drops out with the other bad rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in BAR_COLUMNS])
    raw = spark.read.schema(schema).csv(path, header=False, mode="PERMISSIVE")
    return parse_bars(raw)


def parse_bars(raw: DataFrame) -> DataFrame:
    parsed = raw.select(
        *[c for c in raw.columns if c not in BAR_COLUMNS],
        F.timestamp_millis(F.expr("try_cast(open_time AS BIGINT)")).alias("open_time"),
        *[
            null_if_not_finite(F.expr(f"try_cast({c} AS DOUBLE)")).alias(c)
            for c in BAR_COLUMNS[1:]
        ],
    )
    return parsed.dropna(subset=["open_time", "open", "close"])


def read_zipped_bars(spark: SparkSession, path: str) -> DataFrame:
    """Zip is not a Hadoop codec, so each archive is opened inside a task."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in BAR_COLUMNS])

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as handle:
                            for chunk in pd.read_csv(
                                handle, header=None, dtype=str, chunksize=65536,
                                usecols=range(len(BAR_COLUMNS)), names=list(BAR_COLUMNS),
                            ):
                                yield chunk

    files = spark.read.format("binaryFile").load(path).select("content")
    return parse_bars(files.mapInPandas(unzip, schema))


def pivot_depth(depth: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Long depth rows (timestamp, percentage, notional, seq) to bid and ask columns.

    The last notional per side wins; `seq` fixes what 'last' means.
    """
    keys = list(keys)
    clean = depth.select(
        *keys,
        "timestamp",
        F.expr("try_cast(percentage AS DOUBLE)").alias("percentage"),
        null_if_not_finite(F.expr("try_cast(notional AS DOUBLE)")).alias("notional"),
        "seq",
    ).filter(
        F.col("percentage").isin(-1.0, 1.0)
        & F.col("timestamp").isNotNull()
        & F.col("notional").isNotNull()
    )

    def side(value: float) -> F.Column:
        mine = F.col("percentage") == value
        return F.max_by(F.when(mine, F.col("notional")), F.when(mine, F.col("seq")))

    return (
        clean.groupBy(*keys, "timestamp")
        .agg(side(-1.0).alias("bid_depth_1pct"), side(1.0).alias("ask_depth_1pct"))
        .dropna()
    )


def clean_quotes(quotes: DataFrame, keys: Iterable[str], timezone: str) -> DataFrame:
    """Best-bid-offer rows: last row per timestamp, finite, positive, crossed
    markets removed, with the local date and time of day of the venue."""
    keys = list(keys)
    sides = ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00")
    payload = [c for c in quotes.columns if c not in (*keys, "ts", "seq")]
    last = (
        quotes.groupBy(*keys, "ts")
        .agg(F.max_by(F.struct(*payload), F.col("seq")).alias("q"))
        .select(*keys, "ts", *[F.col(f"q.{c}").alias(c) for c in payload])
    )
    local = F.from_utc_timestamp(F.col("ts"), timezone)
    return (
        clean_doubles(last)
        .dropna(subset=list(sides))
        .filter(
            (F.col("bid_px_00") > 0)
            & (F.col("ask_px_00") > F.col("bid_px_00"))
            & (F.col("bid_sz_00") >= 1)
            & (F.col("ask_sz_00") >= 1)
        )
        .withColumns(
            {"local_date": F.to_date(local), "local_time": F.date_format(local, "HH:mm:ss")}
        )
    )


def session_hours(quotes: DataFrame, start: str, end: str) -> DataFrame:
    return quotes.filter(F.col("local_time").between(start, end))


MARKET_SCHEMA = (
    "id STRING, question STRING, createdAt STRING, startDate STRING, endDate STRING, "
    "closedTime STRING, outcomePrices STRING, clobTokenIds STRING, closed BOOLEAN, "
    "enableOrderBook BOOLEAN, volumeNum DOUBLE, feesEnabled BOOLEAN, "
    "feeSchedule STRUCT<rate: STRING>, category STRING, sportsMarketType STRING, "
    "feeType STRING, marketType STRING, "
    "events ARRAY<STRUCT<id: STRING, title: STRING, endDate: STRING, "
    "series: ARRAY<STRUCT<slug: STRING, title: STRING>>>>, "
    "tags ARRAY<STRUCT<slug: STRING, label: STRING>>"
)
HISTORY_SCHEMA = (
    "token STRING, points ARRAY<STRUCT<t: BIGINT, p: DOUBLE, source: STRING>>"
)


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKET_SCHEMA).json(path)


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def file_fingerprints(spark: SparkSession, path: str, max_bytes: int = 100_000_000) -> DataFrame:
    """Content hash of each file.  A file above the size limit (`length` is pushed down,
    so it is not read) is returned with a null hash and the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = files.filter(F.col("length") <= max_bytes).select(
        "path", "length", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("reason")
    )
    skipped = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("string").alias("sha256"),
        F.lit(f"larger than {max_bytes} bytes").alias("reason"),
    )
    return hashed.unionByName(skipped)
