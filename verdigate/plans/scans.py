"""Readers and writers exercised on copies of the given tables.

Each query writes a table in another format to the shared scratch folder, reads it
back through the library reader and summarises it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.operators.distributed import shared_folder
from verdigate.plans.proxies import DECISION_SQL, decision_view
from verdigate.plans.registry import query
from verdigate.sources import ingest, sinks


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    return f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
EVENT_SQL = """SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1"""


def _events(spark: SparkSession, directory: str) -> DataFrame:
    return ingest.table(spark, directory, "events").select("event_id", "event_type", "value")


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SRC1_csv_scan", EVENT_SQL, ("total",))
def csv_scan(spark, directory):
    path = scratch(spark) + "/events.csv"
    sinks.write_projection(_events(spark, directory), path, "csv")
    return _summary(ingest.read_table(spark, path, EVENT_SCHEMA, ["event_type", "value"]))


@query(
    "SRC2_split_scan",
    f"WITH {DECISION_SQL} SELECT split, count(*) AS n, sum(confidence) AS confidence FROM v "
    "WHERE split = 'train' GROUP BY 1",
    ("confidence",),
)
def split_scan(spark, directory):
    """Split-partitioned parquet; the reader prunes to one directory (SNK2)."""
    path = scratch(spark) + "/decisions"
    sinks.write_by_split(decision_view(spark, directory).select("row_id", "split", "confidence"), path)
    chosen = ingest.read_split(spark.read.parquet(path), "train", ["row_id", "confidence"])
    return chosen.groupBy("split").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


@query("SRC3_parquet_scan", EVENT_SQL, ("total",))
def parquet_scan(spark, directory):
    return _summary(ingest.read_table(spark, f"{directory}/events.parquet", columns=["event_type", "value"]))


@query("SRC11_SNK4_json_roundtrip", EVENT_SQL, ("total",))
def json_roundtrip(spark, directory):
    path = scratch(spark) + "/events.json"
    sinks.write_projection(_events(spark, directory), path, "json")
    return _summary(ingest.read_table(spark, path, EVENT_SCHEMA))


@query("SRC10_file_fingerprints")
def file_fingerprints(spark, directory):
    """Content hashes of the table files up to the size limit."""
    files = ingest.file_fingerprints(spark, directory)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "sha256", "reason")


@query(
    "SNK1_result_csv",
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
)
def result_csv(spark, directory):
    path = scratch(spark) + "/result.csv"
    counts = _events(spark, directory).groupBy("event_type").agg(F.count("*").alias("n"))
    sinks.write_result_csv(counts, path)
    schema = T.StructType(
        [T.StructField("event_type", T.StringType()), T.StructField("n", T.LongType())]
    )
    return ingest.read_table(spark, path, schema)


@query(
    "T7_ordered_results",
    "SELECT row_number() OVER (ORDER BY n DESC, event_type) AS line, event_type, n "
    "FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
)
def ordered_results(spark, directory):
    """The lines of a result table in the order of the sink; one file is one partition."""
    path = scratch(spark) + "/ordered.csv"
    counts = _events(spark, directory).groupBy("event_type").agg(F.count("*").alias("n"))
    sinks.write_result_csv(counts, path, [F.desc_nulls_last("n"), "event_type"])
    schema = T.StructType(
        [T.StructField("event_type", T.StringType()), T.StructField("n", T.LongType())]
    )
    lines = ingest.read_table(spark, path, schema).select(
        F.monotonically_increasing_id().alias("_at"), "event_type", "n"
    )
    line = F.row_number().over(Window.orderBy("_at")).cast("bigint")
    return lines.select(line.alias("line"), "event_type", "n")


@query(
    "SRC4_bar_files",
    """SELECT epoch_us(ts) // 1000 AS open_ms, count(*) AS bars, sum(value) AS open, sum(value * 2.0e0) AS high
    FROM events WHERE event_type <> 'error' GROUP BY 1""",
    ("open", "high"),
)
def bar_files(spark, directory):
    """Bars read from text files: lines that are headers in the middle drop out."""
    path = scratch(spark) + "/bars.csv"
    value = F.col("value")
    bars = ingest.table(spark, directory, "events").select(
        F.when(F.col("event_type") == "error", "open_time")
        .otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("open_time"),
        value.alias("open"), (value * 2.0).alias("high"), *[value.alias(c) for c in ("low", "close", "volume")],
    )
    bars.write.csv(path)
    return ingest.read_bars(spark, path).groupBy(F.unix_millis("open_time").alias("open_ms")).agg(
        F.count("*").alias("bars"), F.sum("open").alias("open"), F.sum("high").alias("high")
    )


@query(
    "SRC8_market_files",
    """SELECT CAST(user_id % 7 AS VARCHAR) AS category, count(*) AS markets, sum(value) AS volume,
      sum(CAST(event_id % 3 AS DOUBLE) / 10.0e0) AS rate, count(*) FILTER (WHERE event_id % 2 = 0) AS tagged
    FROM events GROUP BY 1""",
    ("volume", "rate"),
)
def market_files(spark, directory):
    """Market records written as JSON lines and read with the declared nested schema."""
    path = scratch(spark) + "/markets.json"
    made = ingest.table(spark, directory, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("value").alias("volumeNum"),
        (F.col("user_id") % 7).cast("string").alias("category"),
        F.struct((F.col("event_id") % 3 / 10.0).cast("string").alias("rate")).alias("feeSchedule"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit("t").alias("slug"), F.lit("T").alias("label")))).alias("tags"),
        F.lit("not in the schema").alias("unknown"),
    )
    sinks.write_projection(made, path, "json")
    return ingest.read_markets(spark, path).groupBy("category").agg(
        F.count("*").alias("markets"), F.sum("volumeNum").alias("volume"),
        F.sum(F.col("feeSchedule.rate").cast("double")).alias("rate"), F.count_if(F.size("tags") > 0).alias("tagged"),
    )


@query(
    "SRC8_history_files",
    """SELECT CAST(user_id AS VARCHAR) AS token, count(*) AS points, sum(value) AS total,
      max(epoch_us(ts) // 1000000) AS last FROM events GROUP BY 1""",
    ("total",),
)
def history_files(spark, directory):
    """Price histories, one JSON line a token, read and unnested."""
    path = scratch(spark) + "/histories.json"
    point = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("p"), F.lit("trade").alias("source")
    )
    histories = ingest.table(spark, directory, "events").groupBy(F.col("user_id").cast("string").alias("token")).agg(
        F.collect_list(point).alias("points")
    )
    sinks.write_projection(histories, path, "json")
    points = ingest.read_histories(spark, path).select("token", F.inline("points"))
    return points.groupBy("token").agg(
        F.count("*").alias("points"), F.sum("p").alias("total"), F.max("t").alias("last")
    )
