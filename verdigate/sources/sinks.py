"""Writers for result tables, datasets and manifests."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.functions.columns import canonical_json, null_if_not_finite


def write_result_csv(df: DataFrame, path: str, order: Sequence[str | Column] = ()) -> None:
    """Result tables have one row per rule, profile or grid cell, so one file, whose
    lines follow `order`."""
    one = df.coalesce(1)
    (one.sortWithinPartitions(*order) if order else one).write.mode("errorifexists").csv(path, header=True)


def write_by_split(df: DataFrame, path: str, column: str = "split") -> None:
    """One directory per split.  Rows stay where they are: no shuffle, and a
    split that holds most of the data is still written by every task."""
    df.write.mode("errorifexists").partitionBy(column).parquet(path)


def canonical_rows(df: DataFrame) -> DataFrame:
    """Each row as sorted-key JSON with NaN and infinities as null."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    cleaned = df.withColumns({c: null_if_not_finite(F.col(c)) for c in floating})
    return cleaned.select(canonical_json(*df.columns).alias("value"))


def write_canonical_json(df: DataFrame, path: str) -> None:
    canonical_rows(df).write.mode("errorifexists").text(path)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and a function that makes its paths."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def publish_partitions(
    df: DataFrame, path: str, destinations: Sequence[str], column: str = "destination"
) -> dict[str, int]:
    """Write the rows of each destination to its own folder of a new table and return
    their counts.

    An existing target is refused, and so are rows of another or no destination.  The
    table is written beside the target, read back and counted, and only then renamed to
    its place, so readers see all of it or nothing; a failure leaves no target.  The
    rename is one step on a file system that has it; an object store copies.  Rows
    are counted while they are written, and not moved before.
    """
    spark = df.sparkSession
    files, of = file_system(spark, path)
    if files.exists(of(path)):
        raise FileExistsError(f"refusing to overwrite published table: {path}")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    sent = Observation()
    counts = [F.count_if(F.col(column) == d).alias(f"d{i}") for i, d in enumerate(destinations)]
    try:
        df.observe(sent, F.count(F.lit(1)).alias("all"), *counts).write.partitionBy(column).parquet(staged)
        found = dict(sent.get)
        wanted = {d: found[f"d{i}"] for i, d in enumerate(destinations)}
        if sum(wanted.values()) != found["all"]:
            raise ValueError(f"{found['all'] - sum(wanted.values())} rows have no listed destination")
        stored = {d: 0 for d in destinations}
        if found["all"]:
            back = spark.read.schema(df.schema).parquet(staged)
            stored |= {r[column]: r["n"] for r in back.groupBy(column).agg(F.count("*").alias("n")).collect()}
        else:
            # Without rows there is no file to read the columns from; an empty one has them.
            none = df.drop(column).limit(0)
            none.write.mode("overwrite").parquet(f"{staged}/{column}={destinations[0]}")
        if stored != wanted:
            raise ValueError(f"stored rows {stored} differ from written rows {wanted}")
        if not files.rename(of(staged), of(path)):
            raise FileExistsError(f"could not publish {path}")
    finally:
        if files.exists(of(staged)):
            files.delete(of(staged), True)
    return wanted


def write_projection(df: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt not in ("json", "csv"):
        raise ValueError(f"unsupported projection format: {fmt}")
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.json(path)


def dataset_manifest(
    df: DataFrame,
    enums: Iterable[str],
    cluster: str = "event_cluster_id",
    timestamp: str | None = None,
) -> DataFrame:
    """Counts a dataset is published with, as (section, name, value) rows.

    Enum counts and cluster sizes each need one shuffle of already combined
    rows; the raw table is never moved.
    """
    enums = list(enums)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("name"))
            for c in enums
        ]
    )
    counts = (
        df.select(F.explode(pairs).alias("e"))
        .groupBy("e.section", "e.name")
        .agg(F.count("*").alias("value"))
    )
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    cluster_stats = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("clusters"),
        F.min("n").alias("min_rows_per_cluster"),
        F.max("n").alias("max_rows_per_cluster"),
    )
    names = cluster_stats.columns
    stats = cluster_stats.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])
        ).alias("e")
    ).select(F.lit("dataset").alias("section"), "e.name", "e.value")
    parts = counts.unionByName(stats)
    if timestamp is not None:
        days = df.agg(
            F.min(F.unix_date(F.to_date(timestamp))).alias("first_day"),
            F.max(F.unix_date(F.to_date(timestamp))).alias("last_day"),
        ).select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("value"))
                        for c in ("first_day", "last_day")
                    ]
                )
            ).alias("e")
        )
        parts = parts.unionByName(days.select(F.lit("range").alias("section"), "e.name", "e.value"))
    return parts
