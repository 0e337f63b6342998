"""Row routing as a stream: files that arrive are appended to their split folder.

The batch router copies rows by split and test-cluster half.  Here the same rule runs
on a file stream, so partition files can be extended while new input arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def destinations(rows: DataFrame, halves: DataFrame, cluster: str,
                 keep: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Destination of each row from its split or its cluster's half (stream-static)."""
    joined = rows.join(halves, cluster, "left")
    own = F.when(F.col("split").isin(*keep), F.col("split")).when(
        F.col("split") == "test", F.col("destination")
    )
    return joined.withColumn("destination", own).filter(F.col("destination").isNotNull())


def start_router(
    spark: SparkSession, source: str, schema: StructType, halves: DataFrame, target: str,
    checkpoint: str, cluster: str = "event_cluster_id",
) -> StreamingQuery:
    """Route CSV files of a folder; the checkpoint makes each file count once."""
    rows = spark.readStream.schema(schema).option("header", True).csv(source)
    return (
        destinations(rows, halves, cluster)
        .writeStream.format("parquet")
        .partitionBy("destination")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
