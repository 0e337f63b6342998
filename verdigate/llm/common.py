"""Small pieces the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigate.operators.distributed import shared_folder

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one sorted range may hold, on average.
RANGE_ROWS = 50_000


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, so that very long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; `bytes.split()` then cuts at exactly the
    six white-space characters the word pattern excludes."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Scratch:
    """Tables in the shared folder that cut the lineage, deleted when no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def folder(self) -> str:
        """A new place in the shared folder."""
        path = f"{shared_folder(self.spark)}/llm-{uuid.uuid4().hex}"
        self.paths.append(path)
        return path

    def table(self, df: DataFrame) -> DataFrame:
        """Write `df` once and read it back; later plans start from the files."""
        path = self.folder()
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete the tables but for the `keep` newest."""
        cut = len(self.paths) - keep
        for path in self.paths[:cut]:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        self.paths = self.paths[cut:]


def numbered(docs: DataFrame, scratch: Scratch, *columns: Column) -> DataFrame:
    """`columns` of each row and a row number `_row`, written down, so that
    repeated rows stay apart and the number never changes."""
    return scratch.table(docs.select(F.monotonically_increasing_id().alias("_row"), *columns))


def whole_rows(docs: DataFrame, scratch: Scratch, *columns: Column) -> DataFrame:
    """Every column of each row inside the struct `_doc`, next to `_row` and `columns`."""
    packed = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return numbered(docs, scratch, packed.alias("_doc"), *columns)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(columns)])


def range_count(rows: int) -> int:
    return max(1, -(-rows // RANGE_ROWS))


def offsets_before(df: DataFrame, groups: list[str], part: str, amount: Column) -> DataFrame:
    """Per group and range: the sum of `amount` over all earlier ranges.  The ranges of a
    group are few, because each holds about RANGE_ROWS rows."""
    sums = df.groupBy(*groups, part).agg(amount.alias("_amount"))
    earlier = (
        Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    )
    return sums.select(
        *groups, part, F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_before")
    )


def gapless(
    df: DataFrame, groups: list[str], order: list[str], rows: int, name: str
) -> DataFrame:
    """Position from 0 inside each group, in the order of a hash and then `order`.

    A group is cut into hash ranges that are sorted alone and shifted by the
    sizes of the ranges before them, so no task sorts a whole group.
    """
    parts = range_count(rows)
    cut = df.withColumn("_hash", F.xxhash64(*order)).withColumn(
        "_part", F.pmod(F.shiftright("_hash", 16), F.lit(parts))
    )
    inside = Window.partitionBy(*groups, "_part").orderBy("_hash", *order)
    return (
        cut.join(offsets_before(cut, groups, "_part", F.count("*")), [*groups, "_part"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_hash", "_part", "_before")
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, root).

    Alternating large and small stars: each round hangs a node's larger
    neighbours below the smallest one it knows, and then the node itself.  Every
    round writes its edges; the rounds end when the edges no longer change.
    """
    scratch = Scratch(edges.sparkSession)
    current = scratch.table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        both = current.select("a", "b").unionByName(
            current.select(F.col("b").alias("a"), F.col("a").alias("b"))
        )
        lows = both.groupBy("a").agg(F.min("b").alias("low"))
        lows = lows.select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = scratch.table(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b")))
        current = scratch.table(small.where("a <> b").distinct())
        scratch.drop(keep=1)
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
