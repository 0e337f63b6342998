"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Every document draws an exponential key divided by its quality weight; the smallest
keys come first, which is weighted sampling without replacement.  A source takes
complete epochs first; the rest of its target is filled in key order, by a prefix
sum over key ranges, so no source is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.llm.common import RANGE_ROWS, Scratch, numbered, offsets_before, text_of, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
GOOD, UNRATED, POOR = 2.0, 1.0, 0.5


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for good, 0.5 for poor documents; those without a label
    weigh 1 later.  Of several labels the best counts; null labels count as none."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("q")
    )
    return best.select("doc_id", F.when(F.col("q") > 0, GOOD).otherwise(POOR).alias("weight"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """(source, source_size, rows) -> the same with `target`.  Sources sorted by code
    point, null last, weigh `weights` in turn.  Together they get `share` of all
    sizes; a target stops at `cap` times the source's size and what is above goes
    to the others by weight.  One row per source, so one sorted pass is enough."""
    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sizes.withColumn("_w", F.get(in_turn, F.pmod(number, F.lit(len(weights)))))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    full_first = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    earlier = full_first.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    level = weighed.withColumn("_level", left / weight_left)
    level = level.withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
    level = level.withColumn(
        "_final", F.max(F.when(F.col("_open"), F.struct(-F.col("_cap") / F.col("_w"), "_level"))).over(everything)["_level"]
    )
    return level.select(
        "source", "source_size", "rows",
        F.when(F.col("_final").isNull(), F.col("_cap"))
        .otherwise(F.least("_cap", F.col("_final") * F.col("_w"))).alias("target"),
    )


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of seed and key."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(
    rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """Decide on numbered rows (_row, doc_id, source, size, weight), which must be a
    written table: adds source_size, target, taken and copies.

    `taken` is size times `copies`: the complete epochs, and one more where the middle
    of the document lies within what is left of the target.  Sizes of 0 take nothing;
    null sources form one source; repeated rows are decided one by one; rows that
    agree in doc_id share their draw and go by size.  An empty table gives no rows.
    """
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows")
    )
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "_source")
    drawn = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_key", -F.log(uniform(seed, F.col("doc_id"))) / F.col("weight")
    )
    parts = F.ceil(F.col("rows") / RANGE_ROWS)
    drawn = drawn.withColumn(
        "_part", F.least(F.floor((1 - F.exp(-F.col("_key"))) * parts), parts - 1)
    )
    drawn = drawn.withColumn("_group", F.coalesce("source", F.lit("")))
    drawn = drawn.withColumn("_none", F.col("source").isNull())
    groups = ["_group", "_none"]
    starts = offsets_before(drawn, groups, "_part", F.sum("size"))
    inside = Window.partitionBy(*groups, "_part").orderBy(
        "_key", F.col("doc_id").isNull(), "doc_id", "size", "_row"
    ).rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = (
        drawn.join(starts, [*groups, "_part"])
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("_epochs", epochs)
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    )
    more = (F.col("size") > 0) & (F.col("_start") + F.col("size") / 2 <= F.col("_rest"))
    copies = (F.when(F.col("size") > 0, F.col("_epochs")).otherwise(0) + more.cast("int")).cast("bigint")
    return placed.withColumn("copies", copies).select(
        "_row", "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


def sized(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Numbered narrow rows for `mix`, from documents and quality labels."""
    rows = numbered(
        docs, scratch, docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
        word_count(text_of()).alias("size"),
    )
    return scratch.table(
        rows.join(quality_weights(labels), "doc_id", "left").withColumn(
            "weight", F.coalesce("weight", F.lit(UNRATED))
        )
    )


def mixed_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    from verdigate.llm.common import unpacked, whole_rows

    whole = whole_rows(
        docs, scratch, docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
        word_count(text_of()).alias("size"),
    )
    rows = scratch.table(
        whole.drop("_doc").join(quality_weights(labels), "doc_id", "left")
        .withColumn("weight", F.coalesce("weight", F.lit(UNRATED)))
    )
    taken = mix(rows).where("copies > 0").select("_row", "copies")
    repeated = whole.join(taken, "_row").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    )
    return unpacked(repeated, docs.columns)
