"""Exact duplicates by deterministic block naming.

A text, without its white space, is cut into blocks of a fixed number of bytes.
The distinct blocks are sorted and their positions are their integer names.
Adjacent names are then named pair by pair in the same way, until one name is
left: two texts have the same name and number of blocks exactly if they are equal.

A block travels once, to be compared with the others of its 64-bit hash.  Where a
hash stands for one block only, the hash alone finds the name of its places; where
several blocks share a hash, the places are compared by content.  So no collision
can join two texts, and a block that a third of all rows hold is combined before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.llm.common import SPACE, Scratch, range_count, text_of

BLOCK_BYTES = 4096


def _blocks(docs: DataFrame, block_bytes: int, hashed: Callable[[Column], Column]) -> DataFrame:
    plain = docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id",
        F.char_length("text").alias("_length"),
        F.regexp_replace("text", SPACE + "+", "").cast("binary").alias("_bytes"),
    )
    last = F.greatest(F.floor((F.octet_length("_bytes") - 1) / block_bytes), F.lit(0)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring("_bytes", i * block_bytes + 1, F.lit(block_bytes)),
    )
    placed = plain.select(
        "_row", "doc_id", "_length", F.sha2("_bytes", 256).alias("text_sha256"),
        (last + 1).alias("n_blocks"), F.posexplode(cut).alias("_place", "_block"),
    )
    return placed.withColumn("_hash", hashed(F.col("_block")))


def dense_names(keys: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """`name` 0, 1, 2 ... of distinct keys, in the order of a hash of the key and
    then the key.  Ranges of the hash are sorted each for itself."""
    keys = scratch.table(keys)
    bits = min(20, max(1, (range_count(keys.count()) - 1).bit_length()))
    ordered = keys.withColumn("_order", F.xxhash64(*columns))
    ordered = ordered.withColumn("_range", F.shiftright("_order", 64 - bits))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("_range").agg(F.count("*").alias("_n"))  # 2^20 rows at most
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy("_order", *columns)
    return (
        ordered.join(F.broadcast(starts), "_range")
        .select(*columns, (F.col("_start") + F.row_number().over(inside) - 1).alias("name"))
    )


def exact_identity(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, _length (code points of the
    original text), text_sha256, n_blocks, name.  Rows have equal (n_blocks, name)
    exactly if their texts are equal without white space.

    Null texts count as empty; empty texts have one empty block.  Repeated rows
    and doc_ids stay separate rows.  An empty table gives an empty result.
    `hashed` only groups blocks for comparison; any function gives right results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select("doc_id", text_of().alias("text"))
    blocks = _blocks(source, block_bytes, hashed)
    places = scratch.table(blocks.drop("_block"))
    distinct = blocks.select("_hash", "_block").distinct()
    counted = scratch.table(distinct.groupBy("_hash").agg(F.count("*").alias("_blocks")))
    single = counted.where("_blocks = 1").select("_hash", F.lit(0).alias("_tie"))
    shared = counted.where("_blocks > 1").select("_hash")
    if shared.isEmpty():
        names = dense_names(single, ["_hash", "_tie"], scratch)
        named = places.join(names.drop("_tie"), "_hash")
    else:
        within = Window.partitionBy("_hash").orderBy("_block")
        ties = scratch.table(
            distinct.join(shared, "_hash").withColumn("_tie", F.row_number().over(within))
        )
        keys = single.unionByName(ties.select("_hash", "_tie"))
        names = scratch.table(dense_names(keys, ["_hash", "_tie"], scratch))
        exact = ties.join(names, ["_hash", "_tie"]).select("_hash", "_block", "name")
        compared = (
            _blocks(source, block_bytes, hashed).join(exact, ["_hash", "_block"])
            .select("_row", "_place", "name")
        )
        apart = places.join(shared, "_hash", "left_semi").join(compared, ["_row", "_place"])
        alone = places.join(names.where("_tie = 0").drop("_tie"), "_hash")
        named = alone.unionByName(apart)
    named = scratch.table(named.drop("_hash"))
    about = named.where("_place = 0").drop("_place")
    single_block = about.where("n_blocks = 1")
    most = named.agg(F.max("n_blocks")).first()[0] or 1
    left = named.where("n_blocks > 1").select("_row", "n_blocks", "_place", "name")
    done, width = [], 1
    while width < most:
        width *= 2
        pairs = scratch.table(
            left.groupBy("_row", "n_blocks", F.expr("_place div 2").alias("_place")).agg(
                F.max(F.expr("if(_place % 2 = 0, name, null)")).alias("_left"),
                F.coalesce(F.max(F.expr("if(_place % 2 = 1, name, null)")), F.lit(-1)).alias("_right"),
            )
        )
        names = dense_names(pairs.select("_left", "_right").distinct(), ["_left", "_right"], scratch)
        joined = pairs.join(names, ["_left", "_right"]).drop("_left", "_right")
        left = scratch.table(joined)
        done.append(left.where(F.col("n_blocks") <= width).select("_row", "name"))
        left = left.where(F.col("n_blocks") > width)
    result = single_block
    if done:
        ends = done[0]
        for other in done[1:]:
            ends = ends.unionByName(other)
        result = result.unionByName(about.where("n_blocks > 1").drop("name").join(ends, "_row"))
    return result


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Decisions on every row: doc_id, keep_id, group_size, kept, text_sha256,
    n_blocks, name.  Of equal texts the row with the most code points stays, then
    the smallest doc_id (null last), then the first of repeated rows."""
    return _decided(exact_identity(docs, **options))


def _decided(rows: DataFrame) -> DataFrame:
    best = F.min(
        F.struct((-F.col("_length")).alias("l"), F.col("doc_id").isNull().alias("u"), "doc_id", "_row")
    )
    groups = rows.groupBy("n_blocks", "name").agg(
        best.alias("_best"), F.count("*").alias("group_size")
    )
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256", "n_blocks", "name",
        F.col("_row"),
    )


def without_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.  Rows that agree in
    doc_id and text are told apart by a number given to them before."""
    from verdigate.llm.common import unpacked, whole_rows

    rows = whole_rows(docs, scratch, docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    keyed = rows.select(F.struct("doc_id", "_row").alias("doc_id"), "text")
    kept = exact_duplicates(keyed).where("kept").select(F.col("doc_id._row").alias("_row"))
    return unpacked(rows.join(kept, "_row", "left_semi"), docs.columns)
