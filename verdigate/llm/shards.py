"""Sharding by a k-d tree over document metadata.

A node is split at a weighted median (for an odd number of leaves: at the matching
share) along the metadata dimension in which it is widest, until every leaf holds the
target bytes.  All nodes of a level are split together.  A median is found by
narrowing a histogram of the dimension, 32,768 cells at a time, so the driver sees one
boundary per node and no task holds a node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.llm.common import Scratch, gapless, numbered, text_of

SHARDS = 24
ROW_BYTES = 8
DIMENSIONS = ("size", "source", "lang", "doc_id")
#: A key has 24 bits of the dimension and 36 of a hash that breaks ties.
DIMENSION_BITS, HASH_BITS, CELL_BITS = 24, 36, 15
#: Narrowing ends when the cell at the boundary holds this share of a leaf.
TOLERANCE = 0.001


@dataclass(frozen=True)
class Split:
    node: int
    dimension: int
    key: int  # rows with a smaller key go left


def _scaled(value: Column, low: Column, high: Column) -> Column:
    top = float((1 << DIMENSION_BITS) - 1)
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    return F.floor(share * top).cast("bigint")


def coordinates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Narrow rows: _row, doc_id, size, text_crc32 and a key per dimension.  Names are placed
    by their crc32, sizes by their logarithm; null names and ids by 0.  Equal texts share
    the hash that breaks ties, but splits on source, lang or doc_id can part them."""
    text = text_of()
    rows = numbered(
        docs, scratch, docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
        docs["lang"].alias("lang"), F.octet_length(text).cast("bigint").alias("_bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
    )
    size = F.col("_bytes") + ROW_BYTES
    named = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")), F.lit(0)).cast("double")
    raw = {
        "size": F.log2(size.cast("double")), "source": named("source"), "lang": named("lang"),
        "doc_id": F.coalesce(F.col("doc_id"), F.lit(0)).cast("double"),
    }
    wide = rows.select(
        "_row", "doc_id", size.alias("size"), "text_crc32", "_hash",
        *[raw[d].alias(f"_d{i}") for i, d in enumerate(DIMENSIONS)],
    )
    n = range(len(DIMENSIONS))
    ends = wide.agg(*[f(f"_d{i}").alias(f"{f.__name__}{i}") for i in n for f in (F.min, F.max)]).first()
    tie = F.shiftrightunsigned(F.xxhash64("_hash", "doc_id", "_row"), 64 - HASH_BITS // 2) + F.shiftleft(
        F.shiftrightunsigned("_hash", 64 - HASH_BITS // 2), HASH_BITS // 2
    )
    keys = [
        F.shiftleft(_scaled(F.col(f"_d{i}"), F.lit(ends[f"min{i}"]), F.lit(ends[f"max{i}"])), HASH_BITS) + tie
        for i in n
    ]
    return scratch.table(
        wide.select("_row", "doc_id", "size", "text_crc32", *[k.alias(f"_k{i}") for i, k in zip(n, keys)])
    )


def node_of(splits: list[Split]) -> Column:
    """The node a row has reached; children of node i are 2i and 2i + 1.  Each node that
    is not split is one branch, with the sides of all splits above it."""
    split_at = {s.node: s for s in splits}
    reached: Column | None = None
    todo: list[tuple[int, Column]] = [(1, F.lit(True))]
    while todo:
        node, path = todo.pop()
        if node in split_at:
            s = split_at[node]
            left = F.col(f"_k{s.dimension}") < s.key
            todo += [(2 * node, path & left), (2 * node + 1, path & ~left)]
        else:
            reached = F.when(path, node) if reached is None else reached.when(path, node)
    return reached


def _boundaries(rows: DataFrame, wanted: dict[int, tuple[int, float]], tolerance: float) -> dict[int, int]:
    """Per node (dimension, bytes that go left): the smallest key that goes right."""
    total_bits = DIMENSION_BITS + HASH_BITS
    low = {node: 0 for node in wanted}
    open_nodes = dict(wanted)
    found: dict[int, int] = {}
    for shift in range(total_bits - CELL_BITS, -1, -CELL_BITS):
        node = F.col("_node")
        key = prefix = goal = None
        for n, (dimension, left) in open_nodes.items():
            column, base, want = F.col(f"_k{dimension}"), F.lit(low[n]).cast("bigint"), F.lit(float(left))
            key = F.when(node == n, column) if key is None else key.when(node == n, column)
            prefix = F.when(node == n, base) if prefix is None else prefix.when(node == n, base)
            goal = F.when(node == n, want) if goal is None else goal.when(node == n, want)
        keyed = rows.select("_node", "size", key.alias("_key"), prefix.alias("_low")).where("_key is not null")
        cell = F.when(F.col("_key") < F.col("_low"), -1).otherwise(
            F.least(F.shiftright(F.col("_key") - F.col("_low"), shift), F.lit(1 << CELL_BITS))
        )
        cells = keyed.groupBy("_node", cell.alias("_cell")).agg(F.sum("size").alias("_s"))
        up_to = Window.partitionBy("_node").orderBy("_cell")
        run = cells.withColumn("_end", F.sum("_s").over(up_to)).withColumn("_goal", goal)
        first = (
            run.where("_end >= _goal").groupBy("_node").agg(F.min(F.struct("_cell", "_end", "_s")).alias("c")).collect()
        )
        for r in first:
            n, at = r["_node"], r["c"]
            start = low[n] + (max(at["_cell"], 0) << shift)
            before = at["_end"] - at["_s"]
            if shift == 0 or at["_s"] <= tolerance or at["_cell"] < 0 or at["_cell"] >= 1 << CELL_BITS:
                nearer_end = abs(at["_end"] - open_nodes[n][1]) < abs(before - open_nodes[n][1])
                found[n] = start + (1 << shift if nearer_end else 0)
                del open_nodes[n]
            else:
                low[n] = start
        if not open_nodes:
            break
    return found


def tree(rows: DataFrame, shards: int, total: int) -> tuple[list[Split], dict[int, int]]:
    """The splits, and the shard of each leaf."""
    n = len(DIMENSIONS)
    leaves = {1: shards}
    splits: list[Split] = []
    done: dict[int, int] = {}
    while leaves:
        done |= {node: many for node, many in leaves.items() if many == 1}
        leaves = {node: many for node, many in leaves.items() if many > 1}
        if not leaves:
            break
        placed = rows.withColumn("_node", node_of(splits))
        reach = [f(F.shiftright(f"_k{i}", HASH_BITS)).alias(f"{f.__name__}{i}") for i in range(n) for f in (F.min, F.max)]
        nodes = placed.groupBy("_node").agg(F.sum("size").alias("s"), *reach).collect()
        wanted, sizes = {}, {}
        for r in nodes:
            if r["_node"] in leaves:
                widths = [r[f"max{i}"] - r[f"min{i}"] for i in range(n)]
                left = leaves[r["_node"]] // 2
                wanted[r["_node"]] = (widths.index(max(widths)), r["s"] * left / leaves[r["_node"]])
                sizes[r["_node"]] = r["s"]
        keys = _boundaries(placed, wanted, TOLERANCE * total / shards) if wanted else {}
        below: dict[int, int] = {}
        for node, many in leaves.items():
            # A node without rows is split all the same, so that every shard has its place.
            dimension = wanted[node][0] if node in wanted else 0
            splits.append(Split(node, dimension, keys.get(node, 0)))
            below[2 * node], below[2 * node + 1] = many // 2, many - many // 2
        leaves = below
    return splits, {node: i for i, node in enumerate(sorted(done))}


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law ('bytes'), shard, slot, grown_shard
    (null), for every row of `docs` (doc_id, text, lang, source).

    Shards hold nearly the same bytes, as near as single documents allow: a boundary lies
    within TOLERANCE of a shard.  Slots run from 0 without gaps.  Null texts have no
    bytes, null names their own place; repeated rows are placed one by one; a hot source
    or many equal texts are cut by the hash of the key.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = coordinates(docs, scratch)
    whole = rows.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    splits, leaf = tree(rows, shards, whole["s"] or 0) if whole["n"] else ([], {1: 0})
    names = F.create_map(*[F.lit(x) for pair in leaf.items() for x in pair])
    placed = rows.select(
        "_row", "doc_id", "size", "text_crc32", F.element_at(names, node_of(splits)).alias("shard")
    )
    numbered_rows = gapless(scratch.table(placed), ["shard"], ["doc_id", "_row"], whole["n"], "slot")
    return numbered_rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
