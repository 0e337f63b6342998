"""Near copies by the Jaccard similarity of their word shingles, for the corpus pipeline.

Two documents are near copies if their sets of 5-word shingles have a similarity of 0.8 or
more, and a group holds all that is joined by way of others.  At 0.8 a SimHash bit differs
with probability 0.15, so fingerprints of near copies share few bytes and an index that
finds them holds many of all pairs.  The fingerprint here is longer: 25 positional names,
each of the smallest shingles under four orders.  A pair meets in the list of a name with
probability 0.8^4, and misses all lists with (1 - 0.8^4)^25, 2 in a million; above 0.8
with less.  Whatever meets is verified by the exact similarity.

Pairs of a list are not all compared.  First each member is held against the smallest of
its list.  Lists whose members are then in one group are done.  Of the others, short lists
are compared pair by pair, long ones in blocks, pairs of blocks to a task, which return
a spanning forest and not every pair.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.llm import simhash
from verdigate.llm.common import Scratch, components, lower_ascii, small_batches, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(simhash)

SHINGLE = 5
SIMILARITY = 0.8
LISTS, VALUES = 25, 4
#: Members of a list that is compared pair by pair, at most, and of a block of a longer one.
SHORT, BLOCK = 32, 1000

_random = np.random.default_rng(9)
_FLIPS = _random.integers(0, 2**63, LISTS * VALUES, dtype=np.uint64)
_FACTORS = _random.integers(1, 2**63, LISTS * VALUES, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes, ascending; none for a text without words."""
    words = lower_ascii(text).split()
    step = simhash.WORDS_AT_ONCE
    found = [
        np.unique(simhash.shingle_hashes(words[at : at + step + shingle - 1], shingle))
        for at in range(0, max(1, len(words) - shingle + 1), step)
    ]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def names(hashes: np.ndarray) -> list[int]:
    """Of a set, its name in each list, as signed 64-bit numbers; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(LISTS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1000):
        least = np.minimum(least, ((hashes[at : at + 1000, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    made = [xxhash.xxh64_intdigest(v.tobytes(), i) for i, v in enumerate(least.reshape(LISTS, VALUES))]
    return np.array(made, np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets; 1 if both are empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def forest(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs with that similarity or more that join all sets which such pairs join."""
    sizes = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(column, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(column))])
    left = np.ones(len(sets), bool)
    links = []
    for root in range(len(sets)):
        reached = [root] if left[root] else []
        left[root] = False
        while reached:
            x = reached.pop()
            own = [owner[first[c] : first[c + 1]] for c in column[begin[x] : begin[x + 1]]]
            if not own:
                continue
            common = np.bincount(np.concatenate(own), minlength=len(sets))
            near = np.nonzero(left & (common / (sizes + sizes[x] - common) >= least))[0]
            left[near] = False
            links += [(x, int(y)) for y in near]
            reached += near.tolist()
    return links


def identity(hashes: np.ndarray) -> str:
    """128 bits that stand for a set: at 10^10 documents a chance of 10^-19 that two share one."""
    return xxhash.xxh3_128_hexdigest(hashes.tobytes())


def with_names(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns but `text`, and `node`, the identity of the shingle set, and its names `lists`."""
    small_batches(rows.sparkSession)
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(at)]
            kept = batch.remove_column(at)
            found = [pa.array(map(identity, sets), pa.string()), pa.array(map(names, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *found], names=[*kept.schema.names, "node", "lists"])

    fields = [f for f in rows.schema.fields if f.name != "text"]
    added = [T.StructField("node", T.StringType()), T.StructField("lists", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([*fields, *added]))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of pairs (a, b) those whose texts have the similarity; texts has node and text."""
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            near = [
                similarity(shingle_set(x.as_py(), shingle), shingle_set(y.as_py(), shingle)) >= least
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"
    )
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a string, b string")


def forests(lists: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links inside lists (name, node, members), block against block."""
    blocks = F.ceil(F.col("members") / BLOCK)
    cut = lists.withColumn("_own", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    )
    dealt = cut.select("name", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        found = np.array(forest([shingle_set(t, shingle) for t in rows["text"]], least), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    return dealt.join(texts, "node").groupBy("name", "i", "j").applyInPandas(run, "a string, b string")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Written pairs (node, fp) -> candidate pairs of nodes (a > b) that operator 9 links:
    equal fingerprints, and those at two or fewer differing bits."""
    heads = prints.groupBy("fp").agg(F.min("node").alias("head"))
    same = prints.join(heads, "fp").select(F.col("node").alias("a"), F.col("head").alias("b"))
    of = [heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")) for side in ("a", "b")]
    near = simhash.near_links(heads.select("fp")).join(of[0], "a").join(of[1], "b").select("head_a", "head_b")
    both = same.unionByName(near.toDF("a", "b"))
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def groups(rows: DataFrame, text: str, scratch: Scratch, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Written rows (_row, node, lists, fp, and the text at `text`) -> node, root of each node
    that has near copies."""
    nodes = scratch.table(rows.groupBy("node").agg(F.min("_row").alias("_row"), F.first("lists").alias("lists")))
    posted = nodes.select("node", F.explode("lists").alias("name"))
    of_list = Window.partitionBy("name")
    met = scratch.table(
        posted.withColumn("members", F.count("*").over(of_list)).withColumn("low", F.min("node").over(of_list))
        .where("members > 1")
    )
    hashed = scratch.table(fingerprint_links(scratch.table(rows.select("node", "fp").distinct())))
    some = met.select("node").unionByName(hashed.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(nodes.select("node", "_row"), "node")
    texts = some.join(rows.select("_row", F.col(text).alias("text")), "_row").select("node", "text")
    of_lists = met.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    stars = scratch.table(of_lists.unionByName(hashed).distinct())
    links = scratch.table(verified(stars, texts, shingle, least))
    roots = components(links)
    placed = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parted = scratch.table(
        placed.withColumn("_apart", F.min("root").over(of_list) < F.max("root").over(of_list)).where("_apart")
        .select("name", "node", "root", "members")
    )
    short = parted.where(F.col("members") <= SHORT)
    other = short.select("name", F.col("node").alias("b"), F.col("root").alias("_root"))
    pairs = short.withColumnRenamed("node", "a").join(other, "name").where("a > b and root <> _root").select("a", "b")
    pairs = scratch.table(pairs.distinct().join(stars, ["a", "b"], "left_anti"))
    more = verified(pairs, texts, shingle, least)
    long = forests(parted.where(F.col("members") > SHORT), texts, shingle, least)
    return components(scratch.table(links.unionByName(more).unionByName(long)))


def one_of_each_group(
    docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, least: float = SIMILARITY
) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies, with all its columns;
    of repeated rows the first, and null doc_ids last.  Texts without words are alike."""
    packed = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    marked = docs.select(
        F.monotonically_increasing_id().alias("_row"), docs["doc_id"].alias("doc_id"),
        packed.alias("_doc"), docs["text"].alias("text"),
    )
    rows = scratch.table(with_names(simhash.with_fingerprint(marked), shingle))
    found = groups(rows, f"_doc.c{docs.columns.index('text')}", scratch, shingle, least)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")
    kept = (
        rows.select("_row", "doc_id", "node").join(found, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("k"))
    )
    return unpacked(
        rows.join(kept.select(F.col("k._row").alias("_row")), "_row", "left_semi"), docs.columns
    )
