"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints with at most two
differing bits differ in at most two of them, so they share at least six: that is the
count a pair must reach.  A tally over single bytes would walk lists that hold 1/256 of
all fingerprints each and grow with the square of the corpus.  The index therefore posts
the 28 ways to choose six positional bytes: a pair is in a common list exactly if its
tally is six or more.  A list holds fingerprints that differ in two known bytes only, at
most 65,536 of them.

Pairs are verified without writing them out.  Two fingerprints have at most two
differing bits exactly if some 64-bit number has at most one bit different from each;
the members of a list meet at these midpoints, and each midpoint links its fingerprints
(65 at most, every two of them near) to the smallest.  A group of k near copies thus
gives some multiple of k links, not k squared.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.llm.common import Scratch, components, lower_ascii, small_batches, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
SEED = 42
BITS = 2
BYTES = 8
#: Words hashed at a time, so that a very long text needs little memory.
WORDS_AT_ONCE = 200_000


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `shingle` words, repeats included; of all the words, if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = map(slice, starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())
    digests = b"".join(map(xxhash.xxh64_digest, map(joined.__getitem__, cuts), itertools.repeat(seed)))
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For runs of hashes that begin at `starts` (none empty): how often each bit is set.

    Eight bits at a time are added inside the bytes of a word, in runs of at most
    255, which cannot overflow.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    pieces = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    inside = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + 255 * inside
    out = np.empty((len(starts), 64), np.int64)
    ones = np.uint64(0x0101010101010101)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & ones, cuts)
        out[:, k::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
    return out


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit numbers; 0 for a text without words."""
    counts = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    kept: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def add_up() -> None:
        if kept:
            starts = np.concatenate([[0], np.cumsum([len(h) for h in kept])[:-1]])
            np.add.at(counts, owners, bit_counts(np.concatenate(kept), starts))
            kept.clear()
            owners.clear()

    for i, text in enumerate(texts):
        words = lower_ascii(text).split()
        for at in range(0, max(1, len(words) - shingle + 1), WORDS_AT_ONCE):
            hashes = shingle_hashes(words[at : at + WORDS_AT_ONCE + shingle - 1], shingle, seed)
            if len(hashes):
                kept.append(hashes)
                owners.append(i)
                totals[i] += len(hashes)
                held += len(hashes)
        if held > 500_000:
            add_up()
            held = 0
    add_up()
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    return ((2 * counts > totals[:, None]) * weights).sum(axis=1, dtype=np.uint64)


def with_fingerprint(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """All rows of `docs` and their fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column(at).to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found)], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def byte_lists() -> list[tuple[int, int, int]]:
    """The 28 lists: the mask of six positional bytes and the two bytes left out."""
    full = (1 << 64) - 1
    lists = []
    for a, b in itertools.combinations(range(BYTES), BYTES - (BYTES - BITS)):
        mask = full ^ (0xFF << 8 * a) ^ (0xFF << 8 * b)
        lists.append((mask - (1 << 64) if mask >> 63 else mask, a, b))
    return lists


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join exactly the ones with at
    most two differing bits, by way of others of such."""
    lists = byte_lists()
    posted = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask)) for mask, _, _ in lists]))
        .alias("list", "shared"),
    )
    reached = Window.partitionBy("list", "shared")
    met = posted.withColumn("_members", F.count("*").over(reached)).where("_members > 1")
    left_out = F.array(*[F.array(F.lit(a), F.lit(b)) for _, a, b in lists])
    bits = F.flatten(
        F.transform(
            F.get(left_out, F.col("list")),
            lambda byte: F.transform(
                F.sequence(F.lit(0), F.lit(7)), lambda bit: F.call_function("shiftleft", F.lit(1).cast("bigint"), byte * 8 + bit)
            ),
        )
    )
    midpoints = F.transform(
        F.concat(F.array(F.lit(0).cast("bigint")), bits), lambda flip: F.col("fp").bitwiseXOR(flip)
    )
    at_midpoint = met.select("fp", F.explode(midpoints).alias("midpoint")).distinct()
    smallest = F.min("fp").over(Window.partitionBy("midpoint"))
    linked = at_midpoint.select(F.col("fp").alias("a"), smallest.alias("b")).where("a <> b").distinct()
    return linked.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)


def group_fingerprints(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, fp), a written table -> one row per fingerprint: fp, component_id
    (smallest doc_id reachable over near links; null doc_ids count only if alone)."""
    scratch = Scratch(rows.sparkSession)
    distinct = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(distinct)).withColumnRenamed("node", "fp")
    joined = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return joined.join(smallest, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits),
    component_id.

    Null and empty texts and those of white space have fingerprint zero, linked like
    any other.  Repeated rows each get a row.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(with_fingerprint(docs.select("doc_id", "text")).drop("text"))
    found = group_fingerprints(rows)
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The row with the smallest doc_id of each near-duplicate group, with all its
    columns; of repeated rows the first, and null doc_ids last."""
    packed = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    marked = with_fingerprint(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), docs["doc_id"].alias("doc_id"),
            packed.alias("_doc"), docs["text"].alias("text"),
        )
    )
    rows = scratch.table(marked.drop("text"))
    narrow = rows.select("_row", "doc_id", "fp")
    found = group_fingerprints(narrow)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")
    kept = narrow.join(found, "fp").groupBy("root").agg(F.min(order).alias("k"))
    return unpacked(
        rows.join(kept.select(F.col("k._row").alias("_row")), "_row", "left_semi"), docs.columns
    )
