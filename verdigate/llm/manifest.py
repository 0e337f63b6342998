"""Merkle manifest of a dataset, folded from copied hash states.

Every row is a leaf.  The leaves of a language, in the order of their ids, are hashed
run by run until one subroot is left; the subroots, in the order of the languages, give
the root.  A parent keeps a copy of its SHA-256 state from before each child slot.  To
fold a changed child in, the parent resumes the state of that slot and adds the new
digest and the siblings on its right; what lies on the left is never hashed again.

A tree is cut into blocks of at most 4,096 nodes, aligned to whole subtrees.  A task
builds the subtree of a block; the tops of the blocks are the nodes of the next round.
So a language that holds a third of all rows is spread over its blocks, and the rounds
number log(rows) / log(4,096).  On the way down each node gets its path: per level the
digests on its left and right.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.llm.common import Scratch, offsets_before, range_count

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Children of a parent, and nodes of a block at most.
FANOUT = 2
BLOCK = 4096

#: A path is text: per level `left|right`, the levels joined by commas.
PATHS = "tree bigint, pos bigint, path string, subroot string"


class Parent:
    """A hashed run of children, with the state before each child."""

    def __init__(self, children: list[str]):
        self.children = children
        self.states = []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def left(self, slot: int) -> str:
        return "".join(self.children[:slot])

    def right(self, slot: int) -> str:
        return "".join(self.children[slot + 1 :])

    def resumed(self, slot: int, child: str) -> str:
        """The digest with another child in the slot."""
        return resume(self.states[slot], child, self.right(slot))


def resume(state, child: str, right: str) -> str:
    state = state.copy()
    state.update((child + right).encode())
    return state.hexdigest()


class Subtree:
    """The parents above the nodes of one block, level by level."""

    def __init__(self, nodes: list[str], fanout: int, depth: int | None):
        """`depth` levels, or None: until one node remains."""
        self.fanout = fanout
        self.levels: list[list[Parent]] = []
        while len(nodes) > 1 if depth is None else len(self.levels) < depth:
            parents = [Parent(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
            self.levels.append(parents)
            nodes = [p.digest for p in parents]
        self.top = nodes[0]

    def way(self, leaf: int) -> Iterator[tuple[Parent, int]]:
        """(parent, slot) from the leaf up."""
        for parents in self.levels:
            leaf, slot = divmod(leaf, self.fanout)
            yield parents[leaf], slot


def block_depth(fanout: int) -> tuple[int, int]:
    """Levels of a whole block and its size: the largest power of the fanout that fits."""
    depth = 1
    while fanout ** (depth + 1) <= BLOCK:
        depth += 1
    return depth, fanout**depth


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def ordered(df: DataFrame, order: list[str], rows: int, scratch: Scratch) -> DataFrame:
    """`_pos`, from 0, in the total order of `order`.  Ranges are sorted alone."""
    ranged = df.repartitionByRange(range_count(rows), *order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.table(ranged.withColumn("_all", F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(*order)
    before = offsets_before(ranged, ["_all"], "_part", F.count("*"))
    return (
        ranged.join(before, ["_all", "_part"])
        .withColumn("_pos", (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_all", "_part", "_before")
    )


def _digests(rows: pd.DataFrame) -> list[str]:
    return rows["digest"].tolist()


def _climb(nodes: DataFrame, fanout: int, scratch: Scratch) -> list[DataFrame]:
    """Nodes (tree, pos, size, digest) -> the tables of nodes round by round, until each
    tree has one node."""
    depth, block = block_depth(fanout)

    def tops(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        tree = Subtree(_digests(rows), fanout, depth if size > block else None)
        return pd.DataFrame({
            "tree": rows["tree"].iloc[:1], "pos": rows["pos"].iloc[:1] // block,
            "size": [-(-size // block)], "digest": [tree.top],
        })

    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
        grouped = rounds[-1].groupBy("tree", F.floor(F.col("pos") / block).alias("block"))
        rounds.append(scratch.table(
            grouped.applyInPandas(tops, "tree bigint, pos bigint, size bigint, digest string")
        ))
    return rounds


def _with_paths(nodes: DataFrame, paths: DataFrame, fanout: int, visit, schema: str) -> DataFrame:
    """Each block of `nodes` beside the path of its top (tree, pos, path); `visit` makes the rows."""
    depth, block = block_depth(fanout)

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        tree = Subtree(_digests(rows), fanout, depth if size > block else None)
        path = above["path"].iloc[0]
        made = visit(rows, tree, [tuple(s.split("|")) for s in path.split(",")] if path else [])
        return made.assign(tree=rows["tree"], subroot=above["subroot"].iloc[0])

    tops = paths.select("tree", F.col("pos").alias("block"), "path", "subroot")
    return (
        nodes.withColumn("block", F.floor(F.col("pos") / block)).groupBy("tree", "block")
        .cogroup(tops.groupBy("tree", "block")).applyInPandas(run, schema)
    )


def _paths_of(rows: pd.DataFrame, tree: Subtree, above: list[tuple[str, str]]) -> pd.DataFrame:
    upper = ["|".join(level) for level in above]
    path = [
        ",".join([f"{p.left(s)}|{p.right(s)}" for p, s in tree.way(i)] + upper) for i in range(len(rows))
    ]
    return pd.DataFrame({"pos": rows["pos"], "path": path})


def _descend(rounds: list[DataFrame], tops: DataFrame, fanout: int, scratch: Scratch) -> DataFrame:
    """Paths of the nodes of the second round, from those of the last one."""
    paths = tops
    for nodes in reversed(rounds[1:-1]):
        paths = scratch.table(_with_paths(nodes, paths, fanout, _paths_of, PATHS))
    return paths


def _folds(rows: pd.DataFrame, tree: Subtree, above: list[tuple[str, str]]) -> pd.DataFrame:
    """Proof and folded root of each leaf.  States above the block are made once for the block."""
    states, rights, upper = [], [], []
    for left, right in above:
        state = hashlib.sha256()
        state.update(left.encode())
        states.append(state)
        rights.append(right)
        upper.append(left + right)
    tail = "".join(upper)
    proofs, folded = [], []
    for i, changed in enumerate(rows["changed"]):
        way = list(tree.way(i))
        proof = "".join(p.left(s) + p.right(s) for p, s in way) + tail
        proofs.append(hashlib.sha256(proof.encode()).hexdigest())
        for parent, slot in way:
            changed = parent.resumed(slot, changed)
        for state, right in zip(states, rights):
            changed = resume(state, changed, right)
        folded.append(changed)
    return pd.DataFrame({
        "doc_id": rows["doc_id"], "leaf": rows["digest"], "proof_sha256": proofs, "folded_root": folded,
    })


def tampered(doc_id: Column, n_chars: Column) -> Column:
    """What the check changes: one more character where 7 divides the id's crc32."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    return F.when(F.coalesce(hit, F.lit(False)), n_chars + 1).otherwise(n_chars)


def merkle_manifest(docs: DataFrame, scratch: Scratch, fanout: int = FANOUT, change=tampered) -> DataFrame:
    """One row per row of `docs` (doc_id, source, lang, n_chars, text): doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified.

    `change` gives the n_chars that each leaf is folded with.  Null fields are hashed
    as `-`; rows of a null lang form a tree of their own, before all others.  Null
    doc_ids come first in their tree and are never tampered with.  Rows that share a
    doc_id are ordered by their digests; equal rows stay separate leaves.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    altered = [*fields[:3], change(docs["doc_id"], docs["n_chars"]), docs["text"]]
    leaves = scratch.table(docs.select(
        F.monotonically_increasing_id().alias("_row"), docs["doc_id"].cast("bigint").alias("doc_id"),
        docs["lang"].alias("lang"), leaf_digest(*fields).alias("digest"), leaf_digest(*altered).alias("changed"),
    ))
    placed = scratch.table(ordered(leaves, ["lang", "doc_id", "digest", "_row"], leaves.count(), scratch))
    langs = placed.groupBy("lang").agg(F.min("_pos").alias("first"), F.count("*").alias("size"))
    langs = scratch.table(langs)
    n_langs = langs.count()
    trees = scratch.table(ordered(langs, ["lang"], n_langs, scratch).withColumnRenamed("_pos", "tree"))
    about = trees.select(F.col("lang").alias("_lang"), "first", "size", "tree")
    rows = scratch.table(
        placed.join(about, F.col("lang").eqNullSafe(F.col("_lang")))
        .select("tree", (F.col("_pos") - F.col("first")).alias("pos"), "size", "digest", "changed", F.col("doc_id").cast("string").alias("doc_id"))
    )
    rounds = _climb(rows.select("tree", "pos", "size", "digest"), fanout, scratch)
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    upper = _climb(
        subroots.select(
            F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"),
            F.lit(n_langs).cast("bigint").alias("size"), F.col("subroot").alias("digest"),
        ), fanout, scratch,
    )
    root = upper[-1].agg(F.max("digest")).first()[0]
    summit = upper[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"))
    above = _descend([upper[0], *upper], summit, fanout, scratch)
    above = above.select(F.col("pos").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path")
    paths = _descend(rounds, scratch.table(above.join(subroots, "tree")), fanout, scratch)
    schema = "doc_id string, tree bigint, leaf string, subroot string, proof_sha256 string, folded_root string"
    root = F.lit(root).cast("string")
    return _with_paths(rows, paths, fanout, _folds, schema).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "leaf", "subroot", root.alias("root"),
        "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"),
    )
