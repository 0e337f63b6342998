"""Approximate nearest neighbours by a vantage-point tree per shard.

Rows are dealt into shards of a bounded size.  A shard builds its tree over unit
vectors, where the Euclidean distance falls as the cosine rises: every node takes a
vantage point and halves its rows at the median distance.  The triangle inequality
bounds from below how near a query can come to the rows of a leaf; leaves are searched
nearest bound first, and a query leaves a shard once `factor` times the bound exceeds
its k-th best distance.  A factor of one is exact search; larger factors prune more.

Queries travel in blocks that meet each shard once; a shard returns k rows per query.
Shards and blocks are shuffled, never broadcast: a task reads one shard, then its blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigate.llm.common import Scratch, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 5
FACTOR = 1.0
SHARD_ROWS = 4096
#: Numbers a shard may hold where there are more shards than tasks need.
SHARD_VALUES = 1 << 20
BLOCK_ROWS = 512
LEAF_ROWS = 512
#: Error allowed for in a distance, sqrt(2 - 2 cos): near 0 it is some 1.5e-8.
SLACK = 1e-7


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows multiplied by a power of two that brings the largest component near 1: exact,
    and no square can overflow."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows.  Row by row in a fixed order, so equal vectors tie exactly."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


class Tree:
    """Vantage-point tree over unit rows; `nodes` lists (vantage row, median, children)."""

    def __init__(self, unit: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.unit = unit
        self.nodes: list[tuple[int, np.ndarray, int, int]] = []
        self.leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(unit)), leaf_rows)
        self.leaf_of, self.place = np.empty(len(unit), np.int64), np.empty(len(unit), np.int64)
        for i, rows in enumerate(self.leaves):
            self.leaf_of[rows], self.place[rows] = i, np.arange(len(rows))

    def _build(self, rows: np.ndarray, leaf_rows: int) -> int:
        """Number of a node, or minus one minus the number of a leaf."""
        if len(rows) <= leaf_rows:
            self.leaves.append(rows)
            return -len(self.leaves)
        # The row farthest from the middle spreads the distances best.
        middle = self.unit[rows].mean(axis=0)
        vantage = rows[int(((self.unit[rows] - middle) ** 2).sum(axis=1).argmax())]
        distance = np.sqrt(np.maximum(2 - 2 * self.unit[rows] @ self.unit[vantage], 0))
        order = np.argsort(distance, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        reach = np.array([distance[near].min(), distance[near].max(), distance[far].min(), distance[far].max()])
        at = len(self.nodes)
        self.nodes.append((int(vantage), reach, 0, 0))
        left, right = self._build(rows[near], leaf_rows), self._build(rows[far], leaf_rows)
        self.nodes[at] = (int(vantage), reach, left, right)
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x leaves: no row of the leaf is nearer than this."""
        out = np.zeros((len(queries), len(self.leaves)))

        def walk(node: int, bound: np.ndarray) -> None:
            if node < 0:
                out[:, -node - 1] = bound
                return
            vantage, reach, left, right = self.nodes[node]
            d = np.sqrt(np.maximum(2 - 2 * queries @ self.unit[vantage], 0))
            walk(left, np.maximum(bound, np.maximum(reach[0] - d, d - reach[1])))
            walk(right, np.maximum(bound, np.maximum(reach[2] - d, d - reach[3])))

        walk(self.root, np.zeros(len(queries)))
        return out


def search(
    tree: Tree, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    k: int = K, factor: float = FACTOR,
) -> tuple[pd.DataFrame, int]:
    """The k best rows of one shard for each query (its own id left out), and the number
    of (query, leaf) visits.  `ids` are distinct."""
    unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
    bounds = tree.bounds(unit)
    order = np.argsort(bounds, axis=1, kind="stable")
    sorter = np.argsort(ids, kind="stable")
    itself = sorter[np.minimum(np.searchsorted(ids, query_ids, sorter=sorter), len(ids) - 1)]
    own_leaf = np.where(ids[itself] == query_ids, tree.leaf_of[itself], -1)
    found: list[tuple[np.ndarray, ...]] = []
    best = np.full((len(queries), k), -np.inf)  # cosines, smallest first
    active, visits = np.arange(len(queries)), 0
    for step in range(len(tree.leaves)):
        leaf_of = order[active, step]
        reached = np.sqrt(np.maximum(2 - 2 * best[active, 0], 0))
        reached[np.isneginf(best[active, 0])] = np.inf
        going = factor * bounds[active, leaf_of] <= reached + SLACK
        active, leaf_of = active[going], leaf_of[going]
        if not len(active):
            break
        visits += len(active)
        for leaf in np.unique(leaf_of):
            who, members = active[leaf_of == leaf], tree.leaves[leaf]
            near = unit[who] @ tree.unit[members].T
            mine = np.flatnonzero(own_leaf[who] == leaf)
            near[mine, tree.place[itself[who[mine]]]] = -np.inf
            better = np.flatnonzero(near.max(axis=1) > best[who, 0])
            if len(better):
                both = np.concatenate([best[who[better]], near[better]], axis=1)
                best[who[better]] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
            a, b = np.nonzero((near >= best[who, :1] - 1e-12) & np.isfinite(near))
            found.append((who[a], members[b], near[a, b]))
    q, r, near = (np.concatenate(part) for part in zip(*found))
    near_enough = near >= best[q, 0] - 1e-12
    q, r = q[near_enough], r[near_enough]
    score = cosine(queries[q], rows[r])
    ranked = np.lexsort((ids[r], -score, q))
    q, r, score = q[ranked], r[ranked], score[ranked]
    first = np.searchsorted(q, np.arange(len(queries)))
    kept = np.arange(len(q)) - first[q] < k
    return pd.DataFrame({"query_id": query_ids[q[kept]], "vec_id": ids[r[kept]], "score": score[kept]}), visits


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), dim: rows whose vector has a direction."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null").select("vec_id", v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    ).withColumn("dim", F.size("v"))


def one_per_id(rows: DataFrame) -> DataFrame:
    least = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return least.withColumn("dim", F.size("v"))


def _gathered(rows: DataFrame, name: str, parts: int, seed: int) -> DataFrame:
    """Rows dealt into `parts` bounded groups: dim, the group, ids, values (end to end)."""
    group = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("bigint").alias(name)
    lists = rows.groupBy("dim", group).agg(F.collect_list(F.struct("vec_id", "v")).alias("r"))
    return lists.select("dim", name, F.col("r.vec_id").alias("ids"), F.flatten("r.v").alias("values"))


def nearest(
    vectors: DataFrame, every: int = 50, k: int = K, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by `every`,
    the k rows of largest cosine but itself, ties to the smaller vec_id.

    Vectors that are null, zero, empty, or hold null or non-finite components take no
    part; vectors of another length never meet.  Of equal vectors only the k + 1 with
    the smallest vec_ids can be among the answers, so the others are not indexed.
    Of rows that share a vec_id the one with the smallest vector (component by component)
    stands for all.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    same = Window.partitionBy("v").orderBy("vec_id")
    rows = scratch.table(one_per_id(usable(vectors)))
    asks = F.pmod("vec_id", F.lit(every)) == 0
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(asks).alias("q"), F.coalesce(F.sum("dim"), F.lit(0)).alias("values")
    ).first()
    # Small shards as long as tasks need them; then larger ones, as each meets all queries.
    enough = 8 * spark.sparkContext.defaultParallelism
    shards = max(1, -(-counts["values"] // SHARD_VALUES), min(-(-counts["n"] // shard_rows), enough))
    blocks = max(1, -(-counts["q"] // block_rows))
    ranked = rows.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k + 1)
    indexed = _gathered(ranked, "shard", shards, 0).withColumn("block", F.lit(-1).cast("bigint"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    asked = _gathered(rows.where(asks), "block", blocks, 1).withColumn("shard", everywhere)
    # A join would broadcast the queries by their size before the explode.
    meeting = (
        indexed.unionByName(asked).repartitionById(shards, F.col("shard").cast("int"))
        .sortWithinPartitions("dim", "shard", "block")
    )

    def matrix(ids: np.ndarray, values: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        return ids[order], scaled(values.reshape(-1, dim)[order])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: tuple | None = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                given = matrix(row.ids, row.values, row.dim)
                if row.block < 0:
                    ids, members = given
                    tree = Tree(members / np.sqrt((members * members).sum(axis=1))[:, None])
                    built = (row.dim, row.shard), tree, ids, members
                elif built is not None and built[0] == (row.dim, row.shard):
                    yield search(*built[1:], *given, k, factor)[0]

    small_batches(spark, 4)  # a row holds a whole shard
    local = scratch.table(meeting.mapInPandas(run, "query_id long, vec_id long, score double"))
    small_batches(spark)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
