"""Cluster bootstrap.  Rows shrink to one row per cluster first; the clusters are
then drawn with replacement, n out of n, for every replicate.

`draws` works in two steps that any SQL engine can repeat.  A hash of (seed, replicate,
slot) throws each of the n slots into a run of 1,024 positions; tasks hash the slots of some
replicates in arrays, and only the number of slots per replicate and run is shuffled.  The task that holds a run then draws as many of its
clusters, by a hash of (seed, replicate, run, number).  Draws depend on no size limit and
no partition count.  `blocks`, if asked for, takes seeded random numbers instead of
hashes: the slots of a replicate are split down a binary tree of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.operators.distributed import (
    global_position, hash_position, materialize,
)

BLOCK_ROWS = 4096
RUN_BITS = 10
RUN = 1 << RUN_BITS
#: Slots hashed at a time, and the clusters whose product with a 32-bit hash fits 63 bits.
CHUNK, MOST_CLUSTERS = 1 << 17, 1 << 31
#: Replicates counted by one item of work, and the counts it may hold.
TOGETHER, COUNTS = 25, 1 << 22
#: Runs multiplied by one call, rows of counts in one batch, rows of clusters in one task.
RUNS_TOGETHER, BATCH, TASK_ROWS = 8, 4096, 1 << 18
#: Clusters in whose range the beginnings of moving blocks are kept together.
WIDE = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """The 32-bit finaliser over unsigned 32-bit numbers, in place."""
    part = x >> np.uint32(16)
    x ^= part
    x *= np.uint32(0x21F0AAAD)
    np.right_shift(x, np.uint32(15), out=part)
    x ^= part
    x *= np.uint32(0x735A2D97)
    np.right_shift(x, np.uint32(15), out=part)
    x ^= part
    return x


def replicate_hashes(replicates: np.ndarray, seed: int) -> np.ndarray:
    return mixed(((replicates + seed) & 0xFFFFFFFF).astype(np.uint32))


def resampled_sums(
    clusters: DataFrame,
    key: str,
    values: Sequence[str],
    replicates: int,
    seed: int,
    strata: Sequence[str] = (),
    method: str = "draws",
    block_length: int | None = None,
) -> DataFrame:
    """Sums of `values` over resampled clusters: strata, replicate, clusters, values.

    `clusters` has one row per stratum and key.  With `block_length` whole runs of
    consecutive keys are drawn (circular moving block) and cut to n clusters.
    """
    if replicates <= 0:
        raise ValueError("replicates must be positive")
    strata = list(strata)
    group = strata or ["_all"]
    base = clusters if strata else clusters.withColumn("_all", F.lit(0))
    base = materialize(
        base.select(*group, key, *[F.col(v).cast("double").alias(v) for v in values])
    )
    if base.isEmpty():
        raise ValueError("no event clusters")
    if method == "blocks":
        if block_length:
            raise ValueError("moving blocks need the draws method")
        sums = _sums_by_block(base, group, key, values, replicates, seed)
    elif block_length:
        if strata:
            raise ValueError("moving blocks take no strata")
        sums = _sums_by_moving_block(base, group, key, values, replicates, seed, block_length)
    else:
        sums = _sums_by_draw(base, group, key, values, replicates, seed)
    sizes = base.groupBy(*group).agg(F.count("*").alias("clusters"))
    return sums.join(sizes, group).select(*strata, "replicate", "clusters", *values)


def _items(base: DataFrame, group: list[str], replicates: int) -> DataFrame:
    """Work to be dealt out, group, n, _first, _last: replicates of a stratum whose counts
    per run fit one task."""
    spark = base.sparkSession
    few = F.when(F.col("n") < MOST_CLUSTERS, F.col("n")).otherwise(
        F.raise_error(F.lit(f"a stratum holds {MOST_CLUSTERS} clusters or more")).cast("bigint")
    )
    at_once = F.greatest(F.lit(1), F.least(F.lit(TOGETHER), F.floor(COUNTS / F.ceil(F.col("n") / RUN)))).cast("bigint")
    items = (
        base.groupBy(*group).agg(F.count("*").alias("n")).withColumn("n", few).withColumn("_each", at_once)
        .withColumn("_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"), F.col("_each"))))
        .select(*group, "n", "_first", F.least(F.col("_first") + F.col("_each"), F.lit(replicates)).alias("_last"))
    )
    return items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _starts(n: int, own: np.uint32, each: np.ndarray, shift: int) -> np.ndarray:
    """Where the slots with the hashes `each` begin, in units of 2^shift clusters."""
    start = mixed(own ^ each).astype(np.uint64)
    start *= np.uint64(n)
    start >>= np.uint64(32 + shift)
    return start.view(np.int64)


def _slot_hashes(first: int, last: int) -> np.ndarray:
    return mixed(np.arange(first + 1, last + 1, dtype=np.int64).astype(np.uint32))


def _sum_schema(base: DataFrame, group: list[str], names: list[str]) -> T.StructType:
    fields = {f.name: f.dataType for f in base.schema.fields}
    return T.StructType(
        [T.StructField(g, fields[g]) for g in group]
        + [T.StructField("replicate", T.LongType())]
        + [T.StructField(v, T.DoubleType()) for v in names]
    )


def _added_up(parts: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    return parts.groupBy(*group, "replicate").agg(*[F.sum(v).alias(v) for v in names])


def _tasks(base: DataFrame) -> int:
    """Tasks that share the clusters, so that none holds many of them at once."""
    spread = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(spread, -(-base.count() // TASK_ROWS))


def _keyed(base: DataFrame, group: list[str], fields: str) -> T.StructType:
    """Columns of the strata, then `fields`."""
    types = {f.name: f.dataType for f in base.schema.fields}
    return T.StructType([T.StructField(g, types[g]) for g in group] + T._parse_datatype_string(fields).fields)


def _sums_by_draw(base, group, key, values, replicates, seed) -> DataFrame:
    names, k = list(values), len(values)
    chunk = CHUNK

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many slots of each replicate fall into each run."""
        for batch in batches:
            for item in batch.itertuples(index=False):
                *stratum, n, first, last = item
                runs = -(-n // RUN)
                own = replicate_hashes(np.arange(first, last), seed)
                counts = np.zeros((last - first, runs), np.uint32)
                for begin in range(0, n, chunk):
                    each = _slot_hashes(begin, min(begin + chunk, n))
                    for i, u in enumerate(own):
                        counts[i] += np.bincount(_starts(n, u, each, RUN_BITS), minlength=runs).astype(np.uint32)
                for begin in range(0, runs, BATCH):
                    part = np.ascontiguousarray(counts[:, begin:begin + BATCH].T)
                    frame = pd.DataFrame({
                        "_run": np.arange(begin, begin + len(part)), "_first": first,
                        "_taken": [row.tobytes() for row in part],
                    })
                    for g, v in zip(reversed(group), reversed(stratum)):
                        frame.insert(0, g, v)
                    yield frame

    taken = (
        _items(base, group, replicates)
        .mapInPandas(count, _keyed(base, group, "_run BIGINT, _first BIGINT, _taken BINARY"))
        # Own names for the columns that both sides of the cogroup have from `base`.
        .select(
            *[F.col(g).alias(g) for g in group], F.floor(F.col("_run") / RUNS_TOGETHER).cast("bigint").alias("_runs"),
            "_run", "_first", "_taken",
        )
    )

    def multiply(keys: tuple, counts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((replicates, k))
        drawn = dict(tuple(counts.groupby("_run")))
        for run, members in rows.groupby("_run"):
            size = len(members)
            matrix = np.zeros((size + 1, k))
            matrix[members["_i"].to_numpy()] = np.stack(members["_values"].to_numpy())
            times = np.zeros(replicates, np.int64)
            for first, row in zip(drawn[run]["_first"], drawn[run]["_taken"]):
                part = np.frombuffer(row, np.uint32)
                times[first:first + len(part)] = part
            own = mixed(replicate_hashes(np.arange(replicates), seed) ^ mixed(np.array([run & 0xFFFFFFFF], np.uint32)))
            most = int(times.max())
            number = np.arange(most)
            each = _slot_hashes(0, most)
            # A few replicates at a time stay in the cache of a core.
            few = max(1, (1 << 16) // (max(most, size) + 1))
            for begin in range(0, replicates, few):
                some = slice(begin, begin + few)
                u = mixed(own[some, None] ^ each[None, :])
                member = (u & np.uint32(size - 1)) if size & (size - 1) == 0 else u % np.uint32(size)
                cell = member.astype(np.int64)
                # Numbers beyond those drawn go to a row of zeros.
                cell[number[None, :] >= times[some, None]] = size
                cell += (np.arange(len(cell)) * (size + 1))[:, None]
                weight = np.bincount(cell.ravel(), minlength=len(cell) * (size + 1)).reshape(len(cell), size + 1)
                total[some] += weight.astype(float) @ matrix
        return _by_replicate(total, keys[:-1])

    def _by_replicate(total: np.ndarray, stratum: tuple) -> pd.DataFrame:
        frame = pd.DataFrame(total, columns=names)
        frame.insert(0, "replicate", np.arange(replicates, dtype=np.int64))
        for g, v in zip(reversed(group), reversed(stratum)):
            frame.insert(0, g, v)
        return frame

    run = F.floor(F.col("position") / RUN).cast("bigint")
    # One array instead of very many columns, which are slow to sort and to move.
    packed = base.select(*group, key, F.array(*names).alias("_values"))
    rows = hash_position(packed, key, group).select(
        *group, F.floor(run / RUNS_TOGETHER).cast("bigint").alias("_runs"), run.alias("_run"),
        (F.col("position") % RUN).cast("int").alias("_i"), "_values",
    )
    tasks, by = _tasks(base), [*group, "_runs"]
    parts = (
        taken.repartition(tasks, *by).groupBy(*by).cogroup(rows.repartition(tasks, *by).groupBy(*by))
        .applyInPandas(multiply, _sum_schema(base, group, names))
    )
    return _added_up(parts, group, names)


def _coded(starts: np.ndarray) -> bytes:
    """Sorted numbers as steps of one byte each; 255 is a step that ends at no number."""
    steps = np.diff(starts, prepend=0)
    whole = steps // 255
    out = np.full(len(steps) + whole.sum(), 255, np.uint8)
    out[np.cumsum(whole) + np.arange(len(steps))] = steps % 255
    return out.tobytes()


def _decoded(coded: bytes) -> np.ndarray:
    steps = np.frombuffer(coded, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _sums_by_moving_block(base, group, key, values, replicates, seed, block_length) -> DataFrame:
    """Blocks are sent by where they begin, a byte each; the task with a run of clusters and
    the few after it adds up the blocks that begin in it."""
    names, k = list(values), len(values)
    chunk = CHUNK

    def begin_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item in batch.itertuples(index=False):
                *stratum, n, first, last = item
                # A stratum shorter than a block is one block, cut to its size.
                length = min(block_length, n)
                slots = -(-n // length)
                own = replicate_hashes(np.arange(first, last), seed)
                for begin in range(0, slots, chunk):
                    each = _slot_hashes(begin, min(begin + chunk, slots))
                    for i, u in enumerate(own):
                        starts = _starts(n, u, each, 0)
                        rows = []
                        if begin + chunk >= slots:
                            # The last block ends where n clusters are drawn.
                            rows.append((starts[-1] // WIDE, n - (slots - 1) * length, _coded(starts[-1:] % WIDE)))
                            starts = starts[:-1]
                        starts = np.sort(starts)
                        runs, at = np.unique(starts // WIDE, return_index=True)
                        for run, part in zip(runs, np.split(starts, at[1:])) if len(starts) else ():
                            rows.append((run, length, _coded(part - run * WIDE)))
                        frame = pd.DataFrame(rows, columns=["_run", "_length", "_coded"])
                        frame.insert(0, "replicate", first + i)
                        for g, v in zip(reversed(group), reversed(stratum)):
                            frame.insert(0, g, v)
                        yield frame

    def add(keys: tuple, drawn: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        matrix = np.zeros((WIDE + block_length, k))
        matrix[rows["_i"].to_numpy()] = rows[names].to_numpy(dtype=float)
        blocks = {
            length: sum(matrix[o:o + WIDE] for o in range(length)) for length in drawn["_length"].unique()
        }
        total = np.zeros((replicates, k))
        for replicate, length, coded in zip(drawn["replicate"], drawn["_length"], drawn["_coded"]):
            total[replicate] += blocks[length][_decoded(coded)].sum(axis=0)
        frame = pd.DataFrame(total, columns=names)
        frame.insert(0, "replicate", np.arange(replicates, dtype=np.int64))
        for g, v in zip(reversed(group), reversed(keys[:-1])):
            frame.insert(0, g, v)
        return frame

    sizes = base.groupBy(*group).agg(F.count("*").alias("n"))
    length = F.least(F.lit(block_length), F.col("n"))
    # A cluster is part of the blocks that begin up to a length before it, around the end.
    start = lambda o: F.pmod(F.col("position") - o, F.col("n"))
    cells = F.array_distinct(F.transform(
        F.sequence(F.lit(0).cast("bigint"), (length - 1).cast("bigint")),
        lambda o: F.struct(
            F.floor(start(o) / WIDE).cast("bigint").alias("_run"), (start(o) % WIDE + o).cast("int").alias("_i"),
        ),
    ))
    rows = (
        global_position(base, [key]).join(F.broadcast(sizes), group)
        .select(*group, *names, F.inline(cells)).select(*group, "_run", "_i", *names)
    )
    drawn = _items(base, group, replicates).mapInPandas(
        begin_at, _keyed(base, group, "replicate BIGINT, _run BIGINT, _length BIGINT, _coded BINARY")
    ).select(*[F.col(g).alias(g) for g in group], "replicate", "_run", "_length", "_coded")
    tasks, by = _tasks(base), [*group, "_run"]
    parts = (
        drawn.repartition(tasks, *by).groupBy(*by).cogroup(rows.repartition(tasks, *by).groupBy(*by))
        .applyInPandas(add, _sum_schema(base, group, names))
    )
    return _added_up(parts, group, names)


def _sums_by_block(base, group, key, values, replicates, seed) -> DataFrame:
    """Blocks of some 4,096 clusters by a hash of the key.  The driver holds the size of
    each block, one number for 4,096 clusters."""
    largest = base.groupBy(*group).count().agg(F.max("count")).first()[0]
    blocks = -(-largest // BLOCK_ROWS)
    blocked = base.withColumn(
        "_block", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(blocks)).cast("int")
    )
    counts: dict[tuple, np.ndarray] = {}
    for row in blocked.groupBy(*group, "_block").agg(F.count("*").alias("n")).collect():
        stratum = tuple(str(row[g]) for g in group)
        counts.setdefault(stratum, np.zeros(blocks, dtype=np.int64))[row["_block"]] = row["n"]
    names = list(values)
    order = {stratum: i for i, stratum in enumerate(sorted(counts))}
    upto = {s: np.concatenate([[0], np.cumsum(n)]) for s, n in counts.items()}
    shared = base.sparkSession.sparkContext.broadcast(upto)

    def draw(stratum: tuple, block: int, pdf: pd.DataFrame) -> np.ndarray:
        before = shared.value[stratum]
        # Down the tree: how many slots of each replicate fall into the half with the block.
        low, high = 0, blocks
        times = np.full(replicates, before[-1])
        while high - low > 1:
            middle = (low + high) // 2
            share = (before[middle] - before[low]) / max(before[high] - before[low], 1)
            left = np.random.default_rng([seed, order[stratum], low, high]).binomial(times, share)
            low, high, times = (low, middle, left) if block < middle else (middle, high, times - left)
        # Arrow hands groups over in any order; the key fixes the rows.
        matrix = pdf.sort_values(key)[names].to_numpy(dtype=float)
        members = len(matrix)
        rng = np.random.default_rng([seed, order[stratum], block])
        out = np.zeros((replicates, len(names)))
        for r in range(replicates):
            out[r] = np.bincount(rng.integers(0, members, times[r]), minlength=members) @ matrix
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums over the blocks of a task, handed on once a stratum: blocks come in order, and
        a task holds one of them beside its sums."""
        total: np.ndarray | None = None
        at: tuple | None = None
        parts: list[pd.DataFrame] = []

        def summed() -> pd.DataFrame:
            frame = pd.DataFrame(total, columns=names)
            frame.insert(0, "replicate", np.arange(replicates, dtype=np.int64))
            for g, v in zip(reversed(group), reversed(at[:-1])):
                frame.insert(0, g, v)
            return frame

        for batch in batches:
            for keys, part in batch.groupby([*group, "_block"], sort=False, dropna=False):
                keys = tuple(None if pd.isna(v) else v for v in keys)
                if at is not None and keys != at:
                    drawn = draw(tuple(str(v) for v in at[:-1]), int(at[-1]), pd.concat(parts))
                    total, parts = drawn if total is None else total + drawn, []
                    if keys[:-1] != at[:-1]:
                        yield summed()
                        total = None
                at = keys
                parts.append(part)
        if at is not None:
            drawn = draw(tuple(str(v) for v in at[:-1]), int(at[-1]), pd.concat(parts))
            total = drawn if total is None else total + drawn
            yield summed()

    dealt = blocked.repartition(*group, "_block").sortWithinPartitions(*group, "_block")
    parts = dealt.mapInPandas(run, _sum_schema(base, group, names))
    return _added_up(parts, group, names)


def widen(
    long: DataFrame, by: Sequence[str], members: Mapping[str, Column], fields: Sequence[str]
) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """Pivot a bounded member list (rules, metrics) into columns of cluster rows.

    One draw of a cluster then serves all members.  Returns the wide frame and,
    per member, the column each field went to.
    """
    layout = {
        m: {f: f"c{i}_{f}" for f in fields} for i, m in enumerate(members)
    }
    aggregates = [
        F.coalesce(F.sum(F.when(test, F.col(f))), F.lit(0.0)).cast("double").alias(layout[m][f])
        for m, test in members.items()
        for f in fields
    ]
    return long.groupBy(*by).agg(*aggregates), layout


def lengthen(
    wide: DataFrame, keep: Sequence[str], layout: Mapping[str, Mapping[str, str]], name: str
) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias(name), *[F.col(c).alias(f) for f, c in columns.items()]
            )
            for m, columns in layout.items()
        ]
    )
    return wide.select(*keep, F.inline(rows))


def cluster_bootstrap_bounds(
    sums: DataFrame,
    rules: Sequence[str],
    replicates: int,
    seed: int,
    strata: Sequence[str] = ("profile",),
    cluster: str = "event_cluster_id",
    method: str = "draws",
) -> DataFrame:
    """One-sided 5/95 % bounds of coverage, harm, laundering and utility.

    `sums` holds cluster component sums per rule and stratum.  Replicates without
    an authorized row are counted and left out of the ratios.
    """
    strata = list(strata)
    fields = ("rows", "authorized", "harmful", "laundering", "utility")
    wide, layout = widen(
        sums, [*strata, cluster], {r: F.col("rule") == r for r in rules}, fields
    )
    return wide_bootstrap_bounds(wide, layout, replicates, seed, strata, cluster, method)


def wide_bootstrap_bounds(
    wide: DataFrame, layout: Mapping[str, Mapping[str, str]], replicates: int, seed: int,
    strata: Sequence[str] = ("profile",), cluster: str = "event_cluster_id", method: str = "draws",
) -> DataFrame:
    """The bounds from sums that stand in columns (see `metrics.wide_cluster_sums`); columns
    that rules share are drawn once."""
    strata = list(strata)
    values = list(dict.fromkeys(c for columns in layout.values() for c in columns.values()))
    drawn = resampled_sums(wide, cluster, values, replicates, seed, strata, method)
    long = lengthen(drawn, [*strata, "replicate", "clusters"], layout, "rule")
    taken = F.col("authorized")
    rated = long.withColumns(
        {
            "_cov": taken / F.col("rows"),
            "_far": F.when(taken > 0, F.try_divide(F.col("harmful"), taken)),
            "_alr": F.when(taken > 0, F.try_divide(F.col("laundering"), taken)),
            "_upa": F.when(taken > 0, F.try_divide(F.col("utility"), taken)),
        }
    )

    def q(column: str, p: float) -> Column:
        # At most `replicates` values per group.
        return F.percentile(column, p)

    return rated.groupBy("rule", *strata, "clusters").agg(
        F.count("*").alias("replicates"),
        F.count_if(taken == 0).alias("zero_authorized_replicates"),
        q("_cov", 0.05).alias("coverage_lcb95"), q("_cov", 0.95).alias("coverage_ucb95"),
        q("_far", 0.95).alias("far_ucb95"), q("_alr", 0.95).alias("alr_ucb95"),
        q("utility", 0.05).alias("cau_lcb95"), q("utility", 0.95).alias("cau_ucb95"),
        q("_upa", 0.05).alias("upa_lcb95"), q("_upa", 0.95).alias("upa_ucb95"),
    )


def ratio_bootstrap(
    components: DataFrame,
    rules: Sequence[str],
    metrics: Sequence[str],
    replicates: int,
    seed: int,
    strata: Sequence[str] = (),
    cluster: str = "event_cluster_id",
    method: str = "draws",
) -> DataFrame:
    """Two-sided 95 % intervals of ratio metrics and the share of valid replicates."""
    strata = list(strata)
    members = {
        f"{r}\x1f{m}": (F.col("rule") == r) & (F.col("metric") == m)
        for r in rules
        for m in metrics
    }
    wide, layout = widen(components, [*strata, cluster], members, ("numerator", "denominator"))
    values = [c for columns in layout.values() for c in columns.values()]
    drawn = resampled_sums(wide, cluster, values, replicates, seed, strata, method)
    long = lengthen(drawn, [*strata, "replicate", "clusters"], layout, "_member")
    den = F.col("denominator")
    parts = F.split("_member", "\x1f")
    rated = long.withColumns(
        {
            "rule": parts[0],
            "metric": parts[1],
            "_v": F.when(den > 0, F.try_divide(F.col("numerator"), den)),
        }
    )
    return rated.groupBy("rule", *strata, "metric", "clusters").agg(
        F.count("*").alias("replicates"),
        F.percentile("_v", 0.025).alias("lcb95"),
        F.percentile("_v", 0.975).alias("ucb95"),
        (F.count("_v") / F.count("*")).alias("valid_replicate_fraction"),
    )


def cluster_mean_bootstrap(
    rates: DataFrame, replicates: int, seed: int, strata: Sequence[str],
    cluster: str = "evaluation_cluster_id", method: str = "draws",
) -> DataFrame:
    """Bounds on the mean of cluster rates; clusters without a rate are skipped."""
    measures = ("coverage", "far", "alr")
    prepared = rates.select(
        *strata, cluster,
        *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in measures],
        *[F.col(m).isNotNull().cast("double").alias(f"{m}_n") for m in measures],
    )
    values = [*measures, *[f"{m}_n" for m in measures]]
    drawn = resampled_sums(prepared, cluster, values, replicates, seed, strata, method)
    means = drawn.withColumns(
        {f"_{m}": F.when(F.col(f"{m}_n") > 0, F.try_divide(F.col(m), F.col(f"{m}_n")))
         for m in measures}
    )
    return means.groupBy(*strata, "clusters").agg(
        F.percentile("_coverage", 0.05).alias("coverage_lcb95"),
        F.percentile("_far", 0.95).alias("far_ucb95"),
        F.percentile("_alr", 0.95).alias("alr_ucb95"),
    )


def paired_interval(
    differences: DataFrame, measures: Sequence[str], replicates: int, seed: int,
    cluster: str = "event_cluster_id", block_length: int | None = None,
) -> DataFrame:
    """Mean, standard deviation and two-sided interval of paired cluster differences."""
    complete = differences.dropna(subset=list(measures)).select(cluster, *measures)
    drawn = resampled_sums(
        complete, cluster, list(measures), replicates, seed, block_length=block_length
    )
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), (F.col(m) / F.col("clusters")).alias("v"))
            for m in measures
        ]
    )
    bounds = (
        drawn.select(F.inline(cells)).groupBy("measure").agg(
            F.count("*").alias("replicates"),
            F.percentile("v", 0.025).alias("ci95_lower"),
            F.percentile("v", 0.975).alias("ci95_upper"),
        )
    )
    values = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures]
    )
    points = (
        complete.select(F.inline(values)).groupBy("measure").agg(
            F.count("*").alias("clusters"),
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("standard_deviation"),
        )
    )
    return points.join(bounds, "measure")


def co_primary(interval: DataFrame, false_sesoi: float, laundering_sesoi: float) -> DataFrame:
    """Both arms must reach their smallest effect of interest with a one-signed
    interval; the decision is the intersection."""
    false_arm = F.col("measure") == "false_authorization_difference"
    passed = F.when(
        false_arm, (F.col("mean") <= false_sesoi) & (F.col("ci95_upper") < 0)
    ).otherwise((F.col("mean") >= laundering_sesoi) & (F.col("ci95_lower") > 0))
    judged = interval.withColumn("_passed", passed)

    def arm(test: Column) -> Column:
        return F.coalesce(F.bool_or(F.when(test, F.col("_passed"))), F.lit(False))

    both = judged.agg(
        arm(false_arm).alias("false_authorization_passed"),
        arm(~false_arm).alias("laundering_passed"),
    )
    f, a = F.col("false_authorization_passed"), F.col("laundering_passed")
    return both.withColumns(
        {
            "intersection_union_passed": f & a,
            "classification": F.when(f & a, "PASS").when(f | a, "MIXED_FAIL").otherwise("FAIL"),
        }
    )
