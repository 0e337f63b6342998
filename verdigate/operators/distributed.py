"""Order and quantile operators that never put a whole table in one task.

A window without a partition, or `percentile` over a large group, would send
every row to one task.  Positions are therefore taken inside ranges and shifted
by the sizes of the ranges before them, and quantiles are narrowed round by round
to the few values around the wanted rank.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches: the checkpoint folder of the session.  Where none is
    named, a session on one machine gets a temporary one and a cluster is refused."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="verdigate-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, dictionary: bool = False) -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    The plan runs once (a checkpoint would run its last stage twice), the copy is
    columnar, so later reads are pruned, and its size is known to the optimizer.
    `dictionary` makes a smaller copy of columns with few different values.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_position(
    df: DataFrame, order: Sequence[str], name: str = "position", ranges: int | None = None
) -> DataFrame:
    """Zero-based position in a total order.  `order` must identify a row.

    Range partitioning samples the data, so the range of each row is written
    down before it is used twice.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialize(
        df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    offsets = _offsets(ranged, [], "_range")
    return (
        ranged.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_offset")
    )


def position_in_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Zero-based position inside each group and the group size, without sorting a
    whole group in one task: a global position less the first one of the group."""
    placed = global_position(df, [*groups, *order], "_global")
    firsts = placed.groupBy(*groups).agg(
        F.min("_global").alias("_first"), F.count("*").alias("group_size")
    )
    return (
        placed.join(firsts, list(groups))
        .withColumn(name, F.col("_global") - F.col("_first"))
        .drop("_global", "_first")
    )


def hash_position(
    df: DataFrame, key: str, groups: Sequence[str] = (), name: str = "position",
    digest: Column | None = None,
) -> DataFrame:
    """Zero-based position by md5 (or another hex digest) of a unique key per group.

    The first three hex digits form 4,096 even ranges, so neither a large group
    nor a frequent key prefix can crowd a task.
    """
    groups = list(groups)
    hashed = F.md5(F.col(key).cast("string")) if digest is None else digest
    keyed = df.withColumn("_h", hashed).withColumn(
        "_range", F.substring("_h", 1, 3)
    )
    inside = Window.partitionBy(*groups, "_range").orderBy("_h", key)
    offsets = _offsets(keyed, groups, "_range")
    return (
        keyed.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [*groups, "_range"])
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_h", "_range", "_inside", "_offset")
    )


def _offsets(df: DataFrame, groups: list[str], range_column: str) -> DataFrame:
    before = (
        Window.partitionBy(*groups)
        .orderBy(range_column)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = df.groupBy(*groups, range_column).agg(F.count("*").alias("_size"))
    return sizes.select(
        *groups,
        range_column,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )


#: Rows of a group that one task may sort, and cells a larger group is cut into per round.
SORTED_ROWS = 1_000_000
CELLS = 1000
#: A sketch of this accuracy is off by n / ACCURACY ranks at most.
ACCURACY = 10_000


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "linear",
    sorted_rows: int = SORTED_ROWS,
    cells: int = CELLS,
) -> DataFrame:
    """Exact quantiles per group, in long form (keys, quantile, n, value).

    `linear` interpolates between neighbours; `higher` takes the row at
    ceil((n-1)q).  A group is counted; while the part of it that may hold a wanted
    rank has more than `sorted_rows` rows, a sketch cuts that part into cells and the
    rows of the cells around the rank are counted.  What is left is combined by value
    and sorted, so no task sorts more than `sorted_rows` values of a group.
    """
    if method not in ("linear", "higher"):
        raise ValueError(f"unknown quantile method: {method}")
    keys = list(keys)
    group = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [F.col(k).alias(g) for k, g in zip(keys, group)] or [F.lit(0).alias("_k0")]
    rows = df.select(*named, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sizes = materialize(rows.groupBy(*group).agg(F.count("*").alias("_n")))
    wanted = F.array(
        *[F.struct(F.lit(k).alias("quantile"), F.lit(float(q)).alias("q")) for k, q in probs.items()]
    )
    asked = sizes.select(*group, "_n", F.inline(wanted)).select(
        *group, "_n", "quantile", ((F.col("_n") - 1) * F.col("q")).alias("_h")
    )
    ends = [F.ceil("_h")] if method == "higher" else [F.floor("_h"), F.ceil("_h")]
    ranks = asked.select(*group, "_n", F.explode(F.array(*ends)).alias("_r")).distinct()
    found = _values_at(rows, group, ranks, sorted_rows, cells)
    upper = found.select(*group, F.col("_r").alias("_up"), F.col("_value").alias("_b"))
    asked = _null_safe(asked.withColumn("_up", F.ceil("_h")), upper, [*group, "_up"])
    result = F.col("_b")
    if method == "linear":
        lower = found.select(*group, F.col("_r").alias("_low"), F.col("_value").alias("_a"))
        asked = _null_safe(asked.withColumn("_low", F.floor("_h")), lower, [*group, "_low"])
        result = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))
    return asked.select(
        *[F.col(g).alias(k) for k, g in zip(keys, group)], "quantile", F.col("_n").alias("n"), result.alias("value")
    )


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns of the same name, where null meets null."""
    renamed = right.withColumnsRenamed({c: f"_of{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in on]
    return left.join(renamed, condition).drop(*[f"_of{c}" for c in on])


def _values_at(rows: DataFrame, group: list[str], ranks: DataFrame, sorted_rows: int, cells: int) -> DataFrame:
    """The value at rank _r (from 0) of each group: group, _r, _value.

    A wanted rank lies in an open interval (_lo, _hi) of values, null for no bound, with
    _below rows before it and _inside rows in it.
    """
    nothing = F.lit(None).cast("double")
    open_ = ranks.select(
        *group, "_r", nothing.alias("_lo"), nothing.alias("_hi"), F.lit(0).cast("bigint").alias("_below"),
        F.col("_n").alias("_inside"),
    )
    solved: list[DataFrame] = []
    most = open_.agg(F.max("_inside")).first()[0] or 0
    if most > sorted_rows:
        rows = materialize(rows)
    while most > sorted_rows:
        large = F.col("_inside") > sorted_rows
        state = _narrowed(rows, group, materialize(open_.filter(large)), cells).unionByName(
            open_.filter(~large).withColumn("_value", nothing)
        )
        state = materialize(state)
        solved.append(state.filter("_value is not null").select(*group, "_r", "_value"))
        open_ = state.filter("_value is null").drop("_value")
        most = open_.agg(F.max("_inside")).first()[0] or 0
    parts = open_.select(*group, "_lo", "_hi").distinct()
    counted = (
        _inside(rows, group, parts).groupBy(*group, "_lo", "_hi", "_v").agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*group, "_lo", "_hi").orderBy("_v")
    placed = counted.withColumn("_end", F.sum("_c").over(upto))
    at = F.col("_r") - F.col("_below")
    last = (
        _null_safe(placed, open_, [*group, "_lo", "_hi"])
        .filter((at < F.col("_end")) & (at >= F.col("_end") - F.col("_c")))
        .select(*group, "_r", F.col("_v").alias("_value"))
    )
    for part in solved:
        last = last.unionByName(part)
    return last


def _inside(rows: DataFrame, group: list[str], parts: DataFrame) -> DataFrame:
    """Each row once for every part of its group that it lies in."""
    after = F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))
    before = F.col("_hi").isNull() | (F.col("_v") < F.col("_hi"))
    return _null_safe(rows, parts, group).filter(after & before)


def _narrowed(rows: DataFrame, group: list[str], wanted: DataFrame, cells: int) -> DataFrame:
    """One round: the wanted ranks with a smaller interval, or with their _value."""
    steps = [i / cells for i in range(cells + 1)]
    of = [*group, "_lo", "_hi"]
    grids = (
        _inside(rows, group, wanted.select(*of).distinct()).groupBy(*of)
        .agg(F.percentile_approx("_v", steps, ACCURACY).alias("_grid"))
    )
    cell = F.least(F.floor((F.col("_r") - F.col("_below")) / F.col("_inside") * cells), F.lit(cells - 1)).cast("int")
    cut = _null_safe(wanted, grids, of).withColumn("_cell", cell).withColumns({
        "_a": F.when(F.col("_cell") >= 1, F.get("_grid", F.col("_cell") - 1)),
        "_b": F.when(F.col("_cell") + 2 <= cells, F.get("_grid", F.col("_cell") + 2)),
    })
    cut = materialize(cut.drop("_grid", "_cell"))
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    counts = _inside(rows, group, cut.select(*of, "_a", "_b").distinct()).groupBy(*of, "_a", "_b").agg(
        F.count_if(v < a).alias("_under"), F.count_if(v == a).alias("_at_a"),
        F.count_if((a.isNull() | (v > a)) & (b.isNull() | (v < b))).alias("_mid"),
        F.count_if((v == b) & (a.isNull() | (a < b))).alias("_at_b"),
    )
    at = F.col("_r") - F.col("_below") - F.col("_under")
    begins, ends = F.col("_at_a"), F.col("_at_a") + F.col("_mid")
    missed = F.raise_error(F.lit("quantile sketch missed the rank")).cast("double")
    return _null_safe(cut, counts, [*of, "_a", "_b"]).select(
        *group, "_r", F.coalesce("_a", "_lo").alias("_lo"), F.coalesce("_b", "_hi").alias("_hi"),
        (F.col("_below") + F.col("_under") + begins).alias("_below"), F.col("_mid").alias("_inside"),
        F.when((at < 0) | (at >= ends + F.col("_at_b")), missed).when(at < begins, a).when(at >= ends, b).alias("_value"),
    )


def wide_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], **kwargs
) -> DataFrame:
    """`grouped_quantiles` with one column per quantile name (few groups)."""
    long = grouped_quantiles(df, keys, value, probs, **kwargs)
    picked = [
        F.max(F.when(F.col("quantile") == k, F.col("value"))).alias(k) for k in probs
    ]
    return long.groupBy(*keys).agg(*picked) if keys else long.agg(*picked)


def quantile_bins(df: DataFrame, columns: Sequence[str], bins: int = 5) -> dict[str, Column]:
    """Right-closed quantile bins with duplicate edges dropped; missing is -1.

    The edges are (bins + 1) numbers per column, so they become literals.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    long = df.select(F.explode(cells).alias("e")).select("e.name", "e.v")
    probs = {str(i): i / bins for i in range(bins + 1)}
    edges: dict[str, list[float]] = {c: [] for c in columns}
    for row in grouped_quantiles(long, ["name"], "v", probs).collect():
        edges[row["name"]].append(row["value"])
    return {c: _bin_column(F.col(c).cast("double"), sorted(set(edges[c]))) for c in columns}


def _bin_column(value: Column, edges: list[float]) -> Column:
    if len(edges) < 2:
        return F.lit(-1)
    passed = sum(((value > F.lit(e)).cast("int") for e in edges[1:]), (value > F.lit(edges[0])).cast("int"))
    return F.when(value.isNull(), F.lit(-1)).otherwise(F.greatest(passed, F.lit(1)) - 1)


def average_rank(value: str, groups: Sequence[str]) -> Column:
    """Rank with ties sharing their mean, over a result-sized relation."""
    low = F.rank().over(Window.partitionBy(*groups).orderBy(value))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*groups, value))
    return low + (peers - 1) / F.lit(2.0)


def rank_min(value: str, groups: Sequence[str] = (), descending: bool = False,
             missing: str = "keep") -> Column:
    """Competition rank on a result-sized relation.  `missing='bottom'` ranks
    NULL last, `missing='keep'` leaves it NULL."""
    column = F.col(value)
    key = column.desc_nulls_last() if descending else column.asc_nulls_last()
    ranked = F.rank().over(Window.partitionBy(*(groups or [F.lit(0)])).orderBy(key))
    return ranked if missing == "bottom" else F.when(column.isNotNull(), ranked)


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame,
    sorted_rows: int = SORTED_ROWS, cells: int = CELLS,
) -> DataFrame:
    """The value at each wanted rank: keys, rank, value.  `ranks` holds keys and `rank`
    (from 0); ranks beyond a group's end are left out."""
    keys = list(keys)
    group = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(g) for k, g in zip(keys, group)]
    rows = df.select(*named, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sizes = materialize(rows.groupBy(*group).agg(F.count("*").alias("_n")))
    wanted = ranks.select(*named, F.col("rank").cast("bigint").alias("_r")).distinct()
    wanted = _null_safe(sizes, wanted, group).filter(F.col("_r") < F.col("_n"))
    found = _values_at(rows, group, wanted, sorted_rows, cells)
    return found.select(
        *[F.col(g).alias(k) for k, g in zip(keys, group)], F.col("_r").alias("rank"), F.col("_value").alias("value")
    )
