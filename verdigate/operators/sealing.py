"""Data sets in two sides: features that a rule may read, and outcomes sealed until the
evaluation.  Only the keys, the cluster and the split stand on both sides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators.distributed import materialize
from verdigate.operators.structure import checked_join, chronological_split
from verdigate.sources.sinks import publish_partitions

FEATURES, OUTCOMES, REGISTRY = "features", "outcomes", "registry"


@dataclass(frozen=True)
class Seal:
    """What names a row, which columns (by their beginnings) are known only after the
    decision, and how clusters are cut in time: named counts, then the rest."""

    keys: Sequence[str]
    sealed: Sequence[str]
    bounds: Sequence[tuple[str, int]]
    rest: str
    cluster: str = "event_cluster_id"
    timestamp: str = "decision_timestamp"

    @property
    def splits(self) -> list[str]:
        return [*[name for name, _ in self.bounds], self.rest]

    @property
    def shared(self) -> list[str]:
        return [*self.keys, self.cluster, "split"]


def two_sides(rows: DataFrame, seal: Seal) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, outcomes and the split of each cluster.

    `rows` should be a stored table, since it is read three times.  A row without a
    cluster has no split and stops the job; a beginning that fits no column, or a key
    that would be sealed, is an error."""
    hidden = [c for c in rows.columns if c.startswith(tuple(seal.sealed))]
    idle = [p for p in seal.sealed if not any(c.startswith(p) for c in hidden)]
    if idle:
        raise ValueError(f"no column to seal begins with {idle}")
    clash = sorted({*seal.keys, seal.cluster, seal.timestamp} & set(hidden))
    if clash or "split" in rows.columns:
        raise ValueError(f"columns of both sides cannot be sealed or given: {clash or ['split']}")
    registry = chronological_split(
        rows.filter(F.col(seal.cluster).isNotNull()), seal.cluster, seal.timestamp, seal.bounds, seal.rest
    ).select(seal.cluster, "split")
    unplaced = F.raise_error(F.lit("a row has no cluster and hence no split")).cast("string")
    placed = rows.join(registry, seal.cluster, "left").withColumn("split", F.coalesce("split", unplaced))
    features = placed.select(*seal.keys, *[c for c in rows.columns if c not in (*seal.keys, *hidden)], "split")
    return features, placed.select(*seal.shared, *hidden), registry


def publish_sides(rows: DataFrame, path: str, seal: Seal) -> dict[str, int]:
    """Write both sides by split and the registry below `path`; returns rows per split.

    Each side is staged, counted and renamed once; published sides are never
    overwritten.  The features are open to all, so they are written last: whoever finds
    them finds their outcomes too."""
    features, outcomes, registry = two_sides(materialize(rows), seal)
    registry.write.mode("errorifexists").parquet(f"{path}/{REGISTRY}")
    sealed = publish_partitions(outcomes, f"{path}/{OUTCOMES}", seal.splits, "split")
    opened = publish_partitions(features, f"{path}/{FEATURES}", seal.splits, "split")
    if sealed != opened:
        raise ValueError(f"sides differ in rows: features {opened}, outcomes {sealed}")
    return opened


def read_side(spark: SparkSession, path: str, side: str, splits: Sequence[str]) -> DataFrame:
    """One side; the split is the folder, so other splits are not read."""
    return spark.read.parquet(f"{path}/{side}").filter(F.col("split").isin(*splits))


def unseal(
    spark: SparkSession, path: str, seal: Seal, splits: Sequence[str], required: Sequence[str] = (),
) -> DataFrame:
    """Features with their outcomes, for the splits that may be evaluated.  The last
    split stays sealed; keys must be unique and every `required` outcome present."""
    known = [name for name, _ in seal.bounds]
    refused = sorted(set(splits) - set(known))
    if refused:
        raise ValueError(f"splits may not be unsealed: {refused}")
    features = read_side(spark, path, FEATURES, splits)
    outcomes = read_side(spark, path, OUTCOMES, splits)
    both = sorted(set(features.columns) & set(outcomes.columns) - set(seal.shared))
    if both:
        raise ValueError(f"sealed columns among the features: {both}")
    return checked_join(features, outcomes.drop(seal.cluster, "split"), seal.keys, required=required)
