"""Certification grids, volumes, frontiers on bound and metric tables.

These relations have one row per rule and profile; grids are literal arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.functions.columns import clip, is_true
from verdigate.operators.distributed import rank_min

# Certification grid and the policy grids.
HARM_THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
LAUNDERING_THRESHOLDS = (0.00, 0.01, 0.02, 0.05)
MIN_COVERAGE = (0.05, 0.10, 0.20, 0.30, 0.50)

Grid = tuple[Sequence[float], Sequence[float], Sequence[float]]

POLICY_GRIDS: dict[str, Grid] = {
    "frozen": (HARM_THRESHOLDS, LAUNDERING_THRESHOLDS, MIN_COVERAGE),
    "conservative_institution": (
        (0.05, 0.10, 0.15), (0.00, 0.005, 0.01), (0.10, 0.20, 0.30, 0.50)),
    "balanced_platform": (
        (0.10, 0.20, 0.30, 0.40), (0.00, 0.02, 0.05, 0.10), (0.10, 0.20, 0.40, 0.60)),
    "coverage_priority_research": (
        (0.15, 0.30, 0.45, 0.60), (0.00, 0.05, 0.10, 0.20), (0.20, 0.40, 0.60, 0.75)),
    "lineage_integrity_first": (
        (0.10, 0.20, 0.30), (0.00, 0.005, 0.01, 0.02), (0.05, 0.10, 0.20, 0.30)),
}


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def certification_surface(
    bounds: DataFrame,
    keys: Sequence[str] = ("rule", "profile"),
    harm: Sequence[float] = HARM_THRESHOLDS,
    laundering: Sequence[float] = LAUNDERING_THRESHOLDS,
    coverage: Sequence[float] = MIN_COVERAGE,
) -> DataFrame:
    """Every bound against every grid cell; a missing bound fails its cells."""
    cells = (
        bounds.select(*keys, "far_ucb95", "alr_ucb95", "coverage_lcb95",
                      F.explode(_doubles(harm)).alias("tau_h"))
        .select("*", F.explode(_doubles(laundering)).alias("tau_a"))
        .select("*", F.explode(_doubles(coverage)).alias("c_min"))
    )
    far, alr, cov = F.col("far_ucb95"), F.col("alr_ucb95"), F.col("coverage_lcb95")
    ok_far, ok_alr = is_true(far <= F.col("tau_h")), is_true(alr <= F.col("tau_a"))
    ok_cov = is_true(cov >= F.col("c_min"))
    return cells.select(
        *keys, "tau_h", "tau_a", "c_min",
        (ok_far & ok_alr & ok_cov).alias("passed"),
        (~ok_far).alias("failure_far"),
        (~ok_alr).alias("failure_alr"),
        is_true(cov < F.col("c_min")).alias("failure_coverage"),
    )


def certification_volume(surface: DataFrame, keys: Sequence[str] = ("rule", "profile")) -> DataFrame:
    return surface.groupBy(*keys).agg(
        F.avg(F.col("passed").cast("double")).alias("certification_volume")
    )


def worst_profile_volume(
    volumes: DataFrame, keys: Sequence[str] = ("rule",),
    profiles: Sequence[str] = ("overall", "stress"),
) -> DataFrame:
    """Volume per profile as columns and the smaller of the scored ones."""
    wide = volumes.filter(F.col("profile").isin(*profiles)).groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("profile") == p, F.col("certification_volume"))).alias(p)
            for p in profiles
        ]
    )
    return wide.withColumn(
        "worst_profile_certification_volume", F.least(*[F.col(p) for p in profiles])
    )


def policy_volumes(bounds: DataFrame, policies: Mapping[str, Grid] = POLICY_GRIDS) -> DataFrame:
    """Worst-profile volume and rank of each rule under each named policy grid."""
    scored = bounds.filter(F.col("profile").isin("overall", "stress"))
    parts = [
        certification_volume(certification_surface(scored, harm=h, laundering=a, coverage=c))
        .withColumn("policy", F.lit(name))
        for name, (h, a, c) in policies.items()
    ]
    volumes = parts[0]
    for p in parts[1:]:
        volumes = volumes.unionByName(p)
    worst = volumes.groupBy("policy", "rule").agg(
        F.min("certification_volume").alias("worst_profile_volume")
    )
    return worst.withColumn(
        "rank", rank_min("worst_profile_volume", ["policy"], descending=True).cast("bigint")
    )


def policy_summary(volumes: DataFrame) -> DataFrame:
    return (
        volumes.groupBy("rule")
        .agg(
            F.avg("worst_profile_volume").alias("mean_volume"),
            F.min("worst_profile_volume").alias("min_volume"),
            F.max("worst_profile_volume").alias("max_volume"),
            F.min("rank").alias("min_rank"),
            F.max("rank").alias("max_rank"),
        )
        .withColumn("rank_range", F.col("max_rank") - F.col("min_rank"))
    )


def hypervolume(
    bounds: DataFrame, far_reference: float = 1.0, alr_reference: float = 0.25
) -> DataFrame:
    """Continuous volume between the bounds and a reference point; 0 if any is N/A."""
    far, alr, cov = F.col("far_ucb95"), F.col("alr_ucb95"), F.col("coverage_lcb95")
    span = (
        clip((F.lit(far_reference) - far) / F.lit(far_reference), 0.0, 1.0)
        * clip((F.lit(alr_reference) - alr) / F.lit(alr_reference), 0.0, 1.0)
        * clip(cov, 0.0, 1.0)
    )
    known = far.isNotNull() & alr.isNotNull() & cov.isNotNull()
    volume = F.when(known, span).otherwise(F.lit(0.0))

    def at(profile: str) -> Column:
        found = F.max(F.when(F.col("profile") == profile, F.col("_hv")))
        return F.coalesce(found, F.lit(0.0)).alias(profile)

    return (
        bounds.withColumn("_hv", volume)
        .groupBy("rule")
        .agg(at("overall"), at("stress"))
        .withColumn("worst_profile_hypervolume", F.least("overall", "stress"))
    )


def pareto_flags(
    metrics: DataFrame, keys: Sequence[str], groups: Sequence[str] = (),
    maximise: Sequence[str] = ("coverage",), minimise: Sequence[str] = ("far", "alr", "moc"),
) -> DataFrame:
    """Rows no other row of the group dominates.  Missing objectives never count.

    A group is a rule registry.  Its objective vectors are packed once per group
    and every row is tested against that array, so no pairs are produced.
    """
    names = [*maximise, *minimise]
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull()
    vector = F.struct(
        *[F.col(c).alias(c) for c in maximise], *[(-F.col(c)).alias(c) for c in minimise]
    )
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    rivals = F.collect_set(F.when(known, vector)).over(whole)
    mine = metrics.withColumns({"_known": known, "_v": vector, "_rivals": rivals})

    def dominates(rival: Column) -> Column:
        never_worse, somewhere_better = F.lit(True), F.lit(False)
        for c in names:
            never_worse = never_worse & (rival[c] >= F.col(f"_v.{c}"))
            somewhere_better = somewhere_better | (rival[c] > F.col(f"_v.{c}"))
        return never_worse & somewhere_better

    efficient = F.col("_known") & ~is_true(F.exists("_rivals", dominates))
    return mine.select(*groups, *keys, *names, efficient.alias("pareto_efficient"))


def threshold_sensitivity(surface: DataFrame) -> DataFrame:
    """Pass fraction by each single grid dimension, one scan of the surface."""
    dims = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).alias("threshold"))
            for d in ("tau_h", "tau_a", "c_min")
        ]
    )
    return (
        surface.select("rule", "profile", "passed", F.inline(dims))
        .groupBy("dimension", "rule", "profile", "threshold")
        .agg(F.avg(F.col("passed").cast("double")).alias("pass_fraction"))
    )
