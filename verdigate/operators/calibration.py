"""Grid calibration on chronological folds and shortcut perturbations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.functions.columns import is_true
from verdigate.operators.distributed import global_position, hash_position
from verdigate.operators.labels import apply_task_decision
from verdigate.operators.metrics import _task_aggregates
from verdigate.operators.rules import EXAMPLE_THRESHOLDS, Rule, decide_with

OBJECTIVES = (
    "material_harm_authorization_rate", "authority_violation_rate", "normalized_task_utility",
    "coverage",
)


def expand_grid(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """Candidates in lexical parameter order."""
    names = sorted(grid)
    return [
        dict(zip(names, values)) for values in product(*[sorted(map(float, grid[n])) for n in names])
    ]


def fold_metrics(
    folded: DataFrame, rules: Mapping[str, Rule], grids: Mapping[str, Mapping[str, Sequence[float]]],
    base: Mapping[str, float] = EXAMPLE_THRESHOLDS, fold: str = "fold",
) -> DataFrame:
    """Objectives of every rule, candidate and fold in one pass over the data.

    Each row meets every candidate through a literal array; the aggregation is
    combined map-side, so the shuffle has one row per rule, candidate and fold.
    """
    decisions = [
        F.struct(
            F.lit(name).alias("rule"), F.lit(i).alias("candidate_id"),
            rules[name].build({**base, **candidate}).alias("decision"),
        )
        for name, grid in grids.items()
        for i, candidate in enumerate(expand_grid(grid))
    ]
    ruled = apply_task_decision(folded.select("*", F.inline(F.array(*decisions))))
    wanted = _task_aggregates()
    return ruled.groupBy("rule", "candidate_id", fold).agg(
        F.count("*").alias("rows"), F.count_if("authorized").alias("authorized_count"),
        *[wanted[m].alias(m) for m in OBJECTIVES],
    )


def candidate_summary(
    folds: DataFrame, grids: Mapping[str, Mapping[str, Sequence[float]]]
) -> DataFrame:
    """Out-of-fold means per candidate; an N/A fold makes the mean N/A.  Parameters
    are attached as an ordered array of (name, value)."""
    means = folds.groupBy("rule", "candidate_id").agg(
        F.count("*").alias("folds"),
        *[
            F.when(F.count(m) == F.count("*"), F.avg(m)).alias(f"mean_oof_{m}")
            for m in OBJECTIVES
        ],
    )
    rows = [
        (name, i, [v for _, v in sorted(c.items())], ",".join(f"{k}={v:g}" for k, v in sorted(c.items())))
        for name, grid in grids.items()
        for i, c in enumerate(expand_grid(grid))
    ]
    parameters = folds.sparkSession.createDataFrame(
        rows, "rule STRING, candidate_id INT, parameter_values ARRAY<DOUBLE>, parameters STRING"
    )
    return means.join(F.broadcast(parameters), ["rule", "candidate_id"])


def select_candidates(summary: DataFrame, coverage_floor: float) -> DataFrame:
    """Lexicographic best candidate per rule above the coverage floor, or an N/A row."""
    known = F.lit(True)
    for m in OBJECTIVES:
        known = known & F.col(f"mean_oof_{m}").isNotNull()
    fit = known & is_true(F.col("mean_oof_coverage") >= coverage_floor)
    order = F.struct(
        F.col("mean_oof_material_harm_authorization_rate"),
        F.col("mean_oof_authority_violation_rate"),
        -F.col("mean_oof_normalized_task_utility"), -F.col("mean_oof_coverage"),
        F.col("parameter_values"),
    )
    chosen = F.min_by(F.struct("candidate_id", "parameters"), F.when(fit, order))
    out = summary.groupBy("rule").agg(
        F.when(F.count_if(fit) > 0, chosen).alias("_c"),
        F.count_if(fit).alias("candidates_meeting_floor"),
        F.max("mean_oof_coverage").alias("max_observed_coverage"),
    )
    valid = F.col("candidates_meeting_floor") > 0
    return out.select(
        "rule", valid.alias("calibration_valid"),
        F.when(valid, "CALIBRATED").otherwise("NO_ELIGIBLE_CANDIDATE_COVERAGE_FLOOR").alias(
            "calibration_status"
        ),
        F.col("_c.candidate_id").alias("selected_candidate_id"),
        F.col("_c.parameters").alias("selected_parameters"),
        "candidates_meeting_floor", "max_observed_coverage",
    )


def mask_uncalibrated(metrics: DataFrame, status: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Blank the metrics of rules without a valid calibration.  Rules that were not
    calibrated at all keep theirs."""
    s = status.select("rule", "calibration_valid", "calibration_status")
    joined = metrics.join(s, "rule", "left").withColumns(
        {
            "calibration_valid": F.coalesce("calibration_valid", F.lit(True)),
            "calibration_status": F.coalesce("calibration_status", F.lit("FIXED_FORM_NOT_RECALIBRATED")),
        }
    )
    fields = [c for c in metrics.columns if c not in ("rule", *keep)]
    masked = joined.withColumns({c: F.when(F.col("calibration_valid"), F.col(c)) for c in fields})
    return masked.withColumn(
        "structural_n_a_reason", F.when(~F.col("calibration_valid"), F.col("calibration_status"))
    )


def mask_decisions(ruled: DataFrame, status: DataFrame) -> DataFrame:
    """Decisions of invalid rules become 'not_evaluated' and authorize nothing."""
    s = status.select("rule", F.col("calibration_valid").alias("_v"))
    valid = F.coalesce("_v", F.lit(True))
    return ruled.join(F.broadcast(s), "rule", "left").withColumns(
        {
            "decision": F.when(valid, F.col("decision")).otherwise("not_evaluated"),
            "calibration_valid": valid,
        }
    ).drop("_v")


def chosen_parameters(status: DataFrame) -> DataFrame:
    """rule and `chosen`, a map of the selected threshold values, of each calibrated rule."""
    pairs = F.str_to_map("selected_parameters", F.lit(","), F.lit("="))
    values = F.transform_values(pairs, lambda _, v: v.cast("double"))
    return status.filter("calibration_valid").select("rule", values.alias("chosen"))


def recalibrated_decisions(df: DataFrame, rules: Sequence[Rule], status: DataFrame) -> DataFrame:
    """Decisions under the thresholds that calibration chose; rules for which it found
    none are `not_evaluated` and authorize nothing."""
    return apply_task_decision(mask_decisions(decide_with(df, rules, chosen_parameters(status)), status))


def first_by(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row with the smallest order key per group; NULL keys go last."""
    ranked = Window.partitionBy(*groups).orderBy(*[c.asc_nulls_last() for c in order])
    return df.withColumn("_r", F.row_number().over(ranked)).filter("_r = 1").drop("_r")


def masked_variants(medians: Mapping[str, float]) -> dict[str, dict[str, Column]]:
    """Column replacements of each masking perturbation."""
    m = {c: F.lit(float(v)) for c, v in medians.items()}
    return {
        "original": {},
        "mask_confidence": {"confidence": m["confidence"]},
        "mask_uncertainty": {"uncertainty": m["uncertainty"]},
        "mask_expected_edge": {"expected_edge_bps": m["expected_edge_bps"]},
        "mask_cost": {
            c: m[c] for c in ("liquidity_cost_bps", "turnover_cost_bps", "fee_bps")
        },
        "mask_role": {"source_role": F.lit("edge_proposer")},
        "mask_source_name": {"current_source_id": F.lit("masked_source")},
        "mask_stress_tag": {"stress_tag": F.lit("masked_stress")},
    }


def explode_variants(df: DataFrame, variants: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Every row under every variant, with only the touched columns repeated."""
    touched = sorted({c for v in variants.values() for c in v} & set(df.columns))
    rows = [
        F.struct(
            F.lit(name).alias("variant"), *[v.get(c, F.col(c)).alias(c) for c in touched]
        )
        for name, v in variants.items()
    ]
    rest = [c for c in df.columns if c not in touched]
    return df.select(*rest, F.inline(F.array(*rows)))


def permute_columns(df: DataFrame, row_id: str, columns: Sequence[str], seed: int) -> DataFrame:
    """The column bundle dealt to other rows: the row at position i in id order gets
    the bundle of the row at position i in seeded hash order."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))
    bundle = hash_position(df.select(row_id, *columns), row_id, digest=digest).drop(row_id)
    base = global_position(df.drop(*columns), [row_id])
    return base.join(bundle, "position").drop("position").select(*df.columns)
