"""Fitted gates, learners, thresholds and masked scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators import labels, learn, metrics, rules
from verdigate.operators.distributed import grouped_quantiles, materialize
from verdigate.plans.inference import RATE_SQL, scored_frame
from verdigate.plans.proxies import DECISION_SQL, decision_view, provenance_view
from verdigate.plans.registry import query

FEATURES = learn.Features()


def layer(spark: SparkSession, directory: str, split: str) -> DataFrame:
    v = decision_view(spark, directory).filter(F.col("split") == split)
    return labels.training_schema(v, FEATURES.all, "controlled").withColumns(
        {
            "training_label": labels.safety_label(),
            "authorization_harm": 1 - labels.safety_label(),
            "authority_laundering": ~F.col("original_source_eligible"),
            "evaluation_cluster_id": F.col("training_cluster_id"),
            "evaluation": F.col("opportunity_slice"),
        }
    )


def evaluate(model, frame: DataFrame, threshold: float) -> DataFrame:
    scored = learn.authorize(learn.score(model, frame, FEATURES), threshold)
    return metrics.cluster_rate_bounds(scored, ["evaluation"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("ML1_ML4_logistic_gate")
def logistic_gate(spark, directory):
    """Logistic model, fixed-coverage threshold, per-mechanism cluster rates."""
    model = learn.fit(layer(spark, directory, "train"), FEATURES)
    validation = materialize(layer(spark, directory, "validation"))
    threshold = learn.coverage_threshold(learn.score(model, validation, FEATURES), 0.20)
    return evaluate(model, validation, threshold)


@query("ML2_ML3_learner_comparison")
def learner_comparison(spark, directory):
    """Boosting, perceptron and selective logistic on the same data."""
    train = materialize(layer(spark, directory, "train"))
    validation = materialize(layer(spark, directory, "validation"))
    parts = []
    for learner in ("boosting", "perceptron", "selective_logistic"):
        model = learn.fit(train, FEATURES, learner)
        scored = materialize(learn.score(model, validation, FEATURES))
        if learner == "selective_logistic":
            threshold, target, valid = learn.selective_threshold(
                scored, "evaluation", (0.05, 0.10, 0.20), 0.05
            )
        else:
            threshold, target, valid = learn.coverage_threshold(scored, 0.20), 0.20, True
        bounds = metrics.cluster_rate_bounds(learn.authorize(scored, threshold), ["evaluation"])
        parts.append(
            bounds.withColumns({"learner": F.lit(learner), "target_coverage": F.lit(target),
                                "calibration_floor_satisfied": F.lit(valid)})
        )
    return _union(parts)


@query("R16_provenance_learned_gate")
def provenance_learned_gate(spark, directory):
    """Learned gate fitted on the training split, used next to the fixed rules."""
    features = learn.Features(
        ("confidence", "uncertainty", "expected_edge_bps", "liquidity_cost_bps",
         "turnover_cost_bps", "fee_bps", "hop_depth"),
        ("current_role_verified", "lineage_attested", "claimed_role", "verified_current_role",
         "transformation_type", "traceability"),
    )
    p = provenance_view(spark, directory)
    safe = (
        F.col("current_source_eligible") & ~F.col("authority_laundering") & ~F.col("direct_leakage")
    ).cast("int")
    model = learn.fit(
        p.filter(F.col("split") == "train").withColumn("training_label", safe), features
    )
    scored = learn.score(model, p.filter(F.col("split") != "train"), features, "safe_probability")
    gate = rules.learned_gate(0.7, 0.4, features.all)
    ruled = labels.laundering_outcomes(rules.decide(scored, rules.provenance_rules(gate)))
    return metrics.laundering_metrics(ruled, ["rule"])


@query(
    "T8_higher_quantile",
    f"""WITH {DECISION_SQL}, o AS (
      SELECT split, confidence + uncertainty AS s, row_number() OVER (PARTITION BY split
        ORDER BY confidence + uncertainty) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM v)
    SELECT split, n, max(s) FILTER (WHERE i = CAST(ceil((n - 1) * 0.8e0) AS BIGINT)) AS threshold
    FROM o GROUP BY 1, 2""",
    ("threshold",),
)
def higher_quantile(spark, directory):
    v = decision_view(spark, directory).withColumn("s", F.col("confidence") + F.col("uncertainty"))
    return grouped_quantiles(v, ["split"], "s", {"t": 0.8}, method="higher").select(
        "split", "n", F.col("value").alias("threshold")
    )


@query(
    "A23_seed_aggregates",
    f"""{RATE_SQL}, s AS (SELECT evaluation, event_cluster_id % 3 AS seed, avg(coverage) AS coverage,
      avg(far) AS far FROM cr GROUP BY 1, 2)
    SELECT evaluation, avg(coverage) AS coverage_mean, stddev_samp(coverage) AS coverage_std,
      avg(far) AS far_mean, stddev_samp(far) AS far_std FROM s GROUP BY 1""",
    ("coverage_mean", "coverage_std", "far_mean", "far_std"),
)
def seed_aggregates(spark, directory):
    seeded = scored_frame(spark, directory).withColumn("seed", F.col("event_cluster_id") % 3)
    runs = metrics.cluster_rate_metrics(seeded, ["evaluation", "seed"])
    return metrics.seed_aggregate(runs, ["evaluation"], ["coverage", "far"])


@query("ML4_role_masked_scoring")
def role_masked_scoring(spark, directory):
    """Scores of the fitted model when a feature group is masked."""
    model = learn.fit(layer(spark, directory, "train"), FEATURES)
    validation = materialize(layer(spark, directory, "validation"))
    threshold = learn.coverage_threshold(learn.score(model, validation, FEATURES), 0.20)
    parts = []
    for group in ("none", "role", "cost", "belief"):
        frame = validation if group == "none" else labels.mask_group(validation, group, FEATURES.categorical)
        scored = learn.authorize(learn.score(model, frame, FEATURES), threshold)
        parts.append(
            metrics.cluster_rate_metrics(scored, []).withColumn("masked_group", F.lit(group))
        )
    return _union(parts)
