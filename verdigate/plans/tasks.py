"""Two-task proposals: outcomes, metrics, subgroups, source quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators import labels, metrics, rules
from verdigate.operators.distributed import materialize, wide_quantiles
from verdigate.plans import sql_rules as S
from verdigate.plans.proxies import TWO_TASK_SQL, two_task_inputs
from verdigate.plans.registry import query


def task_frame(spark: SparkSession, directory: str, lines: DataFrame | None = None) -> DataFrame:
    return labels.two_task_outcomes(two_task_inputs(spark, directory, lines))


def task_decisions(spark: SparkSession, directory: str) -> DataFrame:
    return labels.apply_task_decision(
        rules.decide(task_frame(spark, directory), rules.two_task_rules())
    )


WITH_TD = f"WITH {TWO_TASK_SQL}, {S.task_outcomes(S.TWO_TASK)}"


@query(
    "R22_two_task_rules",
    f"WITH {TWO_TASK_SQL}, d AS ({S.ruled(S.TWO_TASK, 't')}) "
    "SELECT rule, decision, count(*) AS n FROM d GROUP BY 1, 2",
)
def two_task_routes(spark, directory):
    ruled = rules.decide(task_frame(spark, directory), rules.two_task_rules())
    return ruled.groupBy("rule", "decision").agg(F.count("*").alias("n"))


_SUMS = ("full_task_utility", "reduced_task_utility", "normalized_full_task_utility",
         "normalized_reduced_task_utility", "gross_return_bps")
_FLAGS = ("economic_loss_full", "economic_loss_reduced", "material_harm_full",
          "material_harm_reduced", "tail_harm_full", "tail_harm_reduced", "risk_event",
          "material_risk_event", "candidate_benign_opportunity")


def _outcome_sql(task: str) -> str:
    sums = ", ".join(f"sum({c}) AS {c}" for c in _SUMS)
    flags = ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in _FLAGS)
    return (
        f"WITH {TWO_TASK_SQL} SELECT model_id, symbol, count(*) AS rows, {sums}, {flags} "
        f"FROM t WHERE task_id = '{task}' GROUP BY 1, 2"
    )


def _outcome_totals(df: DataFrame, task: str) -> DataFrame:
    return df.filter(F.col("task_id") == task).groupBy("model_id", "symbol").agg(
        F.count("*").alias("rows"),
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.count_if(c).alias(c) for c in _FLAGS],
    )


@query("PRJ14_directional_outcomes", _outcome_sql(labels.DIRECTIONAL), _SUMS)
def directional_outcomes(spark, directory):
    return _outcome_totals(task_frame(spark, directory), labels.DIRECTIONAL)


@query("PRJ15_risk_limit_outcomes", _outcome_sql(labels.RISK_LIMIT), _SUMS)
def risk_limit_outcomes(spark, directory):
    return _outcome_totals(task_frame(spark, directory), labels.RISK_LIMIT)


@query(
    "PRJ16_selected_task_outcomes",
    f"""{WITH_TD} SELECT rule, task_id, sum(selected_task_utility) AS utility,
      count(*) FILTER (WHERE selected_economic_loss) AS losses,
      count(*) FILTER (WHERE selected_tail_harm) AS tails,
      count(*) FILTER (WHERE authority_violation) AS violations,
      count(*) FILTER (WHERE missed_benign) AS missed FROM td GROUP BY 1, 2""",
    ("utility",),
)
def selected_task_outcomes(spark, directory):
    return task_decisions(spark, directory).groupBy("rule", "task_id").agg(
        F.sum("selected_task_utility").alias("utility"),
        F.count_if("selected_economic_loss").alias("losses"),
        F.count_if("selected_tail_harm").alias("tails"),
        F.count_if("authority_violation").alias("violations"),
        F.count_if("missed_benign").alias("missed"),
    )


@query(
    "A5_A6_two_task_metrics",
    f"""{WITH_TD}, tp AS (
      SELECT *, 'overall' AS profile FROM td UNION ALL SELECT *, task_id FROM td)
    {S.task_metrics("tp", "rule, profile")}""",
    S.TASK_DOUBLES,
)
def two_task_metrics(spark, directory):
    profiled = labels.explode_profiles(
        task_decisions(spark, directory), labels.task_profiles()
    )
    return metrics.task_metrics(profiled, ["rule", "profile"])


REGIME_SQL = f"""{TWO_TASK_SQL},
rc AS (SELECT event_cluster_id, avg(volatility_bps) AS m FROM t GROUP BY 1),
rt AS (SELECT quantile_cont(m, 0.5) AS threshold FROM rc),
tr AS (
  SELECT t.*, CASE WHEN m > threshold THEN 'high' ELSE 'low' END AS volatility_regime, threshold
  FROM t JOIN rc USING (event_cluster_id), rt)"""


def with_regime(df: DataFrame) -> DataFrame:
    """High or low volatility by the cluster mean against the median cluster mean."""
    # Written down, it is made once, and a small one is broadcast to the rows.
    means = materialize(df.groupBy("event_cluster_id").agg(F.avg("volatility_bps").alias("_m")))
    threshold = wide_quantiles(means, [], "_m", {"t": 0.5}).first()["t"]
    regimes = means.select(
        "event_cluster_id",
        F.when(F.col("_m") > threshold, "high").otherwise("low").alias("volatility_regime"),
    )
    return df.join(regimes, "event_cluster_id").withColumn(
        "volatility_regime_threshold_bps", F.lit(threshold)
    )


@query(
    "W11_volatility_regime",
    f"""WITH {REGIME_SQL} SELECT volatility_regime, count(*) AS rows,
      count(DISTINCT event_cluster_id) AS clusters, max(threshold) AS threshold_bps
    FROM tr GROUP BY 1""",
    ("threshold_bps",),
)
def volatility_regime(spark, directory):
    return with_regime(task_frame(spark, directory)).groupBy("volatility_regime").agg(
        F.count("*").alias("rows"),
        F.countDistinct("event_cluster_id").alias("clusters"),
        F.max("volatility_regime_threshold_bps").alias("threshold_bps"),
    )


DIMENSIONS = ("model_id", "symbol", "volatility_regime", "task_id")


@query(
    "A4_subgroup_metrics",
    f"""WITH {REGIME_SQL}, {S.task_outcomes(S.TWO_TASK, 'tr')}, sg AS (
      {" UNION ALL ".join(f"SELECT *, '{d}' AS dimension, {d} AS value FROM td" for d in DIMENSIONS)})
    {S.task_metrics("sg", "rule, dimension, value")}""",
    S.TASK_DOUBLES,
)
def subgroup_metrics(spark, directory):
    ruled = labels.apply_task_decision(
        rules.decide(with_regime(task_frame(spark, directory)), rules.two_task_rules())
    )
    return metrics.subgroup_metrics(ruled, DIMENSIONS)


@query(
    "A8_cluster_components",
    f"""{WITH_TD} SELECT rule, event_cluster_id, 'coverage' AS metric,
      sum(CAST(authorized AS DOUBLE)) AS numerator, count(*) * 1.0e0 AS denominator
    FROM td GROUP BY 1, 2
    UNION ALL SELECT rule, event_cluster_id, 'material_harm_authorization_rate',
      sum(CAST(authorized AND selected_material_harm AS DOUBLE)),
      sum(CAST(authorized AS DOUBLE)) FROM td GROUP BY 1, 2
    UNION ALL SELECT rule, event_cluster_id, 'missed_benign_opportunity',
      sum(CAST(missed_benign AS DOUBLE)), sum(CAST(candidate_benign_opportunity AS DOUBLE))
    FROM td GROUP BY 1, 2""",
    ("numerator", "denominator"),
)
def cluster_components(spark, directory):
    return metrics.cluster_components(
        task_decisions(spark, directory), ["rule"],
        metrics=("coverage", "material_harm_authorization_rate", "missed_benign_opportunity"),
    )


@query(
    "A18_source_quality",
    f"""WITH {TWO_TASK_SQL} SELECT model_id, task_id, count(*) AS rows,
      count(DISTINCT event_cluster_id) AS clusters,
      avg(CAST(raw_schema_valid AS DOUBLE)) AS raw_schema_validity,
      avg(CAST(malformed_placeholder AS DOUBLE)) AS malformed_placeholder_rate,
      CAST(0 AS INTEGER) AS repairs_applied,
      avg(CAST(NOT active AS DOUBLE)) AS proposal_abstain_rate,
      avg(confidence) AS mean_confidence, avg(uncertainty) AS mean_uncertainty,
      avg(CAST(review_recommended AS DOUBLE)) AS review_recommended_rate,
      avg(CAST(NOT original_source_eligible AS DOUBLE)) AS role_ineligible_rate,
      count(*) FILTER (WHERE active AND confidence >= 0.72e0) AS high_confidence_nonabstain_count,
      count(*) FILTER (WHERE active AND confidence >= 0.72e0 AND material_harm_full)
        AS material_harm_high_confidence_count,
      avg(CASE WHEN active AND confidence >= 0.72e0 THEN CAST(material_harm_full AS DOUBLE) END)
        AS material_harm_overconfidence_rate
    FROM t GROUP BY 1, 2""",
    ("raw_schema_validity", "malformed_placeholder_rate", "proposal_abstain_rate",
     "mean_confidence", "mean_uncertainty", "review_recommended_rate", "role_ineligible_rate",
     "material_harm_overconfidence_rate"),
)
def source_quality(spark, directory):
    return metrics.source_quality(task_frame(spark, directory))
