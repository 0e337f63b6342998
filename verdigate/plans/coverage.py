"""Core rules, decision outcomes, profile metrics, review load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators import labels, metrics, rules
from verdigate.operators.distributed import rank_min
from verdigate.plans import sql_rules as S
from verdigate.plans.proxies import DECISION_SQL, decision_view
from verdigate.plans.registry import query

WITH_D = f"WITH {DECISION_SQL}, {S.outcomes(S.CORE, 'v')}"


def core_decisions(spark: SparkSession, directory: str, lines: DataFrame | None = None) -> DataFrame:
    return labels.decision_outcomes(
        rules.decide(decision_view(spark, directory, lines), rules.core_rules())
    )


def _route_counts(ruled: DataFrame) -> DataFrame:
    return ruled.groupBy("rule", "decision").agg(F.count("*").alias("n"))


def _route_sql(rule_sql: dict[str, str], cte: str, source: str) -> str:
    return (
        f"WITH {cte}, d AS ({S.ruled(rule_sql, source)}) "
        "SELECT rule, decision, count(*) AS n FROM d GROUP BY 1, 2"
    )


@query("R1_R8_core_rules", _route_sql(S.CORE, DECISION_SQL, "v"))
def core_rule_routes(spark, directory):
    return _route_counts(rules.decide(decision_view(spark, directory), rules.core_rules()))


@query(
    "R9_rule_output_validation",
    f"WITH {DECISION_SQL}, d AS ({S.ruled(S.CORE, 'v')}) "
    "SELECT rule, count(*) AS rows, count(*) FILTER (WHERE decision IS NULL OR decision NOT IN "
    "('execute', 'reduce', 'review', 'abstain')) AS invalid_rows, "
    "count(*) FILTER (WHERE decision IS NULL OR decision NOT IN "
    "('execute', 'reduce', 'review', 'abstain')) = 0 AS valid FROM d GROUP BY 1",
)
def rule_output_validation(spark, directory):
    return rules.invalid_decisions(
        rules.decide(decision_view(spark, directory), rules.core_rules())
    )


# Example grid for the public rule family.
PUBLIC_GRID = {
    "confidence": (0.55, 0.75),
    "uncertainty": (0.25, 0.50),
    "edge_bps": (20.0, 60.0),
    "cost_margin_bps": (0.0, 25.0),
    "fee_bps": (5.0, 10.0),
    "risk": ((20.0, 0.60), (30.0, 1.00)),
    "horizon_hours": (12, 36),
    "lifecycle": (("strict", 30.0, 0.50, 0.80), ("loose", 10.0, 0.90, 1.10)),
    "epv": (0.0, 0.30),
}
PUBLIC_SQL = {
    "No Action": "'abstain'",
    "Direct Prior": "'execute'",
    "Confidence Gate [0.55]": S.gate("confidence >= 0.55e0"),
    "Confidence Gate [0.75]": S.gate("confidence >= 0.75e0"),
    "Uncertainty Gate [0.25]": S.gate("uncertainty <= 0.25e0"),
    "Uncertainty Gate [0.50]": S.gate("uncertainty <= 0.5e0"),
    "Edge Gate [20 bps]": S.gate("expected_edge_bps >= 20.0e0"),
    "Edge Gate [60 bps]": S.gate("expected_edge_bps >= 60.0e0"),
    "Cost-Aware Gate [0 bps]": S.gate(f"{S.MARGIN} >= 0.0e0"),
    "Cost-Aware Gate [25 bps]": S.gate(f"{S.MARGIN} >= 25.0e0"),
    "Fee Gate [5 bps]": S.gate("fee_bps <= 5.0e0"),
    "Fee Gate [10 bps]": S.gate("fee_bps <= 10.0e0"),
    "Risk Filter [cost=20, vol=0.60]": S.gate(f"{S.COST} <= 20.0e0 AND volatility_proxy <= 0.6e0"),
    "Risk Filter [cost=30, vol=1.00]": S.gate(f"{S.COST} <= 30.0e0 AND volatility_proxy <= 1.0e0"),
    "Horizon Gate [12 h]": S.gate("horizon >= 12"),
    "Horizon Gate [36 h]": S.gate("horizon >= 36"),
    "Hard Role Gate": S.gate(S.ROLE),
    "Lifecycle Checklist [strict]": S.lifecycle(
        risk="(uncertainty >= 0.5e0 OR volatility_proxy >= 0.8e0)", bar=">= 30.0e0"
    ),
    "Lifecycle Checklist [loose]": S.lifecycle(
        risk="(uncertainty >= 0.9e0 OR volatility_proxy >= 1.1e0)", bar=">= 10.0e0"
    ),
    "EPV Adapter": S.epv(
        S.ROLE, f"({S.MARGIN} - 1000.0e0 * uncertainty)", "0.3e0", ">= 0.0e0"
    ),
}


@query("R18_R21_public_grid_rules", _route_sql(PUBLIC_SQL, DECISION_SQL, "v"))
def public_grid_routes(spark, directory):
    return _route_counts(
        rules.decide(decision_view(spark, directory), rules.grid_rules(PUBLIC_GRID))
    )


@query("R23_lifecycle_ablations", _route_sql(S.ABLATIONS, DECISION_SQL, "v"))
def lifecycle_ablation_routes(spark, directory):
    return _route_counts(
        rules.decide(decision_view(spark, directory), rules.lifecycle_ablations())
    )


@query("R24_role_compositions", _route_sql(S.COMPOSITIONS, DECISION_SQL, "v"))
def role_composition_routes(spark, directory):
    return _route_counts(
        rules.decide(decision_view(spark, directory), rules.role_compositions())
    )


# What a deployable rule must not read.
GLOBAL_FORBIDDEN = ("realized_return", "full_utility", "reduced_utility", "harm_label",
                    "tail_loss", "future_decoy")
IDENTIFIERS = ("row_id", "event_cluster_id", "current_source_id", "stress_tag")


@query(
    "R25_feature_access_audit",
    f"""{WITH_D}
    SELECT rule, 'VALID' AS status, '' AS illegal_features, '' AS undeclared_features,
      count(*) FILTER (WHERE authorized) AS authorized_count
    FROM d GROUP BY rule
    UNION ALL
    SELECT 'Peeking Gate', 'INVALID', 'full_utility', '',
      count(*) FILTER (WHERE full_utility > 0) FROM v
    UNION ALL
    SELECT 'Silent Gate', 'INVALID', '', 'confidence', count(*) FILTER (WHERE confidence >= 0.9e0) FROM v""",
)
def feature_access_audit(spark, directory):
    """Feature access of each rule with the number of rows it authorizes.  A rule that
    looks at the outcome and one that hides what it reads show the INVALID branches."""
    peeking = rules.Rule(
        "Peeking Gate", ("full_utility", "row_id"), lambda t: rules.gate(F.col("full_utility") > 0)
    )
    silent = rules.Rule("Silent Gate", ("uncertainty",), lambda t: rules.gate(F.col("confidence") >= 0.9))
    audited = [*rules.core_rules(), peeking, silent]
    view = decision_view(spark, directory)
    access = rules.feature_access(
        view, audited, "coverage",
        legal=("candidate_action", "confidence", *rules.CHECKLIST_FEATURES),
        forbidden=GLOBAL_FORBIDDEN, identifiers=IDENTIFIERS,
    )
    ruled = labels.decision_outcomes(rules.decide(view, audited))
    counts = ruled.groupBy("rule").agg(F.count_if("authorized").alias("authorized_count"))
    return access.join(counts, "rule").select(
        "rule", "status", F.array_join("illegal_features", ",").alias("illegal_features"),
        F.array_join("undeclared_features", ",").alias("undeclared_features"),
        "authorized_count",
    )


@query(
    "PRJ1_decision_outcomes",
    f"""{WITH_D}
    SELECT rule, count(*) FILTER (WHERE authorized) AS authorized_n,
      sum(selected_utility) AS selected_utility, count(*) FILTER (WHERE selected_harm) AS harm_n,
      count(*) FILTER (WHERE selected_laundering) AS laundering_n,
      sum(best_safe_utility) AS best_safe_utility, sum(missed_opportunity) AS missed_opportunity
    FROM d GROUP BY rule""",
    ("selected_utility", "best_safe_utility", "missed_opportunity"),
)
def decision_outcome_totals(spark, directory):
    return core_decisions(spark, directory).groupBy("rule").agg(
        F.count_if("authorized").alias("authorized_n"),
        F.sum("selected_utility").alias("selected_utility"),
        F.count_if("selected_harm").alias("harm_n"),
        F.count_if("selected_laundering").alias("laundering_n"),
        F.sum("best_safe_utility").alias("best_safe_utility"),
        F.sum("missed_opportunity").alias("missed_opportunity"),
    )


@query(
    "PRJ3_economic_labels",
    f"""WITH {DECISION_SQL}
    SELECT source_role, opportunity_slice, sum(full_utility) AS full_utility,
      sum(reduced_utility) AS reduced_utility, count(*) FILTER (WHERE full_utility < 0) AS harms,
      sum(least(full_utility, 0.0e0)) AS tail_loss FROM v GROUP BY 1, 2""",
    ("full_utility", "reduced_utility", "tail_loss"),
)
def economic_label_totals(spark, directory):
    return decision_view(spark, directory).groupBy("source_role", "opportunity_slice").agg(
        F.sum("full_utility").alias("full_utility"),
        F.sum("reduced_utility").alias("reduced_utility"),
        F.count_if("harm_label").alias("harms"),
        F.sum("tail_loss").alias("tail_loss"),
    )


@query(
    "PRJ4_cluster_opportunity",
    f"""WITH {DECISION_SQL}, c AS (
      SELECT event_cluster_id, bool_or(original_source_eligible
        AND greatest(full_utility, reduced_utility) > 0) AS oracle_positive_opportunity
      FROM v GROUP BY 1)
    SELECT row_id, oracle_positive_opportunity FROM v JOIN c USING (event_cluster_id)""",
)
def cluster_opportunity_rows(spark, directory):
    return labels.cluster_opportunity(decision_view(spark, directory)).select(
        "row_id", "oracle_positive_opportunity"
    )


@query(
    "PRJ27_profile_membership",
    f"""WITH {DECISION_SQL}, d AS (SELECT * FROM v), {S.PROFILED}
    SELECT profile, count(*) AS rows, count(DISTINCT event_cluster_id) AS clusters
    FROM dp GROUP BY 1""",
)
def profile_membership(spark, directory):
    return (
        labels.explode_profiles(
            decision_view(spark, directory), labels.certification_profiles()
        )
        .groupBy("profile")
        .agg(F.count("*").alias("rows"), F.countDistinct("event_cluster_id").alias("clusters"))
    )


A1_SQL = f"{WITH_D}, {S.PROFILED} {S.profile_metrics()}"


@query("A1_profile_metrics", A1_SQL, (*S.PROFILE_DOUBLES, "tla"))
def core_profile_metrics(spark, directory):
    return metrics.profile_metrics(
        core_decisions(spark, directory), labels.certification_profiles(),
        direct_rule="Direct Prior",
    )


@query(
    "A7_cluster_component_sums",
    f"""{WITH_D}, {S.PROFILED}
    SELECT rule, profile, event_cluster_id, count(*) AS rows,
      count(*) FILTER (WHERE authorized) AS authorized,
      count(*) FILTER (WHERE selected_harm) AS harmful,
      count(*) FILTER (WHERE selected_laundering) AS laundering,
      sum(selected_utility) AS utility
    FROM dp GROUP BY 1, 2, 3""",
    ("utility",),
)
def cluster_component_sums(spark, directory):
    return metrics.cluster_sums(
        labels.explode_profiles(
            core_decisions(spark, directory), labels.certification_profiles()
        )
    )


WORKLOAD_SQL = f"""{WITH_D},
w AS (
  SELECT rule, count(*) AS rows, count(*) FILTER (WHERE decision = 'review') AS review_count,
    avg(CAST(decision = 'review' AS DOUBLE)) AS review_rate,
    avg(CAST(decision = 'execute' AS DOUBLE)) AS execute_rate,
    avg(CAST(decision = 'reduce' AS DOUBLE)) AS reduce_rate,
    avg(CAST(decision = 'abstain' AS DOUBLE)) AS abstain_rate,
    coalesce(sum(selected_utility) FILTER (WHERE authorized), 0.0e0) AS authorized_utility,
    sum(missed_opportunity) AS missed_opportunity,
    avg(CASE WHEN decision = 'review' THEN CAST(full_utility < 0 AS DOUBLE) END)
      AS review_if_executed_harm_rate,
    avg(CASE WHEN decision = 'review'
      THEN CAST(best_safe_utility > 0 AND original_source_eligible AS DOUBLE) END)
      AS review_safe_opportunity_rate,
    count(*) FILTER (WHERE decision = 'review' AND full_utility < 0)
      AS review_deflected_harm_count,
    coalesce(sum(best_safe_utility) FILTER (WHERE decision = 'review'), 0.0e0)
      AS reviewed_opportunity_value
  FROM d GROUP BY rule
)"""


@query(
    "A11_review_workload", f"{WORKLOAD_SQL} SELECT * FROM w",
    ("review_rate", "execute_rate", "reduce_rate", "abstain_rate", "authorized_utility",
     "missed_opportunity", "review_if_executed_harm_rate", "review_safe_opportunity_rate",
     "reviewed_opportunity_value"),
)
def review_workload(spark, directory):
    return metrics.review_workload(core_decisions(spark, directory), ["rule"])


@query(
    "A12_capacity_overload",
    f"""{WORKLOAD_SQL}, g AS (SELECT unnest([0.05e0, 0.1e0, 0.2e0, 0.4e0]) AS capacity_fraction)
    SELECT rule, capacity_fraction,
      greatest(review_rate - capacity_fraction, 0.0e0) AS excess_review_fraction,
      CAST(ceil(greatest(review_rate - capacity_fraction, 0.0e0) * rows) AS BIGINT) AS queue_rows
    FROM w, g""",
    ("capacity_fraction", "excess_review_fraction"),
)
def capacity_overload(spark, directory):
    load = metrics.review_workload(core_decisions(spark, directory), ["rule"])
    return metrics.capacity_overload(load).select(
        "rule", "capacity_fraction", "excess_review_fraction", "queue_rows"
    )


@query(
    "A12_review_cost",
    f"""{WORKLOAD_SQL}, g AS (SELECT unnest([0.5e0, 1.0e0, 2.0e0, 5.0e0]) AS review_cost_bps)
    SELECT rule, review_cost_bps,
      authorized_utility - review_count * review_cost_bps / 10000.0e0
        AS cost_adjusted_authorized_utility
    FROM w, g""",
    ("review_cost_bps", "cost_adjusted_authorized_utility"),
)
def review_cost(spark, directory):
    load = metrics.review_workload(core_decisions(spark, directory), ["rule"])
    return metrics.review_cost(load).select(
        "rule", "review_cost_bps", "cost_adjusted_authorized_utility"
    )


@query(
    "A13_opportunity_by_slice",
    f"""WITH {DECISION_SQL}, c AS (
      SELECT event_cluster_id, bool_or(original_source_eligible
        AND greatest(full_utility, reduced_utility) > 0) AS opp FROM v GROUP BY 1),
    f AS (
      SELECT *, row_number() OVER (PARTITION BY event_cluster_id
        ORDER BY decision_timestamp, row_id) AS rn FROM v JOIN c USING (event_cluster_id))
    SELECT opportunity_slice, count(*) AS event_clusters,
      avg(CAST(opp AS DOUBLE)) AS oracle_positive_rate,
      avg(CAST(gross > 0 AS DOUBLE)) AS intended_opportunity_rate,
      bool_and(certification_eligible) AS certification_eligible
    FROM f WHERE rn = 1 GROUP BY 1""",
    ("oracle_positive_rate", "intended_opportunity_rate"),
)
def opportunity_by_slice(spark, directory):
    df = labels.cluster_opportunity(decision_view(spark, directory)).withColumn(
        "intended_opportunity", F.col("candidate_action") * F.col("realized_return") > 0
    )
    return metrics.opportunity_by_slice(df, ["decision_timestamp", "row_id"])


COLLAPSE_CTES = f"""m AS ({S.profile_metrics(tail=False)}),
cc AS (
  SELECT rule, max(coverage) FILTER (WHERE profile = 'ordinary') AS o,
    max(coverage) FILTER (WHERE profile = 'stress') AS s FROM m GROUP BY rule),
collapse AS (
  SELECT rule, CASE WHEN abs(o) > 1e-15 THEN s / o END AS stress_coverage_ratio FROM cc),
collapse2 AS (
  SELECT *, 1.0e0 - stress_coverage_ratio AS coverage_collapse_index,
    CASE WHEN stress_coverage_ratio IS NULL THEN 'UNDEFINED_ZERO_ORDINARY'
      WHEN abs(stress_coverage_ratio - 1.0e0) <= 1e-8 + 1e-5 THEN 'UNIFORM'
      WHEN stress_coverage_ratio < 1 THEN 'COLLAPSE' ELSE 'EXPANSION' END AS coverage_relation
  FROM collapse)"""
COLLAPSE_SQL = f"{WITH_D}, {S.PROFILED}, {COLLAPSE_CTES}"


@query(
    "A14_coverage_collapse", f"{COLLAPSE_SQL} SELECT * FROM collapse2",
    ("stress_coverage_ratio", "coverage_collapse_index"),
)
def coverage_collapse(spark, directory):
    m = metrics.profile_metrics(
        core_decisions(spark, directory), labels.certification_profiles(), tail=False
    )
    return metrics.coverage_collapse(m)


@query(
    "W1_W2_rule_ranks",
    f"""{WITH_D}, {S.PROFILED}, m AS ({S.profile_metrics(tail=False)})
    SELECT rule, far, rank() OVER (ORDER BY far ASC NULLS LAST) AS raw_far_rank,
      cau, rank() OVER (ORDER BY cau DESC) AS raw_cau_rank,
      CASE WHEN upa IS NOT NULL THEN rank() OVER (ORDER BY upa DESC NULLS LAST) END AS upa_rank
    FROM m WHERE profile = 'overall'""",
    ("far", "cau"),
)
def rule_ranks(spark, directory):
    m = metrics.profile_metrics(
        core_decisions(spark, directory), labels.certification_profiles(), tail=False
    ).filter(F.col("profile") == "overall")
    return m.select(
        "rule", "far", rank_min("far", missing="bottom").cast("bigint").alias("raw_far_rank"),
        "cau", rank_min("cau", descending=True).cast("bigint").alias("raw_cau_rank"),
        rank_min("upa", descending=True).cast("bigint").alias("upa_rank"),
    )


@query(
    "A28_run_deltas",
    f"""{WITH_D}, m AS (
      SELECT rule, split, count(*) FILTER (WHERE authorized) * 1.0e0 / count(*) AS coverage,
        avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) AS far FROM d
      WHERE certification_eligible GROUP BY 1, 2)
    SELECT a.rule, a.coverage AS coverage_left, b.coverage AS coverage_right,
      a.far AS far_left, b.far AS far_right, b.coverage - a.coverage AS coverage_delta,
      b.far - a.far AS far_delta
    FROM m a JOIN m b ON a.rule = b.rule AND a.split = 'validation' AND b.split = 'test'""",
    ("coverage_left", "coverage_right", "far_left", "far_right", "coverage_delta", "far_delta"),
)
def run_deltas(spark, directory):
    m = metrics.profile_metrics(
        core_decisions(spark, directory),
        {"overall": F.col("certification_eligible")}, ["rule", "split"], tail=False,
    )
    return metrics.metric_deltas(
        m.filter(F.col("split") == "validation"), m.filter(F.col("split") == "test"),
        ["coverage", "far"],
    )


@query(
    "A26_table_equivalence",
    """SELECT unnest(['coverage', 'far']) AS "column", 0.0e0 AS max_abs_difference,
      CAST(0 AS BIGINT) AS na_mismatches, CAST(0 AS BIGINT) AS unmatched_keys, TRUE AS equal""",
    ("max_abs_difference",),
)
def table_equivalence(spark, directory):
    """Two independent evaluations of the same rules must agree, N/A included."""
    d = core_decisions(spark, directory)
    one = metrics.profile_metrics(d, labels.certification_profiles(), tail=False)
    two = (
        labels.explode_profiles(d, labels.certification_profiles())
        .groupBy("rule", "profile")
        .agg(
            F.avg(F.col("authorized").cast("double")).alias("coverage"),
            F.avg(F.when(F.col("authorized"), F.col("selected_harm").cast("double"))).alias("far"),
        )
    )
    return metrics.tables_equal(one, two, ["rule", "profile"], ["coverage", "far"])
