"""The rules again, as SQL CASE expressions for the oracle."""

from __future__ import annotations

ELIGIBLE = "('edge_proposer', 'learned_prior', 'policy_proposer')"
COST = "(liquidity_cost_bps + turnover_cost_bps + fee_bps)"
MARGIN = f"(expected_edge_bps - {COST})"


def gate(test: str, otherwise: str = "abstain") -> str:
    return f"CASE WHEN {test} THEN 'execute' ELSE '{otherwise}' END"


def lifecycle(
    role: str = f"source_role IN {ELIGIBLE}",
    risk: str = "(uncertainty >= 0.75e0 OR volatility_proxy >= 1.0e0)",
    margin: str = MARGIN, reduce: bool = True, bar: str = "> 20.0e0",
) -> str:
    middle = f"WHEN {role} AND NOT {risk} AND {margin} > 0 THEN 'reduce' " if reduce else ""
    return (
        f"CASE WHEN {role} AND NOT {risk} AND {margin} {bar} THEN 'execute' {middle}"
        f"WHEN NOT ({role}) OR {risk} THEN 'review' ELSE 'abstain' END"
    )


ROLE = f"source_role IN {ELIGIBLE}"
RISK = f"({COST} <= 25.0e0 AND volatility_proxy <= 0.8e0)"
BEATS = f"expected_edge_bps > {COST} + 5.0e0"

CORE = {
    "No Action": "'abstain'",
    "Direct Prior": "'execute'",
    "Confidence Gate": gate("confidence >= 0.6e0"),
    "Uncertainty Gate": gate("uncertainty <= 0.4e0"),
    "Risk Filter": gate(RISK),
    "Cost-Aware Gate": gate(BEATS),
    "Hard Role Gate": gate(ROLE),
    "Lifecycle Checklist": lifecycle(),
}
ABLATIONS = {
    "Lifecycle Checklist [registered]": lifecycle(),
    "Lifecycle without role": lifecycle(role="TRUE"),
    "Lifecycle without review risk": lifecycle(risk="FALSE"),
    "Lifecycle without cost": lifecycle(margin="expected_edge_bps"),
    "Lifecycle without reduce route": lifecycle(reduce=False),
}
COMPOSITIONS = {
    "Role + Cost Gate": gate(f"{ROLE} AND {BEATS}"),
    "Role + Risk Gate": gate(f"{ROLE} AND {RISK}"),
    "Role + Confidence + Cost Gate": gate(f"{ROLE} AND confidence >= 0.6e0 AND {BEATS}"),
}
VERIFIED = f"(current_role_verified AND verified_current_role IN {ELIGIBLE})"
EPV_MARGIN = f"({MARGIN} - 10.0e0 * uncertainty)"


def epv(role: str, margin: str, cap: str, bar: str) -> str:
    base = f"{role} AND {margin} > 0 AND uncertainty <= {cap}"
    return (
        f"CASE WHEN {base} AND {margin} {bar} THEN 'execute' "
        f"WHEN {base} THEN 'reduce' ELSE 'abstain' END"
    )


PROVENANCE = {
    "No Action": "'abstain'",
    "No Role Gate": "'execute'",
    "Shared Threshold": gate("confidence >= 0.6e0"),
    "Soft Penalty": gate(
        f"confidence - CASE WHEN claimed_role IN {ELIGIBLE} AND current_role_verified "
        "THEN 0.0e0 ELSE 0.25e0 END >= 0.5e0"
    ),
    "Hard Role Gate": gate(VERIFIED, "review"),
    "Provenance Hard Gate": (
        f"CASE WHEN NOT {VERIFIED} THEN 'abstain' WHEN NOT lineage_attested THEN 'review' "
        "WHEN e0 AND (hop_depth < 2 OR e1) AND (hop_depth < 3 OR e2) THEN 'execute' "
        "ELSE 'abstain' END"
    ),
    "Lifecycle Checklist": lifecycle(role=VERIFIED, risk="(uncertainty > 0.58e0)"),
    "EPV Adapter": epv(VERIFIED, EPV_MARGIN, "0.7e0", "> 10.0e0"),
}
TWO_TASK = {
    name: f"CASE WHEN candidate_action = 0 THEN 'abstain' ELSE {body} END"
    for name, body in {
        **{k: CORE[k] for k in ("Direct Prior", "Confidence Gate", "Uncertainty Gate",
                                "Risk Filter", "Cost-Aware Gate")},
        "Hard Role Gate": gate("original_source_eligible"),
        "Lifecycle Checklist": lifecycle(role="original_source_eligible"),
    }.items()
}


def ruled(rules: dict[str, str], source: str) -> str:
    """UNION ALL of the rules over a relation, with rule and decision columns."""
    return "\nUNION ALL\n".join(
        f"SELECT *, '{name}' AS rule, {body} AS decision FROM {source}"
        for name, body in rules.items()
    )


OUTCOMES = """
    decision IN ('execute', 'reduce') AS authorized,
    CASE decision WHEN 'execute' THEN full_utility WHEN 'reduce' THEN reduced_utility
                  ELSE 0.0e0 END AS selected_utility,
    greatest(full_utility, reduced_utility, 0.0e0) AS best_safe_utility"""

OUTCOMES_2 = """
    authorized AND selected_utility < 0 AS selected_harm,
    authorized AND NOT original_source_eligible AS selected_laundering,
    CASE WHEN NOT authorized AND original_source_eligible THEN best_safe_utility
         ELSE 0.0e0 END AS missed_opportunity"""


def outcomes(rules: dict[str, str], source: str) -> str:
    """CTEs d0, d1, d: ruled rows of `source` with decision outcomes."""
    return f"""
d0 AS ({ruled(rules, source)}),
d1 AS (SELECT *, {OUTCOMES} FROM d0),
d AS (SELECT *, {OUTCOMES_2} FROM d1)"""


PROFILED = """
dp AS (
  SELECT *, 'overall' AS profile FROM d WHERE certification_eligible
  UNION ALL SELECT *, 'ordinary' FROM d
    WHERE certification_eligible AND opportunity_slice = 'ordinary'
  UNION ALL SELECT *, 'stress' FROM d
    WHERE certification_eligible AND opportunity_slice <> 'ordinary'
)"""

TASK_SELECTED = """
    decision IN ('execute', 'reduce') AS authorized,
    CASE decision WHEN 'execute' THEN full_task_utility WHEN 'reduce' THEN reduced_task_utility
      ELSE 0.0e0 END AS selected_task_utility,
    CASE decision WHEN 'execute' THEN normalized_full_task_utility
      WHEN 'reduce' THEN normalized_reduced_task_utility ELSE 0.0e0 END
      AS selected_normalized_task_utility,
    CASE decision WHEN 'execute' THEN economic_loss_full WHEN 'reduce' THEN economic_loss_reduced
      ELSE FALSE END AS selected_economic_loss,
    CASE decision WHEN 'execute' THEN material_harm_full WHEN 'reduce' THEN material_harm_reduced
      ELSE FALSE END AS selected_material_harm,
    CASE decision WHEN 'execute' THEN tail_harm_full WHEN 'reduce' THEN tail_harm_reduced
      ELSE FALSE END AS selected_tail_harm"""

TASK_SELECTED_2 = """
    authorized AND risk_event AS selected_risk_event,
    authorized AND material_risk_event AS selected_material_risk_event,
    authorized AND NOT is_dir AND NOT original_source_eligible AS authority_violation,
    candidate_benign_opportunity AND NOT authorized AS missed_benign"""


def task_outcomes(rules: dict[str, str], source: str = "t") -> str:
    return f"""
td0 AS ({ruled(rules, source)}),
td1 AS (SELECT *, {TASK_SELECTED} FROM td0),
td AS (SELECT *, {TASK_SELECTED_2} FROM td1)"""


def task_metrics(source: str, keys: str) -> str:
    """The two-task metric row grouped by `keys`."""

    def r(hit: str, base: str) -> str:
        return f"avg(CASE WHEN {base} THEN CAST({hit} AS DOUBLE) END)"

    d, k = "authorized AND is_dir", "authorized AND NOT is_dir"
    return f"""
  SELECT {keys}, count(*) AS rows, count(DISTINCT event_cluster_id) AS clusters,
    avg(CAST(authorized AS DOUBLE)) AS coverage,
    avg(CAST(decision = 'execute' AS DOUBLE)) AS execute_rate,
    avg(CAST(decision = 'reduce' AS DOUBLE)) AS reduce_rate,
    avg(CAST(decision = 'review' AS DOUBLE)) AS review_rate,
    avg(CAST(decision = 'abstain' AS DOUBLE)) AS abstain_rate,
    {r("selected_economic_loss", d)} AS economic_loss_authorization_rate,
    {r("selected_material_harm", "authorized")} AS material_harm_authorization_rate,
    {r("selected_tail_harm", d)} AS tail_harm_authorization_rate,
    {r("selected_risk_event", k)} AS risk_event_authorization_rate,
    {r("selected_material_risk_event", k)} AS material_risk_event_authorization_rate,
    {r("authority_violation", "authorized")} AS authority_violation_rate,
    avg(selected_normalized_task_utility) AS normalized_task_utility,
    sum(selected_task_utility) AS raw_task_utility,
    {r("missed_benign", "candidate_benign_opportunity")} AS missed_benign_opportunity,
    count(*) FILTER (WHERE authorized) AS authorized_count,
    count(*) FILTER (WHERE {d}) AS directional_authorized_count,
    count(*) FILTER (WHERE {k}) AS risk_authorized_count,
    count(*) FILTER (WHERE candidate_benign_opportunity) AS benign_opportunity_count
  FROM {source} GROUP BY {keys}"""


TASK_DOUBLES = (
    "coverage", "execute_rate", "reduce_rate", "review_rate", "abstain_rate",
    "economic_loss_authorization_rate", "material_harm_authorization_rate",
    "tail_harm_authorization_rate", "risk_event_authorization_rate",
    "material_risk_event_authorization_rate", "authority_violation_rate",
    "normalized_task_utility", "raw_task_utility", "missed_benign_opportunity",
)


def profile_metrics(source: str = "dp", keys: str = "rule, profile", tail: bool = True) -> str:
    tla = (
        ", quantile_cont(selected_utility, 0.05) - quantile_cont(full_utility, 0.05) AS tla"
        if tail else ""
    )
    return f"""
  SELECT {keys}, count(*) AS rows, count(*) FILTER (WHERE authorized) AS authorized_count,
    avg(CAST(authorized AS DOUBLE)) AS coverage,
    avg(CAST(decision = 'execute' AS DOUBLE)) AS execute_rate,
    avg(CAST(decision = 'reduce' AS DOUBLE)) AS reduce_rate,
    avg(CAST(decision = 'review' AS DOUBLE)) AS review_rate,
    avg(CAST(decision = 'abstain' AS DOUBLE)) AS abstain_rate,
    avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) AS far,
    avg(CASE WHEN authorized THEN CAST(selected_laundering AS DOUBLE) END) AS alr,
    coalesce(sum(selected_utility) FILTER (WHERE authorized), 0.0e0) AS cau,
    avg(CASE WHEN authorized THEN selected_utility END) AS upa,
    sum(missed_opportunity) AS moc,
    count(*) FILTER (WHERE authorized) = 0 AS zero_action,
    count(*) FILTER (WHERE authorized) = 0 AS n_a_execution_metric{tla}
  FROM {source} GROUP BY {keys}"""


PROFILE_DOUBLES = ("coverage", "execute_rate", "reduce_rate", "review_rate", "abstain_rate",
                   "far", "alr", "cau", "upa", "moc")
