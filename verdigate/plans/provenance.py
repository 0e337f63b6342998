"""Provenance rules, laundering metrics, identifiability, lineage labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators import labels, metrics, rules
from verdigate.operators.distributed import quantile_bins
from verdigate.plans import sql_rules as S
from verdigate.plans.proxies import PROVENANCE_SQL, provenance_view
from verdigate.plans.registry import query


def provenance_decisions(spark: SparkSession, directory: str) -> DataFrame:
    return labels.laundering_outcomes(
        rules.decide(provenance_view(spark, directory), rules.provenance_rules())
    )


WITH_L = f"""WITH {PROVENANCE_SQL}, {S.outcomes(S.PROVENANCE, 'p')},
l AS (
  SELECT *, authorized AND NOT current_source_eligible AS selected_direct_leakage,
    authorized AND authority_laundering AS selected_indirect_leakage,
    safe_delegation AND best_safe_utility > 0 AS positive_safe_delegation,
    safe_delegation AND best_safe_utility > 0 AND NOT authorized AS false_block
  FROM d)"""

LAUNDERING_FIELDS = """count(*) AS rows, count(*) FILTER (WHERE authorized) AS authorized_count,
    avg(CAST(authorized AS DOUBLE)) AS coverage,
    avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) AS far,
    avg(CASE WHEN authorized THEN CAST(selected_laundering AS DOUBLE) END) AS alr,
    avg(CASE WHEN authorized THEN CAST(selected_direct_leakage AS DOUBLE) END)
      AS direct_leakage_rate,
    avg(CASE WHEN authorized THEN CAST(selected_indirect_leakage AS DOUBLE) END)
      AS indirect_leakage_rate,
    count(*) FILTER (WHERE selected_indirect_leakage) AS authority_laundering_count,
    avg(CASE WHEN selected_indirect_leakage THEN CAST(selected_harm AS DOUBLE) END)
      AS laundering_harm_rate,
    count(*) FILTER (WHERE positive_safe_delegation) AS safe_delegation_count,
    avg(CASE WHEN positive_safe_delegation THEN CAST(authorized AS DOUBLE) END)
      AS safe_delegation_coverage,
    avg(CASE WHEN positive_safe_delegation THEN CAST(false_block AS DOUBLE) END)
      AS false_block_rate,
    coalesce(sum(selected_utility) FILTER (WHERE authorized), 0.0e0) AS cau,
    sum(missed_opportunity) AS moc,
    avg(CAST(decision = 'review' AS DOUBLE)) AS review_rate,
    avg(CAST(decision = 'abstain' AS DOUBLE)) AS abstain_rate,
    count(*) FILTER (WHERE authorized) = 0 AS zero_action"""
LAUNDERING_DOUBLES = (
    "coverage", "far", "alr", "direct_leakage_rate", "indirect_leakage_rate",
    "laundering_harm_rate", "safe_delegation_coverage", "false_block_rate", "cau", "moc",
    "review_rate", "abstain_rate",
)


@query(
    "R10_R15_R17_provenance_rules",
    f"WITH {PROVENANCE_SQL}, d AS ({S.ruled(S.PROVENANCE, 'p')}) "
    "SELECT rule, decision, count(*) AS n FROM d GROUP BY 1, 2",
)
def provenance_rule_routes(spark, directory):
    ruled = rules.decide(provenance_view(spark, directory), rules.provenance_rules())
    return ruled.groupBy("rule", "decision").agg(F.count("*").alias("n"))


@query(
    "PRJ2_laundering_outcomes",
    f"""{WITH_L} SELECT rule, count(*) FILTER (WHERE selected_direct_leakage) AS direct_n,
      count(*) FILTER (WHERE selected_indirect_leakage) AS indirect_n,
      count(*) FILTER (WHERE positive_safe_delegation) AS safe_n,
      count(*) FILTER (WHERE false_block) AS blocked_n,
      count(*) FILTER (WHERE selected_indirect_leakage AND selected_harm) AS laundering_harm_n
    FROM l GROUP BY rule""",
)
def laundering_outcome_counts(spark, directory):
    return provenance_decisions(spark, directory).groupBy("rule").agg(
        F.count_if("selected_direct_leakage").alias("direct_n"),
        F.count_if("selected_indirect_leakage").alias("indirect_n"),
        F.count_if("positive_safe_delegation").alias("safe_n"),
        F.count_if("false_block").alias("blocked_n"),
        F.count_if("laundering_harm").alias("laundering_harm_n"),
    )


@query(
    "PRJ5_lineage_labels",
    f"""WITH {PROVENANCE_SQL} SELECT row_id, verified_current_role, transformation_type,
      CAST(hop_depth AS INTEGER) AS hop_depth, original_source_eligible, current_source_eligible,
      authority_laundering, safe_delegation, lineage_attested,
      lineage_attested OR attack_type IN ('clean', 'role_noise') AS detectable_in_principle
    FROM p""",
)
def lineage_label_rows(spark, directory):
    return provenance_view(spark, directory).select(
        "row_id", "verified_current_role", "transformation_type", "hop_depth",
        "original_source_eligible", "current_source_eligible", "authority_laundering",
        "safe_delegation", "lineage_attested", "detectable_in_principle",
    )


_HOP = """'{{"hop":"{n}","source":"src{n}-' || ({key}) || '","role":"' || {role}
    || '","operation":"' || {op} || '"}}'"""
_H0 = _HOP.format(n=0, key="l_suppkey", role="r0", op="'none'")
_H1 = _HOP.format(n=1, key="l_partkey", role="r1", op="op1")
_H2 = _HOP.format(n=2, key="l_partkey + l_linenumber", role="r2", op="op2")


@query(
    "PRJ6_lineage_serialisation",
    f"""WITH {PROVENANCE_SQL}, j AS (
      SELECT *, '[' || {_H0}
        || CASE WHEN hop_depth > 1 THEN ',' || {_H1} ELSE '' END
        || CASE WHEN hop_depth > 2 THEN ',' || {_H2} ELSE '' END || ']' AS chain_json,
        CASE hop_depth WHEN 1 THEN 'src0-' || l_suppkey WHEN 2 THEN 'src1-' || l_partkey
          ELSE 'src2-' || (l_partkey + l_linenumber) END AS current_id FROM p)
    SELECT row_id, CASE WHEN lineage_attested THEN chain_json ELSE '' END AS evidence_lineage,
      lineage_role_chain,
      sha256('{{"chain":' || chain_json || ',"current":"' || current_id || '","original":"src0-'
        || l_suppkey || '","row_id":"' || row_id || '"}}') AS source_content_hash
    FROM j""",
)
def lineage_serialisation(spark, directory):
    return provenance_view(spark, directory).select(
        "row_id", "evidence_lineage", "lineage_role_chain", "source_content_hash"
    )


@query(
    "PRJ7_leakage_and_outcome_time",
    f"""WITH {PROVENANCE_SQL} SELECT row_id, NOT current_source_eligible AS direct_leakage,
      authority_laundering AND current_source_eligible AS indirect_leakage,
      CAST(epoch(outcome_timestamp) AS BIGINT) AS outcome_second FROM p""",
)
def leakage_rows(spark, directory):
    return provenance_view(spark, directory).select(
        "row_id", "direct_leakage", "indirect_leakage",
        F.unix_seconds(F.col("outcome_timestamp").cast("timestamp")).alias("outcome_second"),
    )


@query(
    "A2_laundering_metrics", f"{WITH_L} SELECT rule, {LAUNDERING_FIELDS} FROM l GROUP BY rule",
    LAUNDERING_DOUBLES,
)
def laundering_metrics(spark, directory):
    return metrics.laundering_metrics(provenance_decisions(spark, directory), ["rule"])


def _breakdown(name: str, keys: dict[str, str], where: str = "TRUE") -> str:
    columns = ", ".join(
        f"{keys.get(c, 'NULL')} AS {c}"
        for c in ("attack_type", "traceability", "role_noise_rate", "hop_depth")
    )
    group = ", ".join(["rule", *keys.values()])
    return (
        f"SELECT '{name}' AS breakdown, rule, {columns}, {LAUNDERING_FIELDS} FROM l "
        f"WHERE {where} GROUP BY {group}"
    )


@query(
    "A3_laundering_breakdowns",
    WITH_L
    + " UNION ALL ".join(
        [
            _breakdown("rule", {}),
            _breakdown("attack", {"attack_type": "attack_type"}),
            _breakdown("traceability", {"traceability": "traceability"}),
            _breakdown("noise", {"role_noise_rate": "role_noise_rate"},
                       "attack_type = 'role_noise'"),
            _breakdown("hop", {"hop_depth": "hop_depth", "traceability": "traceability"},
                       "attack_type = 'multi_hop'"),
        ]
    ),
    (*LAUNDERING_DOUBLES, "role_noise_rate"),
)
def laundering_breakdowns(spark, directory):
    return metrics.laundering_breakdowns(provenance_decisions(spark, directory))


BINNED = ("confidence", "uncertainty", "expected_edge_bps", "liquidity_cost_bps",
          "turnover_cost_bps", "volatility_proxy")


_EDGES = ", ".join(
    f"list_sort(list_distinct(quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS {c}_edges"
    for c in BINNED
)
_BINS = ", ".join(
    f"CAST(greatest(len(list_filter({c}_edges, lambda x: x < {c})), 1) - 1 AS INTEGER) AS {c}_bin"
    for c in BINNED
)
BINNED_SQL = f"""{PROVENANCE_SQL}, edges AS (SELECT {_EDGES} FROM p),
b AS (SELECT p.*, {_BINS} FROM p, edges)"""


def binned_view(spark: SparkSession, directory: str) -> DataFrame:
    df = provenance_view(spark, directory)
    return df.withColumns({f"{c}_bin": e for c, e in quantile_bins(df, BINNED).items()})


@query(
    "T9_quintile_bins",
    f"""WITH {BINNED_SQL}, c AS (
      {" UNION ALL ".join(f"SELECT '{c}' AS feature, {c}_bin AS bin FROM b" for c in BINNED)})
    SELECT feature, bin, count(*) AS n FROM c GROUP BY 1, 2""",
)
def quintile_bins(spark, directory):
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_bin").alias("bin")) for c in BINNED]
    )
    return (
        binned_view(spark, directory).select(F.inline(cells)).groupBy("feature", "bin")
        .agg(F.count("*").alias("n"))
    )


SIGNATURES = {
    "current_role_only": ("verified_current_role", "current_role_verified"),
    "legal_partial": (
        "verified_current_role", "current_role_verified", "claimed_role", "transformation_type",
        "lineage_attested", *[f"{c}_bin" for c in BINNED],
    ),
}


def _ambiguity_sql(name: str) -> str:
    keys = ", ".join(("traceability", *SIGNATURES[name]))
    return (
        f"SELECT traceability, '{name}' AS signature, "
        "count(*) FILTER (WHERE authority_laundering) * 1.0e0 AS pos, count(*) * 1.0e0 AS n "
        f"FROM b GROUP BY {keys}"
    )


@query(
    "A19_ambiguity_bound",
    f"""WITH {BINNED_SQL}, g AS ({' UNION ALL '.join(map(_ambiguity_sql, SIGNATURES))}),
    r AS (
    SELECT traceability, signature, CAST(sum(n) AS BIGINT) AS rows,
      sum(pos) / sum(n) AS positive_label_rate, count(*) AS signature_count,
      count(*) FILTER (WHERE n > 1) AS collision_signature_count,
      coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n) AS collision_row_fraction,
      CAST(sum(least(pos, n - pos)) AS BIGINT) AS unavoidable_error_rows,
      sum(least(pos, n - pos)) / sum(n) AS empirical_bayes_error_lower_bound,
      sum(abs(2 * pos - n)) / sum(n) AS empirical_joint_separation
    FROM g GROUP BY 1, 2)
    SELECT *, abs(empirical_bayes_error_lower_bound - (1 - empirical_joint_separation) / 2)
      AS bayes_overlap_identity_residual FROM r""",
    ("positive_label_rate", "collision_row_fraction", "empirical_bayes_error_lower_bound",
     "empirical_joint_separation", "bayes_overlap_identity_residual"),
)
def ambiguity_bound(spark, directory):
    return metrics.ambiguity_bound(
        binned_view(spark, directory), SIGNATURES, "authority_laundering", ["traceability"]
    )
