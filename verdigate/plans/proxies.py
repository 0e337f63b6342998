"""Decision, provenance, two-task and market views over the given tables.

The published data sets of the audited layers are not available, so the queries
run on views with the same columns, derived row by row from the given tables.
Each view is a DataFrame function and, for the oracle, a SQL common table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators.distributed import materialize
from verdigate.operators.labels import economic_labels, leakage_labels, lineage_labels, lineage_text
from verdigate.sources.ingest import table

# Eligible roles first, then ineligible ones.
ROLES = (
    "edge_proposer", "learned_prior", "policy_proposer",
    "risk_critic", "reasoning_prior", "adversarial_reasoning_prior",
)
ATTACKS = ("clean", "role_noise", "delegation", "paraphrase", "multi_hop")
OPERATIONS = ("summarize", "rewrite", "delegate")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {index} {whens} END)"


def lines_with_orders(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "lineitem").join(
        table(spark, directory, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def decision_view(spark: SparkSession, directory: str, lines: DataFrame | None = None) -> DataFrame:
    lines = lines_with_orders(spark, directory) if lines is None else lines
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    priority = F.substring("o_orderpriority", 1, 1)
    slice_ = (
        F.when(priority == "1", "severe_stress")
        .when(priority == "2", "moderate_stress")
        .when(priority == "5", "no_opportunity_control")
        .otherwise("ordinary")
    )
    bucket = F.col("l_orderkey") % 10
    df = lines.select(
        F.concat_ws(
            "-", F.col("l_orderkey"), F.col("l_linenumber"), part, supp,
            F.col("l_quantity").cast("int"),
        ).alias("row_id"),
        F.col("l_orderkey").alias("event_cluster_id"),
        F.col("o_orderdate").alias("decision_timestamp"),
        F.col("l_shipdate").alias("outcome_timestamp"),
        F.when(bucket < 6, "train").when(bucket < 8, "validation").otherwise("test").alias("split"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("candidate_action"),
        (F.col("l_quantity") / 50.0).alias("confidence"),
        (F.col("l_tax") / 0.08).alias("uncertainty"),
        (F.col("l_discount") * 1000.0).alias("expected_edge_bps"),
        (F.col("l_tax") * 250.0).alias("liquidity_cost_bps"),
        (F.col("l_linenumber") * 2.0).alias("turnover_cost_bps"),
        F.lit(8.0).alias("fee_bps"),
        ((part % 100) / 80.0).alias("volatility_proxy"),
        _pick(ROLES, supp % 6).alias("source_role"),
        ((supp % 6) < 3).alias("original_source_eligible"),
        slice_.alias("opportunity_slice"),
        (slice_ != "no_opportunity_control").alias("certification_eligible"),
        slice_.alias("stress_tag"),
        ((F.col("l_extendedprice") / F.col("l_quantity") - 1000.0) / 100000.0).alias(
            "realized_return"
        ),
        ((part % 48) + 1).cast("int").alias("horizon"),
        F.col("l_returnflag").alias("model_id"),
        F.col("l_linestatus").alias("symbol"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
    )
    return economic_labels(df)


DECISION_SQL = f"""
v0 AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || CAST(l_quantity AS INTEGER) AS row_id,
    l_orderkey AS event_cluster_id, o_orderdate AS decision_timestamp,
    l_shipdate AS outcome_timestamp,
    CASE WHEN l_orderkey % 10 < 6 THEN 'train' WHEN l_orderkey % 10 < 8 THEN 'validation'
         ELSE 'test' END AS split,
    CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS candidate_action,
    l_quantity / 50.0e0 AS confidence, l_tax / 0.08e0 AS uncertainty,
    l_discount * 1000.0e0 AS expected_edge_bps, l_tax * 250.0e0 AS liquidity_cost_bps,
    l_linenumber * 2.0e0 AS turnover_cost_bps, 8.0e0 AS fee_bps,
    (l_partkey % 100) / 80.0e0 AS volatility_proxy,
    {_sql_pick(ROLES, "l_suppkey % 6")} AS source_role,
    (l_suppkey % 6) < 3 AS original_source_eligible,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'severe_stress'
      WHEN '2' THEN 'moderate_stress' WHEN '5' THEN 'no_opportunity_control'
      ELSE 'ordinary' END AS opportunity_slice,
    (l_extendedprice / l_quantity - 1000.0e0) / 100000.0e0 AS realized_return,
    CAST(l_partkey % 48 + 1 AS INTEGER) AS horizon,
    l_returnflag AS model_id, l_linestatus AS symbol,
    l_linenumber, l_partkey, l_suppkey, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
v1 AS (
  SELECT *, opportunity_slice <> 'no_opportunity_control' AS certification_eligible,
    opportunity_slice AS stress_tag,
    liquidity_cost_bps + turnover_cost_bps + fee_bps AS cost,
    candidate_action * realized_return AS gross,
    0.0004e0 * (volatility_proxy * volatility_proxy) AS penalty
  FROM v0
),
v AS (
  SELECT *, gross - cost / 10000.0e0 - penalty AS full_utility,
    0.4e0 * gross - 0.4e0 * (cost / 10000.0e0) - 0.16e0 * penalty AS reduced_utility
  FROM v1
)"""


def provenance_view(spark: SparkSession, directory: str) -> DataFrame:
    """Decision view with a chain of one to three hops and its labels."""
    supp, part, line = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    attack = _pick(ATTACKS, line % 5)

    def hop(n: int, role: Column, key: Column, operation: Column) -> Column:
        return F.struct(
            F.lit(str(n)).alias("hop"),
            F.concat(F.lit(f"src{n}-"), key.cast("string")).alias("source"),
            role.alias("role"),
            operation.alias("operation"),
        )

    origin = hop(0, _pick(ROLES, supp % 6), supp, F.lit("none"))
    relay = hop(1, _pick(ROLES, part % 6), part, _pick(OPERATIONS, part % 3))
    final = hop(2, _pick(ROLES, (part + line) % 6), part + line, _pick(OPERATIONS, line % 3))
    chain = (
        F.when(attack.isin("clean", "role_noise"), F.array(origin))
        .when(attack == "multi_hop", F.array(origin, relay, final))
        .otherwise(F.array(origin, relay))
    )
    noisy = attack == "role_noise"
    df = decision_view(spark, directory).drop("original_source_eligible").withColumns(
        {
            "attack_type": attack,
            "original_verified_role": _pick(ROLES, supp % 6),
            "claimed_role": _pick(ROLES, F.when(noisy, (supp + 1) % 6).otherwise(supp % 6)),
            "current_role_verified": ~(noisy & (part % 4 == 0)),
            "traceability": F.when(F.col("l_linestatus") == "O", "traceable").otherwise(
                "untraceable"
            ),
            "role_noise_rate": F.when(noisy, (part % 3) / 10.0).otherwise(0.0),
            "chain": chain,
        }
    )
    df = lineage_text(lineage_labels(df))
    return leakage_labels(df.drop("outcome_timestamp"), "decision_timestamp")


PROVENANCE_SQL = f"""{DECISION_SQL},
p0 AS (
  SELECT * EXCLUDE (original_source_eligible, outcome_timestamp),
    {_sql_pick(ATTACKS, "l_linenumber % 5")} AS attack_type,
    {_sql_pick(ROLES, "l_suppkey % 6")} AS r0,
    {_sql_pick(ROLES, "l_partkey % 6")} AS r1,
    {_sql_pick(ROLES, "(l_partkey + l_linenumber) % 6")} AS r2,
    {_sql_pick(OPERATIONS, "l_partkey % 3")} AS op1,
    {_sql_pick(OPERATIONS, "l_linenumber % 3")} AS op2,
    CASE WHEN l_linestatus = 'O' THEN 'traceable' ELSE 'untraceable' END AS traceability,
    l_linestatus = 'O' AS lineage_attested,
    decision_timestamp + horizon * INTERVAL 1 HOUR AS outcome_timestamp
  FROM v
),
p1 AS (
  SELECT *,
    CASE WHEN attack_type IN ('clean', 'role_noise') THEN 1 WHEN attack_type = 'multi_hop' THEN 3
         ELSE 2 END AS hop_depth,
    CASE WHEN attack_type = 'role_noise' THEN (l_partkey % 3) / 10.0e0 ELSE 0.0e0 END
      AS role_noise_rate,
    NOT (attack_type = 'role_noise' AND l_partkey % 4 = 0) AS current_role_verified,
    CASE WHEN attack_type = 'role_noise'
         THEN {_sql_pick(ROLES, "(l_suppkey + 1) % 6")} ELSE r0 END AS claimed_role
  FROM p0
),
p2 AS (
  SELECT *,
    CASE hop_depth WHEN 1 THEN r0 WHEN 2 THEN r1 ELSE r2 END AS verified_current_role,
    CASE hop_depth WHEN 1 THEN 'none' WHEN 2 THEN op1 ELSE op2 END AS transformation_type,
    l_suppkey % 6 < 3 AS e0, l_partkey % 6 < 3 AS e1, (l_partkey + l_linenumber) % 6 < 3 AS e2,
    CASE WHEN NOT lineage_attested THEN '' WHEN hop_depth = 1 THEN r0
         WHEN hop_depth = 2 THEN r0 || '|' || r1 ELSE r0 || '|' || r1 || '|' || r2 END
      AS lineage_role_chain
  FROM p1
),
p AS (
  SELECT *, e0 AS original_source_eligible,
    CASE hop_depth WHEN 1 THEN e0 WHEN 2 THEN e1 ELSE e2 END AS current_source_eligible,
    CASE hop_depth WHEN 1 THEN FALSE WHEN 2 THEN e1 AND NOT e0
         ELSE e2 AND NOT (e0 AND e1) END AS authority_laundering,
    CASE hop_depth WHEN 1 THEN FALSE WHEN 2 THEN e0 AND e1 ELSE e0 AND e1 AND e2 END
      AS safe_delegation
  FROM p2
)"""


def two_task_lines(spark: SparkSession, directory: str, *more: str) -> DataFrame:
    """Lines with the columns that `two_task_inputs` reads, joined and written once, for plans
    that read the proposals several times; with `l_shipdate` also what `decision_view` reads."""
    return materialize(
        lines_with_orders(spark, directory).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "o_orderdate", "o_orderpriority", *more,
        ),
        dictionary=True,
    )


def two_task_inputs(spark: SparkSession, directory: str, lines: DataFrame | None = None) -> DataFrame:
    """Agent proposals with sealed prices and depths for both tasks."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    directional = F.col("l_linenumber") % 2 == 0
    flag = F.col("l_returnflag")
    action = F.when(
        directional, F.when(flag == "R", -1).when(flag == "A", 1).otherwise(0)
    ).otherwise(F.when(flag == "R", 0).otherwise(1))
    entry = F.col("l_extendedprice") / F.col("l_quantity")
    exit30 = entry * (1.0 + (F.col("l_discount") - 0.05) * 0.1)
    depth = F.when(part % 97 == 0, 0.0).otherwise(1000000.0 + (part % 100) * 10000.0)
    lines = lines_with_orders(spark, directory) if lines is None else lines
    return lines.select(
        F.concat_ws(
            "-", F.col("l_orderkey"), F.col("l_linenumber"), part, supp,
            F.col("l_quantity").cast("int"),
        ).alias("context_id"),
        F.to_date("o_orderdate").alias("event_cluster_id"),
        F.col("o_orderdate").alias("decision_timestamp"),
        F.when(directional, "directional_execution").otherwise("risk_limit_increase").alias("task_id"),
        F.substring("o_orderpriority", 1, 1).alias("model_id"),
        F.col("l_linestatus").alias("symbol"),
        action.alias("candidate_action"),
        (F.col("l_quantity") / 50.0).alias("confidence"),
        (F.col("l_tax") / 0.08).alias("uncertainty"),
        (F.col("l_discount") * 1000.0).alias("expected_edge_bps"),
        (F.col("l_tax") * 250.0).alias("liquidity_cost_bps"),
        F.lit(0.0).alias("turnover_cost_bps"),
        F.lit(8.0).alias("fee_bps"),
        ((part % 100) / 80.0).alias("volatility_proxy"),
        ((part % 40) + 5.0).alias("volatility_bps"),
        ((supp % 6) < 3).alias("original_source_eligible"),
        (part % 7 != 0).alias("raw_schema_valid"),
        (part % 7 == 0).alias("malformed_placeholder"),
        (supp % 4 == 0).alias("review_recommended"),
        entry.alias("entry_price"),
        exit30.alias("exit_price_30m"),
        (entry * (1.0 + (F.col("l_tax") - 0.04) * 0.2)).alias("exit_price_60m"),
        (F.least(entry, exit30) * 0.998).alias("future_min_price_30m"),
        (F.greatest(entry, exit30) * 1.002).alias("future_max_price_30m"),
        ((part % 50) * 2.0).alias("future_realized_volatility_bps_60m"),
        depth.alias("entry_bid_depth_1pct"),
        (depth * 1.5).alias("entry_ask_depth_1pct"),
        (depth * 0.5).alias("exit_bid_depth_1pct_30m"),
        (depth * 0.75).alias("exit_ask_depth_1pct_30m"),
        ((supp % 10) / 10.0).alias("depth_deterioration_fraction_60m"),
    )


_IMPACT = (
    "(CASE WHEN {d} > 0 THEN least(100.0e0, 50.0e0 * {n} / {d}) ELSE 100.0e0 END)"
)


def _sql_friction(notional: str) -> str:
    return (
        "(fee_bps + " + _IMPACT.format(d="d_in", n=notional) + " + "
        + _IMPACT.format(d="d_out", n=notional) + ")"
    )


TWO_TASK_SQL = f"""
t0 AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || CAST(l_quantity AS INTEGER) AS context_id,
    CAST(o_orderdate AS DATE) AS event_cluster_id, o_orderdate AS decision_timestamp,
    CASE WHEN l_linenumber % 2 = 0 THEN 'directional_execution' ELSE 'risk_limit_increase' END
      AS task_id,
    substr(o_orderpriority, 1, 1) AS model_id, l_linestatus AS symbol,
    CASE WHEN l_linenumber % 2 = 0
         THEN CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END
         ELSE CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END END AS candidate_action,
    l_quantity / 50.0e0 AS confidence, l_tax / 0.08e0 AS uncertainty,
    l_discount * 1000.0e0 AS expected_edge_bps, l_tax * 250.0e0 AS liquidity_cost_bps,
    0.0e0 AS turnover_cost_bps, 8.0e0 AS fee_bps, (l_partkey % 100) / 80.0e0 AS volatility_proxy,
    (l_partkey % 40) + 5.0e0 AS volatility_bps, (l_suppkey % 6) < 3 AS original_source_eligible,
    l_partkey % 7 <> 0 AS raw_schema_valid, l_partkey % 7 = 0 AS malformed_placeholder,
    l_suppkey % 4 = 0 AS review_recommended,
    l_extendedprice / l_quantity AS entry_price,
    l_extendedprice / l_quantity * (1.0e0 + (l_discount - 0.05e0) * 0.1e0) AS exit_price_30m,
    l_extendedprice / l_quantity * (1.0e0 + (l_tax - 0.04e0) * 0.2e0) AS exit_price_60m,
    (l_partkey % 50) * 2.0e0 AS realized_vol,
    CASE WHEN l_partkey % 97 = 0 THEN 0.0e0 ELSE 1000000.0e0 + (l_partkey % 100) * 10000.0e0 END
      AS depth,
    (l_suppkey % 10) / 10.0e0 AS thinning
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
t1 AS (
  SELECT *, candidate_action <> 0 AS active, task_id = 'directional_execution' AS is_dir,
    least(entry_price, exit_price_30m) * 0.998e0 AS fmin,
    greatest(entry_price, exit_price_30m) * 1.002e0 AS fmax,
    CASE WHEN candidate_action > 0 THEN depth * 1.5e0 ELSE depth END AS d_in,
    CASE WHEN candidate_action > 0 THEN depth * 0.5e0 ELSE depth * 0.75e0 END AS d_out,
    candidate_action * (exit_price_30m / entry_price - 1.0e0) * 10000.0e0 AS gross,
    abs(exit_price_60m / entry_price - 1.0e0) * 10000.0e0 AS move
  FROM t0
),
t2 AS (
  SELECT *,
    CASE WHEN active THEN gross - {_sql_friction("100000.0e0")} ELSE 0.0e0 END AS d_full,
    CASE WHEN active THEN 0.5e0 * (gross - {_sql_friction("50000.0e0")}) ELSE 0.0e0 END AS d_red,
    CASE WHEN NOT active THEN 0.0e0
         WHEN candidate_action > 0 THEN (fmin / entry_price - 1.0e0) * 10000.0e0
         ELSE -((fmax / entry_price - 1.0e0) * 10000.0e0) END AS adverse,
    greatest(20.0e0, volatility_bps) AS material, greatest(40.0e0, 2.0e0 * volatility_bps) AS tail,
    active AND (move >= greatest(60.0e0, 2.0e0 * volatility_bps)
      OR realized_vol >= greatest(60.0e0, 2.0e0 * volatility_bps) OR thinning >= 0.6e0) AS shock,
    active AND (move >= greatest(90.0e0, 3.0e0 * volatility_bps) OR thinning >= 0.8e0) AS severe
  FROM t1
),
t3 AS (
  SELECT *, CASE WHEN NOT active THEN 0.0e0 WHEN severe THEN -2.0e0 WHEN shock THEN -1.0e0
                 ELSE 1.0e0 END AS r_full
  FROM t2
),
t AS (
  SELECT *,
    CASE WHEN is_dir THEN gross END AS gross_return_bps,
    CASE WHEN is_dir THEN d_full ELSE r_full END AS full_task_utility,
    CASE WHEN is_dir THEN d_red ELSE 0.5e0 * r_full END AS reduced_task_utility,
    CASE WHEN is_dir THEN least(greatest(d_full / material, -5.0e0), 5.0e0) ELSE r_full END
      AS normalized_full_task_utility,
    CASE WHEN is_dir THEN least(greatest(d_red / material, -5.0e0), 5.0e0) ELSE 0.5e0 * r_full END
      AS normalized_reduced_task_utility,
    is_dir AND active AND d_full < 0 AS economic_loss_full,
    is_dir AND active AND d_red < 0 AS economic_loss_reduced,
    CASE WHEN is_dir THEN active AND d_full < -material ELSE severe END AS material_harm_full,
    CASE WHEN is_dir THEN active AND d_red < -material ELSE severe END AS material_harm_reduced,
    is_dir AND active AND adverse < -tail AS tail_harm_full,
    is_dir AND active AND 0.5e0 * adverse < -tail AS tail_harm_reduced,
    NOT is_dir AND shock AS risk_event, NOT is_dir AND severe AS material_risk_event,
    CASE WHEN is_dir THEN active AND d_full > 0
         ELSE active AND NOT shock AND original_source_eligible END
      AS candidate_benign_opportunity
  FROM t3
)"""
