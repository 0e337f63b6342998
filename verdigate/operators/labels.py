"""Outcome labels and row-level projections, all built-in Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigate.functions.columns import clip, impact_bps, is_true, sign_or
from verdigate.operators.rules import AUTHORIZED, ELIGIBLE_ROLES


def decision_outcomes(ruled: DataFrame) -> DataFrame:
    """What each decision earned, cost or missed."""
    taken = is_true(F.col("decision").isin(*AUTHORIZED))
    realised = (
        F.when(F.col("decision") == "execute", F.col("full_utility"))
        .when(F.col("decision") == "reduce", F.col("reduced_utility"))
        .otherwise(F.lit(0.0))
    )
    best = F.greatest(F.col("full_utility"), F.col("reduced_utility"), F.lit(0.0))
    genuine = is_true(F.col("original_source_eligible"))
    return (
        ruled.withColumns(
            {"authorized": taken, "selected_utility": realised, "best_safe_utility": best}
        )
        .withColumns(
            {
                "selected_harm": F.col("authorized") & is_true(F.col("selected_utility") < 0),
                "selected_laundering": F.col("authorized") & ~genuine,
                "missed_opportunity": F.when(
                    ~F.col("authorized") & genuine, F.col("best_safe_utility")
                ).otherwise(F.lit(0.0)),
            }
        )
    )


def laundering_outcomes(ruled: DataFrame) -> DataFrame:
    df = decision_outcomes(ruled)
    safe = is_true(F.col("safe_delegation")) & is_true(F.col("best_safe_utility") > 0)
    indirect = F.col("authorized") & is_true(F.col("authority_laundering"))
    return df.withColumns(
        {
            "selected_direct_leakage": F.col("authorized")
            & ~is_true(F.col("current_source_eligible")),
            "selected_indirect_leakage": indirect,
            "positive_safe_delegation": safe,
            "false_block": safe & ~F.col("authorized"),
            "laundering_harm": indirect & F.col("selected_harm"),
        }
    )


def economic_labels(
    df: DataFrame, risk_scale: float = 0.0004, inventory: str | None = None,
    budget: str | None = None,
) -> DataFrame:
    """Full and reduced utility from action, return, cost and risk penalty."""
    exposure = F.pow(F.col("volatility_proxy"), F.lit(2.0))
    if inventory:
        exposure = exposure + F.lit(0.35) * F.pow(F.col(inventory), F.lit(2.0))
    if budget:
        exposure = exposure + F.lit(0.25) * F.pow(F.col(budget), F.lit(2.0))
    penalty = F.lit(risk_scale) * exposure
    gross = F.col("candidate_action") * F.col("realized_return")
    cost = (
        F.col("liquidity_cost_bps") + F.col("turnover_cost_bps") + F.col("fee_bps")
    ) / F.lit(10000.0)
    full = gross - cost - penalty
    reduced = F.lit(0.4) * gross - F.lit(0.4) * cost - F.lit(0.16) * penalty
    return df.withColumns(
        {
            "full_utility": full,
            "reduced_utility": reduced,
            "harm_label": full < 0,
            "tail_loss": F.least(full, F.lit(0.0)),
        }
    )


def cluster_opportunity(df: DataFrame, cluster: str = "event_cluster_id") -> DataFrame:
    """True on every row of a cluster in which an eligible source could have gained.

    The flag is combined per cluster before it is joined back, so a very large
    cluster costs no more than its rows.
    """
    hit = is_true(F.col("original_source_eligible")) & (
        F.greatest("full_utility", "reduced_utility") > 0
    )
    flags = df.groupBy(cluster).agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("oracle_positive_opportunity")
    )
    return df.join(flags, cluster)


DELEGATION_ATTACKS = ("delegation", "paraphrase", "multi_hop")
OPEN_ATTACKS = ("clean", "role_noise")


def lineage_labels(df: DataFrame, chain: str = "chain") -> DataFrame:
    """Provenance labels from an ordered array of hops (source, role, operation)."""
    hops = F.col(chain)
    last = F.element_at(hops, -1)

    def ok(role: Column) -> Column:
        return is_true(role.isin(*ELIGIBLE_ROLES))

    upstream = F.when(
        F.size(hops) > 1, F.transform(F.slice(hops, 1, F.size(hops) - 1), lambda h: h["role"])
    ).otherwise(F.array(F.col("original_verified_role")))
    current_ok = ok(last["role"])
    tainted = F.exists(upstream, lambda r: ~ok(r))
    all_ok = F.forall(hops, lambda h: ok(h["role"]))
    attack = F.col("attack_type")
    attested = F.col("traceability") == "traceable"
    return df.withColumns(
        {
            "verified_current_role": last["role"],
            "current_source_id": last["source"],
            "transformation_type": last["operation"],
            "hop_depth": F.size(hops),
            "original_source_eligible": ok(F.col("original_verified_role")),
            "current_source_eligible": current_ok,
            "authority_laundering": current_ok & tainted,
            "safe_delegation": attack.isin(*DELEGATION_ATTACKS) & current_ok & all_ok,
            "lineage_attested": attested,
            "detectable_in_principle": attested | attack.isin(*OPEN_ATTACKS),
        }
    )


def lineage_text(df: DataFrame, chain: str = "chain", row_id: str = "row_id") -> DataFrame:
    """Serialised lineage: JSON and role list when attested, and a content hash."""
    hops = F.col(chain)
    attested = is_true(F.col("lineage_attested"))
    payload = F.to_json(
        F.struct(
            hops.alias("chain"),
            F.element_at(hops, -1)["source"].alias("current"),
            F.element_at(hops, 1)["source"].alias("original"),
            F.col(row_id).alias("row_id"),
        )
    )
    roles = F.array_join(F.transform(hops, lambda h: h["role"]), "|")
    return df.withColumns(
        {
            "transformation_chain": F.to_json(hops),
            "evidence_lineage": F.when(attested, F.to_json(hops)).otherwise(F.lit("")),
            "lineage_role_chain": F.when(attested, roles).otherwise(F.lit("")),
            "source_content_hash": F.sha2(payload, 256),
        }
    )


def leakage_labels(df: DataFrame, timestamp: str = "timestamp", hours: str = "horizon") -> DataFrame:
    current = is_true(F.col("current_source_eligible"))
    return df.withColumns(
        {
            "direct_leakage": ~current,
            "indirect_leakage": is_true(F.col("authority_laundering")) & current,
            "outcome_timestamp": F.col(timestamp)
            + F.make_dt_interval(F.lit(0), F.col(hours).cast("int")),
        }
    )


# Defaults for features a layer does not carry.
TRAINING_DEFAULTS: dict[str, object] = {
    "candidate_action": 0, "confidence": 0.5, "uncertainty": 1.0, "expected_edge_bps": 0.0,
    "liquidity_cost_bps": 0.0, "turnover_cost_bps": 0.0, "fee_bps": 0.0,
    "volatility_proxy": 0.0, "liquidity_proxy": 0.0, "horizon": 0, "source_role": "unknown",
    "claimed_role": "unknown", "current_role_verified": False,
    "verified_current_role": "unknown", "hop_depth": 0, "transformation_type": "none",
    "traceability": "none", "lineage_attested": False, "time_to_resolution_hours": 0.0,
    "price_history_points_predecision": 0.0, "fee_rate": 0.0,
}


def training_schema(df: DataFrame, features: Sequence[str], layer: str) -> DataFrame:
    """Fill missing features, tag the layer, prefix the cluster id."""
    filled = {
        f: F.coalesce(F.col(f), F.lit(TRAINING_DEFAULTS[f])) if f in df.columns
        else F.lit(TRAINING_DEFAULTS[f])
        for f in features
    }
    tainted = (
        is_true(F.col("authority_laundering")) if "authority_laundering" in df.columns
        else F.lit(False)
    )
    return df.withColumns(
        {
            **filled,
            "source_layer": F.lit(layer),
            "training_cluster_id": F.concat(
                F.lit(layer + ":"), F.col("event_cluster_id").cast("string")
            ),
            "authority_laundering": tainted,
        }
    )


def safety_label() -> Column:
    safe = (
        is_true(F.col("full_utility") > 0)
        & is_true(F.col("original_source_eligible"))
        & ~is_true(F.col("authority_laundering"))
    )
    return safe.cast("int")


def prediction_label() -> Column:
    return is_true(F.col("candidate_action") * F.col("realized_return") > 0).cast("int")


# Feature groups that can be masked.
FEATURE_GROUPS: dict[str, tuple[str, ...]] = {
    "role": ("source_role", "claimed_role", "current_role_verified", "verified_current_role",
             "hop_depth", "transformation_type", "traceability", "lineage_attested"),
    "cost": ("liquidity_cost_bps", "turnover_cost_bps", "fee_bps", "fee_rate"),
    "belief": ("confidence", "uncertainty", "expected_edge_bps"),
}


def mask_group(df: DataFrame, group: str, categorical: Iterable[str]) -> DataFrame:
    text = set(categorical)
    present = [c for c in FEATURE_GROUPS[group] if c in df.columns]
    return df.withColumns(
        {c: F.lit("masked") if c in text else F.lit(0.0) for c in present}
    )


def coerce_features(df: DataFrame, numeric: Iterable[str], categorical: Iterable[str]) -> DataFrame:
    return df.withColumns(
        {
            **{c: F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)) for c in numeric},
            **{c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categorical},
        }
    )


DIRECTIONAL, RISK_LIMIT = "directional_execution", "risk_limit_increase"

# Example task parameters; the harm floors and multipliers are the documented ones.
TASK_PARAMETERS: dict[str, float] = {
    "notional": 100_000.0, "slope": 50.0, "cap": 100.0,
    "material_floor": 20.0, "material_vol": 1.0, "tail_floor": 40.0, "tail_vol": 2.0,
    "shock_move_floor": 60.0, "shock_move_vol": 2.0, "shock_vol_floor": 60.0,
    "shock_vol_mult": 2.0, "shock_depth": 0.6, "material_move_floor": 90.0,
    "material_move_vol": 3.0, "material_depth": 0.8, "benign": 1.0,
}


def two_task_outcomes(df: DataFrame, p: Mapping[str, float] = TASK_PARAMETERS) -> DataFrame:
    """Utilities and harm flags of directional and risk-limit proposals."""
    directional = F.col("task_id") == DIRECTIONAL
    risk = F.col("task_id") == RISK_LIMIT
    action = F.col("candidate_action").cast("double")
    active = is_true(F.col("candidate_action") != 0)
    long_ = action > 0
    entry = F.col("entry_price")
    vol = F.col("volatility_bps")

    gross = action * (F.col("exit_price_30m") / entry - 1.0) * F.lit(10000.0)
    d_in = F.when(long_, F.col("entry_ask_depth_1pct")).otherwise(F.col("entry_bid_depth_1pct"))
    d_out = F.when(long_, F.col("exit_bid_depth_1pct_30m")).otherwise(
        F.col("exit_ask_depth_1pct_30m")
    )

    def friction(share: float) -> Column:
        notional = F.lit(p["notional"] * share)
        return F.col("fee_bps") + impact_bps(notional, d_in, p["slope"], p["cap"]) + impact_bps(
            notional, d_out, p["slope"], p["cap"]
        )

    zero = F.lit(0.0)
    d_full = F.when(active, gross - friction(1.0)).otherwise(zero)
    d_reduced = F.when(active, F.lit(0.5) * (gross - friction(0.5))).otherwise(zero)
    drop = F.when(
        long_, (F.col("future_min_price_30m") / entry - 1.0) * F.lit(10000.0)
    ).otherwise(-((F.col("future_max_price_30m") / entry - 1.0) * F.lit(10000.0)))
    adverse = F.when(active, drop).otherwise(zero)
    material = F.greatest(F.lit(p["material_floor"]), F.lit(p["material_vol"]) * vol)
    tail = F.greatest(F.lit(p["tail_floor"]), F.lit(p["tail_vol"]) * vol)
    scale = F.greatest(vol, F.lit(p["material_floor"]))

    move = F.abs(F.col("exit_price_60m") / entry - 1.0) * F.lit(10000.0)
    thinning = F.col("depth_deterioration_fraction_60m")
    shock = active & (
        is_true(move >= F.greatest(F.lit(p["shock_move_floor"]), F.lit(p["shock_move_vol"]) * vol))
        | is_true(
            F.col("future_realized_volatility_bps_60m")
            >= F.greatest(F.lit(p["shock_vol_floor"]), F.lit(p["shock_vol_mult"]) * vol)
        )
        | is_true(thinning >= p["shock_depth"])
    )
    severe = active & (
        is_true(
            move >= F.greatest(F.lit(p["material_move_floor"]), F.lit(p["material_move_vol"]) * vol)
        )
        | is_true(thinning >= p["material_depth"])
    )
    r_full = (
        F.when(~active, zero).when(severe, F.lit(-2.0)).when(shock, F.lit(-1.0))
        .otherwise(F.lit(p["benign"]))
    )
    genuine = is_true(F.col("original_source_eligible"))

    def pick(d: Column, r: Column, neither: Column) -> Column:
        return F.when(directional, d).when(risk, r).otherwise(neither)

    no = F.lit(False)
    return df.withColumns(
        {
            "gross_return_bps": F.when(directional, gross),
            "full_task_utility": pick(d_full, r_full, zero),
            "reduced_task_utility": pick(d_reduced, F.lit(0.5) * r_full, zero),
            "normalized_full_task_utility": pick(clip(d_full / scale, -5.0, 5.0), r_full, zero),
            "normalized_reduced_task_utility": pick(
                clip(d_reduced / scale, -5.0, 5.0), F.lit(0.5) * r_full, zero
            ),
            "economic_loss_full": pick(active & is_true(d_full < 0), no, no),
            "economic_loss_reduced": pick(active & is_true(d_reduced < 0), no, no),
            "material_harm_full": pick(active & is_true(d_full < -material), severe, no),
            "material_harm_reduced": pick(active & is_true(d_reduced < -material), severe, no),
            "tail_harm_full": pick(active & is_true(adverse < -tail), no, no),
            "tail_harm_reduced": pick(active & is_true(F.lit(0.5) * adverse < -tail), no, no),
            "risk_event": pick(no, shock, no),
            "material_risk_event": pick(no, severe, no),
            "candidate_benign_opportunity": pick(
                active & is_true(d_full > 0), active & ~shock & genuine, no
            ),
        }
    )


def apply_task_decision(ruled: DataFrame) -> DataFrame:
    """Selected two-task outcomes under the decision in each row."""
    execute, reduce = F.col("decision") == "execute", F.col("decision") == "reduce"
    taken = is_true(F.col("decision").isin(*AUTHORIZED))

    def chosen(full: str, reduced: str, neither: Column) -> Column:
        return F.when(execute, F.col(full)).when(reduce, F.col(reduced)).otherwise(neither)

    zero, no = F.lit(0.0), F.lit(False)
    return ruled.withColumns(
        {
            "authorized": taken,
            "selected_task_utility": chosen("full_task_utility", "reduced_task_utility", zero),
            "selected_normalized_task_utility": chosen(
                "normalized_full_task_utility", "normalized_reduced_task_utility", zero
            ),
            "selected_economic_loss": chosen("economic_loss_full", "economic_loss_reduced", no),
            "selected_material_harm": chosen("material_harm_full", "material_harm_reduced", no),
            "selected_tail_harm": chosen("tail_harm_full", "tail_harm_reduced", no),
            "selected_risk_event": taken & F.col("risk_event"),
            "selected_material_risk_event": taken & F.col("material_risk_event"),
            "authority_violation": taken
            & (F.col("task_id") == RISK_LIMIT)
            & ~is_true(F.col("original_source_eligible")),
            "missed_benign": F.col("candidate_benign_opportunity") & ~taken,
        }
    )


def order_book_outcomes(
    df: DataFrame, with_impact: bool, notional: float = 100_000.0, slope: float = 50.0,
    cap: float = 100.0,
) -> DataFrame:
    """Order-book labels.  Depth sources pay impact and use a signed return; quote
    sources trade at the quoted side, so a short earns entry/exit - 1."""
    action = F.col("candidate_action").cast("double")
    entry, exit_ = F.col("entry_price"), F.col("exit_price")
    bps = F.lit(10000.0)
    if with_impact:
        gross = action * (exit_ / entry - 1.0) * bps

        def friction(share: float) -> Column:
            n = F.lit(notional * share)
            return impact_bps(n, F.col("entry_side_depth_1pct"), slope, cap) + impact_bps(
                n, F.col("exit_side_depth_1pct"), slope, cap
            )
    else:
        gross = F.when(action > 0, (exit_ / entry - 1.0) * bps).otherwise(
            (entry / exit_ - 1.0) * bps
        )

        def friction(share: float) -> Column:
            return F.lit(0.0)

    full = gross - F.col("fee_bps") - friction(1.0)
    return df.withColumns(
        {
            "gross_return_bps": gross,
            "realized_return": gross,
            "full_utility": full,
            "reduced_utility": F.lit(0.5) * (gross - F.col("fee_bps") - friction(0.5)),
            "harm_label": full < 0,
            "tail_loss": F.least(full, F.lit(0.0)),
        }
    )


# Prior families, their roles and eligibility.
PRIOR_ROLES: dict[str, tuple[str, bool]] = {
    "momentum_30m": ("edge_proposer", True),
    "reversal_30m": ("edge_proposer", True),
    "depth_imbalance": ("learned_prior", True),
    "volatility_breakout": ("policy_proposer", True),
    "spread_blind_high_conf": ("edge_proposer", True),
    "liquidity_critic": ("risk_critic", False),
}


def weak_priors(df: DataFrame) -> DataFrame:
    """Six prior rows per decision row from momentum, volatility, imbalance, thinness."""
    m30, m5 = F.col("momentum_30_bps"), F.col("momentum_5_bps")
    vol, imb = F.col("volatility_bps"), F.col("depth_imbalance")
    one = F.lit(1.0)
    trend = F.least(F.abs(m30) / F.lit(80.0), one)
    burst = F.least(F.abs(m5) / F.lit(50.0), one)
    heat = F.least(F.greatest(vol, F.lit(0.0)) / F.lit(80.0), F.lit(1.5))
    tilt = F.least(F.abs(imb), one)
    thin = clip(F.col("thinness"), 0.0, 1.0)
    up = F.lit(1)
    by_trend = sign_or(m30, up)

    def edge(value: Column, floor: float = 0.5) -> Column:
        return F.greatest(F.lit(floor), F.least(F.lit(100.0), value))

    table: dict[str, tuple[Column, Column, Column, Column]] = {
        "momentum_30m": (by_trend, 0.55 + 0.40 * trend, 0.15 + 0.35 * heat, edge(F.abs(m30) * 0.35)),
        "reversal_30m": (-by_trend, 0.53 + 0.32 * trend, 0.25 + 0.40 * heat,
                         edge(F.abs(m30) * 0.25)),
        "depth_imbalance": (sign_or(imb, by_trend), 0.55 + 0.40 * tilt, 0.15 + 0.65 * (1.0 - tilt),
                            F.greatest(F.lit(0.5), 35.0 * tilt)),
        "volatility_breakout": (sign_or(m5, by_trend),
                                0.55 + 0.35 * F.least(burst + 0.20 * heat, one),
                                0.20 + 0.45 * heat, edge(F.abs(m5) * 0.30 + vol * 0.08)),
        "spread_blind_high_conf": (by_trend, F.lit(0.94), F.lit(0.08), edge(F.abs(m30) * 0.50, 8.0)),
        "liquidity_critic": (sign_or(m30, sign_or(imb, up)), 0.85 + 0.10 * thin,
                             0.20 + 0.20 * thin, edge(F.abs(m30) * 0.20 + 20.0 * thin, 5.0)),
    }
    rows = [
        F.struct(
            F.lit(name).alias("prior_family"),
            action.alias("candidate_action"),
            clip(confidence, 0.50, 0.99).alias("confidence"),
            clip(uncertainty, 0.0, 1.50).alias("uncertainty"),
            bps.alias("expected_edge_bps"),
            F.lit(PRIOR_ROLES[name][0]).alias("source_role"),
            F.lit(PRIOR_ROLES[name][1]).alias("original_source_eligible"),
        )
        for name, (action, confidence, uncertainty, bps) in table.items()
    ]
    return df.select("*", F.inline(F.array(*rows)))


def order_book_stress(family: Column, liquidity_cost: Column, volatility: Column) -> Column:
    return (
        F.when(family == "liquidity_critic", "role_ineligible_source")
        .when(family == "spread_blind_high_conf", "cost_blind_high_confidence")
        .when(liquidity_cost > 15.0, "high_execution_friction")
        .when(volatility > 0.80, "high_volatility")
        .otherwise("ordinary")
    )


def market_stress(prior: Column, uncertainty: Column, points: Column, hours: Column,
                  fee_rate: Column) -> Column:
    return (
        F.when((fee_rate > 0) & prior.between(0.40, 0.60), "fee_peak_near_50")
        .when(hours <= 6.0, "short_time_to_resolution")
        .when(uncertainty >= 0.10, "high_historical_price_uncertainty")
        .when(points <= 5, "thin_historical_price_record")
        .when((prior <= 0.10) | (prior >= 0.90), "extreme_probability")
        .otherwise("ordinary")
    )


def reprice_fees(df: DataFrame, fees: Sequence[float]) -> DataFrame:
    """The frame once per fee in the grid, utilities shifted by the fee difference."""
    grid = F.array(*[F.lit(float(f)) for f in fees])
    wide = df.select("*", F.explode(grid).alias("grid_fee_bps"))
    delta = F.col("fee_bps") - F.col("grid_fee_bps")
    return wide.withColumns(
        {
            "full_utility": F.col("full_utility") + delta,
            "reduced_utility": F.col("reduced_utility") + F.lit(0.5) * delta,
        }
    ).withColumn("fee_bps", F.col("grid_fee_bps"))


def action_liquidity_cost(action: Column, long_cost: Column, short_cost: Column) -> Column:
    return (
        F.when(action == "long", long_cost)
        .when(action == "short", short_cost)
        .when(action == "increase_limit", F.greatest(long_cost, short_cost))
        .otherwise(F.least(long_cost, short_cost))
    )


def in_profiles(memberships: Mapping[str, Column]) -> Column:
    """Array of profile names a row belongs to, for one explode over all profiles."""
    flagged = F.array(*[F.when(is_true(c), F.lit(n)) for n, c in memberships.items()])
    return F.filter(flagged, lambda name: name.isNotNull())


def certification_profiles() -> dict[str, Column]:
    scored = is_true(F.col("certification_eligible"))
    calm = is_true(F.col("opportunity_slice") == "ordinary")
    return {"overall": scored, "ordinary": scored & calm, "stress": scored & ~calm}


def stress_profiles() -> dict[str, Column]:
    return {"overall": F.lit(True), "stress": ~is_true(F.col("stress_tag") == "ordinary")}


def task_profiles() -> dict[str, Column]:
    return {
        "overall": F.lit(True),
        DIRECTIONAL: F.col("task_id") == DIRECTIONAL,
        RISK_LIMIT: F.col("task_id") == RISK_LIMIT,
    }


def explode_profiles(df: DataFrame, memberships: Mapping[str, Column]) -> DataFrame:
    return df.select("*", F.explode(in_profiles(memberships)).alias("profile"))


def exclude_mechanisms(df: DataFrame, held_out: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop rows of held-out mechanisms; a missing tag is kept."""
    for column, values in held_out.items():
        if column in df.columns:
            df = df.filter(~is_true(F.col(column).isin(*values)))
    return df
