"""Dataset builders: decision rows from bars, depth and quotes, with exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigate.functions.columns import EPOCH_MICROS, clip, from_micros, impact_bps, micros
from verdigate.operators.distributed import materialize
from verdigate.operators.labels import order_book_stress, weak_priors
from verdigate.operators.structure import first_reason, role_by_hash
from verdigate.operators.timeseries import (
    asof_many, bar_window, quote_spans, realised_volatility, resample_last,
)


@dataclass(frozen=True)
class BookPlan:
    """Timing of an order-book decision, in bar steps."""

    hours: Sequence[int] = (8, 12, 16)
    step_seconds: int = 60
    lookback: int = 30
    short: int = 5
    action_delay: int = 1
    holding: int = 30
    max_age_seconds: float = 60.0
    notional: float = 100_000.0
    slope: float = 50.0
    cap: float = 100.0
    fee_bps: float = 8.0


def shift(ts: Column, seconds: int) -> Column:
    return from_micros(micros(ts) + F.lit(seconds * EPOCH_MICROS))


def decision_grid(bars: DataFrame, by: Sequence[str], hours: Sequence[int]) -> DataFrame:
    """Every (key, day) seen in the bars at each decision hour."""
    days = bars.select(*by, F.to_date("open_time").alias("day")).distinct()
    grid = days.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in hours])))
    at = F.unix_date("day").cast("bigint") * 86400 + F.col("_h") * 3600
    out = grid.withColumn("decision_timestamp", F.timestamp_seconds(at)).drop("_h")
    return out.withColumn(
        "decision_id",
        F.concat_ws("-", *by, F.date_format("decision_timestamp", "yyyy-MM-dd-HHmm")),
    )


def bars_at(
    probes: DataFrame, bars: DataFrame, by: Sequence[str], probe_id: str,
    wanted: Mapping[str, tuple[Column, str]],
) -> DataFrame:
    """Several exact-time lookups per probe in one equi-join and one aggregation."""
    asks = F.array(
        *[F.struct(F.lit(n).alias("_n"), t.alias("open_time")) for n, (t, _) in wanted.items()]
    )
    lead = next(iter(wanted))
    whole = F.struct(*[F.col(c) for c in probes.columns])
    long = probes.select(*by, probe_id, whole.alias("_w"), F.inline(asks)).withColumn(
        "_p", F.when(F.col("_n") == lead, F.col("_w"))
    ).drop("_w")
    fields = sorted({field for _, field in wanted.values()})
    right = bars.select(*by, F.col("open_time").cast("timestamp").alias("open_time"), *fields)
    found = long.join(right, [*by, "open_time"], "left").groupBy(probe_id).agg(
        F.first("_p", ignorenulls=True).alias("_p"),
        *[F.max(F.when(F.col("_n") == n, F.col(field))).alias(n) for n, (_, field) in wanted.items()],
    )
    return found.select("_p.*", *wanted)


def momentum(end: str, start: str) -> Column:
    return (F.try_divide(F.col(end), F.col(start)) - 1.0) * F.lit(10000.0)


def order_book_decisions(bars: DataFrame, depth: DataFrame, plan: BookPlan) -> DataFrame:
    """One row per symbol, day and hour with features, sealed prices and the first
    reason for exclusion."""
    by, step = ["symbol"], plan.step_seconds
    d = F.col("decision_timestamp")
    probes = decision_grid(bars, by, plan.hours).withColumns(
        {
            "feature_start": shift(d, -(plan.lookback + 1) * step),
            "source_timestamp": shift(d, -step),
            "action_timestamp": shift(d, plan.action_delay * step),
            "outcome_timestamp": shift(d, (plan.action_delay + plan.holding) * step),
        }
    )
    probes = bars_at(
        probes, bars, by, "decision_id",
        {
            "start_close": (F.col("feature_start"), "close"),
            "end_close": (F.col("source_timestamp"), "close"),
            "short_close": (shift(d, -(plan.short + 1) * step), "close"),
            "entry_price": (F.col("action_timestamp"), "open"),
            "exit_price": (F.col("outcome_timestamp"), "open"),
        },
    )
    probes = bar_window(
        probes, bars, by, "decision_id", F.col("feature_start"), plan.lookback + 1, step,
        plan.lookback, "feature_",
    )
    sides = ("bid_depth_1pct", "ask_depth_1pct")
    quoted = depth.withColumn("_tie", micros(F.col("timestamp")))
    wanted = [("", "decision_timestamp", False, sides), ("exit_", "outcome_timestamp", False, sides)]
    probes = asof_many(
        probes, quoted, by, "decision_id", wanted, "timestamp", "_tie", "backward", plan.max_age_seconds,
        86400, quote_spans(quoted, by, "timestamp", 86400),
    )
    prices = ("start_close", "end_close", "short_close", "entry_price", "exit_price")
    depths = (*sides, *[f"exit_{s}" for s in sides])
    day = F.to_date("decision_timestamp")
    crosses = (F.to_date("feature_start") != day) | (F.to_date("source_timestamp") != day)
    lacking = F.lit(False)
    for c in prices:
        lacking = lacking | F.col(c).isNull()
    stale = F.col("bid_depth_1pct").isNull() | F.col("exit_bid_depth_1pct").isNull()
    reason = first_reason(
        [
            ("feature_window_crosses_date_boundary", crosses),
            ("missing_required_kline", lacking),
            ("insufficient_feature_window",
             (F.coalesce("feature_bars", F.lit(0)) < plan.lookback) | ~F.col("feature_positive")),
            ("missing_or_stale_depth", stale),
            ("nonpositive_depth", F.least(*depths) <= 0),
            ("nonpositive_price", F.least(*prices) <= 0),
        ]
    )
    bid, ask = F.col("bid_depth_1pct"), F.col("ask_depth_1pct")
    notional = F.lit(plan.notional)
    worst = F.greatest(
        impact_bps(notional, bid, plan.slope, plan.cap),
        impact_bps(notional, ask, plan.slope, plan.cap),
    )
    return probes.withColumns(
        {
            "reason": reason,
            "momentum_30_bps": momentum("end_close", "start_close"),
            "momentum_5_bps": momentum("end_close", "short_close"),
            "volatility_bps": F.col("feature_volatility_bps"),
            "depth_imbalance": F.try_divide(bid - ask, bid + ask),
            "thinness": F.least(F.lit(1.0), worst / F.lit(plan.cap)),
            "volatility_proxy": clip(F.col("feature_volatility_bps") / 100.0, 0.0, 1.5),
        }
    )


def order_book_rows(decisions: DataFrame, plan: BookPlan, source: str) -> DataFrame:
    """Six prior rows per kept decision with the sealed entry and exit sides."""
    long_ = F.col("candidate_action") > 0
    rows = weak_priors(decisions)
    entry = F.when(long_, F.col("ask_depth_1pct")).otherwise(F.col("bid_depth_1pct"))
    exit_ = F.when(long_, F.col("exit_bid_depth_1pct")).otherwise(F.col("exit_ask_depth_1pct"))
    cost = F.lit(2.0) * impact_bps(F.lit(plan.notional), F.col("_entry"), plan.slope, plan.cap)
    day = F.date_format("decision_timestamp", "yyyy-MM-dd")
    clock = F.date_format("decision_timestamp", "HHmm")
    return rows.withColumns({"_entry": entry, "exit_side_depth_1pct": exit_}).withColumns(
        {
            "event_cluster_id": F.concat(F.lit(source + "-"), day),
            "row_id": F.concat_ws("-", F.lit(source), day, "symbol", clock, "prior_family"),
            "liquidity_cost_bps": cost,
            "turnover_cost_bps": F.lit(0.0),
            "fee_bps": F.lit(plan.fee_bps),
            "liquidity_proxy": F.col("_entry"),
            "entry_side_depth_1pct": F.col("_entry"),
            "horizon": F.lit(plan.holding),
            "stress_tag": order_book_stress(F.col("prior_family"), cost, F.col("volatility_proxy")),
            "outcome_used_by_rule": F.lit(False),
        }
    ).drop("_entry")


@dataclass(frozen=True)
class SessionPlan:
    """Timing of a quote-session decision, local clock and seconds."""

    times: Sequence[str] = ("10:00", "14:00")
    timezone: str = "America/Chicago"
    lookback_seconds: int = 1800
    short_seconds: int = 300
    action_delay_seconds: int = 1
    holding_seconds: int = 1800
    max_age_seconds: float = 5.0
    step_seconds: int = 60
    minimum_steps: int = 20
    fee_bps: float = 1.0
    horizon: int = 30


def session_decisions(quotes: DataFrame, plan: SessionPlan) -> DataFrame:
    """Decisions on cleaned session quotes (see `clean_quotes`), quote at each step
    by as-of joins, with the first reason for exclusion."""
    by = ["symbol"]
    sessions = quotes.groupBy("symbol", "local_date").agg(
        (F.min("instrument_id") != F.max("instrument_id")).alias("_switched")
    )
    times = F.array(*[F.lit(t) for t in plan.times])
    p = sessions.withColumn("local_time", F.explode(times))
    local = F.to_timestamp(F.concat_ws(" ", F.col("local_date").cast("string"), "local_time"))
    p = p.withColumns(
        {
            "decision_timestamp": F.to_utc_timestamp(local, plan.timezone),
            "decision_id": F.concat_ws("-", "symbol", F.col("local_date").cast("string"), "local_time"),
        }
    )
    d = F.col("decision_timestamp")
    p = p.withColumns(
        {
            "_start": shift(d, -plan.lookback_seconds),
            "_short": shift(d, -plan.short_seconds),
            "_target": shift(d, plan.action_delay_seconds),
        }
    )
    q = quotes.withColumns(
        {"mid": (F.col("bid_px_00") + F.col("ask_px_00")) / 2.0, "_tie": micros(F.col("ts"))}
    )
    sides = ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "mid")

    busy = quote_spans(q, by, "ts", 86400)

    def nearest(df, direction, wanted):
        return asof_many(
            df, q, by, "decision_id", wanted, "ts", "_tie", direction, plan.max_age_seconds, 86400, busy
        )

    p = nearest(p, "backward", [
        ("now_", "decision_timestamp", True, sides), ("start_", "_start", False, ("mid",)),
        ("short_", "_short", False, ("mid",)),
    ])
    p = nearest(p, "forward", [("entry_", "_target", False, sides)])
    p = p.withColumn("_exit", shift(F.col("entry_observed_timestamp"), plan.holding_seconds))
    p = nearest(p, "forward", [("exit_", "_exit", False, sides)])

    p = materialize(p)
    # Quotes inside each look-back window, found by the minute they fall in.
    width = plan.step_seconds * EPOCH_MICROS
    minutes = F.sequence(F.floor(micros(F.col("_start")) / width), F.floor(micros(d) / width))
    windows = p.select("symbol", "decision_id", "_start", "decision_timestamp",
                       F.explode(minutes).alias("_b"))
    inside = windows.join(
        q.select("symbol", "ts", "mid", "_tie", F.floor(micros(F.col("ts")) / width).alias("_b")),
        ["symbol", "_b"],
    ).filter(F.col("ts").between(F.col("_start"), F.col("decision_timestamp")))
    steps = resample_last(inside, ["decision_id"], "ts", "mid", "_tie", plan.step_seconds)
    vol = realised_volatility(steps, ["decision_id"], "mid", plan.horizon, plan.minimum_steps)
    p = p.join(vol, "decision_id", "left")

    def off_session(c: str) -> Column:
        return F.to_date(F.from_utc_timestamp(F.col(c), plan.timezone)) != F.col("local_date")

    lacking = F.lit(False)
    for c in ("now_mid", "start_mid", "short_mid", "entry_mid", "exit_mid"):
        lacking = lacking | F.col(c).isNull()
    reason = first_reason(
        [
            ("intraday_instrument_change", F.col("_switched")),
            ("missing_or_stale_required_quote", lacking),
            ("action_or_exit_crosses_session_boundary",
             off_session("entry_observed_timestamp") | off_session("exit_observed_timestamp")),
            ("nonpositive_mid", F.least("now_mid", "start_mid", "short_mid") <= 0),
            ("insufficient_feature_window", F.col("volatility_bps").isNull()),
        ]
    )
    size = F.least("now_bid_sz_00", "now_ask_sz_00")
    return p.withColumns(
        {
            "reason": reason,
            "momentum_30_bps": momentum("now_mid", "start_mid"),
            "momentum_5_bps": momentum("now_mid", "short_mid"),
            "depth_imbalance": F.try_divide(
                F.col("now_bid_sz_00") - F.col("now_ask_sz_00"),
                F.col("now_bid_sz_00") + F.col("now_ask_sz_00"),
            ),
            "spread_bps": F.try_divide(
                F.col("now_ask_px_00") - F.col("now_bid_px_00"), F.col("now_mid")
            ) * 10000.0,
            "thinness": clip(1.0 - size / 10.0, 0.0, 1.0),
            "volatility_proxy": clip(F.col("volatility_bps") / 100.0, 0.0, 1.5),
        }
    ).drop("_switched", "_start", "_short", "_target", "_exit")


def session_rows(decisions: DataFrame, source: str, fee_bps: float) -> DataFrame:
    """Prior rows of kept session decisions; prices are the quoted trade sides."""
    long_ = F.col("candidate_action") > 0
    day = F.col("local_date").cast("string")
    return weak_priors(decisions).withColumns(
        {
            "event_cluster_id": F.concat(F.lit(source + "-"), day),
            "row_id": F.concat_ws("-", F.lit(source), "decision_id", "prior_family"),
            "entry_price": F.when(long_, F.col("entry_ask_px_00")).otherwise(F.col("entry_bid_px_00")),
            "exit_price": F.when(long_, F.col("exit_bid_px_00")).otherwise(F.col("exit_ask_px_00")),
            "liquidity_cost_bps": F.col("spread_bps"),
            "turnover_cost_bps": F.lit(0.0),
            "fee_bps": F.lit(fee_bps),
            "stress_tag": order_book_stress(
                F.col("prior_family"), F.col("spread_bps"), F.col("volatility_proxy")
            ),
        }
    )


def two_task_contexts(
    bars: DataFrame, depth: DataFrame, plan: BookPlan, risk_horizon: int,
    eligible_role: str = "risk_limit_proposer", ineligible_role: str = "risk_critic",
) -> DataFrame:
    """Two context rows per date decision with sealed outcomes of both horizons."""
    by, step = ["symbol"], plan.step_seconds
    base = order_book_decisions(bars, depth, plan)
    action, outcome = F.col("action_timestamp"), F.col("outcome_timestamp")
    base = base.withColumn("risk_timestamp", shift(action, risk_horizon * step))
    base = bar_window(base, bars, by, "decision_id", action, plan.holding + 1, step,
                      plan.holding, "direct_")
    base = bar_window(base, bars, by, "decision_id", action, risk_horizon + 1, step,
                      risk_horizon, "risk_")
    base = bars_at(
        base, bars, by, "decision_id", {"exit_price_60m": (F.col("risk_timestamp"), "open")}
    )
    sides = ("bid_depth_1pct", "ask_depth_1pct")
    quoted = depth.withColumn("_tie", micros(F.col("timestamp")))
    wanted = [("entry_", "action_timestamp", False, sides), ("late_", "risk_timestamp", False, sides)]
    base = asof_many(
        base, quoted, by, "decision_id", wanted, "timestamp", "_tie", "backward", plan.max_age_seconds,
        86400, quote_spans(quoted, by, "timestamp", 86400),
    )
    total = F.col("entry_bid_depth_1pct") + F.col("entry_ask_depth_1pct")
    later = F.col("late_bid_depth_1pct") + F.col("late_ask_depth_1pct")
    broken = ~(F.col("direct_complete") & F.col("risk_complete"))
    reason = F.coalesce(
        F.col("reason"),
        first_reason([("missing_required_outcome_kline", broken),
                      ("missing_or_stale_depth", total.isNull() | later.isNull())]),
    )
    cluster = F.concat(F.lit("dates-"), F.date_format("decision_timestamp", "yyyy-MM-dd"))
    tasks = F.array(
        F.struct(F.lit("directional_execution").alias("task_id"),
                 F.lit("edge_proposer").alias("assigned_source_role"),
                 outcome.alias("task_outcome_timestamp")),
        F.struct(F.lit("risk_limit_increase").alias("task_id"),
                 role_by_hash(F.col("event_cluster_id"), eligible_role, ineligible_role)
                 .alias("assigned_source_role"),
                 F.col("risk_timestamp").alias("task_outcome_timestamp")),
    )
    return (
        base.withColumns(
            {
                "reason": reason,
                "event_cluster_id": cluster,
                "depth_deterioration_fraction_60m": clip(
                    1.0 - F.try_divide(later, total), 0.0, 1.0
                ),
            }
        )
        .select("*", F.inline(tasks))
        .withColumn("context_id", F.concat_ws("-", "decision_id", "task_id"))
    )


# Fields an agent may be shown.
PROMPT_FIELDS = (
    "context_id", "task_id", "assigned_source_role", "symbol", "momentum_30_bps",
    "momentum_5_bps", "volatility_bps", "bid_depth_1pct", "ask_depth_1pct", "depth_imbalance",
)


def prompt_view(contexts: DataFrame, fields: Sequence[str] = PROMPT_FIELDS) -> DataFrame:
    """Allow-listed decision-time fields, doubles rounded to six digits."""
    missing = sorted(set(fields) - set(contexts.columns))
    if missing:
        raise ValueError(f"contexts lack prompt fields: {missing}")
    kinds = dict(contexts.dtypes)
    return contexts.select(
        *[F.round(F.col(c), 6).alias(c) if kinds[c] == "double" else F.col(c) for c in fields]
    )
