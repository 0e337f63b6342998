"""Prediction-market replay: candidates, quotas, price-history splits, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.functions.columns import is_true
from verdigate.operators.distributed import grouped_quantiles, materialize
from verdigate.operators.labels import market_stress
from verdigate.operators.structure import first_reason
from verdigate.operators.timeseries import sliced_lag


def json_doubles(c: Column) -> Column:
    """JSON list of numbers or numeric strings as doubles; NULL when malformed."""
    return F.transform(F.from_json(c, "array<string>"), lambda v: v.try_cast("double"))


def epoch(c: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(c)) / F.lit(1e6)


def _named(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def series_key() -> Column:
    """First available of the series, tag and category fields."""
    series = F.try_element_at(F.try_element_at(F.col("events"), F.lit(1))["series"], F.lit(1))
    tag = F.try_element_at(F.col("tags"), F.lit(1))
    options = [
        F.concat(F.lit("series:"), F.coalesce(_named(series["slug"]), _named(series["title"]))),
        F.concat(F.lit("tag:"), F.coalesce(_named(tag["slug"]), _named(tag["label"]))),
        *[
            F.concat(F.lit(f"{f}:"), _named(F.col(f)))
            for f in ("category", "sportsMarketType", "feeType", "marketType")
        ],
    ]
    return F.coalesce(*options, F.lit("unclassified"))


def market_fields(markets: DataFrame) -> DataFrame:
    """Parsed times, prices, fee, cluster and series of raw market metadata."""
    event = F.try_element_at(F.col("events"), F.lit(1))
    prices = F.col("_prices")
    rate = F.col("feeSchedule.rate").try_cast("double")
    free = ~is_true(F.col("feesEnabled"))
    source = (
        F.when(free, "market_metadata_fees_disabled")
        .when(rate.isNotNull(), "market_metadata_fee_schedule")
        .when(F.col("feeSchedule.rate").isNotNull(), "invalid_fee_schedule")
        .otherwise("missing_fee_schedule")
    )
    # The list is parsed once for both prices.
    return markets.withColumn("_prices", json_doubles(F.col("outcomePrices"))).withColumns(
        {
            "created": epoch(F.coalesce("createdAt", "startDate")),
            "closed_at": epoch(F.col("closedTime")),
            "scheduled_end": F.coalesce(epoch(F.col("endDate")), epoch(event["endDate"])),
            "price_yes": F.try_element_at(prices, F.lit(1)),
            "price_no": F.try_element_at(prices, F.lit(2)),
            "token_count": F.size(F.from_json("clobTokenIds", "array<string>")),
            "fee_rate": F.when(free, F.lit(0.0)).otherwise(rate),
            "fee_source": source,
            "event_cluster_id": F.coalesce(
                F.concat(F.lit("event-"), event["id"]), F.concat(F.lit("market-"), F.col("id"))
            ),
            "series_key": series_key(),
        }
    ).drop("_prices")


def resolution() -> Column:
    """1, 0 or NULL when the market did not resolve cleanly."""
    yes, no = F.col("price_yes"), F.col("price_no")
    return F.when((yes >= 0.99) & (no <= 0.01), 1).when((no >= 0.99) & (yes <= 0.01), 0)


def valid_candidate(cutoff: float, min_hours: float, min_volume: float) -> Column:
    return (
        is_true(F.col("closed")) & is_true(F.col("enableOrderBook"))
        & resolution().isNotNull() & is_true(F.col("token_count") >= 2)
        & F.col("scheduled_end").isNotNull()
        & is_true(F.col("closed_at") <= cutoff)
        & is_true((F.col("closed_at") - F.col("created")) / 3600.0 >= min_hours)
        & is_true(F.coalesce("volumeNum", F.lit(0.0)) >= min_volume)
    )


def decision_time(fraction: float) -> Column:
    """Lifecycle-fraction time, NULL unless it lies inside the market's life."""
    created, end, closed = F.col("created"), F.col("scheduled_end"), F.col("closed_at")
    target = created + F.lit(fraction) * (end - created)
    return F.when((end > created) & (created < target) & (target < closed - 60.0), target)


def candidate_score() -> Column:
    return F.struct(
        F.coalesce("volumeNum", F.lit(0.0)).alias("volume"),
        (F.col("closed_at") - F.col("created")).alias("duration"),
        F.col("id").alias("id"),
    )


def best_per_cluster(markets: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    """Highest-scored market per cluster, combined map-side."""
    whole = F.struct(*[F.col(c) for c in markets.columns])
    return markets.groupBy(*keys).agg(F.max_by(whole, score).alias("_m")).select("_m.*")


def quota_top(
    df: DataFrame, month: str, series: str, score: Sequence[Column], per_series: int, per_month: int
) -> DataFrame:
    """At most `per_series` rows of a series and then `per_month` of a month, best
    first.

    The series cut runs first; Spark turns each rank filter into a group limit that
    is applied before the shuffle, so a hot month sends only its best rows.
    """
    order = [c.desc() for c in score]
    within = Window.partitionBy(month, series).orderBy(*order)
    kept = df.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= per_series)
    overall = Window.partitionBy(month).orderBy(*order)
    return (
        kept.withColumn("_q", F.row_number().over(overall))
        .filter(F.col("_q") <= per_month)
        .drop("_r", "_q")
    )


def top_shares(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Top value counts with their share of all rows (a top-k report)."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_total")).withColumn("_k", F.lit(1))
    top = counted.orderBy(F.desc("n"), column).limit(k).withColumn("_k", F.lit(1))
    return top.join(F.broadcast(total), "_k").select(
        column, "n", (F.col("n") / F.col("_total")).alias("share")
    )


def trade_probability(price: Column, asset: Column, yes: Column, no: Column, index: Column) -> Column:
    """YES probability of a trade; flipped for the other token, NULL if out of range."""
    p = (
        F.when(is_true(asset == yes), price)
        .when(is_true(asset == no), 1.0 - price)
        .when(is_true(index == 0), price)
        .when(is_true(index == 1), 1.0 - price)
    )
    return F.when(p.between(0.0, 1.0), p)


def replay_rows(
    markets: DataFrame, points: DataFrame, fraction: float, min_points: int,
    slice_seconds: int = 86400 * 30,
) -> DataFrame:
    """One replay row per market from its fields and its price points (id, t, p,
    source), with the first failing reason.

    Points are split at the decision time by joins and aggregates; their ordered
    differences come from a lag cut into time slices, so a market with very many
    points is not one task's work.
    """
    base = markets.withColumns({"decision_at": decision_time(fraction), "resolved_yes": resolution()})
    frame = base.select("id", "created", "closed_at", "decision_at")
    p = (
        points.join(frame, "id")
        .filter(
            (F.col("t") >= F.col("created")) & (F.col("t") < F.col("closed_at") - 60.0)
            & F.col("p").between(0.005, 0.995)
        )
        .groupBy("id", "t", "p", "decision_at")
        .agg(F.min("source").alias("source"))
    )
    # The points and their differences are read by several aggregates each.
    p = materialize(p)
    t, at = F.col("t"), F.col("decision_at")
    point = F.struct("t", "p", "source")
    totals = p.groupBy("id").agg(
        F.count("*").alias("points"),
        F.count_if(t < at).alias("points_before"),
        F.count_if(t > at).alias("points_after"),
        F.max(F.when(t < at, point)).alias("_last"),
        F.min(F.when(t > at, point)).alias("_next"),
    )
    before = p.filter(t < at).withColumn("ts", F.timestamp_seconds("t"))
    moved = sliced_lag(before, ["id"], "ts", ["p"], "p", "_prev", slice_seconds).withColumn(
        "_d", F.col("p") - F.col("_prev")
    ).filter(F.col("_d").isNotNull())
    moved = materialize(moved.select("id", "_d"))
    spread = moved.groupBy("id").agg(F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("_std"))
    middle = grouped_quantiles(
        moved.withColumn("_a", F.abs("_d")), ["id"], "_a", {"m": 0.5}
    ).select("id", F.col("value").alias("_median"))
    j = base.join(totals, "id", "left").join(spread, "id", "left").join(middle, "id", "left")
    n = F.coalesce("points", F.lit(0))
    reason = first_reason(
        [
            ("missing_market_timestamp",
             F.col("created").isNull() | F.col("closed_at").isNull() | F.col("scheduled_end").isNull()),
            ("invalid_scheduled_lifecycle", F.col("scheduled_end") <= F.col("created")),
            ("fixed_decision_after_close", F.col("decision_at").isNull()),
            ("missing_resolution_price", F.col("price_yes").isNull() | F.col("price_no").isNull()),
            ("ambiguous_resolution", F.col("resolved_yes").isNull()),
            ("invalid_fee_schedule", F.col("fee_source") == "invalid_fee_schedule"),
            ("missing_fee_schedule", F.col("fee_rate").isNull()),
            ("insufficient_history", n < min_points),
            ("insufficient_predecision_history", F.col("points_before") < min_points),
            ("missing_postdecision_execution", F.col("points_after") == 0),
        ]
    )
    prior, execution = F.col("_last.p"), F.col("_next.p")
    long_ = prior >= 0.5
    entry = F.when(long_, execution).otherwise(1.0 - execution)
    payoff = F.when(long_, F.col("resolved_yes")).otherwise(1 - F.col("resolved_yes")).cast("double")
    fee = F.col("fee_rate") * entry * (1.0 - entry)
    gross = payoff - entry
    hours = (F.col("closed_at") - F.col("decision_at")) / 3600.0
    sigma = F.coalesce("_std", F.lit(0.0))
    return j.withColumns(
        {
            "reason": reason,
            "prior_probability": prior,
            "execution_probability": execution,
            "historical_probability_source": F.coalesce(
                F.col("_last.source"), F.lit("clob_prices_history")
            ),
            "candidate_action": F.when(long_, 1).otherwise(-1),
            "confidence": F.greatest(prior, 1.0 - prior),
            "uncertainty": sigma,
            "volatility_proxy": sigma,
            "expected_edge_bps": F.abs(prior - 0.5) * 20000.0,
            "liquidity_cost_bps": F.coalesce("_median", F.lit(0.0)) * 10000.0,
            "turnover_cost_bps": F.lit(0.0),
            "fee_bps": F.col("fee_rate") * prior * (1.0 - prior) * 10000.0,
            "full_utility": gross - fee,
            "reduced_utility": 0.5 * gross - 0.5 * fee,
            "time_to_resolution_hours": hours,
            "horizon": F.greatest(F.lit(1), F.bround(hours).cast("int")),
            "realized_latency_cost_bps": F.abs(execution - prior) * 10000.0,
            "stress_tag": market_stress(
                prior, sigma, F.col("points_before"), hours, F.col("fee_rate")
            ),
        }
    ).drop("_last", "_next", "_std", "_median")
