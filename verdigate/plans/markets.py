"""Market selection and replay over orders (markets) and lines (price points)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators import markets as M
from verdigate.operators import structure as X
from verdigate.operators.distributed import materialize
from verdigate.plans.registry import query
from verdigate.sources.ingest import MARKET_SCHEMA, table


def raw_market_json(spark: SparkSession, directory: str) -> DataFrame:
    """Orders written as market metadata JSON, then read like a market dump."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    price, begin, end = F.col("o_totalprice"), F.col("_begin"), F.col("_end")

    def iso(ts):
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    win = F.when(key % 9 == 0, '["0.5", "0.5"]').when(key % 2 == 0, '["1", "0"]').otherwise('["0", "1"]')
    event = F.struct(
        F.when(key % 7 != 0, (F.floor(key / 2)).cast("string")).alias("id"),
        end.alias("endDate"),
        F.array(F.struct(F.when(key % 3 == 0, F.col("o_orderpriority")).alias("slug"))).alias("series"),
    )
    market = F.struct(
        key.cast("string").alias("id"), begin.alias("createdAt"),
        F.when(key % 5 != 0, end).alias("endDate"),
        F.when(key % 11 != 0, end).alias("closedTime"),
        win.alias("outcomePrices"), F.lit('["a", "b"]').alias("clobTokenIds"),
        (F.col("o_orderstatus") != "P").alias("closed"), F.lit(True).alias("enableOrderBook"),
        price.alias("volumeNum"), (key % 4 == 0).alias("feesEnabled"),
        F.when(key % 8 == 0, F.struct(F.lit("0.02").alias("rate"))).alias("feeSchedule"),
        F.when(key % 3 == 1, F.col("o_orderstatus")).alias("category"),
        F.array(event).alias("events"),
    )
    # Dates are written once for all fields that hold them.
    dated = table(spark, directory, "orders").withColumns(
        {"_begin": iso(date), "_end": iso(date + F.expr("INTERVAL 20 DAYS"))}
    )
    return dated.select(F.to_json(market).alias("value"))


def market_view(spark: SparkSession, directory: str) -> DataFrame:
    parsed = raw_market_json(spark, directory).select(
        F.from_json("value", MARKET_SCHEMA).alias("m")
    ).select("m.*")
    return M.market_fields(parsed)


MARKET_SQL = """m AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, epoch(o_orderdate) AS created,
    CASE WHEN o_orderkey % 11 <> 0 THEN epoch(o_orderdate) + 1728000.0e0 END AS closed_at,
    epoch(o_orderdate) + 1728000.0e0 AS scheduled_end, o_totalprice AS volume,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS resolved,
    CASE WHEN o_orderkey % 4 <> 0 THEN 0.0e0 WHEN o_orderkey % 8 = 0 THEN 0.02e0 END AS fee_rate,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'market_metadata_fees_disabled'
      WHEN o_orderkey % 8 = 0 THEN 'market_metadata_fee_schedule' ELSE 'missing_fee_schedule' END
      AS fee_source,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'event-' || (o_orderkey // 2) ELSE 'market-' || o_orderkey END
      AS event_cluster_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'series:' || o_orderpriority
      WHEN o_orderkey % 3 = 1 THEN 'category:' || o_orderstatus ELSE 'unclassified' END AS series_key,
    o_orderstatus <> 'P' AS closed, strftime(o_orderdate, '%Y-%m') AS month
  FROM orders),
c AS (
  SELECT * FROM m WHERE closed AND resolved IS NOT NULL AND closed_at <= 1e10
    AND (closed_at - created) / 3600.0e0 >= 24 AND volume >= 50000.0e0)"""


@query(
    "SRC8_PRJ24_PRJ33_market_fields",
    f"""WITH {MARKET_SQL} SELECT id, created, closed_at, scheduled_end, fee_rate, fee_source,
      event_cluster_id, series_key, id IN (SELECT id FROM c) AS candidate FROM m""",
    ("created", "closed_at", "scheduled_end", "fee_rate"),
)
def market_field_rows(spark, directory):
    return market_view(spark, directory).select(
        "id", "created", "closed_at", "scheduled_end", "fee_rate", "fee_source",
        "event_cluster_id", "series_key", M.valid_candidate(1e10, 24.0, 50000.0).alias("candidate"),
    )


def candidates(spark: SparkSession, directory: str) -> DataFrame:
    kept = market_view(spark, directory).filter(M.valid_candidate(1e10, 24.0, 50000.0))
    month = F.date_format(F.timestamp_seconds("created"), "yyyy-MM")
    return M.best_per_cluster(
        kept.withColumn("month", month), ["event_cluster_id", "month"], M.candidate_score()
    )


BEST_SQL = f"""{MARKET_SQL}, b AS (
  SELECT *, row_number() OVER (PARTITION BY event_cluster_id, month
    ORDER BY volume DESC, closed_at - created DESC, id DESC) AS rn FROM c),
best AS (SELECT * FROM b WHERE rn = 1)"""


@query("T4_best_market_per_cluster", f"WITH {BEST_SQL} SELECT id, event_cluster_id FROM best")
def best_market_per_cluster(spark, directory):
    return candidates(spark, directory).select("id", "event_cluster_id")


QUOTA_SQL = f"""{BEST_SQL},
q1 AS (SELECT *, row_number() OVER (PARTITION BY month, series_key ORDER BY volume DESC, id DESC) AS r
  FROM best),
q2 AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY volume DESC, id DESC) AS q
  FROM q1 WHERE r <= 5),
picked AS (SELECT * FROM q2 WHERE q <= 20)"""


def picked(spark: SparkSession, directory: str) -> DataFrame:
    return M.quota_top(
        candidates(spark, directory), "month", "series_key", [F.col("volumeNum"), F.col("id")], 5, 20
    )


@query("T5_quota_selection", f"WITH {QUOTA_SQL} SELECT id, month, series_key FROM picked")
def quota_selection(spark, directory):
    return picked(spark, directory).select("id", "month", "series_key")


@query(
    "AU15_capped_months",
    f"""WITH {QUOTA_SQL} SELECT month, count(*) AS selected, count(*) >= 20 AS cap_reached
    FROM picked GROUP BY 1""",
)
def capped_months(spark, directory):
    return X.capped_months(picked(spark, directory), "month", 20)


@query(
    "T6_top_series_share",
    f"""WITH {MARKET_SQL}, s AS (SELECT event_cluster_id, count(*) AS n FROM m GROUP BY 1),
    t AS (SELECT series_key, count(*) AS n FROM m GROUP BY 1)
    SELECT series_key, n, n * 1.0e0 / (SELECT count(*) FROM m) AS share FROM t
    ORDER BY n DESC, series_key LIMIT 10""",
    ("share",),
)
def top_series_share(spark, directory):
    return M.top_shares(market_view(spark, directory), "series_key")


@query(
    "PRJ23_trade_probability",
    """WITH t AS (SELECT l_partkey % 5 AS kind, l_discount * 12.0e0 AS price FROM lineitem),
    p AS (SELECT kind, CASE kind WHEN 0 THEN price WHEN 1 THEN 1.0e0 - price WHEN 2 THEN price
      WHEN 3 THEN 1.0e0 - price END AS p FROM t)
    SELECT kind, count(*) AS trades, count(CASE WHEN p BETWEEN 0 AND 1 THEN p END) AS usable,
      sum(CASE WHEN p BETWEEN 0 AND 1 THEN p END) AS total FROM p GROUP BY 1""",
    ("total",),
)
def trade_probability(spark, directory):
    kind = F.col("l_partkey") % 5
    asset = F.when(kind == 0, "yes").when(kind == 1, "no")
    index = F.when(kind == 2, 0).when(kind == 3, 1)
    p = M.trade_probability(
        F.col("l_discount") * 12.0, asset, F.lit("yes"), F.lit("no"), index
    )
    return table(spark, directory, "lineitem").select(kind.alias("kind"), p.alias("p")).groupBy(
        "kind"
    ).agg(F.count("*").alias("trades"), F.count("p").alias("usable"), F.sum("p").alias("total"))


def price_points(spark: SparkSession, directory: str) -> DataFrame:
    """Each line is a price observation of its order's market."""
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return (
        table(spark, directory, "lineitem")
        .join(table(spark, directory, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("id"),
            (start + (F.col("l_partkey") % 480) * 3600).alias("t"),
            (F.col("l_discount") * 9.0 + 0.05).alias("p"),
            F.when(F.col("l_linestatus") == "O", "clob_prices_history")
            .otherwise("data_api_trade").alias("source"),
        )
    )


REPLAY_SQL = f"""{MARKET_SQL},
pts AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, epoch(o_orderdate) + (l_partkey % 480) * 3600 AS t,
    l_discount * 9.0e0 + 0.05e0 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fr AS (
  SELECT *, CASE WHEN created + 0.5e0 * (scheduled_end - created) < closed_at - 60
    THEN created + 0.5e0 * (scheduled_end - created) END AS decided FROM m),
pp AS (SELECT pts.*, decided FROM pts JOIN fr USING (id)
  WHERE t >= created AND t < closed_at - 60 AND p BETWEEN 0.005e0 AND 0.995e0),
tot AS (
  SELECT id, count(*) AS points, count(*) FILTER (WHERE t < decided) AS points_before,
    count(*) FILTER (WHERE t > decided) AS points_after,
    last(p ORDER BY t, p) FILTER (WHERE t < decided) AS prior,
    first(p ORDER BY t, p) FILTER (WHERE t > decided) AS execution FROM pp GROUP BY 1),
df AS (SELECT id, p - lag(p) OVER (PARTITION BY id ORDER BY t, p) AS d FROM pp WHERE t < decided),
sd AS (SELECT id, coalesce(stddev_samp(d), 0) AS sigma, quantile_cont(abs(d), 0.5) AS med
  FROM df WHERE d IS NOT NULL GROUP BY 1),
rp0 AS (SELECT fr.*, points, points_before, points_after, prior, execution,
    coalesce(sigma, 0) AS sigma, coalesce(med, 0) AS med
  FROM fr LEFT JOIN tot USING (id) LEFT JOIN sd USING (id)),
rp AS (
  SELECT *, CASE WHEN closed_at IS NULL THEN 'missing_market_timestamp'
      WHEN decided IS NULL THEN 'fixed_decision_after_close'
      WHEN resolved IS NULL THEN 'ambiguous_resolution'
      WHEN fee_rate IS NULL THEN 'missing_fee_schedule'
      WHEN coalesce(points, 0) < 2 THEN 'insufficient_history'
      WHEN points_before < 2 THEN 'insufficient_predecision_history'
      WHEN points_after = 0 THEN 'missing_postdecision_execution' END AS reason,
    CASE WHEN prior >= 0.5 THEN execution ELSE 1 - execution END AS entry,
    CASE WHEN prior >= 0.5 THEN resolved ELSE 1 - resolved END AS payoff
  FROM rp0)"""


STRESS_SQL = """CASE WHEN fee_rate > 0 AND prior BETWEEN 0.4 AND 0.6
  THEN 'fee_peak_near_50' WHEN sigma >= 0.1 THEN 'high_historical_price_uncertainty'
  WHEN points_before <= 5 THEN 'thin_historical_price_record'
  WHEN prior <= 0.1 OR prior >= 0.9 THEN 'extreme_probability' ELSE 'ordinary' END"""
UTILITY_SQL = "payoff - entry - fee_rate * entry * (1 - entry)"


#: What a replay and its readers take of a market.
REPLAY_FIELDS = ("id", "created", "closed_at", "scheduled_end", "price_yes", "price_no", "fee_rate", "fee_source",
                 "event_cluster_id", "volumeNum")


def replay(spark: SparkSession, directory: str) -> DataFrame:
    return M.replay_rows(
        materialize(market_view(spark, directory).select(*REPLAY_FIELDS)), price_points(spark, directory), 0.5, 2
    )


@query(
    "PRJ22_market_replay",
    f"""WITH {REPLAY_SQL} SELECT id, coalesce(reason, 'kept') AS reason,
      CASE WHEN reason IS NULL THEN prior END AS prior_probability,
      CASE WHEN reason IS NULL THEN execution END AS execution_probability,
      CASE WHEN reason IS NULL THEN sigma END AS uncertainty,
      CASE WHEN reason IS NULL THEN med * 10000.0e0 END AS liquidity_cost_bps,
      CASE WHEN reason IS NULL THEN {UTILITY_SQL} END
        AS full_utility,
      CASE WHEN reason IS NULL THEN {STRESS_SQL} END
        AS stress_tag FROM rp""",
    ("prior_probability", "execution_probability", "uncertainty", "liquidity_cost_bps",
     "full_utility"),
)
def market_replay(spark, directory):
    kept = F.col("reason").isNull()
    names = ("prior_probability", "execution_probability", "uncertainty", "liquidity_cost_bps",
             "full_utility", "stress_tag")
    return replay(spark, directory).select(
        "id", *[F.when(kept, F.col(c)).alias(c) for c in names],
        F.coalesce("reason", F.lit("kept")).alias("reason"),
    )


@query(
    "PL10_market_exclusions",
    f"""WITH {REPLAY_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS markets FROM rp
    GROUP BY 1""",
)
def market_exclusions(spark, directory):
    return replay(spark, directory).groupBy(
        F.coalesce("reason", F.lit("kept")).alias("reason")
    ).agg(F.count("*").alias("markets"))


@query(
    "PL10_market_dataset",
    f"""WITH {REPLAY_SQL}, kb AS (
      SELECT *, {STRESS_SQL} AS stress_tag, {UTILITY_SQL} AS full_utility,
        greatest(prior, 1 - prior) AS confidence, row_number() OVER (PARTITION BY event_cluster_id
          ORDER BY coalesce(volume, 0) DESC, closed_at - created DESC, id DESC) AS rn
      FROM rp WHERE reason IS NULL),
    placed AS (
      SELECT *, row_number() OVER (ORDER BY closed_at, event_cluster_id) AS place,
        count(*) OVER () AS n FROM kb WHERE rn = 1),
    cut AS (
      SELECT *, CASE WHEN place <= round_even(0.6e0 * n, 0) THEN 'train'
        WHEN place <= round_even(0.6e0 * n, 0) + round_even(0.2e0 * n, 0) THEN 'validation'
        ELSE 'test' END AS split FROM placed)
    SELECT split, stress_tag, count(*) AS rows, avg(full_utility) AS full_utility,
      avg(confidence) AS confidence FROM cut GROUP BY 1, 2""",
    ("full_utility", "confidence"),
)
def market_dataset(spark, directory, thin_to: int | None = None):
    """Kept replay rows, one market per cluster, thinned evenly if asked, split in time order."""
    kept = replay(spark, directory).filter(F.col("reason").isNull())
    best = M.best_per_cluster(kept, ["event_cluster_id"], M.candidate_score())
    best = materialize(best.withColumn("resolved_at", F.timestamp_seconds("closed_at")))
    thin = best if thin_to is None else X.evenly_spaced(best, ["resolved_at", "id"], thin_to)
    bounds = X.fraction_bounds(thin.count(), [("train", 0.6), ("validation", 0.2)])
    splits = X.chronological_split(thin, "event_cluster_id", "resolved_at", bounds, "test")
    rows = thin.join(splits.select("event_cluster_id", "split"), "event_cluster_id")
    return rows.groupBy("split", "stress_tag").agg(
        F.count("*").alias("rows"), F.avg("full_utility").alias("full_utility"),
        F.avg("confidence").alias("confidence"),
    )
