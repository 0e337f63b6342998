"""As-of and window joins and order-book builds over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.functions.columns import micros
from verdigate.operators import datasets, labels, sealing
from verdigate.operators import structure as X
from verdigate.operators.distributed import materialize, shared_folder
from verdigate.operators.timeseries import (
    asof_join, bar_window, exact_bar, outcome_buffer, realised_volatility, resample_last,
)
from verdigate.plans.registry import query
from verdigate.sources.ingest import clean_quotes, parse_bars, pivot_depth, session_hours, table

DAY = 86400


def events(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events")


def _asof(spark, directory, direction, strict, max_age, quote_types=None):
    e = events(spark, directory)
    probes = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    quotes = e if quote_types is None else e.filter(F.col("event_type").isin(*quote_types))
    quotes = quotes.select(
        "user_id", F.col("ts").alias("quote_ts"), F.col("event_id").alias("quote_id"), "value"
    )
    return asof_join(
        probes, quotes, ["user_id"], "ts", "quote_ts", ["quote_id", "value"], "quote_id",
        direction, strict, max_age, slice_seconds=DAY,
    ).select("event_id", "quote_id", "value", "age_seconds")


def _asof_sql(compare: str, order: str, max_age: int, quotes: str) -> str:
    return f"""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    m AS (
      SELECT p.event_id, q.event_id AS quote_id, q.value,
        abs(epoch_us(p.ts) - epoch_us(q.ts)) / 1e6 AS age_seconds,
        row_number() OVER (PARTITION BY p.event_id ORDER BY q.ts {order}, q.event_id {order}) AS rn
      FROM p JOIN events q ON q.user_id = p.user_id AND q.ts {compare} p.ts {quotes}),
    b AS (SELECT * FROM m WHERE rn = 1 AND age_seconds <= {max_age})
    SELECT p.event_id, quote_id, value, age_seconds FROM p LEFT JOIN b USING (event_id)"""


VIEWS = "AND q.event_type IN ('view', 'click')"
_AS = ("value", "age_seconds")


@query("J8_asof_backward", _asof_sql("<=", "DESC", DAY, VIEWS), _AS)
def asof_backward(spark, directory):
    return _asof(spark, directory, "backward", False, DAY, ("view", "click"))


@query("J9_asof_backward_strict", _asof_sql("<", "DESC", 3 * DAY, ""), _AS)
def asof_backward_strict(spark, directory):
    return _asof(spark, directory, "backward", True, 3 * DAY)


@query("J10_asof_forward", _asof_sql(">=", "ASC", DAY, VIEWS), _AS)
def asof_forward(spark, directory):
    return _asof(spark, directory, "forward", False, DAY, ("view", "click"))


def hourly_bars(spark: SparkSession, directory: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return (
        events(spark, directory)
        .withColumns(
            {
                "symbol": F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")),
                "open_time": F.date_trunc("hour", F.col("ts")).cast("timestamp"),
            }
        )
        .groupBy("symbol", "open_time")
        .agg(
            F.min_by("value", at).alias("open"), F.max("value").alias("high"),
            F.min("value").alias("low"), F.max_by("value", at).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )


BARS_SQL = """bars AS (
  SELECT 'S' || (user_id % 2) AS symbol, date_trunc('hour', ts) AS open_time,
    first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*) * 1.0e0 AS volume
  FROM events GROUP BY 1, 2),
dec AS (
  SELECT symbol, day, day + h * INTERVAL 1 HOUR AS d,
    symbol || '-' || strftime(day + h * INTERVAL 1 HOUR, '%Y-%m-%d-%H%M') AS decision_id
  FROM (SELECT DISTINCT symbol, CAST(CAST(open_time AS DATE) AS TIMESTAMP) AS day FROM bars),
    (SELECT unnest([8, 12, 16]) AS h))"""
PLAN = datasets.BookPlan(
    step_seconds=3600, lookback=6, short=2, action_delay=1, holding=2, max_age_seconds=21600.0
)


@query(
    "J11_exact_bar_lookup",
    f"""WITH {BARS_SQL} SELECT decision_id, b.close AS end_close, b.open AS end_open
    FROM dec LEFT JOIN bars b ON b.symbol = dec.symbol AND b.open_time = d - INTERVAL 1 HOUR""",
    ("end_close", "end_open"),
)
def exact_bar_lookup(spark, directory):
    bars = hourly_bars(spark, directory)
    probes = datasets.decision_grid(bars, ["symbol"], PLAN.hours)
    return exact_bar(
        probes, bars, ["symbol"], datasets.shift(F.col("decision_timestamp"), -3600),
        ["close", "open"], "end_",
    ).select("decision_id", "end_close", "end_open")


def _window_sql(lo: str, hi: str, steps: int, horizon: int) -> str:
    return f"""w AS (
      SELECT decision_id, open_time, open, high, low, close, ln(close / lag(close) OVER (
        PARTITION BY decision_id ORDER BY open_time)) AS r
      FROM dec JOIN bars b ON b.symbol = dec.symbol AND b.open_time BETWEEN d {lo} AND d {hi}),
    ws AS (
      SELECT decision_id, count(*) AS bars, min(low) AS min_price, max(high) AS max_price,
        coalesce(stddev_samp(r) * sqrt({horizon}.0e0) * 10000.0e0, 0) AS volatility_bps,
        count(*) = {steps} AND min(least(open, high, low, close)) > 0 AS complete
      FROM w GROUP BY 1)"""


_WIN = ("min_price", "max_price", "volatility_bps")


@query(
    "J12_W6_lookback_window",
    f"""WITH {BARS_SQL}, {_window_sql("- INTERVAL 7 HOUR", "- INTERVAL 1 HOUR", 7, 6)}
    SELECT decision_id, bars, min_price, max_price, volatility_bps,
      coalesce(complete, FALSE) AS complete FROM dec LEFT JOIN ws USING (decision_id)""",
    _WIN,
)
def lookback_window(spark, directory):
    bars = hourly_bars(spark, directory)
    probes = datasets.decision_grid(bars, ["symbol"], PLAN.hours)
    return bar_window(
        probes, bars, ["symbol"], "decision_id",
        datasets.shift(F.col("decision_timestamp"), -7 * 3600), 7, 3600,
    ).select("decision_id", "bars", "min_price", "max_price", "volatility_bps", "complete")


@query(
    "J13_forward_window",
    f"""WITH {BARS_SQL}, {_window_sql("+ INTERVAL 1 HOUR", "+ INTERVAL 3 HOUR", 3, 2)}
    SELECT decision_id, bars, min_price, max_price, volatility_bps,
      coalesce(complete, FALSE) AS complete FROM dec LEFT JOIN ws USING (decision_id)""",
    _WIN,
)
def forward_window(spark, directory):
    bars = hourly_bars(spark, directory)
    probes = datasets.decision_grid(bars, ["symbol"], PLAN.hours)
    return bar_window(
        probes, bars, ["symbol"], "decision_id",
        datasets.shift(F.col("decision_timestamp"), 3600), 3, 3600,
    ).select("decision_id", "bars", "min_price", "max_price", "volatility_bps", "complete")


@query(
    "W7_resample_and_volatility",
    """WITH b AS (
      SELECT user_id % 2 AS g, CAST(ts AS DATE) AS day, epoch_us(ts) // 600000000 AS b,
        last(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1, 2, 3),
    g AS (SELECT g, day, unnest(range(min(b), max(b) + 1)) AS b FROM b GROUP BY 1, 2),
    j AS (SELECT g, day, b, v, lag(v) OVER (PARTITION BY g, day ORDER BY b) AS pv
      FROM g LEFT JOIN b USING (g, day, b)),
    f AS (SELECT g, day, b, coalesce(v, pv) AS v FROM j WHERE coalesce(v, pv) IS NOT NULL),
    r AS (SELECT g, day, ln(v / lag(v) OVER (PARTITION BY g, day ORDER BY b)) AS r FROM f)
    SELECT g, day, count(*) AS steps, CASE WHEN count(*) >= 20
      THEN stddev_samp(r) * sqrt(30.0e0) * 10000.0e0 END AS volatility_bps FROM r GROUP BY 1, 2""",
    ("volatility_bps",),
)
def resample_and_volatility(spark, directory):
    e = events(spark, directory).withColumns(
        {"g": F.col("user_id") % 2, "day": F.to_date("ts")}
    )
    steps = resample_last(e, ["g", "day"], "ts", "value", "event_id", 600)
    return realised_volatility(steps, ["g", "day"], "value", 30, 20)


@query(
    "W10_outcome_buffer",
    """WITH e AS (SELECT DISTINCT user_id, ts AS d, ts + INTERVAL 6 HOUR AS o FROM events
      WHERE event_type = 'purchase'),
    l AS (SELECT user_id, d, lag(o) OVER (PARTITION BY user_id ORDER BY d, o) AS p FROM e)
    SELECT user_id, min((epoch_us(d) - epoch_us(p)) / 1e6) AS min_buffer,
      count(*) FILTER (WHERE d < p) AS overlaps FROM l WHERE p IS NOT NULL GROUP BY 1""",
    ("min_buffer",),
)
def buffer_per_user(spark, directory):
    e = events(spark, directory).filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("decision_timestamp"),
        (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("outcome_timestamp"),
    )
    return outcome_buffer(e, ["user_id"]).groupBy("user_id").agg(
        F.min("buffer_seconds").alias("min_buffer"),
        F.count_if(F.col("buffer_seconds") < 0).alias("overlaps"),
    )


@query(
    "SRC4_bar_parsing",
    """SELECT event_id, value AS open, epoch_us(ts) // 1000 AS open_ms FROM events
    WHERE event_type <> 'error'""",
    ("open",),
)
def bar_parsing(spark, directory):
    """Text bars; rows with a header-like open price fail the cast and drop out."""
    text = events(spark, directory).select(
        "event_id", F.expr("CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING)").alias("open_time"),
        F.when(F.col("event_type") == "error", "open").otherwise(F.col("value").cast("string")).alias("open"),
        *[F.col("value").cast("string").alias(c) for c in ("high", "low", "close", "volume")],
    )
    return parse_bars(text).select(
        "event_id", "open", F.unix_millis("open_time").alias("open_ms")
    )


def depth_rows(spark: SparkSession, directory: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, directory).select(
        F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("symbol"),
        F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600)
        .alias("timestamp"),
        F.when(kind.isin("view", "click"), "-1").when(kind == "error", "5").otherwise("1").alias(
            "percentage"
        ),
        (F.col("value") * 10000.0).cast("string").alias("notional"),
        F.col("event_id").alias("seq"),
    )


DEPTH_SQL = """depth AS (
  SELECT 'S' || (user_id % 2) AS symbol, date_trunc('hour', ts) AS timestamp,
    last(value * 10000.0e0 ORDER BY event_id) FILTER (WHERE event_type IN ('view', 'click'))
      AS bid_depth_1pct,
    last(value * 10000.0e0 ORDER BY event_id) FILTER (WHERE event_type IN ('purchase', 'signup'))
      AS ask_depth_1pct
  FROM events GROUP BY 1, 2
  HAVING bid_depth_1pct IS NOT NULL AND ask_depth_1pct IS NOT NULL)"""


def depth_view(spark: SparkSession, directory: str) -> DataFrame:
    return pivot_depth(depth_rows(spark, directory), ["symbol"])


@query(
    "SRC5_depth_pivot",
    f"""WITH {DEPTH_SQL} SELECT symbol, epoch_ms(timestamp) // 1000 AS second, bid_depth_1pct,
      ask_depth_1pct FROM depth""",
    ("bid_depth_1pct", "ask_depth_1pct"),
)
def depth_pivot(spark, directory):
    return depth_view(spark, directory).select(
        "symbol", F.unix_seconds("timestamp").alias("second"), "bid_depth_1pct", "ask_depth_1pct"
    )


def quote_rows(spark: SparkSession, directory: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events(spark, directory).select(
        F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("symbol"),
        F.date_trunc("minute", F.col("ts")).cast("timestamp").alias("ts"),
        F.lit(1).alias("instrument_id"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias(
            "bid_px_00"
        ),
        (F.col("value") * 1.001 + (k % 5) * 0.01 - 0.01).alias("ask_px_00"),
        (k % 10).cast("double").alias("bid_sz_00"),
        (k % 7 + 1).cast("double").alias("ask_sz_00"),
        F.col("event_id").alias("seq"),
    )


QUOTES_SQL = """q0 AS (
  SELECT 'S' || (user_id % 2) AS symbol, date_trunc('minute', ts) AS ts, event_id, event_type,
    value AS bid, value * 1.001e0 + (CAST(json_extract(props, '$.k') AS BIGINT) % 5) * 0.01e0 - 0.01e0
      AS ask, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bs,
    CAST(json_extract(props, '$.k') AS BIGINT) % 7 + 1 AS asz,
    row_number() OVER (PARTITION BY user_id % 2, date_trunc('minute', ts) ORDER BY event_id DESC) AS rn
  FROM events),
quotes AS (
  SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS loc FROM q0
  WHERE rn = 1 AND event_type <> 'error' AND bid > 0 AND ask > bid AND bs >= 1 AND asz >= 1)"""


@query(
    "SRC6_SRC7_quote_cleaning",
    f"""WITH {QUOTES_SQL} SELECT symbol, epoch_ms(ts) // 1000 AS second, bid AS bid_px_00,
      ask AS ask_px_00, CAST(loc AS DATE) AS local_date, strftime(loc, '%H:%M:%S') AS local_time
    FROM quotes WHERE strftime(loc, '%H:%M:%S') BETWEEN '08:30:00' AND '15:00:00'""",
    ("bid_px_00", "ask_px_00"),
)
def quote_cleaning(spark, directory):
    cleaned = clean_quotes(quote_rows(spark, directory), ["symbol"], "America/Chicago")
    return session_hours(cleaned, "08:30:00", "15:00:00").select(
        "symbol", F.unix_seconds("ts").alias("second"), "bid_px_00", "ask_px_00", "local_date",
        "local_time",
    )


def _imp(c: str) -> str:
    return f"(CASE WHEN {c} > 0 THEN least(100.0e0, 50.0e0 * 100000.0e0 / {c}) ELSE 100.0e0 END)"


BOOK_SQL = f"""{BARS_SQL}, {DEPTH_SQL}, {_window_sql("- INTERVAL 7 HOUR", "- INTERVAL 1 HOUR", 7, 6)},
pos AS (SELECT decision_id, bool_and(least(open, high, low, close) > 0) AS positive FROM w GROUP BY 1),
k AS (
  SELECT dec.*, s.close AS start_close, e.close AS end_close, h.close AS short_close,
    n.open AS entry_price, x.open AS exit_price, ws.bars, ws.volatility_bps, pos.positive
  FROM dec
    LEFT JOIN bars s ON s.symbol = dec.symbol AND s.open_time = d - INTERVAL 7 HOUR
    LEFT JOIN bars e ON e.symbol = dec.symbol AND e.open_time = d - INTERVAL 1 HOUR
    LEFT JOIN bars h ON h.symbol = dec.symbol AND h.open_time = d - INTERVAL 3 HOUR
    LEFT JOIN bars n ON n.symbol = dec.symbol AND n.open_time = d + INTERVAL 1 HOUR
    LEFT JOIN bars x ON x.symbol = dec.symbol AND x.open_time = d + INTERVAL 3 HOUR
    LEFT JOIN ws USING (decision_id) LEFT JOIN pos USING (decision_id)),
k1 AS (
  SELECT decision_id, q.bid_depth_1pct AS bid, q.ask_depth_1pct AS ask,
    row_number() OVER (PARTITION BY decision_id ORDER BY q.timestamp DESC) AS rn, q.timestamp AS qt, d
  FROM dec JOIN depth q ON q.symbol = dec.symbol AND q.timestamp <= d),
k2 AS (
  SELECT decision_id, q.bid_depth_1pct AS xbid, q.ask_depth_1pct AS xask,
    row_number() OVER (PARTITION BY decision_id ORDER BY q.timestamp DESC) AS rn, q.timestamp AS qt, d
  FROM dec JOIN depth q ON q.symbol = dec.symbol AND q.timestamp <= d + INTERVAL 3 HOUR),
bk0 AS (
  SELECT k.*, bid, ask, xbid, xask FROM k
    LEFT JOIN (SELECT * FROM k1 WHERE rn = 1 AND epoch(d) - epoch(qt) <= 21600) a USING (decision_id)
    LEFT JOIN (SELECT * FROM k2 WHERE rn = 1 AND epoch(d) + 10800 - epoch(qt) <= 21600) b
      USING (decision_id)),
bk AS (
  SELECT *, CASE
    WHEN start_close IS NULL OR end_close IS NULL OR short_close IS NULL OR entry_price IS NULL
      OR exit_price IS NULL THEN 'missing_required_kline'
    WHEN coalesce(bars, 0) < 6 OR NOT positive THEN 'insufficient_feature_window'
    WHEN bid IS NULL OR xbid IS NULL THEN 'missing_or_stale_depth'
    WHEN least(bid, ask, xbid, xask) <= 0 THEN 'nonpositive_depth'
    WHEN least(start_close, end_close, short_close, entry_price, exit_price) <= 0
      THEN 'nonpositive_price' END AS reason,
    (end_close / start_close - 1.0e0) * 10000.0e0 AS m30,
    (end_close / short_close - 1.0e0) * 10000.0e0 AS m5,
    (bid - ask) / (bid + ask) AS imb,
    least(1.0e0, greatest({_imp("bid")}, {_imp("ask")}) / 100.0e0) AS thin,
    least(greatest(volatility_bps / 100.0e0, 0.0e0), 1.5e0) AS vp
  FROM bk0)"""


def book(spark: SparkSession, directory: str) -> DataFrame:
    return datasets.order_book_decisions(
        materialize(hourly_bars(spark, directory)), materialize(depth_view(spark, directory)), PLAN
    )


@query(
    "PL7_order_book_decisions",
    f"""WITH {BOOK_SQL} SELECT decision_id, coalesce(reason, 'kept') AS reason,
      CASE WHEN reason IS NULL THEN m30 END AS momentum_30_bps,
      CASE WHEN reason IS NULL THEN m5 END AS momentum_5_bps,
      CASE WHEN reason IS NULL THEN volatility_bps END AS volatility_bps,
      CASE WHEN reason IS NULL THEN imb END AS depth_imbalance,
      CASE WHEN reason IS NULL THEN thin END AS thinness FROM bk""",
    ("momentum_30_bps", "momentum_5_bps", "volatility_bps", "depth_imbalance", "thinness"),
)
def order_book_decisions(spark, directory):
    kept = F.col("reason").isNull()
    return book(spark, directory).select(
        "decision_id",
        *[F.when(kept, F.col(c)).alias(c) for c in
          ("momentum_30_bps", "momentum_5_bps", "volatility_bps", "depth_imbalance", "thinness")],
        F.coalesce("reason", F.lit("kept")).alias("reason"),
    )


@query(
    "AU11_exclusion_accounting",
    f"""WITH {BOOK_SQL}, f AS (
      SELECT day, reason, row_number() OVER (PARTITION BY day
        ORDER BY CASE WHEN reason IS NULL THEN 1 ELSE 0 END, decision_id) AS rn FROM bk)
    SELECT reason, count(*) AS clusters FROM f WHERE rn = 1 GROUP BY 1""",
)
def exclusion_accounting(spark, directory):
    return X.exclusions(book(spark, directory), "day", "decision_id")


_PRIOR_SQL = {
    "momentum_30m": ("sg", "0.55e0 + 0.40e0 * tr", "0.15e0 + 0.35e0 * heat",
                     "greatest(0.5e0, least(100.0e0, abs(m30) * 0.35e0))"),
    "reversal_30m": ("-sg", "0.53e0 + 0.32e0 * tr", "0.25e0 + 0.40e0 * heat",
                     "greatest(0.5e0, least(100.0e0, abs(m30) * 0.25e0))"),
    "depth_imbalance": ("CASE WHEN imb > 0 THEN 1 WHEN imb < 0 THEN -1 ELSE sg END",
                        "0.55e0 + 0.40e0 * tilt", "0.15e0 + 0.65e0 * (1.0e0 - tilt)",
                        "greatest(0.5e0, 35.0e0 * tilt)"),
    "volatility_breakout": ("CASE WHEN m5 > 0 THEN 1 WHEN m5 < 0 THEN -1 ELSE sg END",
                            "0.55e0 + 0.35e0 * least(bu + 0.2e0 * heat, 1.0e0)",
                            "0.2e0 + 0.45e0 * heat",
                            "greatest(0.5e0, least(100.0e0, abs(m5) * 0.3e0 + volatility_bps * 0.08e0))"),
    "spread_blind_high_conf": ("sg", "0.94e0", "0.08e0",
                               "greatest(8.0e0, least(100.0e0, abs(m30) * 0.5e0))"),
    "liquidity_critic": ("CASE WHEN m30 > 0 THEN 1 WHEN m30 < 0 THEN -1 WHEN imb < 0 THEN -1 ELSE 1 END",
                         "0.85e0 + 0.10e0 * thin", "0.2e0 + 0.2e0 * thin",
                         "greatest(5.0e0, least(100.0e0, abs(m30) * 0.2e0 + 20.0e0 * thin))"),
}
PRIOR_ROWS_SQL = f"""{BOOK_SQL},
bad AS (SELECT DISTINCT day FROM bk WHERE reason IS NOT NULL),
ok AS (
  SELECT *, least(abs(m30) / 80.0e0, 1.0e0) AS tr, least(abs(m5) / 50.0e0, 1.0e0) AS bu,
    least(greatest(volatility_bps, 0.0e0) / 80.0e0, 1.5e0) AS heat, least(abs(imb), 1.0e0) AS tilt,
    CASE WHEN m30 > 0 THEN 1 WHEN m30 < 0 THEN -1 ELSE 1 END AS sg
  FROM bk WHERE day NOT IN (SELECT day FROM bad)),
pr0 AS ({" UNION ALL ".join(
    f"SELECT *, '{n}' AS prior_family, {a} AS candidate_action, "
    f"least(greatest({c}, 0.5e0), 0.99e0) AS confidence, "
    f"least(greatest({u}, 0.0e0), 1.5e0) AS uncertainty, {e} AS expected_edge_bps FROM ok"
    for n, (a, c, u, e) in _PRIOR_SQL.items())}),
pr1 AS (SELECT *, CASE WHEN candidate_action > 0 THEN ask ELSE bid END AS din,
    CASE WHEN candidate_action > 0 THEN xbid ELSE xask END AS dout FROM pr0),
pr AS (SELECT *, 2.0e0 * {_imp("din")} AS liquidity_cost_bps FROM pr1)"""


BOOK_STRESS_SQL = """CASE WHEN prior_family = 'liquidity_critic' THEN 'role_ineligible_source'
  WHEN prior_family = 'spread_blind_high_conf' THEN 'cost_blind_high_confidence'
  WHEN liquidity_cost_bps > 15.0e0 THEN 'high_execution_friction'
  WHEN vp > 0.8e0 THEN 'high_volatility' ELSE 'ordinary' END"""


def prior_rows(spark: SparkSession, directory: str) -> DataFrame:
    kept = X.keep_complete(materialize(book(spark, directory)), "day")
    return datasets.order_book_rows(kept, PLAN, "book")


@query(
    "PRJ18_PRJ19_PRJ20_weak_priors",
    f"""WITH {PRIOR_ROWS_SQL} SELECT decision_id, prior_family, candidate_action, confidence,
      uncertainty, expected_edge_bps, liquidity_cost_bps,
      {BOOK_STRESS_SQL} AS stress_tag FROM pr""",
    ("confidence", "uncertainty", "expected_edge_bps", "liquidity_cost_bps"),
)
def weak_prior_rows(spark, directory):
    return prior_rows(spark, directory).select(
        "decision_id", "prior_family", "candidate_action", "confidence", "uncertainty",
        "expected_edge_bps", "liquidity_cost_bps", "stress_tag",
    )


def _pay(n: str) -> str:
    a = f"(CASE WHEN din > 0 THEN least(100.0e0, 50.0e0 * {n} / din) ELSE 100.0e0 END)"
    return f"({a} + {a.replace('din', 'dout')})"


#: Signed return of a depth row, and its utilities after fee and impact on both sides.
BOOK_GROSS_SQL = "candidate_action * (exit_price / entry_price - 1.0e0) * 10000.0e0"
BOOK_FULL_SQL = f"gross - 8.0e0 - {_pay('100000.0e0')}"
BOOK_REDUCED_SQL = f"0.5e0 * (gross - 8.0e0 - {_pay('50000.0e0')})"


@query(
    "PRJ17_order_book_outcomes",
    f"""WITH {PRIOR_ROWS_SQL}, g AS (
      SELECT *, {BOOK_GROSS_SQL} AS gross,
        CASE WHEN candidate_action > 0 THEN (exit_price / entry_price - 1.0e0) * 10000.0e0
          ELSE (entry_price / exit_price - 1.0e0) * 10000.0e0 END AS qgross FROM pr)
    SELECT prior_family, count(*) AS rows,
      sum({BOOK_FULL_SQL}) AS full_utility, sum({BOOK_REDUCED_SQL}) AS reduced_utility,
      count(*) FILTER (WHERE {BOOK_FULL_SQL} < 0) AS harms,
      sum(qgross - 8.0e0) AS quote_full_utility FROM g GROUP BY 1""",
    ("full_utility", "reduced_utility", "quote_full_utility"),
)
def order_book_outcomes(spark, directory):
    rows = prior_rows(spark, directory)
    quoted = labels.order_book_outcomes(rows, with_impact=False).withColumn(
        "quote_full_utility", F.col("full_utility")
    )
    both = labels.order_book_outcomes(quoted, with_impact=True)
    return both.groupBy("prior_family").agg(
        F.count("*").alias("rows"), F.sum("full_utility").alias("full_utility"),
        F.sum("reduced_utility").alias("reduced_utility"), F.count_if("harm_label").alias("harms"),
        F.sum("quote_full_utility").alias("quote_full_utility"),
    )


@query(
    "PRJ25_action_liquidity_cost",
    """WITH c AS (SELECT l_tax * 100.0e0 AS a, l_discount * 100.0e0 AS b,
      ['long', 'short', 'increase_limit', 'abstain'][1 + CAST(l_linenumber % 4 AS INTEGER)] AS action
      FROM lineitem)
    SELECT action, sum(CASE action WHEN 'long' THEN a WHEN 'short' THEN b
      WHEN 'increase_limit' THEN greatest(a, b) ELSE least(a, b) END) AS cost FROM c GROUP BY 1""",
    ("cost",),
)
def action_liquidity_cost(spark, directory):
    actions = F.array(*[F.lit(a) for a in ("long", "short", "increase_limit", "abstain")])
    df = table(spark, directory, "lineitem").select(
        F.element_at(actions, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("action"),
        (F.col("l_tax") * 100.0).alias("a"), (F.col("l_discount") * 100.0).alias("b"),
    )
    cost = labels.action_liquidity_cost(F.col("action"), F.col("a"), F.col("b"))
    return df.groupBy("action").agg(F.sum(cost).alias("cost"))


@query(
    "PL7_order_book_dataset",
    f"""WITH {PRIOR_ROWS_SQL}, days AS (
      SELECT day, row_number() OVER (ORDER BY day) AS place FROM (SELECT DISTINCT day FROM pr))
    SELECT CASE WHEN place <= 5 THEN 'development' WHEN place <= 15 THEN 'paper_test'
        ELSE 'community_hidden' END AS split, prior_family, count(*) AS rows,
      count(DISTINCT day) AS clusters, avg(confidence) AS confidence
    FROM pr JOIN days USING (day) GROUP BY 1, 2""",
    ("confidence",),
)
def order_book_dataset(spark, directory):
    """Feature rows with chronological splits, per split and prior family."""
    rows = prior_rows(spark, directory)
    splits = X.chronological_split(
        rows, "event_cluster_id", "decision_timestamp",
        [("development", 5), ("paper_test", 10)], "community_hidden",
    ).select("event_cluster_id", "split")
    return rows.join(splits, "event_cluster_id").groupBy("split", "prior_family").agg(
        F.count("*").alias("rows"), F.countDistinct("event_cluster_id").alias("clusters"),
        F.avg("confidence").alias("confidence"),
    )


def seal(keys: list[str], *sealed: str) -> sealing.Seal:
    return sealing.Seal(keys, sealed, [("development", 5), ("paper_test", 10)], "community_hidden")


def published(rows: DataFrame, plan: sealing.Seal, required: list[str]) -> DataFrame:
    """The open splits, read back from both published sides."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/sides-{uuid.uuid4().hex}"
    sealing.publish_sides(rows, path, plan)
    return sealing.unseal(spark, path, plan, ["development", "paper_test"], required)


@query(
    "PL7_order_book_sides",
    f"""WITH {PRIOR_ROWS_SQL}, days AS (
      SELECT day, row_number() OVER (ORDER BY day) AS place FROM (SELECT DISTINCT day FROM pr)),
    g AS (
      SELECT *, CASE WHEN place <= 5 THEN 'development' ELSE 'paper_test' END AS split,
        {BOOK_GROSS_SQL} AS gross FROM pr JOIN days USING (day) WHERE place <= 15)
    SELECT split, prior_family, count(*) AS rows, count(DISTINCT day) AS clusters,
      avg(confidence) AS confidence, sum({BOOK_FULL_SQL}) AS full_utility,
      count(*) FILTER (WHERE {BOOK_FULL_SQL} < 0) AS harms FROM g GROUP BY 1, 2""",
    ("confidence", "full_utility"),
)
def order_book_sides(spark, directory):
    """Features and sealed outcomes of the order-book rows, published by split; outcomes
    of the open splits from the joined sides."""
    plan = seal(["row_id"], "outcome_timestamp", "entry_price", "exit_")
    rows = published(prior_rows(spark, directory), plan, ["entry_price", "exit_price"])
    return labels.order_book_outcomes(rows, with_impact=True).groupBy("split", "prior_family").agg(
        F.count("*").alias("rows"), F.countDistinct("event_cluster_id").alias("clusters"),
        F.avg("confidence").alias("confidence"), F.sum("full_utility").alias("full_utility"),
        F.count_if("harm_label").alias("harms"),
    )


SESSION = datasets.SessionPlan(
    times=("10:00", "13:00"), lookback_seconds=7200, short_seconds=3600, holding_seconds=3600,
    max_age_seconds=3600.0, step_seconds=600, minimum_steps=3,
)


def sessions(spark: SparkSession, directory: str) -> DataFrame:
    quotes = clean_quotes(quote_rows(spark, directory), ["symbol"], SESSION.timezone)
    hours = materialize(session_hours(quotes, "07:00:00", "16:00:00"))
    return datasets.session_decisions(hours, SESSION)


def _quote_at_sql(name: str, source: str, probe: str, forward: bool = False, strict: bool = False) -> str:
    """The quote next to `probe` in one direction, not further away than an hour."""
    compare = (">" if forward else "<") + ("" if strict else "=")
    return f"""{name} AS (
      SELECT * EXCLUDE (rn, gap) FROM (
        SELECT decision_id, q.*, abs(epoch_us(q.ts) - epoch_us({probe})) AS gap,
          row_number() OVER (PARTITION BY decision_id ORDER BY q.ts {"" if forward else "DESC"}) AS rn
        FROM {source} p JOIN hq q ON q.symbol = p.symbol AND q.ts {compare} {probe})
      WHERE rn = 1 AND gap <= 3600000000)"""


SESSION_SQL = f"""{QUOTES_SQL},
hq AS (
  SELECT symbol, ts, CAST(loc AS DATE) AS local_date, bid, ask, bs, asz, (bid + ask) / 2.0e0 AS mid
  FROM quotes WHERE strftime(loc, '%H:%M:%S') BETWEEN '07:00:00' AND '16:00:00'),
sp AS (
  SELECT symbol, local_date, symbol || '-' || local_date || '-' || t AS decision_id,
    (CAST(local_date || ' ' || t || ':00' AS TIMESTAMP) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC' AS d
  FROM (SELECT DISTINCT symbol, local_date FROM hq), (SELECT unnest(['10:00', '13:00']) AS t)),
{_quote_at_sql("now_", "sp", "d", strict=True)}, {_quote_at_sql("start_", "sp", "d - INTERVAL 2 HOUR")},
{_quote_at_sql("short_", "sp", "d - INTERVAL 1 HOUR")},
{_quote_at_sql("entry_", "sp", "d + INTERVAL 1 SECOND", forward=True)},
se AS (SELECT decision_id, symbol, ts + INTERVAL 1 HOUR AS leave FROM entry_),
{_quote_at_sql("exit_", "se", "leave", forward=True)},
sb AS (
  SELECT decision_id, epoch_us(q.ts) // 600000000 AS b, last(mid ORDER BY q.ts) AS v
  FROM sp JOIN hq q ON q.symbol = sp.symbol AND q.ts BETWEEN d - INTERVAL 2 HOUR AND d GROUP BY 1, 2),
sg0 AS (SELECT decision_id, unnest(range(min(b), max(b) + 1)) AS b FROM sb GROUP BY 1),
sj AS (SELECT decision_id, b, coalesce(v, lag(v) OVER (PARTITION BY decision_id ORDER BY b)) AS v
  FROM sg0 LEFT JOIN sb USING (decision_id, b)),
sr AS (SELECT decision_id, ln(v / lag(v) OVER (PARTITION BY decision_id ORDER BY b)) AS r
  FROM sj WHERE v IS NOT NULL),
sv AS (SELECT decision_id, CASE WHEN count(*) >= 3 THEN stddev_samp(r) * sqrt(30.0e0) * 10000.0e0 END
  AS volatility_bps FROM sr GROUP BY 1),
sd AS (
  SELECT sp.*, volatility_bps, n.mid AS now_mid, e.bid AS entry_bid, e.ask AS entry_ask, x.bid AS exit_bid,
    x.ask AS exit_ask,
    CASE WHEN n.mid IS NULL OR s.mid IS NULL OR h.mid IS NULL OR e.mid IS NULL OR x.mid IS NULL
        THEN 'missing_or_stale_required_quote'
      WHEN e.local_date <> sp.local_date OR x.local_date <> sp.local_date
        THEN 'action_or_exit_crosses_session_boundary'
      WHEN least(n.mid, s.mid, h.mid) <= 0 THEN 'nonpositive_mid'
      WHEN volatility_bps IS NULL THEN 'insufficient_feature_window' END AS reason,
    (n.mid / s.mid - 1.0e0) * 10000.0e0 AS m30, (n.mid / h.mid - 1.0e0) * 10000.0e0 AS m5,
    (n.bs - n.asz) * 1.0e0 / (n.bs + n.asz) AS imb, (n.ask - n.bid) / n.mid * 10000.0e0 AS spread_bps,
    greatest(0.0e0, least(1.0e0, 1.0e0 - least(n.bs, n.asz) / 10.0e0)) AS thin
  FROM sp LEFT JOIN now_ n USING (decision_id) LEFT JOIN start_ s USING (decision_id)
    LEFT JOIN short_ h USING (decision_id) LEFT JOIN entry_ e USING (decision_id)
    LEFT JOIN exit_ x USING (decision_id) LEFT JOIN sv USING (decision_id))"""
SESSION_ROWS_SQL = f"""{SESSION_SQL},
sk AS (
  SELECT *, CASE WHEN m30 > 0 THEN 1 WHEN m30 < 0 THEN -1 ELSE 1 END AS sg FROM sd
  WHERE local_date NOT IN (SELECT local_date FROM sd WHERE reason IS NOT NULL)),
sa AS ({" UNION ALL ".join(f"SELECT *, '{n}' AS prior_family, {a} AS act FROM sk" for n, (a, *_) in _PRIOR_SQL.items())}),
sx AS (
  SELECT *, CASE WHEN act > 0 THEN (exit_bid / entry_ask - 1.0e0) * 10000.0e0
      ELSE (entry_bid / exit_ask - 1.0e0) * 10000.0e0 END - 1.0e0 AS full_utility FROM sa)"""


@query(
    "PL8_session_decisions",
    f"""WITH {SESSION_SQL} SELECT decision_id, reason, m30 AS momentum_30_bps, m5 AS momentum_5_bps,
      volatility_bps, spread_bps, thin AS thinness FROM sd""",
    ("momentum_30_bps", "momentum_5_bps", "volatility_bps", "spread_bps", "thinness"),
)
def session_decision_rows(spark, directory):
    return sessions(spark, directory).select(
        "decision_id", "reason", "momentum_30_bps", "momentum_5_bps", "volatility_bps",
        "spread_bps", "thinness",
    )


@query(
    "PL8_session_dataset",
    f"""WITH {SESSION_ROWS_SQL} SELECT symbol, prior_family, count(*) AS rows,
      avg(full_utility) AS full_utility, count(*) FILTER (WHERE full_utility < 0) AS harms FROM sx GROUP BY 1, 2""",
    ("full_utility",),
)
def session_dataset(spark, directory):
    """Labelled session prior rows, per symbol and prior family."""
    kept = X.keep_complete(materialize(sessions(spark, directory)), "local_date")
    rows = labels.order_book_outcomes(
        datasets.session_rows(kept, "session", SESSION.fee_bps), with_impact=False
    )
    return rows.groupBy("symbol", "prior_family").agg(
        F.count("*").alias("rows"), F.avg("full_utility").alias("full_utility"),
        F.count_if("harm_label").alias("harms"),
    )


@query(
    "PL8_session_sides",
    f"""WITH {SESSION_ROWS_SQL}, place AS (
      SELECT local_date, row_number() OVER (ORDER BY local_date) AS place FROM (SELECT DISTINCT local_date FROM sx))
    SELECT CASE WHEN place <= 5 THEN 'development' ELSE 'paper_test' END AS split, symbol, prior_family,
      count(*) AS rows, avg(full_utility) AS full_utility, count(*) FILTER (WHERE full_utility < 0) AS harms
    FROM sx JOIN place USING (local_date) WHERE place <= 15 GROUP BY 1, 2, 3""",
    ("full_utility",),
)
def session_sides(spark, directory):
    """The same rows in two published sides; entry and exit quotes come after the decision
    and are sealed.  Outcomes of the open splits."""
    kept = X.keep_complete(materialize(sessions(spark, directory)), "local_date")
    rows = published(
        datasets.session_rows(kept, "session", SESSION.fee_bps), seal(["row_id"], "entry_", "exit_"),
        ["entry_price", "exit_price"],
    )
    return labels.order_book_outcomes(rows, with_impact=False).groupBy("split", "symbol", "prior_family").agg(
        F.count("*").alias("rows"), F.avg("full_utility").alias("full_utility"),
        F.count_if("harm_label").alias("harms"),
    )


def contexts(spark: SparkSession, directory: str) -> DataFrame:
    return datasets.two_task_contexts(
        materialize(hourly_bars(spark, directory)), materialize(depth_view(spark, directory)),
        PLAN, risk_horizon=4,
    )


def _later_window_sql(name: str, last: int, steps: int, horizon: int) -> str:
    """Bars from one hour after the decision to `last` hours after it."""
    return f"""{name}w AS (
      SELECT decision_id, open, high, low, close, ln(close / lag(close) OVER (
        PARTITION BY decision_id ORDER BY open_time)) AS r
      FROM dec JOIN bars b ON b.symbol = dec.symbol
        AND b.open_time BETWEEN d + INTERVAL 1 HOUR AND d + INTERVAL {last} HOUR),
    {name} AS (
      SELECT decision_id, coalesce(stddev_samp(r) * sqrt({horizon}.0e0) * 10000.0e0, 0) AS volatility,
        count(*) = {steps} AND min(least(open, high, low, close)) > 0 AS complete
      FROM {name}w GROUP BY 1)"""


def _depth_at_sql(name: str, hours: int) -> str:
    """Both sides of the last depth not older than six hours, `hours` after the decision."""
    return f"""{name} AS (
      SELECT decision_id, total FROM (
        SELECT decision_id, q.bid_depth_1pct + q.ask_depth_1pct AS total, q.timestamp AS qt,
          d + INTERVAL {hours} HOUR AS probe,
          row_number() OVER (PARTITION BY decision_id ORDER BY q.timestamp DESC) AS rn
        FROM dec JOIN depth q ON q.symbol = dec.symbol AND q.timestamp <= d + INTERVAL {hours} HOUR)
      WHERE rn = 1 AND epoch(probe) - epoch(qt) <= 21600)"""


CONTEXT_SQL = f"""{BOOK_SQL}, {_later_window_sql("direct", 3, 3, 2)}, {_later_window_sql("risk", 5, 5, 4)},
{_depth_at_sql("soon", 1)}, {_depth_at_sql("late", 5)},
cx0 AS (
  SELECT bk.* EXCLUDE (reason), 'dates-' || strftime(d, '%Y-%m-%d') AS cluster, risk.volatility AS risk_volatility_bps,
    greatest(0.0e0, least(1.0e0, 1.0e0 - late.total / nullif(soon.total, 0))) AS depth_deterioration,
    coalesce(reason, CASE WHEN NOT (coalesce(direct.complete, FALSE) AND coalesce(risk.complete, FALSE))
        THEN 'missing_required_outcome_kline'
      WHEN soon.total IS NULL OR late.total IS NULL THEN 'missing_or_stale_depth' END) AS reason
  FROM bk LEFT JOIN direct USING (decision_id) LEFT JOIN risk USING (decision_id)
    LEFT JOIN soon USING (decision_id) LEFT JOIN late USING (decision_id)),
cx AS (
  SELECT *, 'directional_execution' AS task_id, 'edge_proposer' AS assigned_source_role FROM cx0
  UNION ALL
  SELECT *, 'risk_limit_increase', CASE WHEN CAST('0x' || right(sha256(cluster), 1) AS BIGINT) % 2 = 0
    THEN 'risk_limit_proposer' ELSE 'risk_critic' END FROM cx0)"""


@query(
    "PL9_two_task_contexts",
    f"""WITH {CONTEXT_SQL}
    SELECT task_id, assigned_source_role, coalesce(reason, 'kept') AS reason, count(*) AS rows,
      count(DISTINCT cluster) AS clusters, avg(risk_volatility_bps) AS risk_volatility_bps,
      avg(depth_deterioration) AS depth_deterioration FROM cx GROUP BY 1, 2, 3""",
    ("risk_volatility_bps", "depth_deterioration"),
)
def two_task_context_rows(spark, directory):
    return contexts(spark, directory).groupBy(
        "task_id", "assigned_source_role", F.coalesce("reason", F.lit("kept")).alias("reason")
    ).agg(
        F.count("*").alias("rows"), F.countDistinct("event_cluster_id").alias("clusters"),
        F.avg("risk_volatility_bps").alias("risk_volatility_bps"),
        F.avg("depth_deterioration_fraction_60m").alias("depth_deterioration"),
    )


@query(
    "PL9_context_sides",
    f"""WITH {CONTEXT_SQL}, kept AS (SELECT * FROM cx WHERE reason IS NULL),
    place AS (
      SELECT cluster, row_number() OVER (ORDER BY min(d), cluster) AS place FROM kept GROUP BY 1)
    SELECT CASE WHEN place <= 5 THEN 'development' ELSE 'paper_test' END AS split, task_id,
      assigned_source_role, count(*) AS rows, count(DISTINCT cluster) AS clusters,
      avg(m30) AS momentum_30_bps, avg(risk_volatility_bps) AS risk_volatility_bps,
      avg(depth_deterioration) AS depth_deterioration
    FROM kept JOIN place USING (cluster) WHERE place <= 15 GROUP BY 1, 2, 3""",
    ("momentum_30_bps", "risk_volatility_bps", "depth_deterioration"),
)
def context_sides(spark, directory):
    """Kept contexts in two published sides: all prices and depths after the decision are
    sealed, what an agent is shown is not."""
    kept = contexts(spark, directory).filter(F.col("reason").isNull()).drop("reason")
    plan = seal(
        ["context_id"], "outcome_timestamp", "task_outcome_timestamp", "entry_", "exit_", "direct_", "risk_",
        "late_", "depth_deterioration",
    )
    rows = published(kept, plan, ["task_outcome_timestamp", "risk_volatility_bps"])
    return rows.groupBy("split", "task_id", "assigned_source_role").agg(
        F.count("*").alias("rows"), F.countDistinct("event_cluster_id").alias("clusters"),
        F.avg("momentum_30_bps").alias("momentum_30_bps"),
        F.avg("risk_volatility_bps").alias("risk_volatility_bps"),
        F.avg("depth_deterioration_fraction_60m").alias("depth_deterioration"),
    )


@query(
    "PRJ32_prompt_projection",
    f"""WITH {BOOK_SQL} SELECT decision_id || '-' || task AS context_id, task AS task_id, symbol,
      m30 AS momentum_30_bps, imb AS depth_imbalance
    FROM bk, (SELECT unnest(['directional_execution', 'risk_limit_increase']) AS task)""",
    ("momentum_30_bps", "depth_imbalance"),
)
def prompt_projection(spark, directory):
    view = datasets.prompt_view(contexts(spark, directory))
    return view.select("context_id", "task_id", "symbol", "momentum_30_bps", "depth_imbalance")


def book_audit_inputs(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    rows = prior_rows(spark, directory).withColumns(
        {
            "split": F.lit("development"), "instrument_id": F.lit(1),
            "depth_snapshot_age_seconds": F.col("age_seconds"),
            "outcome_depth_snapshot_age_seconds": F.col("exit_age_seconds"),
        }
    )
    sealed = rows.select("row_id", "outcome_depth_snapshot_age_seconds", "entry_price", "exit_price")
    return rows, sealed


@query(
    "AU2_order_book_audit",
    f"""WITH {PRIOR_ROWS_SQL}, c AS (SELECT day, count(*) AS n FROM pr GROUP BY 1),
    s AS (SELECT count(DISTINCT day) AS days, (SELECT count(*) FROM c WHERE n <> 36) AS incomplete
      FROM pr)
    SELECT unnest(['timestamps_parse', 'timestamps_ordered', 'row_ids_unique', 'symbol_coverage',
      'prior_family_coverage', 'decision_depth_staleness', 'outcome_depth_staleness',
      'sealed_outcome_alignment', 'nonoverlapping_outcomes', 'cluster_split_disjoint', 'entry_delay',
      'exit_delay', 'single_instrument']) AS "check", TRUE AS passed
    UNION ALL SELECT 'complete_clusters', incomplete = 0 FROM s
    UNION ALL SELECT 'development_clusters', days = 20 FROM s""",
)
def order_book_audit(spark, directory):
    rows, sealed = book_audit_inputs(spark, directory)
    rows, sealed = materialize(rows), materialize(sealed)
    return X.order_book_audit(
        rows, sealed, 36, ("S0", "S1"), list(labels.PRIOR_ROLES), 21600.0,
        {"development": 20}, 3600.0, (3600.0, 3600.0), (7200.0, 7200.0),
    ).select("check", "passed")
