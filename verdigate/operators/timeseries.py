"""As-of, look-back and forward joins, resampling, realised volatility.

Time is cut into slices that hold a bounded number of rows of a key.  A slice is
ordered in one task; what was last seen before it comes from one summary row per
slice.  So a key that holds a third of all quotes, or all of them in one busy hour,
is spread over as many tasks as it fills slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.functions.columns import EPOCH_MICROS, from_micros, micros
from verdigate.operators.distributed import materialize

#: Rows of a key in one slice, at most; rows of one microsecond stay together.
SLICE_ROWS = 50_000


def busy_spans(events: DataFrame, by: Sequence[str], width: int, most: int = SLICE_ROWS) -> DataFrame | None:
    """Spans of `width` units of `_t` with more than `most` rows of a key: by, _span and
    `_fine`, the width of the slices to cut them into.  None if there is no such span.

    Widths shrink, round by round, until the fullest slice of a span is small enough.
    Only spans that are still too full are counted again.
    """
    by = list(by)
    start = F.floor(F.col("_t") / width) * width
    events = events.select(*by, "_t", start.alias("_span"))
    full = events.groupBy(*by, "_span").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)

    def finer(of: Column) -> Column:
        return F.greatest(F.floor(of.cast("double") * most / F.col("_n") / 2), F.lit(1)).cast("bigint")

    open_ = materialize(full.select(*by, "_span", finer(F.lit(width)).alias("_fine")))
    if open_.isEmpty():
        return None
    done = None
    while True:
        slices = events.join(open_, [*by, "_span"]).groupBy(
            *by, "_span", "_fine", F.floor((F.col("_t") - F.col("_span")) / F.col("_fine")).alias("_at")
        ).agg(F.count("*").alias("_n"))
        fullest = materialize(slices.groupBy(*by, "_span", "_fine").agg(F.max("_n").alias("_n")))
        again = (F.col("_n") > most) & (F.col("_fine") > 1)
        settled = fullest.filter(~again).select(*by, "_span", "_fine")
        done = settled if done is None else done.unionByName(settled)
        open_ = fullest.filter(again).select(*by, "_span", finer(F.col("_fine")).alias("_fine"))
        if open_.isEmpty():
            return done


def with_slices(df: DataFrame, by: Sequence[str], width: int, busy: DataFrame | None) -> DataFrame:
    """Adds `_slice`, the start of the slice that `_t` is in."""
    span = F.floor(F.col("_t") / width) * width
    if busy is None:
        return df.withColumn("_slice", span)
    placed = df.withColumn("_span", span).join(busy, [*by, "_span"], "left")
    fine = F.col("_span") + F.floor((F.col("_t") - F.col("_span")) / F.col("_fine")) * F.col("_fine")
    return placed.withColumn("_slice", F.coalesce(fine, "_span")).drop("_span", "_fine")


def quote_spans(
    quotes: DataFrame, by: Sequence[str], time: str, slice_seconds: int, slice_rows: int = SLICE_ROWS
) -> DataFrame | None:
    """The busy spans of quotes, to be counted once and used by several joins."""
    timed = quotes.dropna(subset=[*by, time]).select(*by, micros(F.col(time)).alias("_t"))
    return busy_spans(timed, by, slice_seconds * EPOCH_MICROS, slice_rows)


#: Sides of equal times: a strict probe comes before the quotes of its time, others after.
_STRICT, _QUOTE, _OPEN = 0, 1, 2


def _last_seen(
    probes: DataFrame, quotes: DataFrame, by: list[str], quote_time: str, values: Sequence[str],
    tiebreak: str, sign: int, width: int, busy: DataFrame | None,
) -> DataFrame:
    """Probes (by, _t, _side, _p) -> _p and _f, the last quote before each in the
    direction of the clock.  A probe without key or time finds nothing."""
    payload = F.struct(
        micros(F.col(quote_time)).alias("_us"), *[F.col(v).alias(v) for v in dict.fromkeys(values)]
    )
    q = quotes.dropna(subset=[*by, quote_time]).select(
        *by, micros(F.col(quote_time)).alias("_t"), F.lit(_QUOTE).alias("_side"),
        (F.lit(sign) * F.col(tiebreak)).alias("_order"), payload.alias("_q"),
    )
    lost = probes.filter(" or ".join(f"`{c}` is null" for c in [*by, "_t"]))
    p = probes.dropna(subset=[*by, "_t"]).withColumn("_order", F.lit(None).cast("bigint"))
    q, p = with_slices(q, by, width, busy), with_slices(p, by, width, busy)
    clock = F.lit(sign) * F.col("_t")
    ordered = Window.partitionBy(*by, "_slice").orderBy(clock, "_side", "_order")
    seen = F.last("_q", ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = (
        q.unionByName(p, allowMissingColumns=True)
        .withColumn("_hit", seen)
        .filter(F.col("_p").isNotNull())
        .select(*by, "_slice", "_p", "_hit")
    )
    last = q.groupBy(*by, "_slice").agg(F.max_by("_q", F.struct(clock, "_order")).alias("_end"))
    asked = p.select(*by, "_slice").distinct()
    before = Window.partitionBy(*by).orderBy(F.lit(sign) * F.col("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        last.join(asked, [*by, "_slice"], "full_outer")
        .withColumn("_before", F.last("_end", ignorenulls=True).over(before))
        .select(*by, "_slice", "_before")
    )
    found = F.coalesce("_hit", "_before")
    joined = inside.join(carry, [*by, "_slice"], "left").select("_p", found.alias("_f"))
    return joined.unionByName(lost.select("_p"), allowMissingColumns=True)


def _columns_of(found: Column, time: Column, values: Sequence[str], prefix: str, max_age: float | None) -> list[Column]:
    age = F.abs(micros(time) - found["_us"]) / F.lit(float(EPOCH_MICROS))
    fresh = found.isNotNull()
    if max_age is not None:
        fresh = fresh & (age <= max_age)
    return [
        *[F.when(fresh, found[v]).alias(f"{prefix}{v}") for v in values],
        F.when(fresh, from_micros(found["_us"])).alias(f"{prefix}observed_timestamp"),
        F.when(fresh, age).alias(f"{prefix}age_seconds"),
    ]


def _sign(direction: str) -> int:
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    return 1 if direction == "backward" else -1


def asof_join(
    probes: DataFrame,
    quotes: DataFrame,
    by: Sequence[str],
    probe_time: str,
    quote_time: str,
    values: Sequence[str],
    tiebreak: str,
    direction: str = "backward",
    strict: bool = False,
    max_age_seconds: float | None = None,
    slice_seconds: int = 3600,
    prefix: str = "",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each probe with the nearest earlier (or later) quote of its key.

    `strict` leaves out quotes at the probe's own time.  A quote older than
    `max_age_seconds` leaves the added columns NULL.  `tiebreak` orders quotes with
    equal times.  A probe without key or time finds nothing.  Slices are
    `slice_seconds` wide, and narrower where a key has more than `slice_rows` quotes.
    """
    by = list(by)
    p = probes.select(
        *by, micros(F.col(probe_time)).alias("_t"), F.lit(_STRICT if strict else _OPEN).alias("_side"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("_p"),
    )
    joined = _last_seen(
        p, quotes, by, quote_time, values, tiebreak, _sign(direction), slice_seconds * EPOCH_MICROS,
        quote_spans(quotes, by, quote_time, slice_seconds, slice_rows),
    )
    return joined.select(
        "_p.*", *_columns_of(F.col("_f"), F.col(f"_p.{probe_time}"), values, prefix, max_age_seconds)
    )


def asof_many(
    probes: DataFrame,
    quotes: DataFrame,
    by: Sequence[str],
    probe_id: str,
    wanted: Sequence[tuple[str, str, bool, Sequence[str]]],
    quote_time: str,
    tiebreak: str,
    direction: str = "backward",
    max_age_seconds: float | None = None,
    slice_seconds: int = 3600,
    busy: DataFrame | None = None,
) -> DataFrame:
    """Several as-of joins of the same direction in one pass over the quotes.

    `wanted` lists (prefix, probe time column, strict, values).  Each row of `probes`,
    which `probe_id` identifies, asks once per entry; the quotes are shuffled once.
    `busy` are the spans found by `quote_spans`.
    """
    by = list(by)
    sign = _sign(direction)
    asks = F.array(*[
        F.struct(
            F.lit(i).alias("_kind"), micros(F.col(time)).alias("_t"),
            F.lit(_STRICT if strict else _OPEN).alias("_side"),
        )
        for i, (_, time, strict, _) in enumerate(wanted)
    ])
    asked = probes.select(*by, F.col(probe_id).alias("_id"), F.inline(asks)).select(
        *by, "_t", "_side", F.struct("_id", "_kind").alias("_p")
    )
    every = [v for _, _, _, values in wanted for v in values]
    found = _last_seen(asked, quotes, by, quote_time, every, tiebreak, sign, slice_seconds * EPOCH_MICROS, busy)
    kinds = [F.first(F.when(F.col("_p._kind") == i, F.col("_f")), ignorenulls=True).alias(f"_f{i}") for i in range(len(wanted))]
    rows = found.groupBy(F.col("_p._id").alias(probe_id)).agg(*kinds)
    added = [
        c for i, (prefix, time, _, values) in enumerate(wanted)
        for c in _columns_of(F.col(f"_f{i}"), F.col(time), values, prefix, max_age_seconds)
    ]
    return probes.join(rows, probe_id).select(*probes.columns, *added)


def sliced_lag(
    df: DataFrame, by: Sequence[str], time: str, order: Sequence[str], value: str,
    name: str, slice_seconds: int = 86400, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Previous value of `value` per key in time order, slice by slice.  Rows without a
    key are left out."""
    by = list(by)
    width = slice_seconds * EPOCH_MICROS
    timed = df.dropna(subset=by).withColumn("_t", micros(F.col(time)))
    sliced = with_slices(timed, by, width, busy_spans(timed, by, width, slice_rows)).drop("_t")
    inside = Window.partitionBy(*by, "_slice").orderBy(time, *order)
    key = F.struct(time, *order)
    ends = sliced.groupBy(*by, "_slice").agg(F.max_by(F.struct(value), key).alias("_end"))
    prior = Window.partitionBy(*by).orderBy("_slice")
    carry = ends.select(*by, "_slice", F.lag("_end").over(prior).alias("_carry"))
    first = F.row_number().over(inside) == 1
    return (
        sliced.withColumns({"_first": first, "_lag": F.lag(value).over(inside)})
        .join(carry, [*by, "_slice"])
        .withColumn(name, F.when(F.col("_first"), F.col(f"_carry.{value}")).otherwise(F.col("_lag")))
        .drop("_slice", "_first", "_lag", "_carry")
    )


def outcome_buffer(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seconds between an outcome and the next decision of the same key."""
    distinct = df.select(*by, "decision_timestamp", "outcome_timestamp").distinct()
    lagged = sliced_lag(
        distinct, by, "decision_timestamp", ["outcome_timestamp"], "outcome_timestamp", "_previous"
    )
    gap = (micros(F.col("decision_timestamp")) - micros(F.col("_previous"))) / F.lit(1e6)
    return lagged.withColumn("buffer_seconds", gap).filter(F.col("buffer_seconds").isNotNull())


def exact_bar(
    probes: DataFrame, bars: DataFrame, by: Sequence[str], time: Column, values: Sequence[str],
    prefix: str,
) -> DataFrame:
    """Bar that opens exactly at the given time; one bar per key and time is assumed."""
    right = bars.select(
        *by, F.col("open_time").alias("_at"), *[F.col(v).alias(f"{prefix}{v}") for v in values]
    )
    return probes.withColumn("_at", time).join(right, [*by, "_at"], "left").drop("_at")


def bar_window(
    probes: DataFrame, bars: DataFrame, by: Sequence[str], probe_id: str, start: Column,
    steps: int, step_seconds: int, horizon: int | None = None, prefix: str = "",
) -> DataFrame:
    """`steps` consecutive bars from `start` per probe: how many exist, extremes and
    realised volatility.

    The window is expanded to its bar times, so the range join is an equi-join on
    (key, time) and a probe never meets more than `steps` bars.
    """
    offsets = F.sequence(F.lit(0), F.lit(steps - 1))
    # The probe travels on its first step only, so it is read and shuffled once.
    whole = F.struct(*[F.col(c) for c in probes.columns])
    wanted = probes.select(
        *by, probe_id, start.alias("_s"), whole.alias("_w"), F.explode(offsets).alias("_i")
    ).select(
        *by, probe_id, "_i", F.when(F.col("_i") == 0, F.col("_w")).alias("_p"),
        from_micros(
            micros(F.col("_s")) + F.col("_i").cast("bigint") * (step_seconds * EPOCH_MICROS)
        ).alias("open_time"),
    )
    prices = ("open", "high", "low", "close")
    right = bars.select(*by, F.col("open_time").cast("timestamp").alias("open_time"), *prices)
    met = wanted.join(right, [*by, "open_time"], "left")
    earlier = Window.partitionBy(probe_id).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("close", ignorenulls=True).over(earlier)
    returns = met.withColumn("_before", before).withColumn(
        "_r",
        F.when((F.col("close") > 0) & (F.col("_before") > 0), F.ln(F.col("close") / F.col("_before"))),
    )
    scale = float(horizon if horizon is not None else steps - 1) ** 0.5 * 10000.0
    found = F.col("close").isNotNull()
    stats = returns.groupBy(probe_id).agg(
        F.first("_p", ignorenulls=True).alias("_p"),
        F.nullif(F.count_if(found), F.lit(0)).alias(f"{prefix}bars"),
        F.coalesce(
            F.bool_and(F.when(found, F.least(*prices) > 0)), F.lit(False)
        ).alias(f"{prefix}positive"),
        F.min("low").alias(f"{prefix}min_price"),
        F.max("high").alias(f"{prefix}max_price"),
        F.when(
            F.count_if(found) > 0, F.coalesce(F.stddev_samp("_r") * F.lit(scale), F.lit(0.0))
        ).alias(f"{prefix}volatility_bps"),
    )
    measured = [c for c in stats.columns if c not in (probe_id, "_p")]
    return stats.select("_p.*", *measured).withColumn(
        f"{prefix}complete",
        F.coalesce((F.col(f"{prefix}bars") == steps) & F.col(f"{prefix}positive"), F.lit(False)),
    )


def resample_last(
    quotes: DataFrame, by: Sequence[str], time: str, value: str, order: str, step_seconds: int = 60
) -> DataFrame:
    """Last value per step, gaps of one step filled forward, longer gaps dropped.

    `by` names a bounded session, so its dense grid is small.
    """
    by = list(by)
    width = step_seconds * EPOCH_MICROS
    bucket = F.floor(micros(F.col(time)) / width)
    last = quotes.withColumn("_b", bucket).groupBy(*by, "_b").agg(
        F.max_by(value, F.struct(time, order)).alias("_v")
    )
    grid = last.groupBy(*by).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi")).select(
        *by, F.explode(F.sequence("_lo", "_hi")).alias("_b")
    )
    previous = F.lag("_v").over(Window.partitionBy(*by).orderBy("_b"))
    return (
        grid.join(last, [*by, "_b"], "left")
        .withColumn(value, F.coalesce(F.col("_v"), previous))
        .filter(F.col(value).isNotNull())
        .select(*by, from_micros(F.col("_b") * width).alias("step_time"), value)
    )


def realised_volatility(
    steps: DataFrame, by: Sequence[str], value: str, horizon: int, minimum: int = 20
) -> DataFrame:
    """Sample deviation of log returns scaled to the horizon, in basis points."""
    along = Window.partitionBy(*by).orderBy("step_time")
    r = steps.withColumn("_r", F.ln(F.col(value) / F.lag(value).over(along)))
    vol = F.stddev_samp("_r") * F.lit(float(horizon) ** 0.5 * 10000.0)
    return r.groupBy(*by).agg(
        F.count("*").alias("steps"),
        F.when(F.count("*") >= minimum, vol).alias("volatility_bps"),
    )
