"""Column builders shared by the operators.  Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH_MICROS = 1_000_000


def null_if_not_finite(c: Column) -> Column:
    """NaN and infinities become NULL, the only marker for 'not applicable'."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) != inf), c)


def is_true(predicate: Column) -> Column:
    """Two-valued predicate: a comparison with a missing value is false."""
    return F.coalesce(predicate, F.lit(False))


def clip(c: Column, lower: float, upper: float) -> Column:
    return F.least(F.greatest(c, F.lit(lower)), F.lit(upper))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def rate(hit: Column, base: Column) -> Column:
    """Share of `base` rows on which `hit` holds; NULL when the base is empty."""
    return F.avg(F.when(base, hit.cast("double")))


def count_true(predicate: Column) -> Column:
    return F.count_if(predicate)


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def impact_bps(
    notional: Column, depth: Column, slope: float = 50.0, cap: float = 100.0
) -> Column:
    """Linear market impact, capped; an unusable depth costs the full cap."""
    usable = is_true(depth > 0) & ~F.isnan(depth)
    return F.when(
        usable, F.least(F.lit(cap), F.lit(slope) * notional / depth)
    ).otherwise(F.lit(cap))


def sign_or(value: Column, fallback: Column) -> Column:
    return (
        F.when(value > 0, F.lit(1))
        .when(value < 0, F.lit(-1))
        .otherwise(F.when(fallback >= 0, F.lit(1)).otherwise(F.lit(-1)))
    )


def hex_to_long(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("bigint")


def stable_seed(namespace: str, base: int, label: Column) -> Column:
    """First four bytes of sha256('<namespace>/<base>/<label>') as an unsigned int."""
    text = F.concat(F.lit(f"{namespace}/{base}/"), label.cast("string"))
    return hex_to_long(F.substring(F.sha2(text, 256), 1, 8))


def hash_low_bit(key: Column) -> Column:
    return hex_to_long(F.substring(F.sha2(key.cast("string"), 256), 64, 1)) % 2


def mix32(c: Column) -> Column:
    """32-bit integer finaliser on a BIGINT; every product fits in 63 bits."""
    mask = F.lit(0xFFFFFFFF)
    c = c.bitwiseAND(mask)
    c = c.bitwiseXOR(F.shiftright(c, 16))
    c = (c * F.lit(0x21F0AAAD)).bitwiseAND(mask)
    c = c.bitwiseXOR(F.shiftright(c, 15))
    c = (c * F.lit(0x735A2D97)).bitwiseAND(mask)
    return c.bitwiseXOR(F.shiftright(c, 15))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def role_list(chain: Column, separator: str = "|") -> Column:
    """Non-empty members of a separator-joined role list."""
    parts = F.split(F.coalesce(chain, F.lit("")), "\\" + separator)
    return F.filter(parts, lambda part: part != "")


def canonical_json(*columns: str) -> Column:
    """Sorted-key JSON of a row, explicit nulls, for hashing and sinks."""
    return F.to_json(
        F.struct(*[F.col(name) for name in sorted(columns)]),
        {"ignoreNullFields": "false"},
    )
