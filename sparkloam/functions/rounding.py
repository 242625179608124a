"""Write-time rounding: decimals half away from zero after scaling, timestamps to a multiple, in any container."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import FLOATS, TableSpec, Type, spark_type, variant
from .json import canonical_json

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_LOW = "(-9223372036854775807L - 1L)"


def scaled(x: Column, digits: int) -> Column:
    """``x * 10**digits`` as the nearest BIGINT, halves away from zero; NaN is 0, beyond its bounds their values.

    This is not ``round(x, digits)``, which rounds the shortest decimal: 1.005 is below its half.
    """
    y = x.cast("double") * F.lit(10.0**digits)
    return (
        F.when(F.isnan(y), F.lit(0).cast("long"))
        .when(y >= F.lit(9.223372036854775807e18), F.lit(2**63 - 1))
        .when(y <= F.lit(-9.223372036854775808e18), F.expr(_LOW))
        .otherwise(F.round(y, 0).cast("long"))
    )


def unscaled(i: Column, digits: int) -> Column:
    return i / F.lit(10.0**digits)


def float_round(x: Column, digits: int) -> Column:
    """``x`` at ``digits`` decimals, as a double. Null for null."""
    return F.when(x.isNotNull(), unscaled(scaled(x, digits), digits))


def to_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))


def round_micros(us: Column, width: int, floor: bool = False) -> Column:
    """Multiple of ``width`` nearest to ``us``, halves up.

    Before the epoch the default goes by the truncated remainder, as stored data has it (-31 s to the minute
    gives +60 s); with ``floor`` it is the nearest there too.
    """
    if width <= 0:
        raise ValueError("a time is rounded to a positive width")
    if floor:
        r = F.pmod(us, F.lit(width))
        return us - r + F.when(r >= width // 2 + width % 2, F.lit(width)).otherwise(F.lit(0))
    r = us % width
    up = F.when((r >= width // 2) | ((r < 0) & (-r > width // 2)), F.lit(1)).otherwise(F.lit(0))
    return ((us - r) / width).cast("long") * width + up * width if width == 1 else (F.call_function("div", us, F.lit(width)) + up) * width


def time_round(ts: Column, width: timedelta, floor: bool = False) -> Column:
    return from_micros(round_micros(to_micros(ts), width // timedelta(microseconds=1), floor))


def _touches(t: Type, digits: int | None, width: timedelta | None) -> bool:
    if t.kind == "struct":
        return any(_touches(x, t.float_round, t.time_round) for x in t.items)
    if t.kind in FLOATS or t.kind == "json":
        return digits is not None
    if t.kind == "datetime":
        return width is not None
    return any(x is not None and _touches(x, digits, width) for x in t.items)


def rounded(c: Column, t: Type, digits: int | None, width: timedelta | None) -> Column:
    """``c`` with every float and datetime in it rounded. Options, arrays, maps (keys and values), tuples and enum
    payloads take the setting over; a nested struct has its own."""
    if not _touches(t, digits, width):
        return c
    if t.kind in FLOATS:
        return float_round(c, digits).cast(spark_type(t))
    if t.kind == "json":
        return canonical_json(c, digits)
    if t.kind == "datetime":
        return time_round(c, width)
    if t.kind == "option":
        if t.item.kind == "option":
            return F.when(c.isNotNull(), F.struct(rounded(c["value"], t.item, digits, width).alias("value")))
        return rounded(c, t.item, digits, width)
    if t.kind == "vec":
        return F.transform(c, lambda x: rounded(x, t.item, digits, width))
    if t.kind == "map":
        k, v = t.items
        # Of keys that become equal the last stays.
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(rounded(e["key"], k, digits, width).alias("key"), rounded(e["value"], v, digits, width).alias("value")))
        if not _touches(k, digits, width):
            return F.map_from_entries(pairs)
        last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
        return F.map_from_entries(last)
    if t.kind == "tuple":
        return F.when(c.isNotNull(), F.struct(*[rounded(c[f"_{i}"], x, digits, width).alias(f"_{i}") for i, x in enumerate(t.items)]))
    if t.kind == "struct":
        return F.when(c.isNotNull(), F.struct(*[rounded(c[n], x, t.float_round, t.time_round).alias(n) for n, x in zip(t.names, t.items)]))
    if t.kind == "enum":
        parts = [rounded(c[variant(tag)], x, digits, width).alias(variant(tag)) for tag, x in zip(t.tags, t.items) if x]
        return F.when(c.isNotNull(), F.struct(c["tag"].alias("tag"), *parts))
    return c


def round_columns(spec: TableSpec) -> dict[str, Column]:
    """Rounded expressions of the fields that rounding changes. Index fields are stored as they are."""
    return {
        n: rounded(F.col(f"`{n}`"), t, spec.float_round, spec.time_round)
        for n, t in spec.fields.items()
        if n not in spec.index and _touches(t, spec.float_round, spec.time_round)
    }
