"""Reading old data with a newer specification: fields by name, numbers clamped, what is missing at its default."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import FLOATS, INT_BOUNDS, TableSpec, Type, default_column, spark_type, variant

NUMBERS = (*INT_BOUNDS, *FLOATS)


def clamp_cast(c: Column, old: Type, new: Type) -> Column:
    """``c`` as the number type ``new``: integers are clamped to its bounds, floats cut towards zero, NaN is 0."""
    kind = spark_type(new)
    if old.kind == new.kind:
        return c
    if new.kind in FLOATS:
        return c.cast("double").cast(kind) if new.kind != "f64" else c.cast(kind)
    low, high = INT_BOUNDS[new.kind]
    if old.kind in FLOATS:
        x = c.cast("double")
        if new.kind == "u64":
            # In two halves, each of which a double and a BIGINT hold exactly.
            upper = F.floor(x / F.lit(2.0**32))
            whole = upper.cast("decimal(20,0)") * F.lit(Decimal(2**32)) + (x - upper * F.lit(2.0**32)).cast("long")
        else:
            whole = x.cast("long")
        bound = F.when(F.isnan(x), F.lit(Decimal(0))).when(x >= F.lit(float(high)), F.lit(Decimal(high))).when(x <= F.lit(float(low)), F.lit(Decimal(low)))
        return F.when(x.isNotNull(), bound.otherwise(whole.cast("decimal(20,0)"))).cast(kind)
    x = c.cast("decimal(20,0)")
    return F.least(F.greatest(x, F.lit(Decimal(low)).cast("decimal(20,0)")), F.lit(Decimal(high)).cast("decimal(20,0)")).cast(kind) if _narrows(old, new) else c.cast(kind)


def _narrows(old: Type, new: Type) -> bool:
    (a, b), (low, high) = INT_BOUNDS[old.kind], INT_BOUNDS[new.kind]
    return a < low or b > high


def converted(c: Column, old: Type, new: Type, path: str) -> Column:
    """A value of type ``old`` as ``new``, element by element in containers."""
    if old == new:
        return c
    if old.kind in NUMBERS and new.kind in NUMBERS:
        return clamp_cast(c, old, new)
    if new.kind == "option" and old.kind != "option":
        inner = converted(c, old, new.item, path)
        return F.struct(inner.alias("value")) if new.item.kind == "option" else inner
    if old.kind != new.kind:
        raise ValueError(f"Field '{path}' can't be read as {new.kind}, it holds {old.kind}")
    if new.kind == "option":
        if old.item.kind == "option":
            return F.when(c.isNotNull(), F.struct(converted(c["value"], old.item, new.item, path).alias("value")))
        return F.when(c.isNotNull(), converted(c, old.item, new.item, path))
    if new.kind == "vec":
        return F.transform(c, lambda x: converted(x, old.item, new.item, path))
    if new.kind == "map":
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.struct(converted(e["key"], old.items[0], new.items[0], path).alias("key"), converted(e["value"], old.items[1], new.items[1], path).alias("value")),
        )
        return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"])))
    if new.kind == "tuple":
        # Elements come and go at the tail.
        parts = [converted(c[f"_{i}"], old.items[i], t, path) if i < len(old.items) else default_column(t) for i, t in enumerate(new.items)]
        return F.when(c.isNotNull(), F.struct(*[p.alias(f"_{i}") for i, p in enumerate(parts)]))
    if new.kind == "struct":
        have = dict(zip(old.names, old.items))
        parts = [(converted(c[n], have[n], t, f"{path}.{n}") if n in have else default_column(t)).alias(n) for n, t in zip(new.names, new.items)]
        return F.when(c.isNotNull(), F.struct(*parts))
    if new.kind == "enum":
        tag = c["tag"] if old.with_payload else c
        known = tag.isin(*new.tags)
        told = F.when(tag.isNull() | known, tag).otherwise(F.lit(new.default)).cast("long")
        if not new.with_payload:
            return told
        have = {t: x for t, x in zip(old.tags, old.items) if x}
        parts = [
            (converted(c[variant(t)], have[t], x, path) if t in have else F.when(tag == t, default_column(x))).alias(variant(t)) for t, x in zip(new.tags, new.items) if x
        ]
        return F.when(c.isNotNull(), F.struct(told.alias("tag"), *parts))
    return c


def evolve(df: DataFrame, old: TableSpec, new: TableSpec) -> DataFrame:
    """``df``, written as ``old``, as ``new``: fields go by name, a missing one is its type's default in every row."""
    for name in (*new.index, *filter(None, (new.timestamp,))):
        if name not in old.fields:
            raise ValueError(f"old data has no index or timestamp field '{name}'")
    if set(new.index) != set(old.index) or new.timestamp != old.timestamp:
        raise ValueError("index and timestamp fields stay what they are")
    out = [(converted(F.col(f"`{n}`"), old.fields[n], t, n) if n in old.fields else default_column(t)).cast(spark_type(t)).alias(n) for n, t in new.fields.items()]
    return df.select(*out)


def read_versions(spark: SparkSession, new: TableSpec, versions: Sequence[tuple[TableSpec, str]]) -> DataFrame:
    """Tables written under several specifications as one of ``new``; each file is read with the schema it was written with."""
    from .layout import read

    parts = [evolve(read(spark, old, path), old, new) for old, path in versions]
    return reduce(DataFrame.unionByName, parts)
