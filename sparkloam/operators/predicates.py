"""The filter language as columns: {path: value, ...}, all of which hold.

A value is a scalar (exact), {"start": a, "end": b} (closed range) or a list (inclusion). Literals are brought
to the column's type here, on the driver, so that Catalyst sees plain comparisons that it can push
into the Parquet scan. A null never matches and no predicate hides nulls behind a coalesce.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.json import canonical
from ..spec import EPOCH, FLOATS, INT_BOUNDS, TableSpec, Type, spark_type

Match = Callable[[Column], Column]


@dataclass(frozen=True)
class Exact:
    value: Any


@dataclass(frozen=True)
class Range:
    start: Any
    end: Any


@dataclass(frozen=True)
class Inclusion:
    values: tuple


Predicate = Exact | Range | Inclusion


def normalise(p: Predicate) -> Predicate:
    """A range of one value and a list of one are exact matches."""
    if isinstance(p, Range) and p.start == p.end:
        return Exact(p.start)
    if isinstance(p, Inclusion) and len(p.values) == 1:
        return Exact(p.values[0])
    return p


def _number(x: Any) -> bool:
    return isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)


def _is_range(v: Any) -> bool:
    return isinstance(v, Mapping) and "start" in v and "end" in v


def micros(value: Any, path: str) -> int:
    """Microseconds since the epoch of an integer, an RFC 3339 string with offset, or a datetime (UTC if naive)."""
    if isinstance(value, bool):
        raise ValueError(f"A time is a number of microseconds or an RFC 3339 string in field '{path}'")
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        try:
            parsed = datetime.fromisoformat(value)
        except ValueError as e:
            raise ValueError(f"Not an RFC 3339 time with offset in field '{path}'") from e
        if parsed.tzinfo is None or len(value) < 11 or value[10] not in "Tt ":
            raise ValueError(f"Not an RFC 3339 time with offset in field '{path}'")
        value = parsed
    if isinstance(value, datetime):
        naive = value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        return (naive - EPOCH) // timedelta(microseconds=1)
    raise ValueError(f"A time is a number of microseconds or an RFC 3339 string in field '{path}'")


def _never(c: Column) -> Column:
    return F.lit(False)


def _one_of(cast: Callable[[Any], Column], p: Predicate) -> Match:
    """The plain comparisons of a resolved predicate."""
    p = normalise(p)
    if isinstance(p, Exact):
        return lambda c: c == cast(p.value)
    if isinstance(p, Range):
        return lambda c: (c >= cast(p.start)) & (c <= cast(p.end))
    return (lambda c: c.isin(*[cast(v) for v in p.values])) if p.values else _never


def _leaf(rest: list[str], path: str, kind: str) -> None:
    if rest:
        raise ValueError(f"Field '{path}' is of type {kind}, there is nothing below it")


def _int(t: Type, value: Any, path: str, compat: bool) -> Match:
    low, high = INT_BOUNDS[t.kind]
    kind = spark_type(t)

    def cast(x: int) -> Column:
        return F.lit(Decimal(x) if t.kind == "u64" else x).cast(kind)

    def whole(x: Any) -> int:
        if not _number(x) or (isinstance(x, float) and not math.isfinite(x)):
            raise ValueError(f"Expected numeric value for field '{path}'")
        return math.trunc(x)

    if _is_range(value):
        a, b = whole(value["start"]), whole(value["end"])
        if a > b or a > high or b < low:
            return _never
        return _one_of(cast, Range(max(a, low), min(b, high)))
    if isinstance(value, (list, tuple)):
        if not value or not all(_number(x) for x in value):
            raise ValueError(f"Expected numeric value for field '{path}'")
        # A value with a fraction is in no list of integers.
        return _one_of(cast, Inclusion(tuple(dict.fromkeys(int(x) for x in value if x == x and abs(x) != math.inf and x == math.trunc(x) and low <= x <= high))))
    x = whole(value)
    if compat:
        x = max(low, min(high, x))
    return _one_of(cast, Exact(x)) if low <= x <= high else _never


def _float(t: Type, value: Any, path: str, digits: int | None) -> Match:
    def real(x: Any) -> float:
        if not _number(x):
            raise ValueError(f"Expected numeric value for field '{path}'")
        return float(x)

    def near(v: float) -> Match:
        if digits is None or not math.isfinite(v):
            return lambda c: c == F.lit(v)
        off = 0.5 * 10.0**-digits
        # The range is wider by a little and can be pushed down; the difference decides.
        wide = off * (1 + 1e-6) + abs(v) * 1e-12
        return lambda c: (c >= F.lit(v - wide)) & (c <= F.lit(v + wide)) & (F.abs(c.cast("double") - F.lit(v)) < F.lit(off))

    if _is_range(value):
        a, b = real(value["start"]), real(value["end"])
        if t.kind == "f32":
            with np.errstate(over="ignore"):
                a, b = float(np.float32(a)), float(np.float32(b))
        if a != a or b != b:
            return _never
        # Spark sorts NaN above all numbers.
        return lambda c: (c >= F.lit(a)) & (c <= F.lit(b)) & ~F.isnan(c) if b == math.inf else (c >= F.lit(a)) & (c <= F.lit(b))
    if isinstance(value, (list, tuple)):
        if not value:
            raise ValueError(f"Expected numeric value for field '{path}'")
        each = [real(x) for x in value if real(x) == real(x)]
        if digits is None:
            return _one_of(F.lit, Inclusion(tuple(each)))
        return lambda c: reduce(lambda a, b: a | b, [near(v)(c) for v in each], F.lit(False))
    v = real(value)
    return _never if v != v else near(v)


def _texts(value: Any, path: str, what: str, parse: Callable[[Any], Any]) -> Match:
    if isinstance(value, (list, tuple)):
        return _one_of(F.lit, Inclusion(tuple(parse(x) for x in value)))
    if isinstance(value, Mapping) or value is None:
        raise ValueError(f"Expected {what} value for field '{path}'")
    return _one_of(F.lit, Exact(parse(value)))


def _datetime(value: Any, path: str) -> Match:
    def at(us: int) -> Column:
        return F.lit(EPOCH + timedelta(microseconds=us)).cast("timestamp_ntz")

    def within(us: int) -> int:
        low, high = micros(datetime.min, path), micros(datetime.max, path)
        return max(low, min(high, us))

    if _is_range(value):
        a, b = micros(value["start"], f"{path}.start"), micros(value["end"], f"{path}.end")
        return _never if a > b else _one_of(at, Range(within(a), within(b)))
    if isinstance(value, (list, tuple)):
        try:
            return _one_of(at, Inclusion(tuple(micros(x, f"{path}[{i}]") for i, x in enumerate(value))))
        except ValueError:
            return _never
    return _one_of(at, Exact(within(micros(value, path))))


def _timeline(value: Any, path: str) -> Match:
    def covers(us: int) -> Match:
        return lambda c: F.exists(c, lambda x: (x["s"] <= us) & (x["e"] >= us))

    if _is_range(value):
        a, b = micros(value["start"], path), micros(value["end"], path)
        return covers(a) if a == b else (lambda c: F.exists(c, lambda x: (x["s"] <= b) & (x["e"] >= a)) if a < b else F.lit(False))
    if isinstance(value, (list, tuple)):
        points = sorted({micros(x, path) for x in value})
        return lambda c: F.exists(c, lambda x: reduce(lambda p, q: p | q, [(x["s"] <= us) & (x["e"] >= us) for us in points], F.lit(False)))
    return covers(micros(value, path))


def match(t: Type, rest: list[str], value: Any, path: str, digits: int | None = None, compat: bool = False) -> Match:
    """The predicate ``value`` on a column of type ``t``, ``rest`` of the path being below it."""
    k = t.kind
    if value is None:
        raise ValueError(f"null cannot be searched for in field '{path}'")
    if k == "option":
        inner = match(t.item, rest, value, path, digits, compat)
        return (lambda c: inner(c["value"])) if t.item.kind == "option" else inner
    if k == "struct":
        if not rest:
            if not compat:
                raise ValueError(f"Field '{path}' is a struct; name one of its fields")
            rest = [t.names[0]]
        if rest[0] not in t.names:
            raise ValueError(f"Unknown field: {path}")
        inner = match(t.items[t.names.index(rest[0])], rest[1:], value, path, t.float_round, compat)
        return lambda c: inner(c[rest[0]])
    if k == "tuple":
        if len(rest) != 1 or not rest[0].isdigit() or int(rest[0]) >= len(t.items):
            raise ValueError(f"Field '{path}': an element of a tuple goes by its number")
        inner = match(t.items[int(rest[0])], [], value, path, None, compat)
        return lambda c: inner(c[f"_{int(rest[0])}"])
    if k == "vec":
        inner = match(t.item, rest, value, path, None, compat)
        return lambda c: F.exists(c, inner)
    if k == "map":
        _leaf(rest, path, "map")
        if t.items[0].kind in ("tuple", "struct", "vec", "map"):
            raise ValueError(f"Field '{path}': maps with composite keys cannot be filtered")
        inner = match(t.items[0], [], value, path, None, compat)
        return lambda c: F.exists(F.map_keys(c), inner)
    _leaf(rest, path, k)
    if k == "enum":
        inner = _int(Type("i64"), value, path, compat)
        return (lambda c: inner(c["tag"])) if t.with_payload else inner
    if k in INT_BOUNDS:
        return _int(t, value, path, compat)
    if k in FLOATS:
        return _float(t, value, path, digits)
    if k == "datetime":
        return _datetime(value, path)
    if k == "timeline":
        return _timeline(value, path)

    def parse(x: Any) -> Any:
        if k == "bool":
            if not isinstance(x, bool):
                raise ValueError(f"Expected boolean value for field '{path}'")
            return x
        if k == "uuid":
            try:
                return str(x if isinstance(x, uuid.UUID) else uuid.UUID(x))
            except (ValueError, AttributeError, TypeError) as e:
                raise ValueError(f"Invalid UUID for field '{path}'") from e
        if not isinstance(x, str):
            raise ValueError(f"Expected string value for field '{path}'")
        return x

    if k in ("bool", "string", "uuid"):
        return _texts(value, path, {"bool": "boolean"}.get(k, k), parse)
    if k == "bytes":
        try:
            raw = value if isinstance(value, (bytes, bytearray)) else bytes.fromhex(value)
        except (ValueError, TypeError) as e:
            raise ValueError(f"Expected hex string for field '{path}'") from e
        return lambda c: c == F.lit(bytearray(raw))
    if k == "json":
        if isinstance(value, (list, tuple)):
            raise ValueError(f"Field '{path}': JSON arrays cannot be searched for")
        text = canonical(json.dumps(value))
        return lambda c: c == F.lit(text)
    raise ValueError(f"Field '{path}' of type {k} cannot be filtered")


def condition(spec: TableSpec, query: Mapping[str, Any], compat: bool = False) -> Column | None:
    """The condition of a query, None for an empty one. Raises ValueError on anything that is not a query."""
    if not isinstance(query, Mapping):
        raise ValueError("a query is an object of fields and values")
    parts = []
    for path, value in query.items():
        if spec.enum is not None:
            if path != "":
                raise ValueError(f"Unknown field: {path}")
            parts.append(match(spec.enum, [], value, path, compat=compat)(F.col("value")))
            continue
        head, *rest = path.split(".")
        if head not in spec.fields:
            raise ValueError(f"Unknown field: {path}")
        found = match(spec.fields[head], rest, value, path, spec.float_round, compat)
        parts.append(found(F.col(f"`{head}`")))
    return reduce(lambda a, b: a & b, parts) if parts else None
