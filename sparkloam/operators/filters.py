"""Typed filters: the query language as Python objects that turn into it and come back from it."""

from __future__ import annotations

import uuid as _uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from ..spec import EPOCH, FLOATS, INT_BOUNDS, TableSpec, Type
from .predicates import micros


@dataclass(frozen=True)
class FieldFilter:
    """An exact value, a closed range or a list; ``kind`` says of what."""

    form: str
    value: Any

    #: Whether ranges are allowed.
    ranges = True

    @classmethod
    def convert(cls, x: Any) -> Any:
        return x

    @classmethod
    def exact(cls, value: Any) -> "FieldFilter":
        return cls("exact", cls.convert(value))

    @classmethod
    def inclusion(cls, values: Iterable[Any]) -> "FieldFilter":
        return cls("inclusion", tuple(cls.convert(v) for v in values))

    @classmethod
    def range(cls, start: Any, end: Any) -> "FieldFilter":
        if not cls.ranges:
            raise ValueError(f"{cls.__name__} has no range")
        return cls("range", (cls.convert(start), cls.convert(end)))

    @classmethod
    def of(cls, x: Any) -> "FieldFilter":
        """From a scalar, a sequence, a Python range (its last value included), a (start, end) mapping, or a filter."""
        if isinstance(x, FieldFilter):
            return cls(x.form, x.value)
        if isinstance(x, range):
            if x.step != 1:
                raise ValueError("a range has step 1")
            return cls.range(x.start, x.stop - 1)
        if isinstance(x, Mapping) and "start" in x and "end" in x:
            return cls.range(x["start"], x["end"])
        if isinstance(x, (list, tuple, set, frozenset)):
            return cls.inclusion(sorted(x) if isinstance(x, (set, frozenset)) else x)
        return cls.exact(x)

    def _plain(self, x: Any) -> Any:
        return x

    def to_json(self) -> Any:
        if self.form == "range":
            return {"start": self._plain(self.value[0]), "end": self._plain(self.value[1])}
        return [self._plain(v) for v in self.value] if self.form == "inclusion" else self._plain(self.value)


class I64Filter(FieldFilter):
    @classmethod
    def convert(cls, x: Any) -> int:
        if isinstance(x, bool) or not isinstance(x, int):
            raise ValueError("Expected integer value")
        # Every width goes to 64 bits; what is above wraps.
        return (x + 2**63) % 2**64 - 2**63 if 2**63 <= x < 2**64 else x


class F64Filter(FieldFilter):
    @classmethod
    def convert(cls, x: Any) -> float:
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            raise ValueError("Expected numeric value")
        return float(x)


class StringFilter(FieldFilter):
    ranges = False

    @classmethod
    def convert(cls, x: Any) -> str:
        if not isinstance(x, str):
            raise ValueError("Expected string value")
        return x


class BoolFilter(FieldFilter):
    ranges = False

    @classmethod
    def convert(cls, x: Any) -> bool:
        if not isinstance(x, bool):
            raise ValueError("Expected boolean value")
        return x


class UuidFilter(FieldFilter):
    ranges = False

    @classmethod
    def convert(cls, x: Any) -> str:
        return str(x if isinstance(x, _uuid.UUID) else _uuid.UUID(x))


class DateTimeFilter(FieldFilter):
    @classmethod
    def convert(cls, x: Any) -> datetime:
        return EPOCH + timedelta(microseconds=micros(x, ""))

    def _plain(self, x: datetime) -> str:
        return x.replace(tzinfo=timezone.utc).isoformat().replace("+00:00", "Z")

    def range_bounds(self) -> tuple[datetime, datetime]:
        if self.form != "range":
            raise ValueError("the filter on the timestamp is no range")
        return self.value


def filter_class(t: Type) -> type[FieldFilter] | None:
    """The filter class of a type, None for types that have no typed filter."""
    while t.kind in ("option", "vec"):
        t = t.item
    if t.kind == "map":
        return filter_class(t.items[0])
    if t.kind in INT_BOUNDS or t.kind == "enum":
        return I64Filter
    if t.kind in FLOATS:
        return F64Filter
    return {"string": StringFilter, "bool": BoolFilter, "uuid": UuidFilter, "datetime": DateTimeFilter, "timeline": DateTimeFilter}.get(t.kind)


class Filter:
    """A query on a table: ``Filter.new(spec, index values..., timestamp range)`` and further fields by name."""

    def __init__(self, spec: TableSpec, **values: Any) -> None:
        self.spec = spec
        self._set: dict[str, Any] = {}
        for name, value in values.items():
            self[name] = value

    @classmethod
    def new(cls, spec: TableSpec, *values: Any) -> "Filter":
        names = [*spec.index, *([spec.timestamp] if spec.timestamp else [])]
        if len(values) != len(names):
            raise ValueError(f"new() takes {', '.join(names)}")
        return cls(spec, **dict(zip(names, values)))

    def _class(self, path: str) -> type[FieldFilter] | None:
        head, *rest = path.split(".")
        if head not in self.spec.fields:
            raise ValueError(f"Unknown field: {path}")
        t = self.spec.fields[head]
        if head == self.spec.timestamp and not rest:
            return DateTimeFilter
        for part in rest:
            while t.kind in ("option", "vec"):
                t = t.item
            if t.kind == "struct" and part in t.names:
                t = t.items[t.names.index(part)]
            elif t.kind == "tuple" and part.isdigit() and int(part) < len(t.items):
                t = t.items[int(part)]
            else:
                raise ValueError(f"Unknown field: {path}")
        return filter_class(t)

    def __setitem__(self, path: str, value: Any) -> None:
        kind = self._class(path)
        self._set[path] = value if kind is None else kind.of(value)

    def __getitem__(self, path: str) -> Any:
        """The filter of a field, None if it has none."""
        return self._set.get(path)

    def set(self, path: str, value: Any) -> "Filter":
        self[path] = value
        return self

    def get(self, path: str) -> Any:
        return self[path]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Filter) and self._set == other._set

    def _times(self) -> DateTimeFilter:
        if self.spec.timestamp is None:
            raise ValueError("the table has no timestamp")
        found = self._set.get(self.spec.timestamp)
        if not isinstance(found, DateTimeFilter):
            raise ValueError("the filter on the timestamp is no range")
        return found

    def range_bounds(self) -> tuple[datetime, datetime]:
        return self._times().range_bounds()

    def range_duration(self) -> timedelta:
        a, b = self.range_bounds()
        return b - a

    def range_shift(self, by: timedelta) -> "Filter":
        """The same filter with its time range moved."""
        a, b = self.range_bounds()
        out = Filter(self.spec)
        out._set = {**self._set, self.spec.timestamp: DateTimeFilter.range(a + by, b + by)}
        return out

    def to_json(self) -> dict[str, Any]:
        out = {k: v.to_json() if isinstance(v, FieldFilter) else v for k, v in self._set.items()}
        ts = self.spec.timestamp
        if ts in out and self.spec.fields[ts].kind == "i64":
            found = self._set[ts]
            out[ts] = {"range": lambda v: {"start": micros(v[0], ts), "end": micros(v[1], ts)}, "inclusion": lambda v: [micros(x, ts) for x in v], "exact": lambda v: micros(v, ts)}[found.form](found.value)
        return out

    @classmethod
    def from_json(cls, spec: TableSpec, query: Mapping[str, Any]) -> "Filter":
        return cls(spec, **query)
