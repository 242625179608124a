"""Reading: a filter and a list of fields over a table, with the rules of projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Filter
from ..operators.predicates import condition, micros
from ..spec import EPOCH, TableSpec, default_column
from . import layout

BOUNDS = layout.BOUNDS


def resolve_fields(spec: TableSpec, query: Mapping[str, Any] | Filter, fields: Sequence[str] = ()) -> list[str]:
    """Fields that a query and a request touch, once each and in the order of declaration.

    An empty request is all fields. The bounds of chunks follow if the timestamp is among them; they can be asked
    for by name where there is a timestamp. Unknown names and paths below a field raise ValueError.
    """
    query = query.to_json() if isinstance(query, Filter) else query
    if spec.enum is not None:
        if fields:
            raise ValueError("an enum table has no fields to ask for")
        return list(spec.fields)
    wanted = set()
    for path in query:
        head = path.split(".")[0]
        if head not in spec.fields:
            raise ValueError(f"Unknown field: {path}")
        wanted.add(head)
    bounds = []
    for name in fields:
        if name in spec.fields:
            wanted.add(name)
        elif spec.timestamp and name in BOUNDS:
            bounds.append(name)
        elif "." in name and name.split(".")[0] in spec.fields:
            raise ValueError(f"Nested field path '{name}' goes below a field; use '{name.split('.')[0]}' instead")
        else:
            raise ValueError(f"Unknown field: {name}")
    if not fields:
        wanted = set(spec.fields)
    out = [n for n in spec.fields if n in wanted]
    if spec.timestamp and spec.timestamp in wanted:
        return out + list(BOUNDS)
    return out + [b for b in BOUNDS if b in bounds]


def filter_table(
    df: DataFrame, spec: TableSpec, query: Mapping[str, Any] | Filter | None = None, fields: Sequence[str] = (), *, default_fill: bool = False, compat: bool = False
) -> DataFrame:
    """The rows of ``df`` that match, with the index fields and those in ``fields`` (all if empty).

    ``default_fill`` returns all fields, those neither asked for nor named by the query at their type's default. A request for nothing but index
    fields of a table with ``chunk_no`` is answered per chunk: one row for each chunk with a match.
    """
    query = query.to_json() if isinstance(query, Filter) else dict(query or {})
    touched = resolve_fields(spec, query, fields)
    where = condition(spec, query, compat)
    out = df if where is None else df.where(where)
    asked = [n for n in spec.fields if not fields or n in fields or n in spec.index]
    if fields and spec.index and set(fields) <= set(spec.index) and layout.CHUNK in df.columns and set(q.split(".")[0] for q in query) <= set(spec.index):
        return out.select(*spec.index, layout.CHUNK).distinct().select(*asked)
    if default_fill:
        return out.select(*[F.col(f"`{n}`") if n in asked or n in touched else default_column(t).alias(n) for n, t in spec.fields.items()])
    bounds = [b for b in touched if b not in spec.fields and b in df.columns]
    return out.select(*[F.col(f"`{n}`") for n in asked], *bounds)


def scan(spark: SparkSession, spec: TableSpec, path: str, query: Mapping[str, Any] | Filter | None = None, fields: Sequence[str] = (), **how: bool) -> DataFrame:
    """``filter_table`` over a written table, with ``start_at`` and ``end_at`` of a row's chunk where ``resolve_fields`` lists them.

    Bounds are stored with the rows. A condition on the timestamp also goes to them, where files' statistics
    let whole groups of chunks be skipped, those of timelines too.
    """
    stored = layout.read(spark, spec, path)
    query = query.to_json() if isinstance(query, Filter) else dict(query or {})
    near = _bounded(spec, query.get(spec.timestamp)) if spec.timestamp in query else None
    return filter_table(stored if near is None else stored.where(near), spec, query, fields, **how)


def _bounded(spec: TableSpec, value: Any) -> Column | None:
    """What must hold of a chunk's bounds if one of its rows matches ``value``; None if that can't be told."""
    t = spec.fields[spec.timestamp]
    if not layout.bounds_of(spec) or t.kind not in ("datetime", "timeline") or (t.kind == "datetime" and spec.time_round is not None):
        return None
    if isinstance(value, Mapping):
        ends = [value.get("start"), value.get("end")]
    else:
        ends = list(value) if isinstance(value, (list, tuple)) else [value]
    try:
        us = [micros(x, spec.timestamp) for x in ends]
    except ValueError:
        return None
    if not us:
        return None
    low, high = (F.lit(x) if t.kind == "timeline" else F.lit(EPOCH + timedelta(microseconds=x)).cast("timestamp_ntz") for x in (min(us), max(us)))
    return (F.col("start_at") <= high) & (F.col("end_at") >= low)
