"""Sets of closed microsecond intervals: ARRAY<STRUCT<s, e>>, sorted and disjoint.

Intervals merge when one starts at most a microsecond after another's end. Array forms suit rows with few
intervals; ``union_intervals`` and ``collapse_runs`` are windows for whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import TableSpec
from .rounding import to_micros

_KIND = "array<struct<s:bigint,e:bigint>>"


def bucket_start(us: Column, width: int) -> Column:
    """Start of the bucket of ``us``, before the epoch too."""
    return us - F.pmod(us, F.lit(width)) if width else us


def interval(start: Column, end: Column, bucket: int = 0) -> Column:
    """The set of one interval, empty if it ends before it starts; with a bucket width, the bucket of its start."""
    s, e = start.cast("long"), end.cast("long")
    b = bucket_start(s, bucket)
    one = F.array(F.struct(b.alias("s"), (b + bucket if bucket else e).alias("e")))
    return F.when(s <= e, one).otherwise(F.array().cast(_KIND))


def coalesce(ranges: Column) -> Column:
    """Sorted, disjoint union of an array of intervals."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"] + 1), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(_KIND), step)


def add(timeline: Column, start: Column, end: Column, bucket: int = 0) -> Column:
    return coalesce(F.concat(timeline, interval(start, end, bucket)))


def extend(timeline: Column, ranges: Column) -> Column:
    """Union with an array of intervals, which are not put in buckets; those that end before they start don't count."""
    return coalesce(F.concat(timeline, F.filter(ranges, lambda x: x["s"] <= x["e"])))


def merge(a: Column, b: Column, bucket: int = 0, compat: bool = False) -> Column:
    """Union of two sets. ``compat`` puts the second's intervals in the bucket of their start again, if the first isn't empty."""
    if compat and bucket:
        again = F.transform(b, lambda x: F.struct(bucket_start(x["s"], bucket).alias("s"), (bucket_start(x["s"], bucket) + bucket).alias("e")))
        return F.when(F.size(a) == 0, b).otherwise(coalesce(F.concat(a, again)))
    return coalesce(F.concat(a, b))


def start(timeline: Column) -> Column:
    return F.try_element_at(timeline, F.lit(1))["s"]


def end(timeline: Column) -> Column:
    return F.try_element_at(timeline, F.lit(-1))["e"]


def span(timeline: Column) -> Column:
    """From first start to last end, gaps included; 0 for an empty set."""
    wide = end(timeline).cast("decimal(20,0)") - start(timeline).cast("decimal(20,0)")
    return F.when(wide.isNull(), F.lit(0).cast("long")).otherwise(F.least(wide, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long"))


def length(timeline: Column) -> Column:
    return F.size(timeline)


def is_empty(timeline: Column) -> Column:
    return F.size(timeline) == 0


def contains(timeline: Column, us: Column | int) -> Column:
    return F.exists(timeline, lambda x: (x["s"] <= us) & (x["e"] >= us))


def overlaps(timeline: Column, first: Column | int, last: Column | int) -> Column:
    return F.exists(timeline, lambda x: (x["s"] <= last) & (x["e"] >= first))


def union_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, s, e): the disjoint union of a table's intervals per key, by one sort."""
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    part = df.select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")).where("_s <= _e")
    before = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = part.withColumn("_new", F.when(F.col("_s") <= before + 1, 0).otherwise(1))
    part = part.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*keys, "_isle").agg(F.min("_s").alias("s"), F.max("_e").alias("e")).drop("_isle")


def bucket_intervals(df: DataFrame, keys: Sequence[str], us: Column, bucket: int) -> DataFrame:
    """(keys, s, e): the union of the buckets of a table's points."""
    points = df.select(*keys, bucket_start(us, bucket).alias("s")).distinct().withColumn("e", F.col("s") + bucket)
    return union_intervals(points, keys, "s", "e")


def timelines(intervals: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, ``name``): one sorted array per key of disjoint intervals (keys, s, e)."""
    return intervals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias(name))


def _equal(a: Column, b: Column, kind: str) -> Column:
    if "map<" in kind:
        a, b = F.array_sort(F.map_entries(a)), F.array_sort(F.map_entries(b))
    same = a.eqNullSafe(b)
    # NaN is not equal to itself here.
    return same & ~F.coalesce(F.isnan(a), F.lit(False)) if kind in ("float", "double") else same


def collapse_runs(df: DataFrame, spec: TableSpec, order_by: str | None = None) -> DataFrame:
    """Rows of a timeline table whose other fields equal those of the row before, in their index group, joined with it.

    Rows are ordered by their first start (0 if they have none), then the tiebreak, which is a field like others, and by
    the column ``order_by``, which needn't be a field. The joined row has the union of the timelines. A, B, A stay three
    rows; without other fields a group is one row. All windows share one shuffle by index and no array is built up step by step.
    """
    ts = spec.timestamp
    if ts is None or spec.fields[ts].kind != "timeline":
        raise ValueError("runs collapse in tables whose timestamp is a timeline")
    kinds = dict(df.dtypes)
    group = [F.col(f"`{c}`") for c in spec.index]
    order = [F.coalesce(start(F.col(ts)), F.lit(0)), *[F.col(f"`{c}`") for c in (spec.tiebreak, order_by) if c]]
    w = Window.partitionBy(*group).orderBy(*order)
    plain = [c for c in spec.fields if c not in (*spec.index, ts)]
    same = F.lit(True)
    for c in plain:
        same = same & _equal(F.lag(c).over(w), F.col(c), kinds[c])
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_new", F.when(first | ~same, 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.select(*spec.index, *plain, "_run", F.explode_outer(ts).alias("_x"))
    by = Window.partitionBy(*group, F.col("_run")).orderBy("_x.s", "_x.e")
    before = F.max("_x.e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_gap", F.when(F.col("_x.s") <= before + 1, 0).otherwise(1))
    parts = parts.withColumn("_isle", F.sum("_gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # Rows of a run have equal fields, so any of them stands for all.
    keep = [F.first(c).alias(c) for c in plain]
    isles = parts.groupBy(*spec.index, "_run", "_isle").agg(*keep, F.min("_x.s").alias("s"), F.max("_x.e").alias("e"))
    found = F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "e"))))
    return isles.groupBy(*spec.index, "_run").agg(*keep, found.alias(ts)).select(*spec.fields)


def point_intervals(ts: Column, micros: int) -> tuple[Column, Column]:
    """Start and end of an interval of ``micros`` from each TIMESTAMP_NTZ."""
    us = to_micros(ts)
    return us, us + micros
