import math
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloam.functions import rounding, timeline
from sparkloam.functions.json import canonical
from sparkloam.spec import DATETIME, F32, F64, I8, I32, I64, JSON, STRING, U8, U32, U64, Enum, Map, Option, Struct, TableSpec, Timeline, Tuple, Vec
from sparkloam.sources.evolve import evolve


def test_float_round(spark):
    xs = [1.005, 0.285, 23.456, -2.5, float("nan"), float("inf"), -float("inf"), None, 1e300]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(rounding.float_round(F.col("x"), 2)).collect()]
    top = (2**63 - 1) / 100.0
    assert got == [1.0, 0.28, 23.46, -2.5, 0.0, top, -(2.0**63) / 100, None, top]


def test_time_round(spark):
    def want(u, g):
        q, r = int(math.copysign(abs(u) // g, u)) if u else 0, int(math.fmod(u, g))
        h = g // 2
        return (q + 1 if r >= h or (r < 0 and -r > h) else q) * g

    rows = [(u,) for u in range(-200, 201)]
    for g in (5, 7, 60):
        got = spark.createDataFrame(rows, "u long").select(rounding.round_micros(F.col("u"), g)).collect()
        assert [r[0] for r in got] == [want(u, g) for (u,) in rows]
    near = spark.createDataFrame([(-31,), (-91,), (29,)], "u long").select(rounding.round_micros(F.col("u"), 60, floor=True)).collect()
    assert [r[0] for r in near] == [-60, -120, 0]


def test_containers(spark):
    spec = TableSpec({"a": Option(F64), "xs": Vec(F32), "m": Map(STRING, Tuple(F64, I32)), "n": Struct({"v": F64}), "t": Vec(DATETIME), "e": Enum({"A": None, "B": (1, F64)}), "j": JSON}, float_round=1, time_round=timedelta(minutes=1))
    row = (None, [1.26], {"k": (2.349, 1)}, (9.99,), [datetime(2024, 1, 1, 0, 0, 30)], (1, 0.06), '{"b":19.96,"a":[1,2.04]}')
    got = spark.createDataFrame([row], spec.schema()).withColumns(rounding.round_columns(spec)).first()
    assert got.a is None and abs(got.xs[0] - 1.3) < 1e-6 and got.m["k"]._0 == 2.3 and got.n.v == 9.99
    assert got.t == [datetime(2024, 1, 1, 0, 1)] and got.e.variant_1 == 0.1 and got.j == '{"a":[1,2.0],"b":20.0}'


def test_canonical():
    assert canonical('{"b": 1, "a": {"d":1.0,"c":null}}') == '{"a":{"c":null,"d":1.0},"b":1}'


def _union(ranges):
    out = []
    for s, e in sorted(r for r in ranges if r[0] <= r[1]):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-60, 60), st.integers(-60, 60)), max_size=8), min_size=1, max_size=20))
def test_union_is_brute_force(spark, groups):
    rows = [(k, s, e) for k, g in enumerate(groups) for s, e in g]
    flat = spark.createDataFrame(rows, "k int, s long, e long")
    got = {}
    for r in timeline.union_intervals(flat, ["k"], "s", "e").collect():
        got.setdefault(r.k, []).append((r.s, r.e))
    lines = spark.createDataFrame([(k, [x for x in g if x[0] <= x[1]]) for k, g in enumerate(groups)], "k int, t array<struct<s:bigint,e:bigint>>")
    arrays = {r.k: [tuple(x) for x in r.c] for r in lines.select("k", timeline.coalesce(F.col("t")).alias("c")).collect()}
    for k, g in enumerate(groups):
        assert sorted(got.get(k, [])) == _union(g) == arrays[k]


def test_timeline_operators(spark):
    one = spark.range(1).select(timeline.interval(F.lit(1000), F.lit(5000)).alias("a"), timeline.interval(F.lit(9), F.lit(1)).alias("none"))
    a = F.col("a")
    r = one.select(
        timeline.add(a, F.lit(3000), F.lit(7000)).alias("more"), timeline.add(timeline.interval(F.lit(3), F.lit(5), 10), F.lit(15), F.lit(18), 10).alias("b"),
        timeline.interval(F.lit(-15), F.lit(-5), 10).alias("neg"), timeline.span(a).alias("span"), timeline.span(F.col("none")).alias("zero"), timeline.contains(a, 5000).alias("c"),
        timeline.overlaps(a, 5001, 6000).alias("o"), timeline.start(F.col("none")).alias("s"), timeline.is_empty(F.col("none")).alias("e"), timeline.merge(F.col("none"), a).alias("m"), timeline.length(a).alias("n"),
    ).first()
    assert [tuple(x) for x in r.more] == [(1000, 7000)] and [tuple(x) for x in r.b] == [(0, 20)] and [tuple(x) for x in r.neg] == [(-20, -10)]
    assert (r.span, r.zero, r.c, r.o, r.s, r.e, r.n) == (4000, 0, True, False, None, True, 1) and [tuple(x) for x in r.m] == [(1000, 5000)]


def test_collapse_runs(spark):
    spec = TableSpec({"d": I64, "seen": Timeline(), "v": F64}, index=("d",), timestamp="seen")
    nan = float("nan")
    rows = [(1, [(1, 2)], 5.0), (1, [(3, 4)], 5.0), (1, [(9, 10)], 6.0), (1, [(20, 21)], 5.0), (2, [(1, 1)], nan), (2, [(5, 5)], nan), (3, [(1, 1)], None), (3, [(5, 5)], None)]
    got = timeline.collapse_runs(spark.createDataFrame(rows, spec.schema()), spec).collect()
    assert sorted((r.d, [tuple(x) for x in r.seen]) for r in got) == [(1, [(1, 4)]), (1, [(9, 10)]), (1, [(20, 21)]), (2, [(1, 1)]), (2, [(5, 5)]), (3, [(1, 1), (5, 5)])]


def test_clamp_and_fill(spark):
    old = TableSpec({"f": F64, "i": I64, "b": U64, "p": Tuple(I32, I32), "e": Enum({"A": None, "B": None}), "xs": Vec(I64)})
    new = TableSpec({"xs": Vec(I8), "i": U8, "f": I32, "b": I64, "p": Tuple(I32, I32, I32), "e": Enum({"A": None}), "added": STRING, "g": Option(I64)})
    inf = float("inf")
    rows = [(inf, -3, Decimal(2**64 - 1), (1, 2), 1, [300, -300]), (-42.9, 300, Decimal(7), (1, 2), 0, []), (float("nan"), 5, Decimal(0), None, 0, None)]
    got = evolve(spark.createDataFrame(rows, old.schema()), old, new).collect()
    assert [r.f for r in got] == [2**31 - 1, -42, 0] and [r.i for r in got] == [0, 255, 5] and got[0].b == 2**63 - 1 and got[0].xs == [127, -128]
    assert tuple(got[0].p) == (1, 2, 0) and got[0].e == 0 and got[0].added == "" and got[0].g is None
    wide = TableSpec({"f": U64})
    xs = [(1.8446744073709552e19,), (-1.0,), (2.0**63 + 4096,), (3.99,)]
    got = evolve(spark.createDataFrame(xs, "f double"), TableSpec({"f": F64}), wide).collect()
    assert [int(r.f) for r in got] == [2**64 - 1, 0, 2**63 + 4096, 3]
    with pytest.raises(ValueError):
        evolve(spark.createDataFrame(xs, "f double"), TableSpec({"f": F64}), TableSpec({"f": STRING}))
    with pytest.raises(ValueError):
        evolve(spark.createDataFrame(xs, "f double"), TableSpec({"f": F64}), TableSpec({"k": I64}, index=("k",)))


def test_specs():
    for bad in (dict(float_round=9), dict(chunk_size=0), dict(index=("no",)), dict(index=("f",)), dict(timestamp="f")):
        with pytest.raises(ValueError):
            TableSpec({"f": F64, "u": U32}, **bad)
