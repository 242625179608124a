import uuid
from datetime import datetime, timedelta

import pytest

from sparkloam.operators.filters import BoolFilter, DateTimeFilter, Filter, I64Filter, StringFilter
from sparkloam.operators.predicates import condition
from sparkloam.sources.scan import filter_table, resolve_fields
from sparkloam.spec import BOOL, BYTES, DATETIME, F32, F64, I32, I64, JSON, STRING, U8, U64, UUID, Enum, Map, Option, Struct, TableSpec, Timeline, Tuple, Vec, enum_table

SPEC = TableSpec({
    "id": I64, "name": STRING, "score": F32, "v": F64, "u": U8, "big": U64, "ok": BOOL, "raw": BYTES, "uid": UUID, "ts": DATETIME, "j": JSON,
    "opt": Option(I32), "xs": Vec(I64), "kids": Vec(Struct({"id": I32, "name": STRING})), "m": Map(STRING, I32), "pair": Tuple(I64, STRING),
    "meta": Struct({"id": I64, "name": STRING}), "kind": Enum({"A": None, "B": 5, "C": None}), "seen": Timeline(),
})
U = "00000000-0000-0000-0000-000000000001"
ROWS = [
    (1, "alice", 95.5, 1.0, 255, 2**64 - 1, True, b"\x01\x02", U, datetime(2024, 1, 1), '{"a":1}', 10, [1, 2, 3], [(1, "alice"), (2, "bob")], {"x": 1}, (42, "a"), (100, "alice"), 0, [(1000, 2000)]),
    (2, "bob", 80.0, float("nan"), 0, 0, False, b"", U, datetime(2024, 1, 2), '{"a":1.0}', None, [], [(3, "c")], {}, (99, "b"), (200, "bob"), 5, [(5000, 6000), (8000, 9000)]),
    (3, "charlie", 95.5, float("inf"), 7, 5, True, b"\xff", str(uuid.uuid4()), datetime(2024, 1, 3), "null", 42, [42], [(2, "bob"), (4, "dave")], {"y": 2, "z": 3}, (42, "c"), (300, "alice"), 6, []),
]


@pytest.fixture(scope="module")
def rows(spark):
    from decimal import Decimal

    return spark.createDataFrame([(*r[:5], Decimal(r[5]), *r[6:]) for r in ROWS], SPEC.schema()).cache()


@pytest.mark.parametrize("query, ids", [
    ({}, [1, 2, 3]), ({"id": 2}, [2]), ({"id": 2.9}, [2]), ({"id": {"start": 2, "end": 3}}, [2, 3]), ({"id": {"start": 3, "end": 2}}, []), ({"id": {"start": 2, "end": 2}}, [2]),
    ({"id": [1, 3, 9]}, [1, 3]), ({"id": [1.5]}, []), ({"id": [1.5, 3.0]}, [3]), ({"id": [2]}, [2]),
    ({"u": 300}, []), ({"u": -5}, []), ({"u": {"start": -5, "end": 300}}, [1, 2, 3]), ({"big": 2**64 - 1}, [1]), ({"big": {"start": 1, "end": 2**64 - 1}}, [1, 3]),
    ({"score": 95.5}, [1, 3]), ({"score": {"start": 80, "end": 90}}, [2]), ({"score": [80, 95.5]}, [1, 2, 3]),
    ({"v": 1}, [1]), ({"v": {"start": 0, "end": 10}}, [1]), ({"v": {"start": 0, "end": float("inf")}}, [1, 3]), ({"v": float("nan")}, []),
    ({"ok": True}, [1, 3]), ({"ok": []}, []), ({"ok": [False]}, [2]), ({"name": "bob"}, [2]), ({"name": ["alice", "bob"]}, [1, 2]), ({"name": []}, []),
    ({"raw": "0102"}, [1]), ({"raw": ""}, [2]), ({"raw": "FF"}, [3]), ({"uid": U.replace("-", "")}, [1, 2]), ({"uid": [U.upper()]}, [1, 2]),
    ({"ts": 1704067200000000}, [1]), ({"ts": "2024-01-02T01:00:00+01:00"}, [2]), ({"ts": {"start": 1704067200000000, "end": "2024-01-02T00:00:00Z"}}, [1, 2]), ({"ts": ["2024-01-01T00:00:00Z", "x"]}, []),
    ({"j": {"a": 1}}, [1]), ({"j": {"a": 1.0}}, [2]),
    ({"opt": 42}, [3]), ({"opt": {"start": 0, "end": 50}}, [1, 3]), ({"xs": 2}, [1]), ({"xs": {"start": 3, "end": 50}}, [1, 3]), ({"xs": [1, 42]}, [1, 3]),
    ({"kids.id": 2, "kids.name": "dave"}, [3]), ({"kids.id": 1, "kids.name": "bob"}, [1]), ({"m": "x"}, [1]), ({"m": ["y", "x"]}, [1, 3]),
    ({"pair.0": 42}, [1, 3]), ({"pair.1": "b"}, [2]), ({"meta.name": "alice", "meta.id": {"start": 200, "end": 400}}, [3]),
    ({"kind": 5}, [2]), ({"kind": [0, 6]}, [1, 3]), ({"kind": {"start": 1, "end": 5}}, [2]),
    ({"seen": 2000}, [1]), ({"seen": 7000}, []), ({"seen": {"start": 2000, "end": 5000}}, [1, 2]), ({"seen": {"start": 6001, "end": 7999}}, []), ({"seen": [1500, 8500]}, [1, 2]),
])
def test_matches(rows, query, ids):
    assert sorted(r.id for r in filter_table(rows, SPEC, query, ["id"]).collect()) == ids


@pytest.mark.parametrize("query", [
    {"nope": 1}, {"id.x": 1}, {"id": []}, {"id": "1"}, {"id": None}, {"id": True}, {"ok": 1}, {"ok": {"start": False, "end": True}}, {"name": {"start": "a", "end": "b"}}, {"name": ["a", 1]},
    {"v": []}, {"v": "x"}, {"uid": "x"}, {"raw": "zz"}, {"raw": ["01"]}, {"ts": "yesterday"}, {"ts": "2024-01-01"}, {"j": [1]}, {"j": None}, {"m.x": 1}, {"pair": 1}, {"pair.2": 1}, {"pair.0.1": 1},
    {"meta": 1}, {"meta.no": 1}, {"seen": "x"}, {"opt": None},
])
def test_rejects(query):
    with pytest.raises(ValueError):
        condition(SPEC, query)
    with pytest.raises(ValueError):
        condition(SPEC, [query])


def test_enum_table(spark):
    t = Enum({"A": None, "B": 3, "C": None})
    rows = spark.createDataFrame([(0,), (3,), (4,)], "value long")
    spec = enum_table(t)
    assert [r.value for r in filter_table(rows, spec, {"": [3, 4]}).collect()] == [3, 4]
    for bad in ({"value": 3},):
        with pytest.raises(ValueError):
            condition(spec, bad)


def test_compat_clamps_literals(spark):
    spec = TableSpec({"u": U8})
    rows = spark.createDataFrame([(255,), (0,)], "u short")
    assert [r.u for r in filter_table(rows, spec, {"u": 300}, compat=True).collect()] == [255]


def test_float_round_tolerance(spark):
    spec = TableSpec({"id": I64, "value": F64, "xs": Vec(F64)}, float_round=2)
    rows = spark.createDataFrame([(1, 500.0, [500.0]), (2, 500.01, [500.01]), (3, 499.99, [499.99])], "id long, value double, xs array<double>")
    assert [r.id for r in filter_table(rows, spec, {"value": 500.004}).collect()] == [1]
    assert [r.id for r in filter_table(rows, spec, {"value": [500.0, 499.99]}).collect()] == [1, 3]
    assert filter_table(rows, spec, {"xs": 500.004}).count() == 0


def test_projection(spark):
    spec = TableSpec({"id": I64, "temperature": F64, "label": STRING}, index=("id",))
    rows = spark.createDataFrame([(1, 20.0, "a"), (2, 25.0, "b")], "id long, temperature double, label string")
    assert filter_table(rows, spec, {"id": 1}, ["label"]).collect() == [(1, "a")]
    assert filter_table(rows, spec, {}, ["label"], default_fill=True).collect() == [(1, 0.0, "a"), (2, 0.0, "b")]
    timed = TableSpec({"a": I64, "t": DATETIME, "m": Struct({"x": I64})}, timestamp="t")
    assert resolve_fields(timed, {"m.x": 1}, ["a"]) == ["a", "m"]
    assert resolve_fields(timed, {}, []) == ["a", "t", "m", "start_at", "end_at"]
    assert resolve_fields(timed, {}, ["start_at"]) == ["start_at"]
    for bad in (["nope"], ["m.x"]):
        with pytest.raises(ValueError):
            resolve_fields(timed, {}, bad)
    with pytest.raises(ValueError, match="use 'm' instead"):
        resolve_fields(timed, {}, ["m.x"])


def test_typed_filters():
    spec = TableSpec({"device": I64, "at": DATETIME, "t": F64, "name": STRING, "on": BOOL}, index=("device",), timestamp="at")
    f = Filter.new(spec, range(1, 4), {"start": "2024-01-01T00:00:00Z", "end": datetime(2024, 1, 2)})
    f["name"] = ["a", "b"]
    assert f.to_json() == {"device": {"start": 1, "end": 3}, "at": {"start": "2024-01-01T00:00:00Z", "end": "2024-01-02T00:00:00Z"}, "name": ["a", "b"]}
    assert Filter.from_json(spec, f.to_json()) == f and f["t"] is None
    assert f.range_duration() == timedelta(days=1)
    assert f.range_shift(timedelta(days=1)).range_bounds() == (datetime(2024, 1, 2), datetime(2024, 1, 3))
    assert I64Filter.exact(2**64 - 1).value == -1
    for bad in (lambda: StringFilter.range("a", "b"), lambda: BoolFilter.of(1), lambda: DateTimeFilter.exact("2024-01-01T00:00:00Z").range_bounds(), lambda: Filter(spec, zz=1), lambda: Filter(TableSpec({"a": I64}), a=1).range_bounds()):
        with pytest.raises(ValueError):
            bad()


def test_pushdown(spark, sf):
    from sparkloam.plans import catalog

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = catalog.q01(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,8)" in plan and "In(event_type" in plan and "GreaterThanOrEqual(ts" in plan
    assert "props" not in plan.split("ReadSchema")[1]
