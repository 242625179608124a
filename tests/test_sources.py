from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkloam.sources import evolve, layout
from sparkloam.sources.scan import scan
from sparkloam.spec import DATETIME, F64, I64, STRING, TableSpec, Timeline
from sparkloam.streaming import windows

SPEC = TableSpec({"d": I64, "at": DATETIME, "v": F64, "n": I64}, index=("d",), timestamp="at", float_round=1, chunk_size=3, tiebreak="n")


def _rows(spark):
    return spark.createDataFrame([(i % 2, datetime(2024, 1, 1) + timedelta(minutes=i), i + 0.26, i) for i in range(20)], SPEC.schema())


def test_write_and_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    for by_directory in (True, False):
        path = str(tmp_path / str(by_directory))
        layout.write(_rows(spark), SPEC, path, by_directory=by_directory)
        back = layout.read(spark, SPEC, path)
        assert back.count() == 20 and {round(r.v * 10) for r in back.collect()} == {round((i + 0.3) * 10) for i in range(20)}
        meta = sorted(layout.chunk_metadata(back, SPEC).collect())
        assert [(m.d, m.chunk_no, m.n) for m in meta] == [(d, c, n) for d in (0, 1) for c, n in enumerate([3, 3, 3, 1])]
        stored = layout.chunk_metadata(back, SPEC)._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema" in stored and ",v:" not in stored and "<at:" not in stored and ",at:" not in stored
        assert len(scan(spark, SPEC, path, {"d": 1}, ["d"]).collect()) == 4
        some = scan(spark, SPEC, path, {"d": 0, "at": {"start": "2024-01-01T00:02:00Z", "end": "2024-01-01T00:06:00Z"}}, ["n", "start_at"])
        assert sorted((r.n, r.start_at.minute) for r in some.collect()) == [(2, 0), (4, 0), (6, 6)]
        assert layout.expand(back, SPEC, 3, d=1).collect()[0].n == 19
    line = scan(spark, SPEC, str(tmp_path / "False"), {"at": {"start": "2024-01-01T00:02:00Z", "end": "2024-01-01T00:06:00Z"}}, ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(start_at" in line and "GreaterThanOrEqual(end_at" in line and line.count("Scan parquet") == 1 and "Exchange" not in line
    plan = scan(spark, SPEC, str(tmp_path / "True"), {"d": 1}, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan


def test_empty_and_timeline(spark, tmp_path):
    layout.write(_rows(spark).limit(0), SPEC, str(tmp_path / "none"))
    assert layout.read(spark, SPEC, str(tmp_path / "none")).count() == 0
    spec = TableSpec({"d": I64, "seen": Timeline(), "v": I64}, index=("d",), timestamp="seen")
    layout.write(spark.createDataFrame([(1, [(1, 2)], 5), (1, [(3, 4)], 5)], spec.schema()), spec, str(tmp_path / "t"))
    back = layout.read(spark, spec, str(tmp_path / "t"))
    meta = layout.chunk_metadata(back, spec).collect()
    assert [(m.start_at, m.end_at, m.n) for m in meta] == [(1, 4, 1)]


def test_versions(spark, tmp_path):
    old, new = TableSpec({"id": I64, "v": F64}), TableSpec({"id": I64, "name": STRING, "v": I64})
    layout.write(spark.createDataFrame([(1, 2.9)], old.schema()), old, str(tmp_path / "a"))
    layout.write(spark.createDataFrame([(2, "x", 3)], new.schema()), new, str(tmp_path / "b"))
    both = evolve.read_versions(spark, new, [(old, str(tmp_path / "a")), (new, str(tmp_path / "b"))])
    assert sorted(map(tuple, both.collect())) == [(1, "", 2), (2, "x", 3)]


def test_stream(spark, tmp_path):
    layout.write(_rows(spark), SPEC, str(tmp_path / "in"), by_directory=False)
    some = windows.filter_stream(windows.stream_table(spark, SPEC, str(tmp_path / "in")), SPEC, {"d": 1})
    windows.run_to_end(some, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_texts_as_index(spark, tmp_path):
    spec = TableSpec({"k": STRING, "u": STRING, "v": I64}, index=("k", "u"))
    rows = [("", "a", 1), ("x", "", 2), ("_", "b/c=d", 3), ("7", "null", 4)]
    for by_directory in (True, False):
        path = str(tmp_path / str(by_directory))
        layout.write(spark.createDataFrame(rows, spec.schema()), spec, path, by_directory=by_directory)
        assert sorted(map(tuple, layout.read(spark, spec, path).select("k", "u", "v").collect())) == sorted(rows)
        for k, u, v in rows:
            assert [r.v for r in scan(spark, spec, path, {"k": k, "u": u}).collect()] == [v]
    plan = scan(spark, spec, str(tmp_path / "True"), {"k": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "__dir_k" in plan.split("PartitionFilters")[1][:200]


def test_rows_without_order_are_numbered_where_they_are(spark, tmp_path):
    spec = TableSpec({"v": I64}, chunk_size=7)
    rows = spark.range(0, 1000, 1, 8).selectExpr("id % 3 v").where("spark_partition_id() <> 2")
    for name, df in (("some", rows), ("none", rows.limit(0))):
        layout.write(df, spec, str(tmp_path / name))
        n = df.count()
        back = layout.read(spark, spec, str(tmp_path / name))
        assert sorted(r.v for r in back.collect()) == sorted(r.v for r in df.collect())
        meta = sorted((m.chunk_no, m.n) for m in layout.chunk_metadata(back, spec).collect())
        assert meta == [(k, min(7, n - 7 * k)) for k in range(-(-n // 7))]
    plan = layout.prepare(rows, spec)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan.split("BroadcastExchange")[0] and "Window" not in plan.split("BroadcastExchange")[0] and "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
    files = spark.read.parquet(str(tmp_path / "some")).selectExpr("input_file_name() f").groupBy("f").count().collect()
    assert max(f["count"] for f in files) < rows.count()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none", "some"]


def test_rounded_rows_without_order_stay_spread(spark, tmp_path):
    old, new = TableSpec({"id": I64, "v": F64}, float_round=1), TableSpec({"id": I64, "v": I64})
    rows = spark.range(0, 400, 1, 4).selectExpr("id", "id - 200.04D v")
    layout.write(rows, old, str(tmp_path / "t"))
    assert sorted(map(tuple, evolve.read_versions(spark, new, [(old, str(tmp_path / "t"))]).collect())) == [(i, i - 200) for i in range(400)]
    assert max(r["count"] for r in spark.read.parquet(str(tmp_path / "t")).selectExpr("input_file_name() f").groupBy("f").count().collect()) < 400


def test_large_groups_are_numbered_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "RANGE_ROWS", 20, raising=False)
    monkeypatch.setattr(layout, "TASK_ROWS", 50, raising=False)
    at = [None if i % 97 == 0 else datetime(2024, 1, 1) + timedelta(minutes=i * 37 % 300) for i in range(1000)]
    rows = [(None if i % 5 == 0 else ["a", "", "b"][i % 3], at[i], (i * 7919) % 1000) for i in range(1000)]
    for index in (("k",), ()):
        spec = TableSpec({"k": STRING, "at": DATETIME, "n": I64}, index=index, timestamp="at", chunk_size=7, tiebreak="n")
        groups = {}
        for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.min, r[2])):
            groups.setdefault(r[0] if index else 0, []).append(r)
        want = {r: k // 7 for g in groups.values() for k, r in enumerate(g)}
        df = spark.createDataFrame(rows, spec.schema()).repartition(3)
        got = layout.number_chunks(df, spec)
        assert {(r.k, r.at, r.n): r.chunk_no for r in got.collect()} == want and got.count() == 1000
        for by_directory in (True, False) if index else (False,):
            path = str(tmp_path / f"{len(index)}{by_directory}")
            layout.write(df.fillna("", ["k"]) if by_directory else df, spec, path, by_directory=by_directory)
            chunks = {}
            for r in layout.read(spark, spec, path).collect():
                chunks.setdefault((r.k if index else 0, r.chunk_no), []).append(r)
            assert sum(map(len, chunks.values())) == 1000
            for part in chunks.values():
                times = [r.at for r in part if r.at is not None]
                assert {(r.chunk_rows, r.start_at, r.end_at) for r in part} == {(len(part), min(times, default=None), max(times, default=None))}
            # No task has a whole group.
            assert max(r["count"] for r in spark.read.parquet(path).selectExpr("input_file_name() f").groupBy("f").count().collect()) < 200


def test_large_groups_without_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "RANGE_ROWS", 20, raising=False)
    spec = TableSpec({"k": STRING, "v": I64}, index=("k",), chunk_size=7)
    layout.write(spark.range(0, 500, 1, 4).selectExpr("if(id % 5 = 0, 'a', 'b') k", "1L v"), spec, str(tmp_path / "t"))
    meta = sorted(layout.chunk_metadata(layout.read(spark, spec, str(tmp_path / "t")), spec).collect())
    assert [(m.k, m.chunk_no, m.n) for m in meta] == [(k, c, min(7, n - 7 * c)) for k, n in (("a", 100), ("b", 400)) for c in range(-(-n // 7))]


def test_large_group_of_an_empty_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "RANGE_ROWS", 20, raising=False)
    monkeypatch.setattr(layout, "TASK_ROWS", 50, raising=False)
    spec = TableSpec({"k": STRING, "n": I64}, index=("k",), chunk_size=7, tiebreak="n")
    rows = spark.range(0, 600, 1, 3).selectExpr("if(id % 6 = 0, 'x', '') k", "id n")
    for by_directory in (True, False):
        path = str(tmp_path / str(by_directory))
        layout.write(rows, spec, path, by_directory=by_directory)
        assert sorted(r.n for r in scan(spark, spec, path, {"k": ""}, ["n"]).collect()) == [i for i in range(600) if i % 6]
        assert max(r["count"] for r in spark.read.parquet(path).selectExpr("input_file_name() f").groupBy("f").count().collect()) < 250
