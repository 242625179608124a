"""The engine's operators on the test tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounding, timeline
from ..functions.json import canonical_json
from ..operators.filters import Filter
from ..sources import evolve, layout, scan
from ..spec import BOOL, BYTES, F32, F64, I8, I32, I64, STRING, Enum, Map, Option, Struct, TableSpec, Timeline, Tuple, Vec
from ..streaming import windows
from . import more
from .tables import EVENTS, HALF_HOUR, HOUR, ORDERS, events, scratch, table

SPAN = TableSpec({"user_id": I64, "seen": Timeline()})


def q01(spark: SparkSession, d: str) -> DataFrame:
    query = {"user_id": 8, "ts": {"start": "2024-01-02T00:00:00Z", "end": "2024-01-20T00:00:00Z"}, "event_type": ["click", "view"]}
    return scan.filter_table(events(spark, d), EVENTS, query, ["event_id", "value"]).select("event_id", "value")


def q02(spark: SparkSession, d: str) -> DataFrame:
    return scan.filter_table(events(spark, d), EVENTS, {"user_id": 8}, ["event_id"], default_fill=True).select("event_id", "event_type", "value")


def q03(spark: SparkSession, d: str) -> DataFrame:
    return scan.filter_table(layout.number_chunks(events(spark, d), EVENTS), EVENTS, {}, ["user_id"])


def q04(spark: SparkSession, d: str) -> DataFrame:
    spec = TableSpec({"v": Option(F64)})
    some = events(spark, d).select(F.when(F.col("value") > 50, None).otherwise(F.col("value")).alias("v"))
    return scan.filter_table(some, spec, {"v": 12.31}).agg(F.count(F.lit(1)).alias("n"))


def q05(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", rounding.float_round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("v"))


def q06(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", rounding.time_round(F.col("ts"), timedelta(minutes=1)).alias("ts"))


def q07(spark: SparkSession, d: str) -> DataFrame:
    spec = TableSpec({"vec_id": I64, "embedding": Vec(F32)}, index=("vec_id",))
    return scan.filter_table(table(spark, d, "embeddings"), spec, {"embedding": {"start": 0.2, "end": 0.3}}, ["vec_id"])


def _orders_with_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("lines"))


def q08(spark: SparkSession, d: str) -> DataFrame:
    spec = TableSpec({"l_orderkey": I64, "lines": Vec(Struct({"l_linenumber": I32, "l_returnflag": STRING}))})
    return scan.filter_table(_orders_with_lines(spark, d), spec, {"lines.l_linenumber": 2, "lines.l_returnflag": "R"}, ["l_orderkey"])


def q09(spark: SparkSession, d: str) -> DataFrame:
    spec = TableSpec({"l_orderkey": I64, "flags": Map(STRING, I32)})
    flags = F.map_from_entries(F.array_distinct(F.transform("lines", lambda x: F.struct(x["l_returnflag"], F.lit(1)))))
    return scan.filter_table(_orders_with_lines(spark, d).select("l_orderkey", flags.alias("flags")), spec, {"flags": "R"}, ["l_orderkey"])


def q10(spark: SparkSession, d: str) -> DataFrame:
    return layout.chunk_metadata(layout.number_chunks(events(spark, d), EVENTS), EVENTS).select("user_id", "chunk_no", "start_at", "end_at", "n")


def q11(spark: SparkSession, d: str) -> DataFrame:
    us = rounding.to_micros(F.col("ts"))
    spec = TableSpec({"user_id": I64, "seen": Timeline(), "event_type": STRING}, index=("user_id",), timestamp="seen")
    runs = timeline.collapse_runs(events(spark, d).select("user_id", timeline.interval(us, us).alias("seen"), "event_type", "event_id"), spec, order_by="event_id")
    return runs.select("user_id", "event_type", *[rounding.from_micros(f(F.col("seen"))).alias(n) for n, f in (("s", timeline.start), ("e", timeline.end))], F.size("seen").cast("long").alias("n"))


def q12(spark: SparkSession, d: str) -> DataFrame:
    return timeline.bucket_intervals(events(spark, d), ["user_id"], rounding.to_micros(F.col("ts")), HOUR)


def _half_hours(spark: SparkSession, d: str) -> DataFrame:
    s, e = timeline.point_intervals(F.col("ts"), HALF_HOUR)
    return timeline.union_intervals(events(spark, d).select("user_id", s.alias("a"), e.alias("b")), ["user_id"], "a", "b")


def q13(spark: SparkSession, d: str) -> DataFrame:
    return _half_hours(spark, d)


def q14(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("props", canonical_json(F.col("props")))
    return scan.filter_table(rows, EVENTS, {"props": {"k": 9}}, ["event_id"]).select("event_id")


def q15(spark: SparkSession, d: str) -> DataFrame:
    old, new = TableSpec({"event_id": I64, "value": F64}), TableSpec({"event_id": I64, "value": I8})
    return evolve.evolve(events(spark, d), old, new).withColumnRenamed("value", "v")


def q16(spark: SparkSession, d: str) -> DataFrame:
    old, new = TableSpec({"id": I64}), TableSpec({"id": I64, "src": STRING})
    rows = events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("src"))
    both = evolve.evolve(rows.where("id % 2 = 0"), old, new).unionByName(evolve.evolve(rows.where("id % 2 = 1"), new, new))
    return scan.filter_table(both, new, {"src": ["", "click"]})


def q17(spark: SparkSession, d: str) -> DataFrame:
    lines = timeline.timelines(_half_hours(spark, d), ["user_id"], "seen")
    return scan.filter_table(lines, SPAN, {"seen": {"start": 1704200000000000, "end": 1704300000000000}}, ["user_id"])


def q18(spark: SparkSession, d: str) -> DataFrame:
    lines = timeline.timelines(_half_hours(spark, d), ["user_id"], "seen")
    return scan.filter_table(lines, SPAN, {"seen": [1704200000000000, 1704300000000000]}, ["user_id"])


def q19(spark: SparkSession, d: str) -> DataFrame:
    spec = TableSpec({"meta": Struct({"c_name": STRING, "c_nationkey": I32, "c_acctbal": F64}), "pair": Tuple(I64, STRING)})
    rows = table(spark, d, "customer").select(F.struct("c_name", "c_nationkey", "c_acctbal").alias("meta"), F.struct(F.col("c_custkey").alias("_0"), F.col("c_mktsegment").alias("_1")).alias("pair"))
    found = scan.filter_table(rows, spec, {"meta.c_nationkey": {"start": 3, "end": 5}, "meta.c_acctbal": {"start": 0, "end": 1000}, "pair.0": {"start": 1, "end": 10**9}})
    return found.select(F.col("meta.c_name").alias("c_name"))


def q20(spark: SparkSession, d: str) -> DataFrame:
    spec = TableSpec({"o_orderkey": I64, "status": Enum({"F": 0, "O": 1, "P": (2, F64)})})
    tag = F.when(F.col("o_orderstatus") == "F", F.lit(0)).when(F.col("o_orderstatus") == "O", F.lit(1)).otherwise(F.lit(2)).cast("long")
    rows = table(spark, d, "orders").select("o_orderkey", F.struct(tag.alias("tag"), F.when(tag == 2, F.col("o_totalprice")).alias("variant_2")).alias("status"))
    return scan.filter_table(rows, spec, {"status": [0, 2]}).select("o_orderkey", F.col("status.tag").alias("tag"))


def q21(spark: SparkSession, d: str) -> DataFrame:
    spec = TableSpec({"event_id": I64, "raw": BYTES})
    return scan.filter_table(events(spark, d).select("event_id", F.col("event_type").cast("binary").alias("raw")), spec, {"raw": "636c69636b"}, ["event_id"])


def q22(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "orders")
    layout.write(table(spark, d, "orders"), ORDERS, path)
    query = {"o_orderstatus": ["O", "F"], "o_totalprice": {"start": 10, "end": 20000}}
    return scan.scan(spark, ORDERS, path, query, ["o_orderkey", "o_totalprice"]).select("o_orderkey", "o_totalprice")


def q23(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "counts")
    events(spark, d).repartition(1).write.parquet(f"{path}/in")
    counted = windows.window_counts(windows.stream_table(spark, EVENTS, f"{path}/in"), "ts", "event_type", "1 hour", "10 minutes")
    windows.run_to_end(counted, f"{path}/out", f"{path}/state", "append")
    return spark.read.parquet(f"{path}/out").withColumn("start_at", F.col("start_at").cast("timestamp_ntz"))


def q24(spark: SparkSession, d: str) -> DataFrame:
    """Metadata, bounds and pruning of a stored table: chunks read back from files."""
    path = scratch(spark, "events")
    layout.write(events(spark, d), EVENTS, path)
    return layout.chunk_metadata(layout.read(spark, EVENTS, path), EVENTS).select("user_id", "chunk_no", "start_at", "end_at", "n")


def q25(spark: SparkSession, d: str) -> DataFrame:
    """A typed filter, its range moved by a day."""
    week = Filter.new(EVENTS, [8, 9, 10], {"start": "2024-01-02T00:00:00Z", "end": "2024-01-09T00:00:00Z"})
    return scan.filter_table(events(spark, d), EVENTS, week.range_shift(timedelta(days=1)), ["event_id"]).select("event_id", "user_id")


def q26(spark: SparkSession, d: str) -> DataFrame:
    """Exact match on rounded floats, within half a unit of the last decimal."""
    spec = TableSpec({"event_id": I64, "value": F64}, float_round=1)
    rows = events(spark, d).select("event_id", "value").withColumns(rounding.round_columns(spec))
    return scan.filter_table(rows, spec, {"value": 12.34})


def q27(spark: SparkSession, d: str) -> DataFrame:
    """Merged timelines: spans, lengths and ends of a user's activity."""
    lines = timeline.timelines(_half_hours(spark, d), ["user_id"], "seen")
    seen = F.col("seen")
    return lines.select("user_id", F.size(seen).cast("long").alias("ranges"), timeline.span(seen).alias("span"), timeline.start(seen).alias("first"), timeline.end(seen).alias("last"))


def q28(spark: SparkSession, d: str) -> DataFrame:
    """Booleans, and a list of them."""
    spec = TableSpec({"c_custkey": I64, "rich": BOOL})
    return scan.filter_table(table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 5000).alias("rich")), spec, {"rich": [True]}, ["c_custkey"])


_ISLES = """select user_id, min(s) s, max(e) e from (select *, sum(brk) over (partition by user_id order by s, e rows unbounded preceding) isl
 from (select *, case when s <= max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end brk
 from (select user_id, epoch_us(ts) s, epoch_us(ts) + 1800000000 e from events))) group by user_id, isl"""
_CHUNKS = """select user_id, ((rn - 1) // 64)::bigint chunk_no, min(ts) start_at, max(ts) end_at, count(*) n
 from (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) group by 1, 2"""

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "q01_filter_exact_range_in": (q01, "select event_id, value from events where user_id = 8 and ts between timestamp '2024-01-02' and timestamp '2024-01-20' and event_type in ('click', 'view')"),
    "q02_project_default_fill": (q02, "select event_id, '' event_type, 0::double as value from events where user_id = 8"),
    "q03_index_only": (q03, f"select user_id from ({_CHUNKS})"),
    "q04_option_null": (q04, "select count(*) n from (select case when value > 50 then null else value end v from events) where v = 12.31"),
    "q05_float_round": (q05, "select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * 100)::bigint / 100.0::double v from lineitem"),
    "q06_time_round": (q06, "select event_id, make_timestamp((epoch_us(ts) // 60000000 + case when epoch_us(ts) % 60000000 >= 30000000 then 1 else 0 end) * 60000000) ts from events"),
    "q07_array_any": (q07, "select vec_id from embeddings where len(list_filter(embedding, lambda x: x >= 0.2::float and x <= 0.3::float)) > 0"),
    "q08_array_struct_paths": (q08, "select l_orderkey from lineitem group by 1 having bool_or(l_linenumber = 2) and bool_or(l_returnflag = 'R')"),
    "q09_map_key": (q09, "select distinct l_orderkey from lineitem where l_returnflag = 'R'"),
    "q10_chunk_metadata": (q10, _CHUNKS),
    "q11_run_collapse": (
        q11,
        """select user_id, event_type, min(ts) s, max(ts) e, count(*) n from (select *, sum(chg) over (partition by user_id order by ts, event_id) run
 from (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) is not distinct from event_type then 0 else 1 end chg from events))
 group by user_id, run, event_type""",
    ),
    "q12_bucket_islands": (
        q12,
        """select user_id, min(b) s, max(b) + 3600000000 e from (select user_id, b, sum(brk) over (partition by user_id order by b) isl
 from (select user_id, b, case when b - lag(b) over (partition by user_id order by b) <= 3600000000 then 0 else 1 end brk
 from (select distinct user_id, (epoch_us(ts) // 3600000000) * 3600000000 b from events))) group by user_id, isl""",
    ),
    "q13_interval_union": (q13, _ISLES),
    "q14_json_equal": (q14, """select event_id from events where json(props) = json('{"k": 9}')"""),
    "q15_clamp_cast": (q15, "select event_id, greatest(least(trunc(value)::bigint, 127), -128)::tinyint v from events"),
    "q16_schema_evolve": (q16, "select id, src from (select event_id id, case when event_id % 2 = 0 then '' else event_type end src from events) where src in ('', 'click')"),
    "q17_timeline_overlap": (q17, f"select distinct user_id from ({_ISLES}) where s <= 1704300000000000 and 1704200000000000 <= e"),
    "q18_timeline_points": (q18, f"select distinct user_id from ({_ISLES}) where (s <= 1704200000000000 and 1704200000000000 <= e) or (s <= 1704300000000000 and 1704300000000000 <= e)"),
    "q19_nested_path": (q19, "select c_name from customer where c_nationkey between 3 and 5 and c_acctbal between 0 and 1000 and c_custkey between 1 and 1000000000"),
    "q20_enum_tag": (q20, "select o_orderkey, (case o_orderstatus when 'F' then 0 else 2 end)::bigint tag from orders where o_orderstatus <> 'O'"),
    "q21_bytes_hex": (q21, "select event_id from events where event_type = 'click'"),
    "q22_index_prune": (q22, "select o_orderkey, o_totalprice from orders where o_orderstatus in ('O', 'F') and o_totalprice between 10 and 20000"),
    "q23_stream_window": (q23, "select event_type, time_bucket(interval 1 hour, ts) start_at, count(*) n from events group by 1, 2 having start_at + interval 1 hour <= (select max(ts) from events) - interval 10 minute"),
    "q24_stored_chunks": (q24, _CHUNKS),
    "q25_typed_filter_shift": (q25, "select event_id, user_id from events where user_id in (8, 9, 10) and ts between timestamp '2024-01-03' and timestamp '2024-01-10'"),
    "q26_rounded_tolerance": (q26, "select event_id, round(value * 10)::bigint / 10.0::double as value from events where abs(round(value * 10)::bigint / 10.0::double - 12.34) < 0.05"),
    "q27_timeline_spans": (q27, f"select user_id, count(*) ranges, max(e) - min(s) span, min(s) first, max(e) last from ({_ISLES}) group by 1"),
    "q28_bool_inclusion": (q28, "select c_custkey from customer where c_acctbal > 5000"),
    **more.CATALOG,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
