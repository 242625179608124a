"""Further queries of the engine on the test tables: typed filters, containers, stored tables, sets of intervals, evolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounding, timeline
from ..functions.json import canonical_json
from ..operators.filters import BoolFilter, F64Filter, Filter, I64Filter, StringFilter, UuidFilter
from ..sources import evolve, layout, scan
from ..spec import BOOL, F64, I8, I32, I64, STRING, UUID, Enum, Map, Struct, TableSpec, Timeline, Tuple, Vec, enum_table
from .tables import EVENTS, HOUR, ORDERS, events, scratch, table

DAY = {"start": "2024-01-03T00:00:00Z", "end": "2024-01-04T00:00:00Z"}


def q29(spark: SparkSession, d: str) -> DataFrame:
    """Typed filters on floats and texts; a range of Python integers holds its last one."""
    f = Filter(EVENTS, value=F64Filter.range(10, 20.5), event_type=StringFilter.inclusion(["click", "view"]), user_id=range(1, 101))
    return scan.filter_table(events(spark, d), EVENTS, f, ["event_id"]).select("event_id")


def _uuid(name: Column) -> Column:
    h = F.md5(name.cast("string"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def q30(spark: SparkSession, d: str) -> DataFrame:
    """A typed filter on UUIDs, given in capitals and without hyphens."""
    spec = TableSpec({"event_id": I64, "id": UUID})
    f = Filter(spec, id=UuidFilter.inclusion(["A87FF679A2F3E71D9181A67B7542122C", "e4da3b7f-bbce-2345-d777-2b0674a318d5", "00000000-0000-0000-0000-000000000000"]))
    return scan.filter_table(events(spark, d).select("event_id", _uuid(F.col("event_id")).alias("id")), spec, f)


def q31(spark: SparkSession, d: str) -> DataFrame:
    """Typed filters on booleans and integers."""
    spec = TableSpec({"c_custkey": I64, "c_nationkey": I32, "poor": BOOL})
    f = Filter(spec, poor=BoolFilter.exact(True), c_nationkey=I64Filter.inclusion([1, 2, 3]))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).alias("poor"))
    return scan.filter_table(rows, spec, f, ["c_custkey"])


def q32(spark: SparkSession, d: str) -> DataFrame:
    """A filter through JSON and back, set and read by name; sets and scalars turn into filters."""
    f = Filter(EVENTS, user_id={8, 9}, event_type="click").set("ts", DAY)
    again = Filter.from_json(EVENTS, f.to_json())
    if again != f or again.get("event_type") != StringFilter.exact("click") or again["value"] is not None:
        raise AssertionError("a filter comes back from JSON as it was")
    return scan.filter_table(events(spark, d), EVENTS, again, ["event_id", "user_id"]).select("event_id", "user_id")


def q33(spark: SparkSession, d: str) -> DataFrame:
    """Floats within JSON, rounded; integers stay."""
    text = F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit(',"a":[{"v":'), (F.col("event_id") % 97).cast("string"), F.lit("."), F.lpad((F.col("event_id") * 7 % 1000).cast("string"), 3, "0"), F.lit("}]}"))
    j = canonical_json(text, 1)
    return events(spark, d).select("event_id", F.get_json_object(j, "$.a[0].v").cast("double").alias("v"), F.get_json_object(j, "$.n").cast("long").alias("n"))


def q34(spark: SparkSession, d: str) -> DataFrame:
    """Rounding in arrays, maps, tuples, options and enums; a nested struct has its own setting or none."""
    spec = TableSpec(
        {"k": I64, "n": I32, "xs": Vec(F64), "m": Map(STRING, F64), "t": Tuple(F64, I32), "own": Struct({"v": F64}, float_round=2), "bare": Struct({"v": F64}), "e": Enum({"A": 0, "B": (1, F64)})},
        float_round=1,
    )
    v = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, d, "lineitem").where("l_orderkey % 10 = 0").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.array(v, -v).alias("xs"), F.create_map(F.lit("a"), v).alias("m"), F.struct(v.alias("_0"), F.lit(1).alias("_1")).alias("t"),
        F.struct(v.alias("v")).alias("own"), F.struct(F.col("l_extendedprice").alias("v")).alias("bare"), F.struct(F.lit(1).cast("long").alias("tag"), v.alias("variant_1")).alias("e"), "l_partkey",
    )
    out = rows.withColumns(rounding.round_columns(spec))
    return out.select("k", "n", "l_partkey", F.get("xs", F.lit(1)).alias("x"), F.col("m")["a"].alias("m"), F.col("t._0").alias("t"), F.col("own.v").alias("own"), F.col("bare.v").alias("bare"), F.col("e.variant_1").alias("e"))


def _stored_events(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "events")
    layout.write(events(spark, d), EVENTS, path)
    return path


def q35(spark: SparkSession, d: str) -> DataFrame:
    """One chunk of a stored table, as a unit."""
    return layout.expand(layout.read(spark, EVENTS, _stored_events(spark, d)), EVENTS, 0, user_id=8).select("event_id", "event_type", "value")


def q36(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a time range touches, by what is stored of them: neither times nor payload are read."""
    meta = layout.chunk_metadata(layout.read(spark, EVENTS, _stored_events(spark, d)), EVENTS)
    return meta.where("start_at <= timestamp_ntz'2024-01-04' and end_at >= timestamp_ntz'2024-01-03'").select("user_id", "chunk_no", "start_at", "end_at", "n")


def q37(spark: SparkSession, d: str) -> DataFrame:
    """A time range over a stored table, skipped by the bounds of chunks, which come with the timestamp."""
    return scan.scan(spark, EVENTS, _stored_events(spark, d), {"ts": DAY}, ["event_id", "ts"]).select("event_id", "ts", "start_at", "end_at")


def q38(spark: SparkSession, d: str) -> DataFrame:
    """An empty text as an index value, by directory and by ranges of the key."""
    rows = table(spark, d, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(F.lit("")))
    out = []
    for by_directory in (True, False):
        path = scratch(spark, "orders")
        layout.write(rows, ORDERS, path, by_directory=by_directory)
        out.append(scan.scan(spark, ORDERS, path, {"o_orderstatus": ""}, ["o_orderkey"]).select("o_orderkey", "o_orderstatus"))
    return out[0].unionByName(out[1])


def q39(spark: SparkSession, d: str) -> DataFrame:
    """A table of one enum with payloads: written, read and filtered by tag."""
    spec = enum_table(Enum({"Click": (0, F64), "View": (1, F64), "Other": 5}))
    tag = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(5).cast("long")
    value = F.struct(tag.alias("tag"), F.when(tag == 0, F.col("value")).alias("variant_0"), F.when(tag == 1, F.col("value")).alias("variant_1"))
    path = scratch(spark, "enum")
    layout.write(events(spark, d).select(value.alias("value")), spec, path)
    return scan.scan(spark, spec, path, {"": [0, 5]}).select("value.tag", "value.variant_0")


def _ranges(*ends: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(a.alias("s"), b.alias("e")) for a, b in ends])


def q40(spark: SparkSession, d: str) -> DataFrame:
    """Sets of intervals, extended and merged, and the points and ranges that they hold."""
    us, x = rounding.to_micros(F.col("ts")), F.col("event_id") % 7000
    line = timeline.extend(timeline.interval(us, us + 1000), _ranges((us + 1001, us + 2000), (us + 5000, us + 6000), (us + 9, us + 3)))
    both = timeline.merge(line, timeline.interval(us + x, us + x + 100))
    return events(spark, d).select(
        "event_id", F.size(line).cast("long").alias("n"), timeline.end(line).alias("last"), timeline.contains(line, us + x).alias("has"),
        timeline.overlaps(line, us + x, us + x + 100).alias("hits"), timeline.length(both).cast("long").alias("merged"), timeline.is_empty(line).alias("none"),
    )


def q41(spark: SparkSession, d: str) -> DataFrame:
    """Merging sets of buckets as it is, and as the stored form has it, in the bucket of the start."""
    us = rounding.to_micros(F.col("ts"))
    a, b = timeline.interval(us, us, HOUR), _ranges((us + 5 * HOUR, us + 7 * HOUR))
    grown = timeline.add(a, us + HOUR, us + HOUR, HOUR)
    return events(spark, d).select(
        "event_id", timeline.end(timeline.merge(a, b, HOUR)).alias("last"), timeline.end(timeline.merge(a, b, HOUR, compat=True)).alias("last_compat"), F.size(grown).cast("long").alias("n"), timeline.span(grown).alias("span"),
    )


def q42(spark: SparkSession, d: str) -> DataFrame:
    """Fields removed and put in another order; a field becomes the tiebreak."""
    old = TableSpec({"event_id": I64, "user_id": I64, "event_type": STRING, "value": F64}, index=("user_id",))
    new = TableSpec({"value": F64, "user_id": I64, "event_id": I64}, index=("user_id",), tiebreak="event_id")
    return evolve.evolve(events(spark, d), old, new)


def q43(spark: SparkSession, d: str) -> DataFrame:
    """Numbers clamped within arrays, maps and tuples, a tuple with a new tail, an enum without one of its variants."""
    old = TableSpec({"id": I64, "xs": Vec(I64), "m": Map(STRING, I64), "t": Tuple(I64, STRING), "e": Enum({"A": 0, "B": 1, "C": 2})})
    new = TableSpec({"id": I64, "xs": Vec(I8), "m": Map(STRING, I8), "t": Tuple(I8, STRING, I32), "e": Enum({"A": 0, "B": 1})})
    i = F.col("event_id")
    rows = events(spark, d).select(
        i.alias("id"), F.array(i, -i).alias("xs"), F.create_map(F.lit("a"), i).alias("m"), F.struct(i.alias("_0"), F.col("event_type").alias("_1")).alias("t"), (i % 3).alias("e")
    )
    out = evolve.evolve(rows, old, new)
    return out.select("id", F.get("xs", F.lit(1)).cast("long").alias("x"), F.col("m")["a"].cast("long").alias("m"), F.col("t._0").cast("long").alias("t0"), F.col("t._1").alias("t1"), F.col("t._2").cast("long").alias("t2"), "e")


def q44(spark: SparkSession, d: str) -> DataFrame:
    """A field stored rounded, read as an integer."""
    old, new = TableSpec({"event_id": I64, "value": F64}, float_round=1), TableSpec({"event_id": I64, "value": I64})
    path = scratch(spark, "rounded")
    layout.write(events(spark, d).select("event_id", "value"), old, path)
    return evolve.read_versions(spark, new, [(old, path)]).withColumnRenamed("value", "v")


def q45(spark: SparkSession, d: str) -> DataFrame:
    """A struct by its bare name means its first field where old queries are to be kept."""
    spec = TableSpec({"c_custkey": I64, "meta": Struct({"nation": I32, "name": STRING})})
    rows = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")).alias("meta"))
    return scan.filter_table(rows, spec, {"meta": [3, 4]}, ["c_custkey"], compat=True)


def q46(spark: SparkSession, d: str) -> DataFrame:
    """Fields that queries and requests touch, and requests that are refused."""
    cases = [({}, []), ({"value": 1.0}, ["event_id"]), ({"user_id": 1}, ["end_at"]), ({"ts": DAY}, ["props"]), ({}, ["props.k"]), ({"no": 1}, [])]
    rows = []
    for k, (query, fields) in enumerate(cases):
        try:
            rows.append((k, ",".join(scan.resolve_fields(EVENTS, query, fields))))
        except ValueError:
            rows.append((k, "refused"))
    return spark.createDataFrame(rows, "k long, fields string")


def q47(spark: SparkSession, d: str) -> DataFrame:
    """Default fill leaves what the query names as it is, asked for or not."""
    return scan.filter_table(events(spark, d), EVENTS, {"value": {"start": 10, "end": 20}}, ["event_type"], default_fill=True).select("user_id", "event_id", "event_type", "value", "props")


def q48(spark: SparkSession, d: str) -> DataFrame:
    """Rows that differ in the tiebreak only aren't joined; its values all stay."""
    us = rounding.to_micros(F.col("ts"))
    spec = TableSpec({"user_id": I64, "seen": Timeline(), "half": I64}, index=("user_id",), timestamp="seen", tiebreak="half")
    rows = events(spark, d).select("user_id", timeline.interval(us - us % HOUR, us - us % HOUR).alias("seen"), (F.col("event_id") % 2).alias("half"))
    return timeline.collapse_runs(rows, spec).select("user_id", "half", F.size("seen").cast("long").alias("n"), timeline.start(F.col("seen")).alias("s"))


_R1 = "round({x} * 10)::bigint / 10.0::double"
_CHUNK_ROWS = """select *, min(ts) over c start_at, max(ts) over c end_at, count(*) over c n from
 (select *, ((row_number() over (partition by user_id order by ts, event_id) - 1) // 64)::bigint chunk_no from events) window c as (partition by user_id, chunk_no)"""
_V = "l_extendedprice * (1 - l_discount)"

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "q29_typed_floats_texts": (q29, "select event_id from events where value between 10 and 20.5 and event_type in ('click', 'view') and user_id between 1 and 100"),
    "q30_typed_uuid": (q30, "select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) id from (select event_id, md5(event_id::varchar) h from events) where h in ('a87ff679a2f3e71d9181a67b7542122c', 'e4da3b7fbbce2345d7772b0674a318d5')"),
    "q31_typed_bool_int": (q31, "select c_custkey from customer where c_acctbal < 0 and c_nationkey in (1, 2, 3)"),
    "q32_filter_to_json": (q32, "select event_id, user_id from events where user_id in (8, 9) and event_type = 'click' and ts between timestamp '2024-01-03' and timestamp '2024-01-04'"),
    "q33_round_json": (q33, f"select event_id, {_R1.format(x='v')} v, event_id n from (select event_id, ((event_id % 97)::varchar || '.' || lpad((event_id * 7 % 1000)::varchar, 3, '0'))::double v from events)"),
    "q34_round_containers": (q34, f"select l_orderkey k, l_linenumber n, l_partkey, {_R1.format(x=f'(-({_V}))')} x, {_R1.format(x=f'({_V})')} m, {_R1.format(x=f'({_V})')} t, round(({_V}) * 100)::bigint / 100.0::double own, l_extendedprice bare, {_R1.format(x=f'({_V})')} e from lineitem where l_orderkey % 10 = 0"),
    "q35_one_chunk": (q35, f"select event_id, event_type, value from ({_CHUNK_ROWS}) where user_id = 8 and chunk_no = 0"),
    "q36_chunks_of_range": (q36, f"select distinct user_id, chunk_no, start_at, end_at, n from ({_CHUNK_ROWS}) where start_at <= timestamp '2024-01-04' and end_at >= timestamp '2024-01-03'"),
    "q37_range_by_bounds": (q37, f"select event_id, ts, start_at, end_at from ({_CHUNK_ROWS}) where ts between timestamp '2024-01-03' and timestamp '2024-01-04'"),
    "q38_empty_index": (q38, "select o_orderkey, '' o_orderstatus from orders, range(2) where o_orderstatus = 'P'"),
    "q39_enum_table": (q39, "select (case event_type when 'click' then 0 else 5 end)::bigint tag, case event_type when 'click' then value end variant_0 from events where event_type <> 'view'"),
    "q40_sets_of_intervals": (
        q40,
        """select event_id, 2::bigint n, us + 6000 as last, x <= 2000 or x between 5000 and 6000 has, x <= 2000 or x between 4900 and 6000 hits,
 (case when x <= 2001 or x between 4899 and 6001 then 2 else 3 end)::bigint merged, false as none from (select event_id, epoch_us(ts) us, event_id % 7000 x from events)""",
    ),
    "q41_merge_buckets": (q41, "select event_id, us + 25200000000 as last, us // 3600000000 * 3600000000 + 21600000000 last_compat, 1::bigint n, 7200000000::bigint span from (select event_id, epoch_us(ts) us from events)"),
    "q42_fewer_fields": (q42, "select value, user_id, event_id from events"),
    "q43_evolve_containers": (q43, "select event_id id, greatest(-event_id, -128) x, least(event_id, 127) m, least(event_id, 127) t0, event_type t1, 0::bigint t2, case event_id % 3 when 2 then 0 else event_id % 3 end e from events"),
    "q44_rounded_to_integer": (q44, f"select event_id, trunc({_R1.format(x='value')})::bigint v from events"),
    "q45_struct_bare_name": (q45, "select c_custkey from customer where c_nationkey in (3, 4)"),
    "q46_resolve_fields": (
        q46,
        """select * from (values (0::bigint, 'event_id,ts,user_id,event_type,value,props,start_at,end_at'), (1, 'event_id,value'), (2, 'user_id,end_at'),
 (3, 'ts,props,start_at,end_at'), (4, 'refused'), (5, 'refused')) v(k, fields)""",
    ),
    "q47_default_fill_queried": (q47, "select user_id, 0::bigint event_id, event_type, value, 'null' props from events where value between 10 and 20"),
    "q48_tiebreak_stays": (
        q48,
        """select user_id, half, count(distinct h) n, min(h) s from (select *, sum(chg) over (partition by user_id order by h, half rows unbounded preceding) run from
 (select *, case when lag(half) over (partition by user_id order by h, half) is not distinct from half then 0 else 1 end chg from
 (select user_id, epoch_us(ts) // 3600000000 * 3600000000 h, event_id % 2 half from events))) group by user_id, half, run""",
    ),
}
