"""Specifications of the test tables, and where queries put what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch as scratch
from ..spec import DATETIME, F64, I64, JSON, STRING, TableSpec

EVENTS = TableSpec(
    {"event_id": I64, "ts": DATETIME, "user_id": I64, "event_type": STRING, "value": F64, "props": JSON},
    index=("user_id",), timestamp="ts", chunk_size=64, tiebreak="event_id",
)
ORDERS = TableSpec({"o_orderkey": I64, "o_orderstatus": STRING, "o_totalprice": F64, "o_orderdate": DATETIME}, index=("o_orderstatus",), timestamp="o_orderdate", tiebreak="o_orderkey")
HALF_HOUR, HOUR = 1_800_000_000, 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
