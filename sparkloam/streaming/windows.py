"""Thin Structured Streaming forms of what batch tables have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import condition
from ..spec import TableSpec


def stream_table(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, with the specification's schema."""
    return spark.readStream.schema(spec.schema()).parquet(path)


def filter_stream(stream: DataFrame, spec: TableSpec, query: dict) -> DataFrame:
    where = condition(spec, query)
    return stream if where is None else stream.where(where)


def window_counts(events: DataFrame, timestamp: str, key: str, width: str, late: str) -> DataFrame:
    """Rows per key and tumbling window of ``width``; rows later than ``late`` are left out, state is bounded by it."""
    ts = F.col(timestamp)
    ts = ts.cast("timestamp") if dict(events.dtypes)[timestamp] == "timestamp_ntz" else ts
    timed = events.withColumn("_ts", ts).withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", width), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("window.start").alias("start_at"), "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, writing Parquet."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
