"""Queries that run as streams over the events table, each to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.operators import cache
from bibloom.runtime import shared_dir
from bibloom.streaming import fresh


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bibloom-stream-{name}-{uuid.uuid4().hex}"


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = fresh.run_once(fresh.active_windows(_events(spark, sf), ["event_type"], "ts"), "complete", _place(spark, "counts"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest value of each user and type, from the changes that the stream told."""
    told = fresh.run_once(fresh.newest(_events(spark, sf), ["user_id", "event_type"], "ts", "value"), "update", _place(spark, "newest"))
    return cache.latest(told, ["user_id", "event_type"], "ts", "value").select("user_id", "event_type", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_daily_counts, stream_newest)}


SQL = {
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_newest": "SELECT user_id, event_type, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1, 2",
}
