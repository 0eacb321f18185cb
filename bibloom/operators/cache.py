"""Answers kept for reuse: the newest per key, within an age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """The newest row of each key (of equals the one with the greatest ``tie``), by partial aggregation instead of a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(stamp, tie)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def lookup_fresh(requests: DataFrame, rows: DataFrame, keys: list[str], stamp: str, tie: str, now: Column, max_age_days: int) -> DataFrame:
    """Requests with ``hit`` and the kept answer's columns; an answer counts only if its stamp can be read and is young enough.

    An age of 0 or less turns reuse off. The answer keeps its own stamp.
    """
    if max_age_days <= 0:
        fresh = rows.limit(0)
    else:
        fresh = rows.filter(F.col(stamp).isNotNull() & (F.col(stamp) >= now - F.make_interval(days=F.lit(max_age_days))))
    best = latest(fresh, keys, stamp, tie).withColumn("hit", F.lit(True))
    return requests.join(best, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def reusable_counts(requests: DataFrame, rows: DataFrame, keys: list[str], stamp: str, tie: str, now: Column, max_age_days: int, count: str = "citation_count") -> DataFrame:
    """lookup_fresh() over answers that have a count: a failure isn't kept, it is asked again."""
    return lookup_fresh(requests, rows.filter(F.col(count).isNotNull()), keys, stamp, tie, now, max_age_days)


def reusable_risk(requests: DataFrame, rows: DataFrame, keys: list[str], stamp: str, tie: str, now: Column, max_age_days: int, sources: str = "sources") -> DataFrame:
    """lookup_fresh() over answers that at least one source gave."""
    return lookup_fresh(requests, rows.filter(F.size(sources) > 0), keys, stamp, tie, now, max_age_days)


def upsert(kept: DataFrame, new: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """The kept table with new answers put in: per key the newest."""
    return latest(kept.unionByName(new), keys, stamp, tie)


def expire(rows: DataFrame, stamp: str, status: str, now: Column, days: int = 90, failed: str = "all_sources_failed") -> DataFrame:
    """The table without failures older than ``days``; everything else stays."""
    old = (F.col(status) == failed) & (F.col(stamp) < now - F.make_interval(days=F.lit(days)))
    return rows.filter(~F.coalesce(old, F.lit(False)))


def stats(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
