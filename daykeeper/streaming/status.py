"""Live day status and reuse of fresh results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import CACHE_SECONDS


def live_day_status(stream: DataFrame) -> DataFrame:
    """Newest status per collector, day and replica; run it in update mode.

    ``stream``: collector, archive_date, replica, status, ts, seq (breaks ties). One row of state for each.
    """
    newest = F.struct("ts", "seq")
    return stream.groupBy("collector", "archive_date", "replica").agg(
        F.max_by("status", newest).alias("status"), F.max("ts").alias("ts")
    )


def fresh_results(results: DataFrame, now: Column, keys: list[str], seconds: int = CACHE_SECONDS) -> DataFrame:
    """The newest successful check of each key younger than ``seconds``; errors are never reused."""
    fresh = (F.col("state") == "verified") & (F.col("checked_at") > now - F.expr(f"INTERVAL {seconds} SECONDS"))
    return results.where(fresh).groupBy(*keys).agg(F.max("checked_at").alias("checked_at"))


def stale_keys(wanted: DataFrame, results: DataFrame, now: Column, keys: list[str], seconds: int = CACHE_SECONDS) -> DataFrame:
    """Keys that must be checked again."""
    return wanted.join(fresh_results(results, now, keys, seconds), keys, "left_anti")
