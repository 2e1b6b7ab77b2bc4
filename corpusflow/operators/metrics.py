"""Service metrics over a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.options import DEFAULTS


def query_metrics(log: DataFrame, window: int = DEFAULTS.metrics_window) -> DataFrame:
    """One row of metrics. ``log``: seq, duration, is_error, cache_hit; seq orders the log.

    Times cover the last ``window`` entries, a bounded top-k; totals and rates
    cover everything. Percentiles are the value at index floor(n * p), without
    interpolation.
    """
    totals = log.agg(
        F.count("*").alias("total_queries"),
        F.count_if("is_error").alias("errors"),
        F.count_if("cache_hit").alias("hits"),
        F.count("cache_hit").alias("looked_up"),
    )
    recent = log.select("seq", "duration").orderBy(F.desc("seq")).limit(window).agg(
        F.array_sort(F.collect_list("duration"))
    )
    n = F.size("times")

    def at(p: float):
        return F.coalesce(F.get("times", F.floor(n * p).cast("int")), F.lit(0.0))

    def percent(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(0.0)

    mean = F.when(n > 0, F.aggregate("times", F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return totals.withColumn("times", recent.scalar()).select(
        "total_queries",
        mean.alias("avg_response_time"),
        at(0.95).alias("p95_response_time"),
        at(0.99).alias("p99_response_time"),
        percent("errors", "total_queries").alias("error_rate"),
        percent("hits", "looked_up").alias("cache_hit_rate"),
    )
