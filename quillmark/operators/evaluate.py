"""Latencies, recall, rates and issue counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_percentiles(rows: DataFrame, value: str, by: str) -> DataFrame:
    pct = lambda p: F.round(F.percentile(value, p), 6)
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), pct(0.5).alias("p50"), pct(0.95).alias("p95"), pct(0.99).alias("p99"))


def self_recall(hits: DataFrame, top: int) -> DataFrame:
    """How often a query vector finds itself first, and among ``top``."""
    own = hits.groupBy("query_id").agg(F.min(F.when(F.col("query_id") == F.col("vec_id"), F.col("rank"))).alias("at"))
    rate = lambda k: F.round(F.avg(F.coalesce(F.col("at") <= k, F.lit(False)).cast("double")), 6)
    return own.agg(F.count(F.lit(1)).alias("queries"), rate(1).alias("self_at_1"), rate(top).alias("self_at_k"))


def first_delta(events: DataFrame, start: str, delta: str) -> DataFrame:
    """Seconds from a conversation's first start to its first delta."""
    at = lambda name: F.min(F.when(F.col("event_type") == name, F.col("ts").cast("timestamp")))
    g = events.groupBy("user_id").agg(at(start).alias("s"), at(delta).alias("d"), F.count(F.lit(1)).alias("n_events"))
    return g.select("user_id", "n_events", F.round((F.unix_micros("d") - F.unix_micros("s")) / 1e6, 6).alias("ttft"))


def issue_frequency(cases: DataFrame) -> DataFrame:
    """(bucket, n) of issues ``bucket: detail`` or ``bucket(detail)``."""
    return cases.select(F.split(F.split("issue", ":")[0], r"\(")[0].alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
