"""Session statistics, as one aggregate over events; the same columns serve the stream (halyard.streaming.session)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.text import js_round

#: What a whole file counts where an event doesn't say.
WHOLE_FILE = 1420


def parts() -> list[Column]:
    """The sums that all figures follow from: events need status, tokens, full, latency."""
    tokens = F.coalesce("tokens", F.lit(0))
    full = F.when(F.coalesce("full", F.lit(0)) == 0, WHOLE_FILE).otherwise(F.col("full"))
    return [
        F.count("*").alias("total"), F.count_if(F.col("status") == "hit").alias("hits"), F.count_if(F.col("status") == "junction").alias("junctions"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(F.greatest(F.lit(0), full - tokens)), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.sum(F.coalesce("latency", F.lit(0))), F.lit(0)).alias("total_latency_ms"),
    ]


def figures(sums: DataFrame, *keys: str) -> DataFrame:
    share = lambda a, b: F.when(b > 0, js_round(a / b * 1000) / 10).otherwise(0.0)
    t = F.col("total")
    return sums.select(
        *keys, "total", "hits", "junctions", (t - F.col("hits") - F.col("junctions")).alias("misses"), "total_tokens", "saved_tokens", "total_latency_ms",
        share(F.col("hits"), t).alias("hit_rate_pct"), F.when(t > 0, js_round(F.col("total_latency_ms") / t)).otherwise(0).cast("long").alias("avg_latency_ms"),
        share(F.col("saved_tokens"), F.col("total_tokens") + F.col("saved_tokens")).alias("net_savings_pct"),
    )


def stats(events: DataFrame, *keys: str) -> DataFrame:
    """Totals, hit rate, mean latency and net savings; whatever is neither hit nor junction is a miss."""
    return figures((events.groupBy(*keys) if keys else events).agg(*parts()), *keys)


def recent(events: DataFrame, n: int) -> DataFrame:
    """The last n events by time, then id: a top-n report."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
