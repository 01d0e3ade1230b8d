"""Session statistics over a stream of event files: the batch aggregate, kept running."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halyard.operators import session

SCHEMA = "timestamp STRING, caller STRING, repoRoot STRING, query STRING, category STRING, tierRoute STRING, matchedSymbol STRING, matchedPath STRING, matchedLine INT, score INT, payloadTokens INT, fullFileTokensEquivalent INT, tokensSavedPct DOUBLE, latencyMs INT, timingBreakdown MAP<STRING, DOUBLE>, status STRING, backingFiles ARRAY<STRING>, details STRING"


def read_log(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Session events from NDJSON files, in the columns of the statistics; lines that aren't events are left out."""
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(SCHEMA).json(folder)
    return raw.where("status IS NOT NULL").select(F.to_timestamp("timestamp").alias("ts"), "query", "status", F.col("payloadTokens").alias("tokens"), F.col("fullFileTokensEquivalent").alias("full"), F.col("latencyMs").alias("latency"))


def append_log(events: DataFrame, folder: str) -> None:
    """Append events to an NDJSON log."""
    events.write.mode("append").json(folder)


def running(events: DataFrame) -> DataFrame:
    """The statistics so far; for output mode complete."""
    return session.stats(events)


def windowed(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The statistics of event-time windows (an extension: the batch engine has none); for output mode append."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length)).agg(*session.parts())
    return session.figures(w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in w.columns if c != "window"]), "start", "end")


def start(stats: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run statistics into a memory table of that name."""
    return stats.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
