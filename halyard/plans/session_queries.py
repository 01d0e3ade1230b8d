"""Queries over session events, searches and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import evaluate as E
from halyard.operators import session as S
from halyard.sources import corpus as C

NEEDLES = ["The", "und der", "éa", "zzzz", "  ", "Licensed"]


def session_stats(spark: SparkSession, folder: str) -> DataFrame:
    return S.stats(C.session_events(spark, folder))


def session_stats_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return S.stats(C.session_events(spark, folder), "user_id")


def recent_events(spark: SparkSession, folder: str) -> DataFrame:
    return S.recent(C.session_events(spark, folder), 25).select("event_id", "status", "tokens", "latency")


def _needles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in NEEDLES], "query string")


def baseline_grep(spark: SparkSession, folder: str) -> DataFrame:
    return E.baseline(C.lines(spark, folder), _needles(spark))


def baseline_compare(spark: SparkSession, folder: str) -> DataFrame:
    b = baseline_grep(spark, folder)
    own = b.select("query", (F.length("query") * 3 % 7).alias("ms"), F.lit(5).alias("matches"), F.lit(120).alias("tokens"), (F.length("query") * 11).alias("base_ms"), F.col("total_matches").alias("base_matches"), F.col("estimated_tokens").alias("base_tokens"))
    return E.comparison(own)


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    drift = F.element_at(F.array(*[F.lit(x) for x in ("VERIFIED_EXACT", "VERIFIED_DRIFTED", "STALE_OR_MODIFIED", None)]), (F.col("event_id") % 4 + 1).cast("int"))
    got = E.routing_matches(F.col("status"), F.when(F.col("event_id") % 3 == 0, "hit"))
    return C.session_events(spark, folder).select(got.alias("passed"), drift.alias("drift"), F.col("latency").alias("duration_ms"), F.when(F.col("tokens") % 2 == 0, F.col("tokens") / 128).alias("noise_ratio"), (F.col("tokens") - 30).alias("savings_pct"))


def eval_scoreboard(spark: SparkSession, folder: str) -> DataFrame:
    return E.scoreboard(_reports(spark, folder))


def latency_ranks(spark: SparkSession, folder: str) -> DataFrame:
    ev = C.session_events(spark, folder)
    mid = E.at_rank(ev, "status", "latency", 0.5).withColumnRenamed("value", "median")
    return mid.join(E.at_rank(ev, "status", "latency", 0.95).withColumnRenamed("value", "p95"), "status")


def architecture_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Files, lines and words per language and source."""
    n = C.lines(spark, folder).groupBy("path", "language").agg(F.count("*").alias("lines"), F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("symbols"))
    return n.select("path", "language", "lines", "symbols")


def architecture_totals(spark: SparkSession, folder: str) -> DataFrame:
    a = architecture_summary(spark, folder)
    return a.groupBy("language").agg(F.count("*").alias("total_files"), F.sum("lines").alias("total_lines"), F.sum("symbols").alias("total_symbols"))


def _stats_sql(key: str = "") -> str:
    return f"""WITH {C.EVENTS_SQL}, s AS (SELECT {key and key + ','} count(*) total, count(*) FILTER (status = 'hit') hits, count(*) FILTER (status = 'junction') junctions, CAST(sum(coalesce(tokens, 0)) AS BIGINT) total_tokens,
 CAST(sum(greatest(0, CASE WHEN coalesce("full", 0) = 0 THEN 1420 ELSE "full" END - coalesce(tokens, 0))) AS BIGINT) saved_tokens, CAST(sum(coalesce(latency, 0)) AS BIGINT) total_latency_ms FROM session {key and 'GROUP BY ' + key})
SELECT {key and key + ','} total, hits, junctions, total - hits - junctions AS misses, total_tokens, saved_tokens, total_latency_ms, CASE WHEN total > 0 THEN floor(hits / total * 1000 + 0.5) / 10 ELSE 0.0 END AS hit_rate_pct,
 CAST(CASE WHEN total > 0 THEN floor(total_latency_ms / total + 0.5) ELSE 0 END AS BIGINT) AS avg_latency_ms, CASE WHEN total_tokens + saved_tokens > 0 THEN floor(saved_tokens / (total_tokens + saved_tokens) * 1000 + 0.5) / 10 ELSE 0.0 END AS net_savings_pct FROM s"""


_BASE = f"""WITH {C.LINES_SQL}, q AS (SELECT unnest({NEEDLES}) AS query), b AS (SELECT query, count(path) AS total_matches, count(DISTINCT path) AS files, CAST(ceil(coalesce(sum(length(text)), 0) / 4) AS BIGINT) AS estimated_tokens FROM q LEFT JOIN lines ON contains(lower(text), lower(query)) GROUP BY query)"""
_WORDS = "len(list_filter(string_split(text, ' '), lambda w: w != ''))"
ORACLES = {
    "session_stats": _stats_sql(),
    "session_stats_by_user": _stats_sql("user_id"),
    "recent_events": f"WITH {C.EVENTS_SQL} SELECT event_id, status, tokens, latency FROM session ORDER BY ts DESC, event_id DESC LIMIT 25",
    "baseline_grep": _BASE + " SELECT query, total_matches, files, estimated_tokens FROM b",
    "baseline_compare": _BASE + """ SELECT query, CASE WHEN ms > 0 THEN floor(length(query) * 11 / ms * 100 + 0.5) / 100 ELSE 1.0 END AS speedup_factor, CASE WHEN total_matches > 5 THEN floor((total_matches - 5) / total_matches * 1000 + 0.5) / 1000 ELSE 0.0 END AS noise_reduction_ratio,
  CASE WHEN estimated_tokens > 120 THEN floor((estimated_tokens - 120) / estimated_tokens * 1000 + 0.5) / 1000 ELSE 0.0 END AS token_savings_pct FROM (SELECT *, length(query) * 3 % 7 ms FROM b)""",
    "eval_scoreboard": f"""WITH {C.EVENTS_SQL}, r AS (SELECT CASE WHEN event_id % 3 = 0 THEN status = 'hit' ELSE true END passed, event_id % 4 d, latency, CASE WHEN tokens % 2 = 0 THEN tokens / 128 END noise, tokens - 30 sav FROM session)
 SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (d = 0) AS verified_exact, count(*) FILTER (d = 1) AS verified_drifted, count(*) FILTER (d = 2) AS stale_or_modified, count(*) FILTER (d = 3) AS na,
 coalesce(floor(avg(latency) * 10 + 0.5) / 10, 0.0) AS average_duration_ms, coalesce(floor(avg(noise * 100) * 10 + 0.5) / 10, 0.0) AS average_noise_reduction_pct, coalesce(floor(avg(sav) FILTER (sav > 0) * 10 + 0.5) / 10, 0.0) AS average_token_savings_pct FROM r""",
    "latency_ranks": f"""WITH {C.EVENTS_SQL}, s AS (SELECT status, list_sort(list(latency)) l FROM session GROUP BY status) SELECT status, l[CAST(least(floor(len(l) * 0.5), len(l) - 1) AS BIGINT) + 1] AS median, l[CAST(least(floor(len(l) * 0.95), len(l) - 1) AS BIGINT) + 1] AS p95 FROM s""",
    "architecture_summary": f"WITH {C.LINES_SQL} SELECT path, language, count(*) AS lines, CAST(sum({_WORDS}) AS BIGINT) AS symbols FROM lines GROUP BY path, language",
    "architecture_totals": f"WITH {C.LINES_SQL}, a AS (SELECT path, language, count(*) n, sum({_WORDS}) s FROM lines GROUP BY path, language) SELECT language, count(*) AS total_files, CAST(sum(n) AS BIGINT) AS total_lines, CAST(sum(s) AS BIGINT) AS total_symbols FROM a GROUP BY language",
}
QUERIES = {"session_stats": session_stats, "session_stats_by_user": session_stats_by_user, "recent_events": recent_events, "baseline_grep": baseline_grep, "baseline_compare": baseline_compare, "eval_scoreboard": eval_scoreboard, "latency_ranks": latency_ranks, "architecture_summary": architecture_summary, "architecture_totals": architecture_totals}
