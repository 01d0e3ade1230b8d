"""Queries over charted notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import text as T
from halyard.operators import memory as M
from halyard.sources import corpus as C


def _fresh(spark: SparkSession, folder: str) -> DataFrame:
    return M.freshness(C.entries(spark, folder), C.entry_files(spark, folder), C.stored(spark, folder))


def memory_freshness(spark: SparkSession, folder: str) -> DataFrame:
    return _fresh(spark, folder).select("id", "n_files", F.array_join("missing", ",").alias("missing"), F.array_join("stale", ",").alias("stale"), "fresh")


def memory_prune(spark: SparkSession, folder: str) -> DataFrame:
    return M.prune(C.entries(spark, folder), C.entry_files(spark, folder), C.stored(spark, folder))


def memory_bust(spark: SparkSession, folder: str) -> DataFrame:
    changed = C.table(spark, folder, "labels").where("toxic = 1").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"))
    return M.bust(C.entries(spark, folder), C.entry_files(spark, folder), changed)


def memory_unchart(spark: SparkSession, folder: str) -> DataFrame:
    ids = C.table(spark, folder, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return M.unchart(C.entries(spark, folder), ids)


def memory_chart(spark: SparkSession, folder: str) -> DataFrame:
    new = spark.createDataFrame([(1_000_000, "2030-01-01 00:00:00", "[FACET:LIFECYCLE] how does it start", "by itself"), (1_000_001, "2030-01-02 00:00:00", "a plain note", "text")], "id long, at string, question string, details string")
    return M.chart(C.entries(spark, folder), new)


def memory_exact(spark: SparkSession, folder: str) -> DataFrame:
    e = C.entries(spark, folder)
    q = e.select(F.col("id").alias("qid"), F.concat(F.lit("  "), F.translate("question", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("?! ")).alias("question"))
    return M.exact(q, e, _fresh(spark, folder))


def memory_bm25(spark: SparkSession, folder: str) -> DataFrame:
    q = C.table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    d = C.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return M.bm25(q, d)


def facet_map(spark: SparkSession, folder: str) -> DataFrame:
    return M.facet_map(C.entries(spark, folder), _fresh(spark, folder), C.FACET_IDS).select("facet", "status", "id")


def facet_status(spark: SparkSession, folder: str) -> DataFrame:
    return M.facet_summary(M.facet_map(C.entries(spark, folder), _fresh(spark, folder), C.FACET_IDS))


_STOP = "(" + ", ".join(f"'{w}'" for w in T.MEMORY_STOP) + ")"
_TERMS = r"list_filter(regexp_extract_all(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '([\p{{L}}\p{{N}}_]+)', 1), lambda w: length(w) > 1 AND w NOT IN " + _STOP + ")"
_FRESH = f"""WITH {C.ENTRIES_SQL}, fr AS (SELECT e.id, count(f.file) n_files, coalesce(string_agg(f.file, ',' ORDER BY f.file) FILTER (f.file IS NOT NULL AND s.file IS NULL), '') missing,
  coalesce(string_agg(f.file, ',' ORDER BY f.file) FILTER (s.file IS NOT NULL AND regexp_full_match(f.sha256, '[0-9a-f]{{64}}') AND f.sha256 != s.sha256), '') stale
  FROM entries e LEFT JOIN entry_files f ON e.id = f.id LEFT JOIN stored s ON f.file = s.file GROUP BY e.id), fresh AS (SELECT *, missing = '' AND stale = '' fresh FROM fr)"""
_FACETS = _FRESH + f""", dim AS (SELECT unnest({C.FACET_IDS}) facet, unnest(range(5)) k), hit AS (SELECT facet, k, e.id, details, fresh, n_files, row_number() OVER (PARTITION BY facet ORDER BY "at" DESC, e.id) rn
  FROM dim JOIN entries e ON contains(upper(question), '[FACET:' || upper(facet) || ']') JOIN fresh USING (id)),
 fm AS (SELECT facet, k, CASE WHEN h.id IS NULL THEN 'missing' WHEN NOT fresh OR n_files = 0 THEN 'drifted' WHEN regexp_matches(trim(details), '(?im)^\\s*status\\s*:\\s*["'']?not_applicable["'']?\\s*$') OR regexp_matches(trim(details), '(?i)^\\[?not_applicable\\]?(\\s*$|\\s*[:\\-—.]|\\s+-\\s)') THEN 'not_applicable' ELSE 'active' END AS status, h.id AS id
  FROM dim LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h USING (facet, k))"""
ORACLES = {
    "memory_freshness": _FRESH + " SELECT id, n_files, missing, stale, fresh FROM fresh",
    "memory_prune": _FRESH + ' SELECT id, "at", question, details FROM entries JOIN fresh USING (id) WHERE fresh',
    "memory_bust": f"""WITH {C.ENTRIES_SQL} SELECT id, "at", question, details FROM entries WHERE id NOT IN (SELECT id FROM entry_files WHERE file IN (SELECT 'doc/' || doc_id FROM labels WHERE toxic = 1))""",
    "memory_unchart": f"""WITH {C.ENTRIES_SQL} SELECT id, "at", question, details FROM entries WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
    "memory_chart": f"""WITH {C.ENTRIES_SQL} SELECT id, "at", question, details FROM entries WHERE upper(regexp_extract(question, '(\\[[Ff][Aa][Cc][Ee][Tt]:[A-Za-z_]+\\])', 1)) != '[FACET:LIFECYCLE]'
 UNION ALL SELECT 1000000, '2030-01-01 00:00:00', '[FACET:LIFECYCLE] how does it start', 'by itself' UNION ALL SELECT 1000001, '2030-01-02 00:00:00', 'a plain note', 'text'""",
    "memory_exact": _FRESH + """, q AS (SELECT id qid, regexp_replace(lower(trim('  ' || translate(question, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '?! ')), '[?.,!]+$', '') key FROM entries), e AS (SELECT id, "at", regexp_replace(lower(question), '[?.,!]+$', '') key FROM entries JOIN fresh USING (id) WHERE fresh),
 r AS (SELECT qid, e.id, row_number() OVER (PARTITION BY qid ORDER BY "at" DESC, e.id) rn FROM q JOIN e USING (key)) SELECT qid, id, 100 AS score FROM r WHERE rn = 1""",
    "memory_bm25": f"""WITH d AS (SELECT doc_id id, {_TERMS.format(x='text')} t FROM documents), st AS (SELECT count(*) n, avg(len(t)) mean FROM d), q AS (SELECT DISTINCT item_id qid, unnest({_TERMS.format(x='text')}) term FROM benchmark),
 tf AS (SELECT term, id, len, count(*) tf FROM (SELECT id, len(t) len, unnest(t) term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf GROUP BY term),
 s AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))), 6) score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY qid, id),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid, id, rank, score FROM r WHERE rank <= 5""",
    "facet_map": _FACETS + " SELECT facet, status, id FROM fm",
    "facet_status": _FACETS + """ SELECT CASE WHEN count(*) FILTER (status = 'drifted') > 0 THEN 'drifted' WHEN count(*) FILTER (status IN ('active', 'not_applicable')) = 5 THEN 'healthy' WHEN count(*) FILTER (status IN ('active', 'not_applicable')) = 0 THEN 'empty' ELSE 'incomplete' END AS status,
 count(*) FILTER (status IN ('active', 'not_applicable')) || '/5' AS completion, count(*) FILTER (status IN ('active', 'not_applicable')) AS active_count, CAST(floor(count(*) FILTER (status IN ('active', 'not_applicable')) * 20 + 0.5) AS BIGINT) AS percentage,
 coalesce(string_agg(facet, ',' ORDER BY k) FILTER (status = 'missing'), '') AS missing, coalesce(string_agg(facet, ',' ORDER BY k) FILTER (status = 'drifted'), '') AS drifted FROM fm""",
}
QUERIES = {"memory_freshness": memory_freshness, "memory_prune": memory_prune, "memory_bust": memory_bust, "memory_unchart": memory_unchart, "memory_chart": memory_chart, "memory_exact": memory_exact, "memory_bm25": memory_bm25, "facet_map": facet_map, "facet_status": facet_status}
