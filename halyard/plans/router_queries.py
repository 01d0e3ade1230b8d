"""Queries that need Python functions or run many stages; tests check them against brute force and goldens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import fuzzy, integrity, router
from halyard.plans.cut import spread
from halyard.sources import corpus as C


def fuzzy_rank(spark: SparkSession, folder: str) -> DataFrame:
    syms = C.symbols(spark, folder)
    names = syms.select("name").distinct()
    forms = F.array(F.col("name"), F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)")), F.replace("name", F.lit("_"), F.lit("")), F.lower("name"))
    return fuzzy.rank(names.select(F.explode(forms).alias("token")), syms)


def batch(spark: SparkSession, folder: str) -> DataFrame:
    """qid, question: user turns, templates over symbols of both tiers, paths, and notes' own questions."""
    conv = spread(C.table(spark, folder, "conversations").where("role = 'user'")).select(F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("qid"), F.regexp_replace("text", r"\s+", " ").alias("question"))
    names = spread(C.symbols(spark, folder).select("qualified").distinct(), "qualified")
    forms = ["Who calls {}?", "Where is {} declared?", "How does {} work?", "is there a {}x in it", "lookup"]
    parts = F.array(*[F.regexp_replace(F.lit(f), r"\{\}", F.col("qualified")) for f in forms])
    made = names.select("qualified", F.posexplode(parts).alias("k", "question")).select(F.concat_ws(":", F.lit("s"), "qualified", "k").alias("qid"), "question")
    f = C.files(spark, folder)
    path = C.path_questions(f).select(F.concat(F.lit("p:"), F.col("qid").cast("string")).alias("qid"), "question")
    note = C.entries(spark, folder).select(F.concat(F.lit("n:"), F.col("id").cast("string")).alias("qid"), F.concat("question", F.lit("?")).alias("question"))
    return conv.union(made).union(path).union(note)


def route_batch(spark: SparkSession, folder: str) -> DataFrame:
    syms = C.symbols(spark, folder)
    return router.route(batch(spark, folder), C.files(spark, folder), syms, C.entries(spark, folder), C.entry_files(spark, folder), C.stored(spark, folder))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return C.table(spark, folder, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")


def span_anchor(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder)
    n = F.size(integrity.lines_of(F.col("text")))
    r = d.select("path", F.explode(F.array(F.struct(F.lit(1).alias("s"), F.least(n, F.lit(3)).alias("e")), F.struct(n.alias("s"), n.alias("e")), F.struct(F.lit(1).alias("s"), (n + 1).alias("e")))).alias("r"))
    a = integrity.anchor(d, r.select("path", F.col("r.s").alias("start"), F.col("r.e").alias("end")))
    sig = F.col("signature")
    return a.select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "error", "file_sha256", "span_hash", "span_len", F.col("span_lines").cast("long").alias("span_lines"), sig["first_hash"].alias("first_hash"), sig["last_hash"].alias("last_hash"))


def span_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of the documents' first lines, verified against texts that have since gained a line, lost one or changed."""
    d = _documents(spark, folder).dropDuplicates(["path"])
    r = d.select("path", F.lit(1).alias("start"), F.least(F.size(integrity.lines_of(F.col("text"))), F.lit(2)).alias("end"))
    a = integrity.anchor(d, r).drop("error")
    k = F.length("text") % 5
    now = d.select("path", F.when(k == 0, F.concat(F.lit("new\n"), F.col("text"))).when(k == 1, F.regexp_replace("text", r"^[^\n]*\n?", "")).when(k == 2, F.concat(F.lit("x\n"), F.col("text"), F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("text"), k.alias("k")).where("k != 4").drop("k")
    return integrity.verify(a, now).select("path", "status", "reason", "new_start")


ORACLES = {
    "span_anchor": rf"""WITH d AS (SELECT 'doc/' || doc_id AS path, text, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) ls FROM documents),
 r AS (SELECT path, text, ls, len(ls) n, unnest([1, len(ls), 1]) s, unnest([least(len(ls), 3), len(ls), len(ls) + 1]) e FROM d), b AS (SELECT *, CASE WHEN e > n THEN 'INVALID_RANGE' END error, list_transform(ls[s:e], lambda x: regexp_replace(x, '[ \t]+$', '')) cut FROM r),
 c AS (SELECT *, list_filter(range(1, len(cut) + 1), lambda i: regexp_matches(cut[i], '\S')) f FROM b), t AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN len(f) = 0 THEN '' ELSE array_to_string(cut[f[1]:f[-1]], chr(10)) END END sp FROM c)
 SELECT path, s AS "start", e AS "end", error, CASE WHEN error IS NULL THEN sha256(text) END AS file_sha256, sha256(sp) AS span_hash, CAST(strlen(sp) AS BIGINT) AS span_len, CASE WHEN error IS NULL THEN e - s + 1 END AS span_lines,
  CASE WHEN error IS NULL THEN sha256(CASE WHEN len(f) = 0 THEN '' ELSE cut[f[1]] END) END AS first_hash, CASE WHEN error IS NULL THEN sha256(CASE WHEN len(f) = 0 THEN '' ELSE cut[f[-1]] END) END AS last_hash FROM t""",
}
QUERIES = {"fuzzy_rank": fuzzy_rank, "route_batch": route_batch, "span_anchor": span_anchor, "span_verify": span_verify}
