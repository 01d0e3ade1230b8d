"""The engine's tables, made of a folder of parquet tables: files, lines, symbols, edges, entries, questions, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, ord (walk order), lower_path, base: one row a path."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    p = table(spark, folder, "pages").select(path.alias("path"), F.col("page_id").alias("ord")).groupBy("path").agg(F.min("ord").alias("ord"))
    low = F.lower("path")
    return p.select("path", "ord", low.alias("lower_path"), F.element_at(F.split(low, "/"), -1).alias("base"))


FILES_SQL = r"""files AS (SELECT path, min(page_id) ord, lower(path) lower_path, list_extract(string_split(lower(path), '/'), -1) base
 FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') path FROM pages) GROUP BY path)"""


def path_questions(f: DataFrame) -> DataFrame:
    """Five questions for each file: its path, its name, its end, a piece of it, and a path that isn't there."""
    base = F.element_at(F.split("path", "/"), -1)
    qs = F.array(F.col("path"), F.concat(F.lit("./"), base), F.substring("path", -12, 12), F.substring("path", 4, 14), F.concat(F.lit("no/"), base, F.lit(".nope")))
    return f.select("ord", F.posexplode(qs).alias("k", "question")).select((F.col("ord") * 5 + F.col("k")).alias("qid"), "question")


PATH_QUESTIONS_SQL = r"""questions AS (SELECT ord * 5 + k - 1 qid, q[k] question FROM (SELECT ord, k, [path, './' || list_extract(string_split(path, '/'), -1),
   CASE WHEN length(path) < 12 THEN path ELSE right(path, 12) END, substr(path, 4, 14), 'no/' || list_extract(string_split(path, '/'), -1) || '.nope'] q FROM files, range(1, 6) r(k)))"""


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """name, qualified, kind, path, line, tier: parts and suppliers are the primary index, customers the fallback."""
    part = table(spark, folder, "part").select(
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("qualified"),
        F.when(F.col("p_type") == "ECONOMY", "import").when(F.col("p_type") == "SMALL", "function").when(F.col("p_type") == "LARGE", "class").otherwise("method").alias("kind"),
        F.concat(F.when(F.col("p_size") < 10, "tests/").when(F.col("p_size") < 30, "src/").otherwise("pkg/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".ts")).alias("path"),
        F.col("p_partkey").alias("line"), F.lit("primary").alias("tier"),
    )
    other = lambda t, name, key, nation, kind, ext, tier: table(spark, folder, t).select(
        F.replace(name, F.lit("#"), F.lit("_")).alias("name"), F.replace(name, F.lit("#"), F.lit("_")).alias("qualified"), F.lit(kind).alias("kind"),
        F.concat(F.lit(f"lib/{t}_"), F.col(nation).cast("string"), F.lit(ext)).alias("path"), F.col(key).alias("line"), F.lit(tier).alias("tier"),
    )
    return part.unionByName(other("supplier", "s_name", "s_suppkey", "s_nationkey", "class", ".go", "primary")).unionByName(other("customer", "c_name", "c_custkey", "c_nationkey", "function", ".mjs", "fallback"))


SYMBOLS_SQL = """symbols AS (
 SELECT replace(p_name, ' ', '_') AS name, lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '_') AS qualified,
  CASE p_type WHEN 'ECONOMY' THEN 'import' WHEN 'SMALL' THEN 'function' WHEN 'LARGE' THEN 'class' ELSE 'method' END AS kind,
  CASE WHEN p_size < 10 THEN 'tests/' WHEN p_size < 30 THEN 'src/' ELSE 'pkg/' END || lower(replace(p_brand, '#', '_')) || '.ts' AS path, p_partkey AS line, 'primary' AS tier FROM part
 UNION ALL SELECT replace(s_name, '#', '_'), replace(s_name, '#', '_'), 'class', 'lib/supplier_' || s_nationkey || '.go', s_suppkey, 'primary' FROM supplier
 UNION ALL SELECT replace(c_name, '#', '_'), replace(c_name, '#', '_'), 'function', 'lib/customer_' || c_nationkey || '.mjs', c_custkey, 'fallback' FROM customer)"""


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """src calls dst: orders call customers, customers and suppliers call nations, nations regions."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda n: table(spark, folder, n)
    e = t("nation").select(key("nation:", "n_nationkey").alias("src"), key("region:", "n_regionkey").alias("dst"))
    e = e.union(t("customer").select(key("customer:", "c_custkey"), key("nation:", "c_nationkey")))
    e = e.union(t("supplier").select(key("supplier:", "s_suppkey"), key("nation:", "s_nationkey")))
    return e.union(t("orders").select(key("order:", "o_orderkey"), key("customer:", "o_custkey")))


EDGES_SQL = """edges AS (SELECT 'nation:' || n_nationkey src, 'region:' || n_regionkey dst FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """path, language, line (from 1), text: the documents' lines."""
    d = table(spark, folder, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    split = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    return d.select(path.alias("path"), F.col("lang").alias("language"), F.posexplode(split).alias("line", "text")).withColumn("line", F.col("line") + 1)


LINES_SQL = r"""docs AS (SELECT source || '/' || doc_id AS path, lang AS language, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents),
 lines AS (SELECT path, language, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM docs)"""


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """file, sha256: what is there now."""
    d = table(spark, folder, "documents")
    return d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """id, at, question, details: charted notes, some of them tagged with a facet."""
    facet = F.element_at(F.array(*[F.lit(f"[FACET:{x}] ") for x in FACETS]), (F.col("item_id") % 7 + 1).cast("int"))
    b = table(spark, folder, "benchmark")
    return b.select(
        F.col("item_id").alias("id"), F.date_format(F.timestamp_seconds(F.col("item_id") * 37 % 11 * 3600), "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.concat(F.when(F.col("item_id") % 7 < 4, facet).otherwise(""), F.substring("text", 1, 60)).alias("question"),
        F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("status: not_applicable\n"), F.col("text"))).otherwise(F.col("text")).alias("details"),
    )


FACETS = ["LIFECYCLE", "DATA_STATE", "BOUNDARIES", "INVARIANTS", "FAILURE", "NONE", "NONE"]
FACET_IDS = ["lifecycle", "data_state", "boundaries", "invariants", "failure"]

ENTRIES_SQL = f"""entries AS (SELECT item_id AS id, strftime(TIMESTAMP '1970-01-01' + to_seconds(item_id * 37 % 11 * 3600), '%Y-%m-%d %H:%M:%S') AS "at",
  CASE WHEN item_id % 7 < 4 THEN ['[FACET:{"] ', '[FACET:".join(FACETS)}] '][item_id % 7 + 1] ELSE '' END || substr(text, 1, 60) AS question,
  CASE WHEN item_id % 5 = 0 THEN 'status: not_applicable' || chr(10) || text ELSE text END AS details FROM benchmark),
 stored AS (SELECT 'doc/' || doc_id AS file, sha256(text) AS sha256 FROM documents),
 cited AS (SELECT item_id AS id, 'doc/' || (item_id * 13 + k * 5 + CASE WHEN item_id % 9 = 4 AND k = 1 THEN 100000000 ELSE 0 END) AS file, k, item_id % 4 = 1 AND k = 0 AS altered FROM benchmark, range(2) r(k)),
 entry_files AS (SELECT id, cited.file, CASE WHEN altered THEN sha256(cited.file) ELSE coalesce(s.sha256, '') END AS sha256 FROM cited LEFT JOIN stored s ON cited.file = s.file)"""


def entry_files(spark: SparkSession, folder: str) -> DataFrame:
    """id, file, sha256 (as recorded): two files an entry, some of them changed since, some gone."""
    b = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    gone = F.when((F.col("id") % 9 == 4) & (F.col("k") == 1), 100000000).otherwise(0)
    cited = b.select("id", F.concat(F.lit("doc/"), (F.col("id") * 13 + F.col("k") * 5 + gone).cast("string")).alias("file"), ((F.col("id") % 4 == 1) & (F.col("k") == 0)).alias("altered"))
    s = stored(spark, folder)
    return cited.join(s, "file", "left").select("id", "file", F.when(F.col("altered"), F.sha2(F.col("file").cast("binary"), 256)).otherwise(F.coalesce("sha256", F.lit(""))).alias("sha256"))


def session_events(spark: SparkSession, folder: str) -> DataFrame:
    """status, tokens, full, latency of session events."""
    return as_session(table(spark, folder, "events"))


def as_session(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "purchase", "hit").when(F.col("event_type") == "click", "junction").when(F.col("event_type") == "error", "error").otherwise("miss")
    return e.select("event_id", "ts", "user_id", status.alias("status"), k.alias("tokens"), F.when(F.col("event_id") % 3 == 0, k * 9).alias("full"), F.floor("value").alias("latency"))


EVENTS_SQL = """session AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'purchase' THEN 'hit' WHEN 'click' THEN 'junction' WHEN 'error' THEN 'error' ELSE 'miss' END AS status,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 9 END AS "full", CAST(floor(value) AS BIGINT) AS latency FROM events)"""
