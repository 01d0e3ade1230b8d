"""Queries over lines as outlines, and over question text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import text as T
from halyard.operators import outline as O
from halyard.operators import symbols as S
from halyard.plans.cut import spread
from halyard.plans.path_queries import _in
from halyard.sources import corpus as C


def _line_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """path, line, name, start, end: each line opens a span as long as its length says."""
    ln = C.lines(spark, folder)
    return ln.select("path", "line", F.concat(F.lit("s"), F.col("line").cast("string")).alias("name"), F.col("line").alias("start"), (F.col("line") + F.length("text") % 5).alias("end"))


def outline_filter(spark: SparkSession, folder: str) -> DataFrame:
    ln = C.lines(spark, folder).select("path", "line", F.col("text").alias("name"))
    terms = F.split(F.regexp_replace("path", "/.*", ""), "src")
    return O.by_name(ln, "ENT").where(O.any_term(F.col("name"), F.array_append(F.filter(terms, lambda t: t != ""), F.lit("tion")))).select("path", "line", "name")


def innermost_enclosing(spark: SparkSession, folder: str) -> DataFrame:
    spans = _line_symbols(spark, folder)
    return S.enclosing(spans.select("path", "line"), spans.where("end > start"), strict=True)


def heading_spans(spark: SparkSession, folder: str) -> DataFrame:
    ln = C.lines(spark, folder)
    last = ln.groupBy("path").agg(F.max("line").alias("last_line"))
    h = ln.where(F.length("text") % 2 == 0).select("path", "line", (F.length("text") % 6 + 1).alias("level"))
    return O.section_ends(h.join(last, "path")).select("path", "line", F.col("level").cast("long").alias("level"), "end")


def _questions(spark: SparkSession, folder: str, *of: Column) -> DataFrame:
    """qid, question and `of` it: conversation turns by users, and templates over symbol names and files.

    A qualified name is put in the templates once, however many symbols bear it; they get what is said of its questions.
    """
    conv = C.table(spark, folder, "conversations").where("role = 'user'").select(F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("qid"), F.regexp_replace("text", r"\s+", " ").alias("question"))
    forms = ["Who calls {}?", "callers of {}", "What does {} call", "Where is {} declared?", "definition of {} please", "{}", "{}()", "How does {} work?", "show the architecture", "find {} in the module, e.g. a.b_c and fooBar", "what is {}", "Explain plugin architecture", "src/{}.ts"]
    syms = C.symbols(spark, folder).withColumn("_key", F.coalesce(F.concat(F.lit("="), "qualified"), F.lit("")))
    parts = F.array(*[F.regexp_replace(F.lit(f), r"\{\}", F.col("qualified")) if "{}" in f else F.lit(f) for f in forms])
    names = spread(syms.select("_key", "qualified"), "_key").distinct().select("_key", F.posexplode(parts).alias("k", "question"))
    made = spread(syms.select("_key", "tier", "path", "line"), "_key").join(names.select("*", *of), "_key").drop("_key")
    made = made.select(F.concat_ws(":", "tier", "path", "line", "k").alias("qid"), *made.columns[4:])
    return spread(conv).select("qid", "question", *of).union(made)


FORMS_SQL = r"""forms AS (SELECT unnest(['Who calls {}?', 'callers of {}', 'What does {} call', 'Where is {} declared?', 'definition of {} please', '{}', '{}()', 'How does {} work?', 'show the architecture', 'find {} in the module, e.g. a.b_c and fooBar', 'what is {}', 'Explain plugin architecture', 'src/{}.ts']) f, unnest(range(13)) k),
 questions AS (SELECT 'c:' || conv_id || ':' || turn AS qid, regexp_replace(text, '\s+', ' ', 'g') AS question FROM conversations WHERE role = 'user'
  UNION ALL SELECT tier || ':' || path || ':' || line || ':' || k, replace(f, '{}', qualified) FROM symbols, forms)"""


def intent_classify(spark: SparkSession, folder: str) -> DataFrame:
    q = _questions(spark, folder, T.intent(F.col("question")).alias("i"), T.is_narrative(F.col("question")).alias("narrative"))
    return q.select("qid", "question", "i.tool", "i.target", "i.requires_parser", "narrative")


def token_partition(spark: SparkSession, folder: str) -> DataFrame:
    q = _questions(spark, folder, T.tokens(F.col("question")).alias("t"))
    return q.select("qid", "t.shape", F.array_join("t.candidates", " ").alias("candidates"), F.array_join("t.plain", " ").alias("plain"))


def memory_terms(spark: SparkSession, folder: str) -> DataFrame:
    d = C.table(spark, folder, "documents")
    return d.select("doc_id", T.memory_terms(F.col("text")).alias("t"), "text").select("doc_id", F.size("t").cast("long").alias("n_terms"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("terms"), T.estimate_tokens(F.col("text")).alias("tokens"))


def subsequence_filter(spark: SparkSession, folder: str) -> DataFrame:
    s = C.symbols(spark, folder).select("path", "line", "name", F.explode(F.array(*map(F.lit, ["sup01", "cs9", "rdwdg", "small", "_bolt", "zz"]))).alias("needle"))
    return s.where(T.is_subsequence(F.col("needle"), F.lower("name"))).select("path", "line", "name", "needle")


_names = lambda stop: rf"list_filter(regexp_extract_all(q, '([A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*)', 1), lambda t: lower(t) NOT IN {_in(stop)} AND length(t) > 1)"
_q = lambda p: "'" + p.replace("'", "''") + "'"
_ident = r"(length(w) > 1 AND regexp_matches(w, '[a-z].*[A-Z]|[_.]'))"
ORACLES = {
    "outline_filter": f"""WITH {C.LINES_SQL} SELECT path, line, text AS name FROM lines WHERE contains(lower(text), 'ent')
 AND (contains(lower(text), 'tion') OR len(list_filter(string_split(regexp_replace(path, '/.*', ''), 'src'), lambda t: t != '' AND contains(lower(text), lower(t)))) > 0)""",
    "innermost_enclosing": f"""WITH {C.LINES_SQL}, s AS (SELECT path, line, line + length(text) % 5 AS e FROM lines), m AS (SELECT a.path, a.line, min({{'a': -b.line, 'b': b.e, 'c': 's' || b.line}}) FILTER (b.line IS NOT NULL) m FROM s a LEFT JOIN s b ON a.path = b.path AND b.e > b.line AND b.line < a.line AND a.line <= b.e GROUP BY ALL)
 SELECT path, line, m.c AS "owner", -m.a AS owner_start, m.b AS owner_end FROM m""",
    "heading_spans": f"""WITH {C.LINES_SQL}, mx AS (SELECT path, max(line) last_line FROM lines GROUP BY path), h AS (SELECT path, line, length(text) % 6 + 1 AS level FROM lines WHERE length(text) % 2 = 0)
 SELECT path, line, level, coalesce((SELECT min(n.line) FROM h n WHERE n.path = h.path AND n.line > h.line AND n.level <= h.level) - 1, last_line) AS "end" FROM h JOIN mx USING (path)""",
    "intent_classify": f"""WITH {C.SYMBOLS_SQL}, {FORMS_SQL}, a AS (SELECT qid, question, trim(question) q FROM questions),
 b AS (SELECT *, regexp_matches(q, {_q(T.NARRATIVE)}) nar, regexp_matches(q, {_q(T.NARRATIVE_ANY)}) nany, (regexp_matches(q, {_q(T.NARRATIVE)}) OR (regexp_matches(q, '(?i)^what\\s+is\\b') AND NOT regexp_matches(q, '(?i)entry\\s*point|main\\s+entry|architecture'))) told,
  regexp_replace(replace(regexp_replace(q, '^[''"`]+|[''"`]+$', '', 'g'), chr(92), '/'), '^\\./', '') nm FROM a),
 c AS (SELECT *, (NOT told AND regexp_matches(q, {_q(T.ARCH)})) OR regexp_matches(q, {_q(T.ARCH_ANY)}) arch, regexp_matches(q, {_q(T.TRACE)}) tr, regexp_matches(q, {_q(T.SYMBOL)}) sy,
  NOT (contains(nm, '/') OR regexp_extract(lower(nm), '\\.([a-z0-9]+)[?!.,;)]*$', 1) IN {_in(T.EXTENSIONS)} OR lower(nm) LIKE '.%' OR lower(nm) IN {_in(T.BUILD_FILES)}) AND regexp_matches(q, {_q(T.BARE)}) bare, {_names(T.TRACE_STOP)} tn, {_names(T.DEFINITION_STOP)} dn FROM b)
 SELECT qid, question, CASE WHEN arch THEN 'get_architecture' WHEN tr THEN 'trace_path' ELSE 'search_graph' END AS tool,
  CASE WHEN arch THEN NULL WHEN tr THEN regexp_replace(coalesce(tn[-1], q), '[?().]+$', '') WHEN sy THEN regexp_replace(coalesce(dn[1], q), '[?().]+$', '') WHEN bare THEN regexp_replace(q, '[?().]+$', '') END AS target,
  arch OR tr OR sy OR bare AS requires_parser, nar OR nany AS narrative FROM c""",
    "token_partition": rf"""WITH {C.SYMBOLS_SQL}, {FORMS_SQL}, a AS (SELECT qid, regexp_replace(question, '[?(),;:!''"\[\]{{}}<>/\\`]', ' ', 'g') x FROM questions),
 b AS (SELECT qid, regexp_replace(regexp_replace(regexp_replace(x, '\.([^A-Za-z0-9_]|$)', ' \1', 'g'), '\.([^A-Za-z0-9_]|$)', ' \1', 'g'), '(^|[^A-Za-z0-9_])\.', '\1 ', 'g') x FROM a), c AS (SELECT qid, list_filter(string_split_regex(x, '\s+'), lambda w: w != '') ws FROM b),
 d AS (SELECT qid, list_filter(list_filter(ws, lambda w, i: list_position(ws, w) = i), lambda w: {_ident}) ca, list_filter(list_filter(ws, lambda w, i: list_position(ws, w) = i), lambda w: NOT {_ident} AND lower(w) NOT IN {_in(T.STOP)} AND length(w) > 2) pl FROM c)
 SELECT qid, CASE WHEN len(ca) > 0 THEN 'identifier-like' ELSE 'narrative' END AS shape, array_to_string(ca, ' ') AS candidates, array_to_string(pl, ' ') AS plain FROM d""",
    "memory_terms": r"""WITH d AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '([\p{L}\p{N}_]+)', 1), lambda w: length(w) > 1 AND w NOT IN """ + _in(T.MEMORY_STOP) + """) t FROM documents)
 SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(list_sort(list_distinct(t)), ' ') AS terms, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens FROM d""",
    "subsequence_filter": f"""WITH {C.SYMBOLS_SQL}, n AS (SELECT unnest(['sup01', 'cs9', 'rdwdg', 'small', '_bolt', 'zz']) needle) SELECT path, line, name, needle FROM symbols, n WHERE regexp_matches(lower(name), array_to_string(list_transform(string_split(needle, ''), lambda c: c), '.*'))""",
}
QUERIES = {"outline_filter": outline_filter, "innermost_enclosing": innermost_enclosing, "heading_spans": heading_spans, "intent_classify": intent_classify, "token_partition": token_partition, "memory_terms": memory_terms, "subsequence_filter": subsequence_filter}
