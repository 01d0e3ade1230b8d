"""Queries over paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import text as T
from halyard.operators import paths
from halyard.sources import corpus as C


def path_cascade(spark: SparkSession, folder: str) -> DataFrame:
    f = C.files(spark, folder)
    return paths.cascade(C.path_questions(f), f)


def path_collisions(spark: SparkSession, folder: str) -> DataFrame:
    f = C.files(spark, folder)
    return paths.collisions(C.path_questions(f), f)


def path_normalize(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("path")
    forms = F.array(p, F.concat(F.lit("./"), p), F.concat(F.lit("a/../"), p), F.concat(F.lit("../"), p), F.concat(F.lit("/"), p), F.concat(F.lit("C:"), p), F.replace(p, F.lit("/"), F.lit("\\")), F.concat(F.lit("x/.//y/../../"), p, F.lit("/")), F.lit(""), F.lit(".."), F.concat(p, F.lit("/../../..")))
    rows = C.files(spark, folder).select("ord", F.posexplode(forms).alias("form", "raw"))
    return rows.select("ord", F.col("form").cast("long").alias("form"), "raw", T.normalized_path(F.col("raw")).alias("r")).select("ord", "form", "raw", "r.path", "r.error")


def skip_filter(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("path")
    forms = F.array(p, F.concat(F.lit("node_modules/"), p), F.concat(F.lit("src/tmp/"), p), F.concat(F.lit("tmp/"), p), F.concat(p, F.lit(".log")), F.concat(p, F.lit("/.DS_Store")), F.concat(F.lit("lib/dist/"), p))
    rows = C.files(spark, folder).select("ord", F.posexplode(forms).alias("form", "raw"))
    return rows.where(~T.skipped(F.col("raw"))).select("ord", F.col("form").cast("long").alias("form"), F.col("raw").alias("path"))


def literal_intent(spark: SparkSession, folder: str) -> DataFrame:
    base = F.element_at(F.split("path", "/"), -1)
    forms = F.array(F.col("path"), F.concat(F.lit("'"), base, F.lit("'")), F.concat(base, F.lit(".sql")), F.lit("Dockerfile"), F.concat(F.lit(".\\"), base), F.lit("mutex.lock"), F.concat(base, F.lit(" ok?")), F.lit(".gitignore"))
    rows = C.files(spark, folder).select("ord", F.posexplode(forms).alias("form", "question"))
    return rows.select("ord", F.col("form").cast("long").alias("form"), "question", T.literal_intent(F.col("question")).alias("i")).select("ord", "form", "question", "i.*")


def plausible_edges(spark: SparkSession, folder: str) -> DataFrame:
    exts = [".go", ".ts", ".py", ".pxi", ".cpp", ".md", ".JS", ""]
    e = C.edges(spark, folder)
    pick = lambda c: F.concat(F.replace(c, F.lit(":"), F.lit("/")), F.element_at(F.array(*map(F.lit, exts)), (F.pmod(F.length(c) * 3 + F.ascii(F.substring(c, -1, 1)), F.lit(8)) + 1).cast("int")))
    e = e.select("src", "dst", pick("src").alias("caller"), pick("dst").alias("callee"), F.when(F.length("dst") % 2 == 0, F.concat(F.lit("Pkg.Run"), F.substring_index("dst", ":", -1))).otherwise(F.concat(F.lit("run"), F.substring_index("dst", ":", -1))).alias("name"))
    return e.select("src", "dst", "caller", "callee", "name", T.language_family(F.col("caller")).alias("caller_family"), T.plausible_edge(F.col("caller"), F.col("callee"), F.col("name")).alias("plausible"))


_in = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_EXT = "nullif(lower(regexp_extract(list_extract(string_split({p}, '/'), -1), '[^/]\\.([^./]+)$', 1)), '')"
FAMILY = "CASE " + " ".join(f"WHEN {_EXT} IN {_in(e.split())} THEN '{f}'" for f, e in T.FAMILIES.items()) + " END"
_DIR = "CASE WHEN NOT contains({p}, '/') THEN '.' WHEN regexp_replace({p}, '/+[^/]*$', '') = '' THEN '/' ELSE regexp_replace({p}, '/+[^/]*$', '') END"

_CASCADE = f"""WITH {C.FILES_SQL}, {C.PATH_QUESTIONS_SQL},
 q AS (SELECT qid, question, regexp_replace(replace(question, chr(92), '/'), '^\\./', '') norm, question LIKE './%' OR question LIKE '.' || chr(92) || '%' explicit FROM questions),
 m AS (SELECT qid, question, norm, explicit, count(*) FILTER (base = list_extract(string_split(lower(norm), '/'), -1)) nb, count(*) FILTER (lower_path = lower(norm)) ne,
   count(*) FILTER (path = norm) ns, count(*) FILTER (ends_with(lower_path, lower(norm))) nf, count(*) FILTER (contains(lower_path, lower(norm))) nu,
   arg_min(path, ord) FILTER (base = list_extract(string_split(lower(norm), '/'), -1)) fb, arg_min(path, ord) FILTER (lower_path = lower(norm)) fe,
   arg_min(path, ord) FILTER (ends_with(lower_path, lower(norm))) ff, arg_min(path, ord) FILTER (contains(lower_path, lower(norm))) fu FROM q, files GROUP BY ALL)"""
ORACLES = {
    "path_cascade": _CASCADE + """, k AS (SELECT *, CASE WHEN NOT explicit AND NOT contains(norm, '/') AND nb > 1 THEN NULL WHEN ne > 0 THEN 'exact' WHEN nb = 1 THEN 'basename' WHEN nf = 1 THEN 'suffix' WHEN nu = 1 THEN 'substring' END kind FROM m)
 SELECT qid, question, CASE WHEN kind IS NULL THEN 'miss' ELSE 'hit' END AS status, kind, CAST(CASE WHEN kind IS NULL THEN 0 WHEN kind = 'exact' AND ns = 0 THEN ne ELSE 1 END AS BIGINT) AS n_files,
  CASE kind WHEN 'exact' THEN CASE WHEN ns > 0 THEN norm ELSE fe END WHEN 'basename' THEN fb WHEN 'suffix' THEN ff WHEN 'substring' THEN fu END AS file FROM k""",
    "path_collisions": _CASCADE + """, k AS (SELECT *, CASE WHEN nb > 1 THEN 'basename' WHEN nf > 1 THEN 'suffix' WHEN nu > 1 THEN 'substring' END kind FROM m WHERE norm != '')
 SELECT qid, question, 'AMBIGUOUS_PATH_COLLISION' AS miss_code, kind, count(*) AS n_files, array_to_string(list_slice(list(path ORDER BY ord), 1, 10), ',') AS candidates
 FROM k, files WHERE CASE kind WHEN 'basename' THEN base = list_extract(string_split(lower(norm), '/'), -1) WHEN 'suffix' THEN ends_with(lower_path, lower(norm)) WHEN 'substring' THEN contains(lower_path, lower(norm)) END
 GROUP BY qid, question, kind""",
    "path_normalize": rf"""WITH {C.FILES_SQL}, f AS (SELECT ord, path, [path, './' || path, 'a/../' || path, '../' || path, '/' || path, 'C:' || path, replace(path, '/', chr(92)), 'x/.//y/../../' || path || '/', '', '..', path || '/../../..'] fs FROM files),
 r AS (SELECT ord, k - 1 form, fs[k] raw, replace(fs[k], chr(92), '/') s FROM f, range(1, 12) t(k)),
 n AS (SELECT *, list_reduce(list_prepend('', string_split(s, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN CASE WHEN a = '' THEN '..' WHEN regexp_matches(a, '(^|/)\.\.$') THEN a || '/..' ELSE regexp_replace(a, '(^|/)[^/]+$', '') END
   WHEN a = '' THEN x ELSE a || '/' || x END) w FROM r),
 z AS (SELECT *, CASE WHEN w = '' THEN CASE WHEN ends_with(s, '/') THEN './' ELSE '.' END ELSE w || CASE WHEN ends_with(s, '/') THEN '/' ELSE '' END END p FROM n),
 b AS (SELECT *, raw = '' OR s LIKE '/%' OR regexp_matches(s, '^[A-Za-z]:') OR p IN ('.', '..') OR p LIKE '../%' bad FROM z)
 SELECT ord, form, raw, CASE WHEN NOT bad THEN regexp_replace(p, '^\./', '') END AS path, CASE WHEN bad THEN 'INVALID_PATH' END AS error FROM b""",
    "skip_filter": rf"""WITH {C.FILES_SQL}, f AS (SELECT ord, [path, 'node_modules/' || path, 'src/tmp/' || path, 'tmp/' || path, path || '.log', path || '/.DS_Store', 'lib/dist/' || path] fs FROM files),
 r AS (SELECT ord, k - 1 form, fs[k] path, string_split(fs[k], '/') ps FROM f, range(1, 8) t(k))
 SELECT ord, form, path FROM r WHERE NOT (list_has_any(ps[1:len(ps) - 1], {_list(T.SKIP_ANY)}) OR (len(ps) > 1 AND ps[1] IN {_in(T.SKIP_ROOT)}) OR ps[-1] = '.DS_Store' OR path LIKE '%.log' OR path LIKE '%.tsbuildinfo')""",
    "literal_intent": rf"""WITH {C.FILES_SQL}, f AS (SELECT ord, list_extract(string_split(path, '/'), -1) b, path FROM files),
 r AS (SELECT ord, k - 1 form, [path, '''' || b || '''', b || '.sql', 'Dockerfile', '.' || chr(92) || b, 'mutex.lock', b || ' ok?', '.gitignore'][k] question FROM f, range(1, 9) t(k)),
 s AS (SELECT *, regexp_replace(trim(question), '^[''"`]+|[''"`]+$', '', 'g') q FROM r), n AS (SELECT *, regexp_replace(replace(q, chr(92), '/'), '^\./', '') nm FROM s),
 m AS (SELECT *, lower(nm) lo, regexp_extract(lower(nm), '\.([a-z0-9]+)[?!.,;)]*$', 1) IN {_in(T.EXTENSIONS)} he, contains(nm, '/') OR q LIKE './%' OR q LIKE '.' || chr(92) || '%' OR q LIKE '/%' ex FROM n),
 z AS (SELECT *, contains(nm, '/') OR he OR lo LIKE '.%' OR lo IN {_in(T.BUILD_FILES)} li FROM m)
 SELECT ord, form, question, li AS is_literal, nm AS normalized, ex AS is_explicit, li AND NOT ex AND he AND regexp_matches(q, '^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)+(\(\))?$') AS could_be_symbol FROM z""",
    "plausible_edges": rf"""WITH {C.EDGES_SQL}, x AS (SELECT src, dst, ['.go', '.ts', '.py', '.pxi', '.cpp', '.md', '.JS', ''] e FROM edges),
 c AS (SELECT src, dst, replace(src, ':', '/') || e[(length(src) * 3 + ascii(right(src, 1))) % 8 + 1] caller, replace(dst, ':', '/') || e[(length(dst) * 3 + ascii(right(dst, 1))) % 8 + 1] callee,
   CASE WHEN length(dst) % 2 = 0 THEN 'Pkg.Run' ELSE 'run' END || list_extract(string_split(dst, ':'), -1) AS name FROM x),
 f AS (SELECT *, {FAMILY.format(p='caller')} fa, {FAMILY.format(p='callee')} fb, {_DIR.format(p='caller')} da, {_DIR.format(p='callee')} db FROM c)
 SELECT src, dst, caller, callee, name, fa AS caller_family, (fa IS NULL OR fb IS NULL OR fa = fb OR (fa = 'python' AND fb = 'c_cpp') OR (fa = 'c_cpp' AND fb = 'python'))
  AND NOT coalesce(fa = 'go' AND fb = 'go' AND regexp_matches(list_extract(string_split(name, '.'), -1), '^[a-z]') AND da != db, false) AS plausible FROM f""",
}
QUERIES = {"path_cascade": path_cascade, "path_collisions": path_collisions, "path_normalize": path_normalize, "skip_filter": skip_filter, "literal_intent": literal_intent, "plausible_edges": plausible_edges}
