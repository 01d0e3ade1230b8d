"""Routing a batch of questions through the tiers: structure, literal paths, then fuzzy names and charted notes.

A stage sees only what the stages before left open (anti joins on qid); a question that a stage refuses as ambiguous
ends there. Ambiguity is reported, never resolved by a guess.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions import text as T
from halyard.functions.substrings import holders
from halyard.operators import fuzzy, graph, memory, paths, symbols
from halyard.plans.cut import cut

COLUMNS = ["qid", "question", "status", "stage", "provider", "name", "path", "line", "score", "miss_code"]
TIERS = ("auto", "ast", "path", "fuzzy", "memory")


def _rows(df: DataFrame, status: str, stage: str | Column, provider: str, **cols: Column) -> DataFrame:
    kinds = {"line": "long", "score": "double"}
    return df.select("qid", "question", F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.lit(provider).alias("provider"), *[cols.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS[5:]])


def best_token(scored: DataFrame) -> DataFrame:
    """Per question the token with the highest confidence; the first of equals. scored: qid, pos, confidence, ..."""
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), "pos")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _fuzzy(open_: DataFrame, which: str, syms: DataFrame) -> DataFrame:
    t = open_.select("qid", "question", "tool", "requires_parser", F.posexplode(T.tokens(F.col("question"))[which]).alias("pos", "token"))
    top = fuzzy.rank(t.select("token"), syms, top=1)
    hit = t.join(top, "token")
    if which == "candidates":  # a call graph only starts at something callable
        hit = hit.where(~(F.col("requires_parser") & (F.col("tool") == "trace_path")) | F.col("kind").isNull() | F.lower("kind").isin("", "function", "method"))
    return best_token(hit)


def route(questions: DataFrame, files: DataFrame, syms: DataFrame, entries: DataFrame, cited: DataFrame, stored: DataFrame, tier: str = "auto", auto_resolve: bool = False) -> DataFrame:
    """One row per question: status (hit, junction, miss), the stage that decided, and what it found or why not.

    questions: qid, question (one row a qid). tier forces one tier: ast, path, fuzzy or memory.
    """
    if tier not in TIERS:
        raise ValueError(f"INVALID_TIER_OVERRIDE: {tier}")
    q = questions.select("qid", "question", T.intent(F.col("question")).alias("i"))
    q = cut(q.select("qid", "question", "i.tool", "i.target", "i.requires_parser"))  # what later stages need is made for what is left
    files, syms = cut(files), cut(syms)  # every stage reads them
    done: list[DataFrame] = []

    def settle(df: DataFrame, rest: DataFrame) -> DataFrame:
        df = cut(df)
        done.append(df)
        return cut(rest.join(df.select("qid"), "qid", "left_anti"))

    def parted(cond: Column, status: str, stage: str, provider: str, **cols: Column) -> DataFrame:
        """What a condition settles needs no join to leave the rest."""
        done.append(_rows(rest.where(cond), status, stage, provider, **cols))
        return rest.where(~F.coalesce(cond, F.lit(False)))

    rest = q
    soft = "hit" if auto_resolve else "junction"
    if tier in ("auto", "ast"):
        rest = parted(F.col("requires_parser") & (F.col("tool") == "get_architecture"), "hit", "architecture", "structure")
        asked = rest.where("requires_parser AND target IS NOT NULL")
        # targets that several questions share are looked up once
        got = symbols.answers(asked.select(F.col("target").alias("qid"), F.col("target").alias("question")).distinct(), syms, widen=True).where("status = 'hit'").drop("question", "status").withColumnRenamed("qid", "target")
        j = asked.select("qid", "question", "tool", "target").join(got.drop("stage"), "target")
        stage = F.when(F.col("ambiguous"), "ambiguous").otherwise(F.col("tool"))
        rest = settle(_rows(j, "hit", stage, "structure", name=F.col("qualified"), path=F.col("path"), line=F.col("line"), score=F.col("n_hits")), rest)
    if tier in ("auto", "path"):
        rest = cut(rest.select("*", T.literal_intent(F.col("question")).alias("l")).select(*rest.columns, "l.*"))
        literal = F.lit(True) if tier == "path" else F.coalesce("is_literal", F.lit(False))
        lit, rest = rest.where(literal), rest.where(~literal)  # each literal question ends in this tier
        asked = lit.select("qid", F.col("normalized").alias("question"), "is_explicit")
        cas = cut(paths.cascade(asked, files).where("status = 'hit'").select("qid", "kind", "file"))
        done.append(_rows(lit.join(cas, "qid"), "hit", "literal", "path", name=F.col("kind"), path=F.col("file")))
        lit = cut(lit.join(cas.select("qid"), "qid", "left_anti"))
        col = cut(paths.collisions(lit.select("qid", F.col("normalized").alias("question")), files).select("qid", "candidates"))
        done.append(_rows(lit.join(col, "qid"), "miss", "literal", "path", name=F.col("candidates"), miss_code=F.lit("AMBIGUOUS_PATH_COLLISION")))
        lit = cut(lit.join(col.select("qid"), "qid", "left_anti"))
        dotted = lit.where("could_be_symbol")
        key = dotted.select("qid", F.regexp_replace("normalized", r"\(\)\z", "").alias("question"))
        sym = cut(symbols.answers(key, syms).where("status = 'hit'").drop("question"))
        done.append(_rows(dotted.select("qid", "question").join(sym.drop("stage", "status"), "qid"), "hit", "literal_symbol", "structure", name=F.col("qualified"), path=F.col("path"), line=F.col("line"), score=F.col("n_hits")))
        done.append(_rows(lit.join(sym.select("qid"), "qid", "left_anti"), "miss", "literal", "path", miss_code=F.lit("SYMBOL_NOT_FOUND")))
    if tier in ("auto", "fuzzy"):
        rest = settle(_rows(_fuzzy(rest, "candidates", syms), soft, "fuzzy_identifiers", "fuzzy-lexical", name=F.col("name"), path=F.col("path"), line=F.col("line"), score=F.col("confidence")), rest)
    if tier in ("auto", "memory"):
        fresh = cut(memory.freshness(entries, cited, stored))
        hit = memory.exact(rest.select("qid", "question"), entries, fresh)
        rest = settle(_rows(rest.select("qid", "question").join(hit, "qid"), soft, "memory_exact", "memory", name=F.col("id").cast("string"), score=F.lit(100)), rest)
        listed = cited.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("file")), " ").alias("files"))
        body = entries.join(fresh.where("fresh").select("id"), "id", "left_semi").join(listed, "id", "left").select("id", F.concat_ws(" ", "question", "details", "files").alias("body"))
        near = memory.bm25(rest.select("qid", "question"), body, 1)
        rest = settle(_rows(rest.select("qid", "question").join(near, "qid"), soft, "memory_bm25", "memory", name=F.col("id").cast("string"), score=F.col("score")), rest)
    if tier == "memory":
        rest = parted(F.lit(True), "miss", "memory", "memory", miss_code=F.lit("NO_CHARTED_MEMORY"))
    if tier == "ast":
        rest = parted(F.lit(True), "miss", "structure", "structure", miss_code=F.lit("SYMBOL_NOT_FOUND"))
    if tier == "auto":
        rest = parted(F.col("requires_parser") & (F.col("tool") == "trace_path"), "miss", "trace", "structure", miss_code=F.lit("SYMBOL_NOT_FOUND"))
        rest = parted(T.is_narrative(F.col("question")), "miss", "narrative", "memory", miss_code=F.lit("NO_CHARTED_MEMORY"))
    if tier in ("auto", "fuzzy"):
        rest = settle(_rows(_fuzzy(rest, "plain", syms), soft, "fuzzy_plain", "fuzzy-lexical", name=F.col("name"), path=F.col("path"), line=F.col("line"), score=F.col("confidence")), rest)
    code = "JUNCTION_EXHAUSTED" if tier == "auto" else "SYMBOL_NOT_FOUND"
    done.append(_rows(rest, "miss", "end", "junction", miss_code=F.lit(code)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def scoped(questions: DataFrame, symbols: DataFrame) -> DataFrame:
    """qid, question, status, path, terms, names: questions (qid, question, path) about one file, answered from its outline
    (path, name, start_line): its symbols whose name holds a term of the question, case aside, in line order; all of them
    for an empty question. A file's outline is bounded by its extractor."""
    q = questions.select("qid", "question", "path", T.file_terms(F.col("question")).alias("terms"))
    held = F.exists("terms", lambda t: F.contains(F.lower("name"), F.lower(t)))
    hit = q.join(symbols.select("path", "name", "start_line"), "path").where((F.size("terms") == 0) | held)
    got = hit.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]).alias("names"))
    r = q.join(got, "qid", "left")
    return r.select("qid", "question", F.when(F.col("names").isNull(), "miss").otherwise("hit").alias("status"), "path", "terms", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.when(F.col("names").isNull(), "SYMBOL_NOT_FOUND").alias("miss_code"))


def _heads(shown: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        terms, low, n, first = asked.column("terms").to_pylist(), *(held.column(c).to_pylist() for c in ("low", "n", "first"))
        at = holders({t for ts in terms if ts for t in ts if t is not None}, low)
        total, every = sum(n), None
        rows = []
        for ts in terms:
            if ts is None:
                continue
            if ts:
                own = sorted({k for t in ts if t is not None for k in at[t]})
                size, best = sum(n[k] for k in own), heapq.nsmallest(shown, (line for k in own for line in first[k]), key=_line)
            else:
                every = every or heapq.nsmallest(shown, (line for lines in first for line in lines), key=_line)
                size, best = total, every
            if size:
                rows.append((ts, size, [x["name"] for x in best]))
        path = asked.column("_asked")[0].as_py() if len(asked) else None
        return pa.table({"path": pa.array([path] * len(rows), pa.string()), "terms": pa.array([r[0] for r in rows], pa.list_(pa.string())), "n": pa.array([r[1] for r in rows], pa.int64()), "names": pa.array([r[2] for r in rows], pa.list_(pa.string()))})

    return run


def _line(x: dict) -> tuple:
    return x["start_line"] is not None, x["start_line"] or 0, x["name"] is not None, x["name"] or ""


def scoped_heads(questions: DataFrame, symbols: DataFrame, shown: int) -> DataFrame:
    """qid, question, status, path, terms, n, names, miss_code: as `scoped`, with the number of names and only the first `shown`.

    A file's distinct lists of terms are answered once each, in one task over its distinct names; a term is looked up by
    its rarest run of characters, so terms don't meet all names."""
    q = questions.select("qid", "question", "path", T.file_terms(F.col("question")).alias("terms"))
    low = F.transform("terms", lambda t: F.lower(t))
    q = q.withColumn("_low", low)
    w = Window.partitionBy("path", "name").orderBy("start_line")
    s = symbols.select("path", "name", "start_line")
    few = s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= shown).groupBy("path", "name").agg(F.collect_list(F.struct("start_line", "name")).alias("first"))
    few = few.join(s.groupBy("path", "name").agg(F.count("*").alias("n")).withColumnsRenamed({"path": "_p", "name": "_n"}), (F.col("path") == F.col("_p")) & F.col("name").eqNullSafe(F.col("_n")))
    held = few.select(F.col("path").alias("_file"), F.lower("name").alias("low"), "n", "first")
    asked = q.where("path IS NOT NULL").select(F.col("path").alias("_asked"), F.col("_low").alias("terms")).distinct()
    got = asked.groupBy("_asked").cogroup(held.groupBy("_file")).applyInArrow(_heads(shown), "path string, terms array<string>, n long, names array<string>")
    r = q.join(got.withColumnsRenamed({"path": "_p", "terms": "_t", "names": "_names"}), (F.col("path") == F.col("_p")) & (F.col("_low") == F.col("_t")), "left")
    miss = F.col("n").isNull()
    return r.select("qid", "question", F.when(miss, "miss").otherwise("hit").alias("status"), "path", "terms", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_names", F.array().cast("array<string>")).alias("names"), F.when(miss, "SYMBOL_NOT_FOUND").alias("miss_code"))


def upgraded(questions: DataFrame, traversal: Column) -> DataFrame:
    """questions (qid, question) with tool and target; a bare symbol asked with a traversal option is a trace."""
    i = T.intent(F.col("question"))
    q = questions.select("*", i.alias("_i"), traversal.alias("_t"))
    up = F.col("_t") & (F.col("_i.tool") == "search_graph") & F.col("_i.target").isNotNull()
    return q.select(*questions.columns, F.when(up, "trace_path").otherwise(F.col("_i.tool")).alias("tool"), F.col("_i.target").alias("target"), (up | F.col("_i.requires_parser")).alias("requires_parser"))


def faceted(questions: DataFrame) -> DataFrame:
    """questions (qid, question, facet, tier) as they are routed: `status` asks for the map; another facet's tag goes before
    the question, which then is for the notes unless a tier is forced."""
    f = F.lower(T.js_trim(F.coalesce("facet", F.lit(""))))
    tag = F.concat(F.lit("[FACET:"), F.upper(f), F.lit("]"))
    text = F.when((f == "") | (f == "status"), F.col("question")).when(T.js_trim(F.col("question")) == "", tag).otherwise(F.concat(tag, F.lit(" "), T.js_trim(F.col("question"))))
    tier = F.when(f == "status", "map").when((f != "") & (F.coalesce("tier", F.lit("auto")) == "auto"), "memory").otherwise(F.coalesce("tier", F.lit("auto")))
    return questions.select("qid", text.alias("question"), tier.alias("tier"))


def citing(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """answers (qid, id, path, ...) of facet questions about one file, as misses where the note doesn't cite that file."""
    norm = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "")
    there = cited.select("id", F.col("file").alias("_f")).distinct().withColumn("_ok", F.lit(True))
    j = answers.withColumn("_f", norm).join(there, ["id", "_f"], "left")
    bad = F.col("path").isNotNull() & F.col("_ok").isNull()
    return j.select(*[c for c in answers.columns if c != "id"], F.when(~bad, F.col("id")).alias("id"), F.when(bad, "NO_CHARTED_MEMORY").alias("miss_code"))


def ask(questions: DataFrame, files: DataFrame, syms: DataFrame, entries: DataFrame, cited: DataFrame, stored: DataFrame, edges: DataFrame | None = None, depth: int = 1, direction: str = "both", **options) -> tuple[DataFrame, DataFrame | None]:
    """(answers, graph): the router's rows, and for trace questions that it answered with one definition, the capped traversal
    of that definition over edges (nodes are qualified names)."""
    got = cut(route(questions, files, syms, entries, cited, stored, **options))
    if edges is None:
        return got, None
    roots = got.where("status = 'hit' AND stage = 'trace_path'").select("qid", F.col("name").alias("node"))
    return got, graph.traverse(roots, edges, depth, direction, graph.CAP)
