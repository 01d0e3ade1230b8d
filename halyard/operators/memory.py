"""Charted notes: freshness of the files they cite, exact and BM25 recall, removal, and the facet map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.text import exact_question, is_not_applicable, js_round, memory_terms
from halyard.plans.cut import cut

K1, B = 1.2, 0.75


def freshness(entries: DataFrame, cited: DataFrame, stored: DataFrame) -> DataFrame:
    """id, n_files, missing, stale, fresh: cited files that are gone or have changed (sorted lists). Files without a
    recorded digest are checked for existence only."""
    now = stored.select("file", F.col("sha256").alias("now"), F.lit(True).alias("there"))
    c = cited.join(now, "file", "left")
    gone = F.col("there").isNull()
    changed = ~gone & F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("sha256") != F.col("now"))
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("file"))))
    got = c.groupBy("id").agg(F.count("*").alias("n_files"), listed(gone).alias("missing"), listed(changed).alias("stale"))
    r = entries.select("id").join(got, "id", "left")
    empty = F.array().cast("array<string>")
    r = r.select("id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("missing", empty).alias("missing"), F.coalesce("stale", empty).alias("stale"))
    return r.withColumn("fresh", (F.size("missing") == 0) & (F.size("stale") == 0))


def described(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """id, text: why each entry that isn't fresh goes."""
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    e = entries.join(fresh.where("NOT fresh"), "id")
    return e.select("id", F.concat(F.col("id").cast("string"), F.lit(' "'), "question", F.lit('" ('), F.concat_ws("; ", part("missing", "missing"), part("changed", "stale")), F.lit(")")).alias("text"))


def prune(entries: DataFrame, cited: DataFrame, stored: DataFrame) -> DataFrame:
    """The entries whose files are all there and unchanged."""
    stale = freshness(entries, cited, stored).where("NOT fresh").select("id")
    return entries.join(stale, "id", "left_anti")


def bust(entries: DataFrame, cited: DataFrame, files: DataFrame) -> DataFrame:
    """The entries that cite none of `files`."""
    return entries.join(cited.join(files.select("file"), "file", "left_semi").select("id").distinct(), "id", "left_anti")


def unchart(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id"), "id", "left_anti")


def chart(entries: DataFrame, new: DataFrame, question_limit: int = 240, details_limit: int = 4000) -> DataFrame:
    """entries with `new` in place of earlier entries of the same facet; raises on texts over the limits."""
    if new.where((F.length("question") > question_limit) | (F.length("details") > details_limit)).limit(1).count():
        raise ValueError("TEXT_LIMIT: the question or the answer is too long")
    tag = F.upper(F.regexp_extract("question", r"(?i)(\[facet:[a-z_]+\])", 1))
    tags = new.select(tag.alias("tag")).where("tag != ''").distinct()
    old = entries.withColumn("tag", tag).join(tags, "tag", "left_anti").select(*entries.columns)
    return old.join(new.select("id"), "id", "left_anti").unionByName(new.select(*entries.columns))


def exact(questions: DataFrame, entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """qid, id, score 100: for each question the newest fresh entry with the same normalised question (then least id)."""
    e = entries.join(fresh.where("fresh").select("id"), "id", "left_semi").select("id", "at", F.regexp_replace(F.lower("question"), r"[?.,!]+\z", "").alias("key"))
    hit = questions.select("qid", exact_question(F.col("question")).alias("key")).join(e, "key")
    w = Window.partitionBy("qid").orderBy(F.desc("at"), "id")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", "id", F.lit(100).alias("score"))


def bm25(questions: DataFrame, docs: DataFrame, top: int = 5) -> DataFrame:
    """qid, id, rank, score: Okapi BM25 (k1 1.2, b 0.75) of docs (id, body) for questions (qid, question), best first,
    ties to the smaller id. Only shared terms are joined; a document with none never appears. Questions with the same shared
    terms are answered once."""
    d = docs.select("id", F.sort_array(memory_terms(F.col("body"))).alias("t"))
    size = d.select(F.size("t").alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    # a term's count is the distance between the starts of its run and the next in the sorted terms: no row a repeat
    at = F.filter(F.sequence(F.lit(0), F.size("t")), lambda i: (i == 0) | (i == F.size("t")) | (F.get("t", i) != F.get("t", i - 1)))
    d = d.where(F.size("t") > 0).select("id", F.size("t").alias("len"), "t", at.alias("at"))
    runs = F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda a, k: F.struct(F.get("t", a).alias("term"), (F.get("at", k + 1) - a).cast("long").alias("tf")))
    post = d.select("id", "len", F.inline(runs))
    q = questions.select("qid", F.explode(F.array_distinct(memory_terms(F.col("question")))).alias("term"))
    tf = cut(post.join(q.select("term").distinct(), "term", "left_semi").select("term", "id", "len", "tf"))  # bodies are read once
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    own = q.join(df.select("term"), "term", "left_semi").groupBy("qid").agg(F.sort_array(F.collect_list("term")).alias("terms"))  # a question's own
    same = own.groupBy("terms").agg(F.min("qid").alias("_as"))
    s = same.select(F.col("_as").alias("qid"), F.explode("terms").alias("term")).join(tf, "term").join(df, "term").crossJoin(F.broadcast(size))  # size is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    s = s.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumnRenamed("qid", "_as")
    return own.join(same, "terms").select("qid", "_as").join(best, "_as").select("qid", "id", F.col("rank").cast("long").alias("rank"), "score")


def facet_map(entries: DataFrame, fresh: DataFrame, facets: list[str]) -> DataFrame:
    """facet, status (active, missing, drifted or not_applicable), entry id: the newest entry whose question has the tag."""
    dim = entries.sparkSession.createDataFrame([(f, k, f"[FACET:{f.upper()}]") for k, f in enumerate(facets)], "facet string, k int, tag string")
    e = entries.join(fresh, "id").select("id", "at", "question", "details", "fresh", "n_files")
    hit = e.join(F.broadcast(dim), F.contains(F.upper("question"), F.col("tag")))  # the dimension is fixed
    w = Window.partitionBy("facet").orderBy(F.desc("at"), "id")
    newest = hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("facet", "id", "details", "fresh", "n_files")
    r = dim.join(newest, "facet", "left")
    status = F.when(F.col("id").isNull(), "missing").when(~F.col("fresh") | (F.col("n_files") == 0), "drifted").when(is_not_applicable(F.col("details")), "not_applicable").otherwise("active")
    return r.select("facet", "k", status.alias("status"), "id")


def facet_summary(facets: DataFrame) -> DataFrame:
    """status, completion, active_count, percentage, missing, drifted of a facet map."""
    done = F.count_if(F.col("status").isin("active", "not_applicable"))
    listed = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("k", "facet")))), lambda x: x["facet"]), ",")
    a = facets.agg(F.count("*").alias("n"), done.alias("active_count"), F.count_if(F.col("status") == "drifted").alias("d"), listed("missing").alias("missing"), listed("drifted").alias("drifted"))
    status = F.when(F.col("d") > 0, "drifted").when(F.col("active_count") == F.col("n"), "healthy").when(F.col("active_count") == 0, "empty").otherwise("incomplete")
    return a.select(status.alias("status"), F.concat(F.col("active_count").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("completion"), "active_count", js_round(F.col("active_count") / F.col("n") * 100).cast("long").alias("percentage"), "missing", "drifted")


def relevant(question: Column, text: Column) -> Column:
    """True where the two share a content term."""
    return F.arrays_overlap(memory_terms(question), memory_terms(text))
