"""Literal-path questions: the cascade exact, basename, suffix, substring, refusing what is ambiguous.

Exact and basename levels are joins by key. Suffix and substring candidates come from an n-gram index: of each distinct
question the rarest gram is looked up, and only files that hold it are compared, so no question meets all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.text import basename, grams


def prepared(questions: DataFrame) -> DataFrame:
    """qid, question, norm, lower_path, base, explicit."""
    norm = F.regexp_replace(F.replace("question", F.lit("\\"), F.lit("/")), r"^\./", "")
    explicit = F.col("question").startswith("./") | F.col("question").startswith(".\\")
    q = questions.select("qid", "question", norm.alias("norm"), F.lower(norm).alias("lower_path"), explicit.alias("explicit"))
    return q.withColumn("base", basename(F.col("lower_path")))


#: The longest run of characters by which a question is looked up.
RUN = 8


def containing(wants: DataFrame, files: DataFrame) -> DataFrame:
    """lower_path, path, ord, at_end: for each distinct `lower_path` asked, the files whose lower-case path contains it.

    A question is looked up by the rarest of its runs of 8 characters (4, 2 or 1 where it is shorter): runs of three are
    shared by a fixed part of all files, however many there are.
    """
    n = F.length("lower_path")
    sized = wants.select("lower_path").where(n > 0).distinct().withColumn("n", F.when(n >= RUN, RUN).when(n >= 4, 4).when(n >= 2, 2).otherwise(1))
    sizes = sorted(r.n for r in sized.select("n").distinct().collect())  # four at most
    runs = lambda k: F.transform(grams(F.col("lower_path"), k), lambda g: F.xxhash64(g))
    own = F.coalesce(*[F.when(F.col("n") == k, runs(k)) for k in sizes or [RUN]])
    want = sized.select("lower_path", F.explode(own).alias("g"))
    held = files.select("path", F.explode(F.array_distinct(F.concat(*[runs(k) for k in sizes or [RUN]]))).alias("g"))
    count = held.groupBy("g").agg(F.count("*").alias("c"))
    rare = want.join(count.hint("merge"), "g", "left").groupBy("lower_path").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g")).alias("m"))
    rare = rare.where("m.c > 0").select(F.col("lower_path").alias("_want"), F.col("m.g").alias("g"))
    hit = held.join(rare.hint("merge"), "g").select("_want", "path").join(files.select("path", "ord", "lower_path").hint("merge"), "path")
    return hit.where(F.contains("lower_path", "_want")).select(F.col("_want").alias("lower_path"), "path", "ord", F.endswith("lower_path", "_want").alias("at_end"))


def _levels(questions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables that questions meet are as long as the files, so none is sent to the driver to be broadcast."""
    q = prepared(questions)
    first = lambda name: F.min(F.struct("ord", "path"))["path"].alias(name)
    bases = files.groupBy("base").agg(F.count("*").alias("n_base"), first("base_file")).hint("merge")
    exact = files.groupBy("lower_path").agg(F.count("*").alias("n_exact"), first("exact_file")).hint("merge")
    strict = files.select(F.col("path").alias("norm"), F.lit(True).alias("strict")).hint("merge")
    return q, q.join(bases, "base", "left").join(exact, "lower_path", "left").join(strict, "norm", "left")


def cascade(questions: DataFrame, files: DataFrame) -> DataFrame:
    """qid, question, status, kind, n_files, file: the first level that decides; several files only as exact case variants."""
    q, lv = _levels(questions, files)
    lv = lv.withColumn("refused", ~F.col("explicit") & ~F.col("norm").contains("/") & (F.coalesce("n_base", F.lit(0)) > 1))
    open_ = ~F.col("refused") & F.col("n_exact").isNull() & (F.coalesce("n_base", F.lit(0)) != 1)
    got = containing(lv.where(open_), files).groupBy("lower_path").agg(
        F.count("*").alias("n_sub"), F.count_if("at_end").alias("n_end"), F.min(F.struct("ord", "path"))["path"].alias("sub_file"),
        F.min(F.when(F.col("at_end"), F.struct("ord", "path")))["path"].alias("end_file"),
    )
    got = got.withColumnRenamed("lower_path", "_want").hint("merge")
    r = lv.join(got, F.when(open_, F.col("lower_path")) == F.col("_want"), "left")
    kind = F.when(F.col("refused"), F.lit(None)).when(F.col("n_exact").isNotNull(), "exact").when(F.col("n_base") == 1, "basename").when(F.col("n_end") == 1, "suffix").when(F.col("n_sub") == 1, "substring")
    r = r.withColumn("kind", kind)
    file = F.when(F.col("kind") == "exact", F.when(F.col("strict"), F.col("norm")).otherwise(F.col("exact_file"))).when(F.col("kind") == "basename", F.col("base_file")).when(F.col("kind") == "suffix", F.col("end_file")).when(F.col("kind") == "substring", F.col("sub_file"))
    n = F.when(F.col("kind").isNull(), 0).when((F.col("kind") == "exact") & F.col("strict").isNull(), F.col("n_exact")).otherwise(1)
    return r.select("qid", "question", F.when(F.col("kind").isNull(), "miss").otherwise("hit").alias("status"), "kind", n.cast("long").alias("n_files"), file.alias("file"))


def _first(rows: DataFrame, key: str, shown: int) -> DataFrame:
    """key, kind, n_files, candidates: of rows (key, kind, path, ord) the number a key and the first `shown` in walk order."""
    w = Window.partitionBy(key)
    few = rows.withColumn("n_files", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("ord", "path"))).where((F.col("_r") <= shown) & (F.col("n_files") > 1))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "path"))), lambda x: x["path"]), ",")
    return few.groupBy(key).agg(F.first("kind").alias("kind"), F.first("n_files").alias("n_files"), listed.alias("candidates"))


def collisions(questions: DataFrame, files: DataFrame, shown: int = 10) -> DataFrame:
    """qid, question, miss_code, kind, n_files, candidates (the first `shown` in walk order) of ambiguous questions.

    Names and texts that many questions ask for are counted once each, before the questions meet them."""
    q = prepared(questions).where("norm != ''").select("qid", "question", "lower_path", "base")
    named = _first(files.select("base", F.lit("basename").alias("kind"), "path", "ord"), "base", shown)
    q = q.join(named.hint("merge"), "base", "left").drop("base")
    rest = q.where("kind IS NULL").select("qid", "question", "lower_path")
    hits = containing(rest, files)
    n_end = F.count_if("at_end").over(Window.partitionBy("lower_path"))
    hits = hits.withColumn("kind", F.when(n_end > 1, "suffix").otherwise("substring")).where("kind = 'substring' OR at_end")
    found = rest.join(_first(hits.drop("at_end"), "lower_path", shown).hint("merge"), "lower_path")
    out = ["qid", "question", F.lit("AMBIGUOUS_PATH_COLLISION").alias("miss_code"), "kind", "n_files", "candidates"]
    return q.where("kind IS NOT NULL").select(*out).unionByName(found.select(*out))
