"""Definition lookup in stages, ranking and multi-symbol answers.

Where only the count and the best definition are asked for, definitions are reduced to one row a key before any question
meets them; a question then joins its keys once and keeps its first stage. Every choice has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.text import is_test_file

AMBIGUOUS = 25


def lookup(questions: DataFrame, symbols: DataFrame, widen: bool = False) -> DataFrame:
    """qid, question, stage, source, widened and the symbol's columns: all definitions of each question's name.

    Stages: the bare name in the primary index; a dotted name among its last segment's definitions; the fallback index
    (qualified if dotted, else bare); with `widen`, a dotted name's last segment, primary before fallback.
    """
    q = questions.select("qid", "question", F.trim("question").alias("want")).withColumn("bare", F.substring_index("want", ".", -1))
    q = q.withColumn("bare", F.when((F.col("bare") != F.col("want")) & (F.col("bare") != ""), F.col("bare")))
    first, second = symbols.where("tier = 'primary'"), symbols.where("tier = 'fallback'")
    stages = [("direct", q.where("want != ''"), "want", first, "name"), ("qualified", q.where("bare IS NOT NULL"), "want", first, "qualified"),
              ("fallback", q.where("want LIKE '%.%'"), "want", second, "qualified"), ("fallback", q.where("want NOT LIKE '%.%'"), "want", second, "name")]
    if widen:
        stages += [("widened", q.where("bare IS NOT NULL"), "bare", first, "name"), ("widened_fallback", q.where("bare IS NOT NULL"), "bare", second, "name")]
    found = None
    for k, (stage, qs, key, syms, of) in enumerate(stages):
        got = qs.select("qid", "question", F.col(key).alias("_k")).join(syms.withColumn("_k", F.col(of)), "_k").drop("_k").withColumn("stage", F.lit(stage)).withColumn("_n", F.lit(k))
        found = got if found is None else found.unionByName(got)
    lead = found.groupBy("qid").agg(F.min("_n").alias("_n"))
    return found.join(lead, ["qid", "_n"]).drop("_n").withColumn("widened", F.col("stage").startswith("widened")).withColumn("source", F.col("tier"))


def staged(questions: DataFrame, symbols: DataFrame, first: Column, widen: bool = False) -> DataFrame:
    """qid, stage, n_hits, first: of each question's first stage (see `lookup`) the number of definitions and the least
    `first`, an expression over a symbol and `question`, which is the key that the stage looks up."""
    of = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("question")) for c in ("name", "qualified")]))
    keyed = symbols.select("*", of.alias("_x")).select("*", "_x.of", "_x.question").groupBy("tier", "of", "question").agg(F.count("*").alias("n_hits"), F.min(first).alias("first"))
    q = questions.select("qid", F.trim("question").alias("want")).withColumn("bare", F.substring_index("want", ".", -1))
    bare = F.when((F.col("bare") != F.col("want")) & (F.col("bare") != ""), F.col("bare"))
    want, dotted = F.when(F.col("want") != "", F.col("want")), F.contains("want", F.lit("."))
    stages = [("direct", "primary", "name", want), ("qualified", "primary", "qualified", F.when(bare.isNotNull(), want)), ("fallback", "fallback", "qualified", F.when(dotted, want)), ("fallback", "fallback", "name", F.when(~dotted, want))]
    if widen:
        stages += [("widened", "primary", "name", bare), ("widened_fallback", "fallback", "name", bare)]
    asks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(stage).alias("stage"), F.lit(tier).alias("tier"), F.lit(c).alias("of"), key.alias("question")) for k, (stage, tier, c, key) in enumerate(stages)])
    q = q.select("qid", F.explode(F.filter(asks, lambda x: x["question"].isNotNull())).alias("x")).select("qid", "x.*")
    hit = q.join(keyed, ["tier", "of", "question"])
    return hit.groupBy("qid").agg(F.min_by(F.struct("stage", "n_hits", "first"), "k").alias("m")).select("qid", "m.*")


def answers(questions: DataFrame, symbols: DataFrame, widen: bool = False) -> DataFrame:
    """Per question: stage, n_hits, ambiguous (AMBIGUOUS definitions or more), status, and the first definition in order."""
    r = questions.select("qid", "question").join(staged(questions, symbols, F.struct("path", "line", "name", "qualified", "kind"), widen), "qid", "left")
    n = F.coalesce("n_hits", F.lit(0))
    return r.select("qid", "question", "stage", n.alias("n_hits"), (n >= AMBIGUOUS).alias("ambiguous"), F.when(n == 0, "miss").otherwise("hit").alias("status"), F.col("first.path").alias("path"), F.col("first.line").alias("line"), F.col("first.qualified").alias("qualified"))


def score(root: str):
    """The rank of a definition for `question`."""
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    kind = F.lower(F.coalesce("kind", F.lit("")))
    name = F.when(F.contains("question", F.lit(".")), F.coalesce("qualified", "name")).otherwise(F.col("name"))
    s = F.when(is_test_file(F.col("path")), 0).otherwise(1000) + F.when(name == F.col("question"), 500).when(F.lower(name) == F.lower("question"), 250).otherwise(0)
    s = s + F.when(path.rlike(r"(^|/)(src|lib)/"), 200).otherwise(0) + F.when(F.contains(path, F.lit(root.lower() + "/")), 150).otherwise(0)
    s = s + F.when(kind.contains("def") | kind.isin("class", "struct", "function"), 100).when(kind.contains("import") | kind.contains("use"), -300).otherwise(0)
    return s - F.least(F.lit(100), F.length(path))


def best(questions: DataFrame, symbols: DataFrame, root: str) -> DataFrame:
    """One row per distinct trimmed question: status, and its best definition by score, then path, line, name."""
    qs = questions.select(F.trim("question").alias("question")).where("question != ''").distinct().withColumn("qid", F.col("question"))
    top = staged(qs, symbols, F.struct((-score(root)).alias("s"), "path", "line", "name", "kind")).select("qid", "first.*")
    return qs.join(top, "qid", "left").select("question", F.when(F.col("path").isNull(), "miss").otherwise("hit").alias("status"), "path", "line", "kind", (-F.col("s")).cast("long").alias("score"))


def summary(items: DataFrame) -> DataFrame:
    """status (hit, partial or miss), total, hits, misses of a multi-symbol answer."""
    n = items.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "hit").alias("hits"))
    status = F.when((F.col("hits") == F.col("total")) & (F.col("total") > 0), "hit").when(F.col("hits") > 0, "partial").otherwise("miss")
    return n.select(status.alias("status"), "total", "hits", (F.col("total") - F.col("hits")).alias("misses"))


def enclosing(points: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """Each point (path, line, ...) with its innermost span (name, start, end) of the same path; null where none holds it.

    The latest start wins, then the earliest end, then the name. `strict` leaves out a span that begins at the point.

    A span is kept in the smallest aligned block of 2^level lines that holds it, and a point asks the block it is in on
    each level its path has, so a point meets few spans but those that hold it; no path is one task's.
    """
    level = lambda a, z: F.when(a == z, 0).otherwise(F.length(F.bin(a.bitwiseXOR(z))))
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    s = spans.where("start <= `end`").select(F.col("path").alias("_p"), F.col("name").alias("owner"), F.col("start").alias("owner_start"), F.col("end").alias("owner_end"), level(start, end).alias("_level"), start.alias("_s"))
    s = s.withColumn("_block", F.expr("shiftright(_s, _level)")).drop("_s")
    levels = s.groupBy(F.col("_p").alias("_q")).agg(F.collect_set("_level").alias("_levels"))  # 64 at most
    p = points.withColumn("_id", F.monotonically_increasing_id())
    p = p.join(levels, p["path"] == levels["_q"], "left").drop("_q").withColumn("_at", F.explode_outer("_levels")).drop("_levels")
    p = p.withColumn("_in", F.expr("shiftright(cast(line as bigint), _at)"))
    inside = (F.col("owner_start") < F.col("line")) if strict else (F.col("owner_start") <= F.col("line"))
    hit = p.join(s, (F.col("path") == F.col("_p")) & (F.col("_at") == F.col("_level")) & (F.col("_in") == F.col("_block")) & inside & (F.col("line") <= F.col("owner_end")), "left")
    keep = points.columns
    order = F.struct((-F.col("owner_start")).alias("a"), F.col("owner_end").alias("b"), F.col("owner").alias("c"))
    got = hit.groupBy("_id").agg(*[F.first(c).alias(c) for c in keep], F.min(F.when(F.col("owner").isNotNull(), order)).alias("m"))
    return got.select(*keep, F.col("m.c").alias("owner"), (-F.col("m.a")).alias("owner_start"), F.col("m.b").alias("owner_end"))


CALLABLE = ["constructor", "function", "method"]


def resolve(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id and the definition (qualified, path, line) that each call reaches, or none where that isn't certain.

    calls: call_id, callee, receiver (null, `new`, `this` or a name), path, owner (the caller's class, or null).
    """
    s = symbols.select(F.col("name").alias("callee"), "qualified", "kind", F.col("path").alias("def_path"), F.col("line").alias("def_line"))
    out = ["call_id", "qualified", "def_path", "def_line"]
    free, classes = s.where(F.col("kind").isin(CALLABLE)), s.where("kind = 'class'")
    functions, methods = free.where("kind = 'function'"), free.where("kind = 'method'")
    only = lambda d: d.groupBy("callee").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in out[1:]]).where("n = 1").drop("n")
    c = calls.select("call_id", "callee", "receiver", "path", "owner")
    new = c.where("receiver = 'new'").join(classes, "callee").select(*out)
    # a bare name: the file's own functions, else the only function of that name
    bare, local = c.where("receiver IS NULL"), functions.withColumnRenamed("def_path", "path")
    here = bare.join(local, ["callee", "path"]).select("call_id", "qualified", F.col("path").alias("def_path"), "def_line")
    there = bare.join(local.select("callee", "path").distinct(), ["callee", "path"], "left_anti").join(only(functions), "callee").select(*out)
    # this: the own class's; a receiver: its qualified name, else the only method of that name
    named = c.where("receiver IS NOT NULL AND receiver != 'new'").withColumn("want", F.concat(F.when(F.col("receiver") == "this", F.col("owner")).otherwise(F.col("receiver")), F.lit("."), "callee"))
    by_name = free.withColumnRenamed("qualified", "want")
    exact = named.join(by_name, ["want", "callee"]).select("call_id", F.col("want").alias("qualified"), "def_path", "def_line")
    loose = named.where("receiver != 'this'").join(by_name.select("want", "callee").distinct(), ["want", "callee"], "left_anti").join(only(methods), "callee").select(*out)
    return new.unionByName(here).unionByName(there).unionByName(exact).unionByName(loose)


def targets(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, n_targets, first_target, first_path: of each call that `resolve` finds definitions for, their number, least
    qualified name and least path. Definitions are reduced to one row a key before calls meet them, so no call is repeated
    for each of its definitions. One row a row of calls."""
    s = symbols.select(F.col("name").alias("callee"), "qualified", "kind", F.col("path").alias("def_path"))
    few = lambda d, *key: d.groupBy(*key).agg(F.count("*").alias("n_targets"), F.min("qualified").alias("first_target"), F.min("def_path").alias("first_path"))
    out = ["call_id", "n_targets", "first_target", "first_path"]
    free = s.where(F.col("kind").isin(CALLABLE))
    functions, methods = free.where("kind = 'function'"), free.where("kind = 'method'")
    c = calls.select("call_id", "callee", "receiver", "path", "owner")
    new = c.where("receiver = 'new'").join(few(s.where("kind = 'class'"), "callee"), "callee").select(*out)
    bare, local = c.where("receiver IS NULL"), few(functions.withColumn("path", F.col("def_path")), "callee", "path")
    here = bare.join(local, ["callee", "path"]).select(*out)
    there = bare.join(local.select("callee", "path"), ["callee", "path"], "left_anti").join(few(functions, "callee").where("n_targets = 1"), "callee").select(*out)
    named = c.where("receiver IS NOT NULL AND receiver != 'new'").withColumn("want", F.concat(F.when(F.col("receiver") == "this", F.col("owner")).otherwise(F.col("receiver")), F.lit("."), "callee"))
    by_name = few(free.withColumn("want", F.col("qualified")), "want", "callee")
    exact = named.join(by_name, ["want", "callee"]).select(*out)
    loose = named.where("receiver != 'this'").join(by_name.select("want", "callee"), ["want", "callee"], "left_anti").join(few(methods, "callee").where("n_targets = 1"), "callee").select(*out)
    return new.unionByName(here).unionByName(there).unionByName(exact).unionByName(loose)
