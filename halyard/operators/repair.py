"""Repairing the facet map: candidate sources, drafts of evidence for missing and drifted facets, bootstrap and heal.

Drafts are read-only and unverified: they quote lines, nothing is charted. Ties are broken by total orders; a table without
rows gives no drafts; null texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.text import extension, is_test_file, line_words
from halyard.operators import evidence as V

SOURCES, SOURCE_BYTES, HINT_WEIGHT = 400, 256 * 1024, 3
CODE = sorted("bash c cc cjs cpp cs cts ex exs go h hpp java js jsx kt lua mjs mts php py rb rs scala sh sol swift ts tsx zig".split())
ENTRY_FILES = sorted(["app.py", "index.js", "index.ts", "main.go", "main.py", "src/cli.ts", "src/index.ts", "src/lib.rs", "src/main.rs", "src/main.ts"])

#: facet: (question, keywords, words of paths that hint at it), the lists sorted.
FACETS = {
    "lifecycle": ("Which programs start the system, and what runs until it stops?", sorted("main start stop boot init launch spawn listen serve shutdown close exit argv daemon lifecycle warm run".split()), sorted("app bin boot bootstrap cli cmd daemon entry index lifecycle main start".split())),
    "data_state": ("Where are data, state and caches kept, and how do they reach the disk?", sorted("store cache persist state save write load disk dir mkdir fs db database sqlite sql schema migrat memory".split()), sorted("cache database db memory migration migrations model models persist persistence repo repository schema state storage store stores".split())),
    "boundaries": ("Over which protocols do the parts talk to each other and to others?", sorted("socket pipe http rpc jsonrpc ipc net server client request response protocol stdio stdin stdout connect exec spawn port endpoint fetch url mcp".split()), sorted("api bridge client daemon gateway handler handlers http https ipc mcp net protocol route router routes rpc server socket transport".split())),
    "invariants": ("What about paths, security and platforms must never be broken?", sorted("normalize resolve realpath symlink canonical escape contain inside outside relative absolute platform win posix sanitize valid assert guard invariant integrity verify reject forbid safe".split()), sorted("auth guard guards integrity invariant invariants normalize path paths sanitize sanitizer security util utils valid validate validation validator validators".split())),
    "failure": ("How does it refuse what it can't answer, and recover from bad states?", sorted("err throw catch fail recover fallback retry miss reject abort timeout degrad corrupt invalid uninitiali exception panic fatal".split()), sorted("error errors exception exceptions fail failure fallback recover recovery retry types".split())),
}


def facet_table(spark: SparkSession, facets: dict[str, tuple[str, list[str], list[str]]] = FACETS) -> DataFrame:
    """facet, k, question, keywords, hints."""
    return spark.createDataFrame([(f, k, f"[FACET:{f.upper()}] {q}", words, hints) for k, (f, (q, words, hints)) in enumerate(facets.items())], "facet string, k int, question string, keywords array<string>, hints array<string>")


def is_source(path: Column) -> Column:
    """True for files of program text that aren't tests or type declarations."""
    return F.coalesce(extension(path).isin(CODE), F.lit(False)) & ~path.endswith(".d.ts") & ~is_test_file(path)


def hinted(path: Column, hints: Column) -> Column:
    """True where a word of the path, its extension aside, is one of the facet's."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", "")
    return F.arrays_overlap(line_words(bare), hints)


def candidates(files: DataFrame, entry_files: DataFrame | None = None, most: int = SOURCES, most_bytes: int = SOURCE_BYTES) -> DataFrame:
    """path, text, depth, entry: entry files, then sources by depth and path, `most` of them before those over `most_bytes`
    go. A file that is both counts once. files: path, text; entry_files: path (what a package manifest names)."""
    named = files.sparkSession.createDataFrame([(p,) for p in ENTRY_FILES], "path string")
    if entry_files is not None:
        named = named.union(entry_files.select("path"))
    f = files.join(named.distinct().withColumn("entry", F.lit(True)), "path", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    f = f.where(F.col("entry") | is_source(F.col("path"))).withColumn("depth", F.size(F.split("path", "/")))
    top = f.select("path", "entry", "depth").orderBy(F.desc("entry"), "depth", "path").limit(most)  # the feature: a bounded report
    return f.join(top.select("path"), "path", "left_semi").where(F.octet_length("text") <= most_bytes).select("path", "text", "depth", "entry")


def ranked(sources: DataFrame, facets: DataFrame, most: int = V.FILES) -> tuple[DataFrame, DataFrame]:
    """(files, lines): for each facet its best files (facet, path, place, n_files), and their evidence lines.

    Files with keyword lines come first, by their number and HINT_WEIGHT more for a hinted name, then hinted, entry, depth,
    path. Where a facet has none of them, hinted files with exported declarations; else entry files with such.
    """
    split = sources.select("path", "depth", "entry", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    lines = V.evidence(split.select("path", "line", "text"), facets.select("facet", "keywords")).join(sources.select("path", "depth", "entry"), "path")
    lines = lines.join(F.broadcast(facets.select("facet", "hints")), "facet").withColumn("hint", hinted(F.col("path"), F.col("hints"))).drop("hints")
    n = lines.groupBy("facet", "path", "depth", "entry", "hint").agg(F.count_if(F.col("hits") > 0).alias("keyword_lines"))
    level = F.when(F.col("keyword_lines") > 0, 0).when(F.col("hint"), 1).when(F.col("entry"), 2)
    n = n.withColumn("level", level).where("level IS NOT NULL")
    by = Window.partitionBy("facet")
    n = n.withColumn("least", F.min("level").over(by)).where("level = least")
    weight = F.when(F.col("level") == 0, F.col("keyword_lines") + F.when(F.col("hint"), HINT_WEIGHT).otherwise(0)).otherwise(0)
    order = by.orderBy(F.desc(weight), F.desc("hint"), F.desc("entry"), "depth", "path")
    files = n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    files = files.withColumn("n_files", F.count("*").over(by)).select("facet", "path", "place", "n_files", "keyword_lines", "hint")
    return files, lines.join(files.select("facet", "path"), ["facet", "path"], "left_semi").select("facet", "path", "line", "excerpt", "hits", "score")


def drafts(sources: DataFrame, facets: DataFrame, most: int = V.LINES) -> DataFrame:
    """facet, k, question, files, evidence (file, line, excerpt): for each facet with evidence, `most` lines in all, equally
    many of each file, a file's in line order; files without a quoted line aren't cited."""
    files, lines = ranked(sources, facets)
    x = lines.join(files, ["facet", "path"])
    both = Window.partitionBy("facet", "path")
    x = x.withColumn("_k", F.max(F.when(F.col("hits") > 0, 1).otherwise(0)).over(both)).where((F.col("hits") > 0) | (F.col("_k") == 0))
    x = x.withColumn("_r", F.row_number().over(both.orderBy(F.desc("score"), "line"))).where(F.col("_r") <= F.ceil(F.lit(most) / F.col("n_files")))
    x = x.withColumn("_o", F.row_number().over(Window.partitionBy("facet").orderBy("place", "line"))).where(F.col("_o") <= most)
    got = x.groupBy("facet").agg(F.array_sort(F.collect_list(F.struct("_o", F.struct(F.col("path").alias("file"), "line", "excerpt").alias("e")))).alias("rows"))
    got = got.join(F.broadcast(facets.select("facet", "k", "question")), "facet").withColumn("evidence", F.transform("rows", lambda r: r["e"]))
    return got.select("facet", "k", "question", F.array_distinct(F.transform("evidence", lambda e: e["file"])).alias("files"), "evidence")


def bootstrap(facet_map: DataFrame, sources: DataFrame, facets: DataFrame) -> DataFrame:
    """Drafts for the facets of a map (facet, status) that are missing or drifted; nothing is changed."""
    open_ = facet_map.where("status IN ('missing', 'drifted')").select("facet")
    return drafts(sources, facets.join(open_, "facet", "left_semi"))


def heal(entries: DataFrame, facet_map: DataFrame, fresh: DataFrame, sources: DataFrame, facets: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, pruned, drafts): the entries without those of drifted facets, what went (facet, k, id, missing, stale), and
    drafts for missing and drifted facets. dry_run: the entries stay."""
    gone = facet_map.where("status = 'drifted' AND id IS NOT NULL").select("facet", "id").join(fresh.select("id", "missing", "stale"), "id")
    gone = gone.join(facets.select("facet", "k"), "facet").select("facet", "k", "id", "missing", "stale")
    left = entries if dry_run else entries.join(gone.select("id"), "id", "left_anti")
    return left, gone, bootstrap(facet_map, sources, facets)


def backing_error(files: Column, known: Column) -> Column:
    """INVALID_BACKING_FILES where a facet's entry cites no file, or one that isn't in `known` (those cited that are there)."""
    return F.when(files.isNull() | (F.size(files) == 0) | (F.size(F.array_except(files, known)) > 0), "INVALID_BACKING_FILES")


def validated(new: DataFrame, files: DataFrame) -> DataFrame:
    """new (id, question, files) with error: facet entries must cite files, and only such as are there."""
    cited = new.select("id", F.explode("files").alias("file")).join(files.select("file").distinct(), "file", "left_semi")
    known = cited.groupBy("id").agg(F.collect_set("file").alias("_known"))
    facet = F.coalesce(F.col("question").rlike(r"(?i)\[facet:[a-z_]+\]"), F.lit(False))
    r = new.join(known, "id", "left")
    return r.select(*new.columns, F.when(facet, backing_error(F.col("files"), F.coalesce("_known", F.array().cast("array<string>")))).alias("error"))
