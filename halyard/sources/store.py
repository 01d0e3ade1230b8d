"""The store of charted notes: versioned Parquet folders beside a small config file.

Each change writes a whole new version and nothing else; readers take the latest version that was written to its end, so a
failed writer leaves the store as it was. A store that isn't there, or that embeds, refuses to answer.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.text import facet_question, unique_files
from halyard.operators import memory

SCHEMA = "id string, at string, question string, details string, files array<struct<file: string, sha256: string>>"


class StoreError(ValueError):
    """A refusal; the code comes first."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, store: str) -> list[int]:
    """The numbers of the complete versions."""
    fs, p = _fs(spark, f"{store}/entries")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[8:]) for n in names if re.fullmatch(r"version=\d+", n) and _exists(spark, f"{store}/entries/{n}/_SUCCESS"))


def config(spark: SparkSession, store: str) -> dict | None:
    """The store's config; None where there is none; raises STORE_CONFIG_CORRUPT."""
    fs, p = _fs(spark, f"{store}/config.json")
    if not fs.exists(p):
        return None
    raw = "\n".join(r.value for r in spark.read.text(f"{store}/config.json").collect())  # one small file
    try:
        got = json.loads(raw)
    except ValueError:
        raise StoreError("STORE_CONFIG_CORRUPT") from None
    return got if isinstance(got, dict) else {}


def initialise(spark: SparkSession, store: str) -> None:
    """Make an empty lexical store; one that is there stays as it is."""
    if config(spark, store) is not None:
        return
    write(spark.createDataFrame([], SCHEMA), store)
    fs, p = _fs(spark, f"{store}/config.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"embedding": False}).encode()))
    out.close()


def check_lexical(spark: SparkSession, store: str) -> None:
    """Raises where the store isn't there, or isn't a lexical one."""
    got = config(spark, store)
    if got is None:
        raise StoreError("STORE_UNINITIALIZED", store)
    if got.get("embedding") is not False:
        raise StoreError("NON_DETERMINISTIC_MODE", store)


def read(spark: SparkSession, store: str) -> DataFrame:
    """The entries of the latest version."""
    got = versions(spark, store)
    return spark.read.schema(SCHEMA).parquet(f"{store}/entries/version={got[-1]}") if got else spark.createDataFrame([], SCHEMA)


def write(entries: DataFrame, store: str) -> int:
    """Write the entries as the next version; gives its number."""
    spark = entries.sparkSession
    n = (versions(spark, store) or [0])[-1] + 1
    entries.select("id", "at", "question", "details", "files").write.mode("overwrite").parquet(f"{store}/entries/version={n}")
    return n


def cited(entries: DataFrame) -> DataFrame:
    """id, file, sha256 of what entries cite."""
    return entries.select("id", F.explode("files").alias("f")).select("id", "f.file", "f.sha256")


def publish(spark: SparkSession, store: str, new: DataFrame, stored: DataFrame, facets: list[str], at: str) -> DataFrame:
    """Chart new (question, details, facet, files) and write a version; returns the charted rows, with id and error.

    Questions get one canonical tag; files are normalised and their digests recorded; facet entries must cite files that are
    there, and take the place of the facet's earlier ones. Rows with an error aren't charted. Makes the store if need be.
    """
    initialise(spark, store)
    check_lexical(spark, store)
    q, u = facet_question(F.col("question"), F.col("facet"), facets), unique_files(F.col("files"))
    n = new.select(q.alias("q"), F.trim("details").alias("details"), u.alias("u")).select("q.question", "q.facet", "details", F.coalesce("q.error", "u.error").alias("error"), F.coalesce("u.files", F.array().cast("array<string>")).alias("names"))
    bare = F.trim(F.regexp_replace("question", r"^\[FACET:[A-Z_]+\]", ""))
    long = (F.length(bare) > 240) | ((F.length(bare) == 0) & F.col("facet").isNull()) | ~F.length("details").between(1, 4000)
    n = n.withColumn("error", F.coalesce("error", F.when(long, "TEXT_LIMIT"))).withColumn("id", F.substring(F.sha2(F.concat_ws("\0", F.coalesce("question", F.lit("")), "details", F.array_join("names", "\0")), 256), 1, 8))
    found = n.select("id", F.explode("names").alias("file")).join(stored.select("file", "sha256"), "file").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("files"))
    n = n.join(found, "id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<struct<file: string, sha256: string>>")))
    lacking = F.col("facet").isNotNull() & ((F.size("names") == 0) | (F.size("files") < F.size("names")))
    n = n.withColumn("error", F.coalesce("error", F.when(lacking, "INVALID_BACKING_FILES")))
    good = n.where("error IS NULL").select("id", F.lit(at).alias("at"), "question", "details", "files").dropDuplicates(["id"])
    write(memory.chart(read(spark, store), good, question_limit=260), store)
    return n.select("id", "question", "facet", "error")


def unchart(spark: SparkSession, store: str, ids: DataFrame, if_exists: bool = False) -> int:
    """Remove entries by id and write a version; raises UNKNOWN_ID for those that aren't there, unless `if_exists`."""
    old = read(spark, store)
    if not if_exists and ids.select("id").join(old.select("id"), "id", "left_anti").limit(1).count():
        raise StoreError("UNKNOWN_ID")
    return write(memory.unchart(old, ids), store)


def listed(spark: SparkSession, store: str, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, notices): prunes first; a notice (id, text) says what went and why. A store that isn't there lists nothing."""
    old = read(spark, store)
    gone = memory.described(old, memory.freshness(old, cited(old), stored))
    left = memory.prune(old, cited(old), stored)
    if versions(spark, store) and gone.limit(1).count():
        write(left, store)
    return left, gone


def recall(spark: SparkSession, store: str, questions: DataFrame, stored: DataFrame) -> DataFrame:
    """qid, id, score, reason: the charted answer of each question: the same question, else the best by BM25 that shares a
    content term. Stale entries don't answer. A store that isn't there, or embeds, gives its reason for every question."""
    try:
        check_lexical(spark, store)
    except StoreError as e:
        return questions.select("qid", F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(e.code).alias("reason"))
    e = read(spark, store)
    fresh = memory.freshness(e, cited(e), stored)
    hit = memory.exact(questions, e, fresh).select("qid", "id", F.col("score").cast("double").alias("score"))
    rest = questions.join(hit.select("qid"), "qid", "left_anti")
    body = e.join(fresh.where("fresh").select("id"), "id", "left_semi").select("id", F.concat_ws(" ", "question", "details", F.array_join(F.transform("files", lambda f: f["file"]), " ")).alias("body"))
    near = memory.bm25(rest, body, 1).select("qid", "id", "score")
    got = hit.unionByName(near)
    return questions.select("qid").join(got, "qid", "left").select("qid", "id", "score", F.when(F.col("id").isNull(), "NO_CHARTED_MEMORY").alias("reason"))


def migrate(spark: SparkSession, source: str, store: str) -> int:
    """Copy the entry files (*.md) of an older lexical store into this one; gives their number. The source is only read.

    Refuses a source that is this store (MIGRATE_SOURCE_INVALID), isn't lexical (MIGRATE_SOURCE_NOT_LEXICAL), or holds
    files that aren't entries (MIGRATE_SOURCE_INVALID), and a store that has entries (MIGRATE_DESTINATION_NOT_EMPTY).
    """
    from halyard.sources.repository import charted_entries

    plain = lambda p: p.removeprefix("file:").rstrip("/").replace("//", "/") + "/"
    if plain(source).startswith(plain(store)):
        raise StoreError("MIGRATE_SOURCE_INVALID", "the source is the store itself")
    try:
        got = config(spark, source)
    except StoreError:
        got = None
    if got is None or got.get("embedding") is not False:
        raise StoreError("MIGRATE_SOURCE_NOT_LEXICAL", source)
    old = charted_entries(spark, f"{source}/entries") if _exists(spark, f"{source}/entries") else None
    files = spark.read.text(f"{source}/entries", wholetext=True, pathGlobFilter="*.md").count() if old is not None else 0
    if old is not None and (files != old.count() or old.where(~F.col("id").rlike("^[0-9a-f]{8}$")).limit(1).count()):
        raise StoreError("MIGRATE_SOURCE_INVALID", "files that aren't entries")
    if read(spark, store).limit(1).count():
        raise StoreError("MIGRATE_DESTINATION_NOT_EMPTY", store)
    initialise(spark, store)
    if old is None:
        return 0
    write(old.select("id", "at", "question", "details", F.transform("files", lambda f: F.struct(f.alias("file"), F.col("hashes")[f].alias("sha256"))).alias("files")), store)
    return files
