"""A corpus pipeline of five operators; each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import invindex, mixing, simhash, tokens, toxicity
from halyard.llm.common import shared_path, ship, table, written

#: At most this many file names are listed and broadcast.
FILES = 100_000


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 for toxicity; null and empty texts are scored as texts without words, repeated rows
    alike; no rows give none; other columns stay as they are."""
    ship(spark)
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, toxicity.allowed()))


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """_key (unique) and _doc (the row as it is).

    Rows of Parquet files are keyed by file and place in it, which are the same whenever they are read; the files' numbers
    are broadcast where there are at most FILES. Other rows, and those of more files, are written with a key first.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    try:
        rows = docs.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), doc)
    except AnalysisException:  # not rows of files
        rows = None
    files = [] if rows is None else sorted(r[0] for r in rows.select("_file").distinct().limit(FILES + 1).collect())
    if rows is None or len(files) > FILES:
        rows = docs.select(F.monotonically_increasing_id().alias("_key"), doc)
        path = shared_path(docs.sparkSession, name)
        rows.write.option("compression", "zstd").parquet(path)
        return docs.sparkSession.read.schema(rows.schema).parquet(path)
    numbers = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], "_file string, _base long")
    return rows.join(F.broadcast(numbers), "_file").select((F.col("_base") + F.col("_row")).alias("_key"), "_doc")


def without(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The documents of keyed rows but those of `keys`, which are written first: where they are few the rows needn't move."""
    return rows.join(written(keys.select("_key"), name), "_key", "left_anti").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: of the smallest doc_id, rows without an id last; of equals any one.

    Rows decide by themselves, so repeated ids don't take each other along; null and empty texts are a component; no rows
    give none; other columns stay as they are.
    """
    ship(spark)
    rows = keyed(docs, "simhash-rows")
    found = simhash.near_duplicates(rows.select("_key", F.col("_doc.text").alias("text")), doc_id="_key")
    found = found.select(F.col("doc_id").alias("_key"), "component_id").join(rows.select("_key", F.col("_doc.doc_id").alias("doc_id")), "_key")
    found = written(found, "simhash-found")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("best"))
    return without(rows, found.join(best.select(F.col("best._key").alias("_key")), "_key", "left_anti"), "simhash-drop")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark window occurs, whatever their doc_id; null and empty texts stay, repeated rows fare
    alike, no rows give none, other columns stay as they are."""
    ship(spark)
    rows = keyed(docs, "decontaminate-rows")
    found = invindex.decontaminate(rows.select("_key", F.col("_doc.text").alias("text")), table(spark, sf_dir, "benchmark"), doc_id="_key")
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias("_key")), "decontaminate-drop")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: null and empty texts have no words and come at most twice, null sources
    are a source; no rows give none; other columns stay as they are."""
    ship(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and from them doc_id, start, n_tokens, ids_crc32 of every copy: null texts have the end id only, null
    ids come last, no rows give none."""
    ship(spark)
    folder = shared_path(spark, "tokens")
    return tokens.read_tokens(folder, tokens.write_tokens(docs, folder))


STAGES = [("toxicity", toxic), ("simhash", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", encode)]
ORACLE_SQL = None  # trained weights, XXH64 and tokenisation aren't in SQL; tests follow the stages by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
