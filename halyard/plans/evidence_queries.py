"""Queries over facet evidence, and texts rendered from answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import evidence as V
from halyard.operators import graph
from halyard.sources import corpus as C

WORDS = {"lifecycle": ["the", "un", "la"], "failure": ["er", "ion", "re"], "none": ["zzz"]}


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return V.evidence(C.lines(spark, folder), spark.createDataFrame(list(WORDS.items()), "facet string, keywords array<string>"))


def facet_evidence(spark: SparkSession, folder: str) -> DataFrame:
    got = V.selected(_found(spark, folder))
    return got.select("facet", "path", F.col("line").cast("long").alias("line"), F.sha2("excerpt", 256).alias("excerpt_sha"), F.col("hits").cast("long").alias("hits"), F.col("score").cast("long").alias("score"))


def facet_files(spark: SparkSession, folder: str) -> DataFrame:
    return V.ranked_files(_found(spark, folder))


def render_flat_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The flat listing of callers and callees, as text."""
    e = C.edges(spark, folder)
    g = graph.flat(e.select(F.col("src").alias("node")).union(e.select("dst")), e)
    text = F.concat(F.lit("function: "), "node", F.lit("\ndirection: both\ncallees_total: "), F.col("callees_total").cast("string"), F.lit("\ncallees: "), "callees", F.lit("\ncallers_total: "), F.col("callers_total").cast("string"), F.lit("\ncallers: "), "callers")
    return g.select("node", text.alias("text"))


ORACLES = {
    "render_flat_graph": f"""WITH {C.EDGES_SQL}, e AS (SELECT * FROM edges), n AS (SELECT src node FROM e UNION SELECT dst FROM e),
 i AS (SELECT dst node, count(DISTINCT src) c, string_agg(DISTINCT src, ', ' ORDER BY src) l FROM e GROUP BY dst), o AS (SELECT src node, count(DISTINCT dst) c, string_agg(DISTINCT dst, ', ' ORDER BY dst) l FROM e GROUP BY src)
 SELECT node, 'function: ' || node || chr(10) || 'direction: both' || chr(10) || 'callees_total: ' || coalesce(o.c, 0) || chr(10) || 'callees: ' || coalesce(o.l, 'None') || chr(10) || 'callers_total: ' || coalesce(i.c, 0) || chr(10) || 'callers: ' || coalesce(i.l, 'None') AS text
 FROM n LEFT JOIN i USING (node) LEFT JOIN o USING (node)""",
}
QUERIES = {"facet_evidence": facet_evidence, "facet_files": facet_files, "render_flat_graph": render_flat_graph}
