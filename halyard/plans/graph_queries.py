"""Queries over the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import graph
from halyard.sources import corpus as C


def _roots(spark: SparkSession, folder: str) -> DataFrame:
    n = C.table(spark, folder, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    r = C.table(spark, folder, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return n.union(r).withColumn("qid", F.col("node"))


def callers_flat(spark: SparkSession, folder: str) -> DataFrame:
    e = C.edges(spark, folder)
    return graph.flat(e.select(F.col("src").alias("node")).union(e.select("dst")), e)


def bfs_depth(spark: SparkSession, folder: str) -> DataFrame:
    return graph.traverse(_roots(spark, folder), C.edges(spark, folder), 3, "callers").select("qid", "node", F.col("depth").cast("long").alias("depth"))


def bfs_both(spark: SparkSession, folder: str) -> DataFrame:
    got = graph.traverse(_roots(spark, folder), C.edges(spark, folder), 2, "both")
    return got.groupBy("qid", "direction", "depth").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node")).withColumn("depth", F.col("depth").cast("long"))


def bfs_capped(spark: SparkSession, folder: str) -> DataFrame:
    return graph.traverse(_roots(spark, folder), C.edges(spark, folder), 3, "callers", graph.CAP).select("qid", "node", F.col("depth").cast("long").alias("depth"), "place", "parent", "truncated")


_ROOTS = "roots AS (SELECT 'nation:' || n_nationkey qid FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region)"
_LEVEL = """h{k} AS (SELECT qid, e.src node, min({{'p': place, 'n': f.node}}) m FROM l{j} f JOIN edges e ON e.dst = f.node GROUP BY qid, e.src),
 a{k} AS (SELECT * FROM h{k} WHERE NOT EXISTS (SELECT 1 FROM s{j} s WHERE s.qid = h{k}.qid AND s.node = h{k}.node)),
 r{k} AS (SELECT qid, node, m.n parent, row_number() OVER (PARTITION BY qid ORDER BY m.p, node) + (SELECT count(*) FROM s{j} s WHERE s.qid = a{k}.qid) place FROM a{k}),
 l{k} AS (SELECT qid, {k} AS depth, node, parent, place FROM r{k} WHERE place <= 50), s{k} AS (SELECT * FROM s{j} UNION ALL SELECT * FROM l{k})"""
ORACLES = {
    "callers_flat": f"""WITH {C.EDGES_SQL}, n AS (SELECT DISTINCT src node FROM edges UNION SELECT DISTINCT dst FROM edges),
 i AS (SELECT dst node, count(DISTINCT src) c, string_agg(DISTINCT src, ', ' ORDER BY src) l FROM edges GROUP BY dst), o AS (SELECT src node, count(DISTINCT dst) c, string_agg(DISTINCT dst, ', ' ORDER BY dst) l FROM edges GROUP BY src)
 SELECT node, coalesce(i.c, 0) AS callers_total, coalesce(o.c, 0) AS callees_total, coalesce(i.l, 'None') AS callers, coalesce(o.l, 'None') AS callees FROM n LEFT JOIN i USING (node) LEFT JOIN o USING (node)""",
    "bfs_depth": f"""WITH RECURSIVE {C.EDGES_SQL}, {_ROOTS}, b AS (SELECT qid, qid node, 0 AS depth FROM roots UNION SELECT qid, e.src, depth + 1 FROM b JOIN edges e ON e.dst = b.node WHERE depth < 3)
 SELECT qid, node, CAST(min(depth) AS BIGINT) AS depth FROM b GROUP BY qid, node""",
    "bfs_both": f"""WITH RECURSIVE {C.EDGES_SQL}, {_ROOTS}, b AS (SELECT qid, qid node, 0 AS depth, 'root' d FROM roots UNION SELECT qid, CASE WHEN d2 = 'callers' THEN e.src ELSE e.dst END, depth + 1, d2 FROM b, (VALUES ('callers'), ('callees')) v(d2), edges e
   WHERE depth < 2 AND (d = 'root' OR d = d2) AND CASE WHEN d2 = 'callers' THEN e.dst ELSE e.src END = b.node),
 f AS (SELECT qid, node, arg_min(d, depth) d, min(depth) depth FROM b GROUP BY qid, node) SELECT qid, d AS direction, CAST(depth AS BIGINT) AS depth, count(*) AS n_nodes, min(node) AS first_node FROM f GROUP BY ALL""",
    "bfs_capped": f"""WITH {C.EDGES_SQL}, {_ROOTS}, l0 AS (SELECT qid, 0 AS depth, qid AS node, CAST(NULL AS VARCHAR) AS parent, 1 AS place FROM roots), s0 AS (SELECT * FROM l0),
 {_LEVEL.format(k=1, j=0)}, {_LEVEL.format(k=2, j=1)}, {_LEVEL.format(k=3, j=2)},
 t AS (SELECT qid FROM r1 WHERE place > 50 UNION SELECT qid FROM r2 WHERE place > 50 UNION SELECT qid FROM r3 WHERE place > 50)
 SELECT qid, node, CAST(depth AS BIGINT) AS depth, CAST(place AS BIGINT) AS place, parent, qid IN (SELECT qid FROM t) AS truncated FROM s3""",
}
QUERIES = {"callers_flat": callers_flat, "bfs_depth": bfs_depth, "bfs_both": bfs_both, "bfs_capped": bfs_capped}
