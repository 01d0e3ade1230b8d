"""Call-graph traversal for batches of roots: level by level, one loop of joins for all roots at once.

Each level is one join of the frontier with the edges, an anti join with what was seen, and a cut of the lineage. With a
cap, a root keeps its first nodes by (parent's place, node name), the root counting as one, and is marked truncated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.plans.cut import cut

MAX_DEPTH, CAP = 5, 50


def traverse(roots: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "callers", cap: int | None = None) -> DataFrame:
    """qid, direction, depth, parent, node, place of every node reached, roots at depth 0; `truncated` per root with a cap.

    roots: qid, node. edges: src calls dst. depth is clamped to 1..MAX_DEPTH. Visited nodes are shared by both directions;
    callers come before callees at each level.
    """
    depth = min(max(depth, 1), MAX_DEPTH)
    ways = {"callers": ["callers"], "callees": ["callees"], "both": ["callers", "callees"]}[direction]
    start = roots.select("qid", "node").distinct().select("qid", F.lit("root").alias("direction"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), "node", F.lit(1).cast("long").alias("place"))
    seen = cut(start)
    fronts = dict.fromkeys(ways, seen)
    cut_off = None
    for level in range(1, depth + 1):
        for way in ways:
            here, there = ("dst", "src") if way == "callers" else ("src", "dst")
            hop = fronts[way].select("qid", F.col("node").alias("parent"), "place").join(edges.select(F.col(here).alias("parent"), F.col(there).alias("node")), "parent")
            hop = hop.groupBy("qid", "node").agg(F.min(F.struct("place", "parent")).alias("m")).join(seen.select("qid", "node"), ["qid", "node"], "left_anti")
            hop = hop.select("qid", F.lit(way).alias("direction"), F.lit(level).alias("depth"), F.col("m.parent").alias("parent"), "node", F.col("m.place").alias("from"))
            order = Window.partitionBy("qid").orderBy("from", "node")
            if cap is None:
                hop = hop.withColumn("place", F.col("from"))  # no order among nodes is needed
            else:
                had = seen.groupBy("qid").agg(F.count("*").alias("had"))
                hop = hop.withColumn("_r", F.row_number().over(order)).where(f"_r <= {cap}").join(had, "qid").withColumn("place", F.col("had") + F.col("_r"))
                over = hop.where(F.col("place") > cap).select("qid").distinct()
                cut_off = over if cut_off is None else cut_off.union(over)
                hop = hop.where(F.col("place") <= cap)
            fresh = cut(hop.select("qid", "direction", "depth", "parent", "node", "place"))
            fronts[way] = fresh
            seen = seen.unionByName(fresh)
    if cap is None:
        return seen
    marks = cut_off.distinct().withColumn("truncated", F.lit(True))
    return seen.join(marks, "qid", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def flat(names: DataFrame, edges: DataFrame) -> DataFrame:
    """node, callers_total, callees_total, and both lists comma-joined in order ("None" where empty)."""
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("callers_total"), F.array_join(F.array_sort(F.collect_set("src")), ", ").alias("callers"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("callees_total"), F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("callees"))
    r = names.select("node").distinct().join(ins, "node", "left").join(outs, "node", "left")
    return r.select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers_total", "callees_total")], *[F.coalesce(c, F.lit("None")).alias(c) for c in ("callers", "callees")])
