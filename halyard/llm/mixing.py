"""Mixing sources to target weights.

Sizes (words) are summed per source, targets follow by filling up to caps, and each document is taken floor(rate) times
plus one Bernoulli copy with the fraction as its probability, drawn from a hash of its id. Of DRAWS seeds each source
uses the one whose draw comes nearest to its target (the first of equals), so reruns agree and small sources don't stray.

Only sums and counts come to the driver. Sources are joined by broadcast when there are at most MANY of them, counted
first; else by a salted shuffle join.

Cases: null text has size 0; a null source is a source of its own, last in order; a null id draws as the text "null";
repeated rows draw alike; size 0 has target 0; an empty table gives an empty result; other columns stay (mixed) or are
ignored (plan), and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.llm.common import salted_lookup, table, written

WEIGHTS, SHARE, CAP, DRAWS, MANY = (5, 2, 1), 1.5, 2, 16, 10_000
TWO32 = float(1 << 32)


def size_of(text: Column) -> Column:
    """The number of runs of characters other than space and \\t to \\r."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, k: int) -> Column:
    """The k-th 32-bit draw of a document, from md5 of its id."""
    digest = F.md5(F.concat(F.lit(f"{k // 4}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, k % 4 * 8 + 1, 8), 16, 10).cast("double")


def ranked(df: DataFrame, key: str, out: str) -> DataFrame:
    """The 0-based rank of each row by `key`, nulls last, without one task that sees all rows."""
    parts = df.withColumn("_null", F.col(key).isNull()).repartitionByRange("_null", key).withColumn("_p", F.spark_partition_id())
    parts = written(parts, "ranks")
    counts = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())  # one row a partition
    before, rows = 0, []
    for p, c in counts:
        rows.append((p, before))
        before += c
    base = F.broadcast(df.sparkSession.createDataFrame(rows, "_q int, _base long"))
    row = F.row_number().over(Window.partitionBy("_p").orderBy("_null", key)) - 1
    return parts.withColumn("_row", row).join(base, F.col("_p") == F.col("_q")).withColumn(out, F.col("_base") + F.col("_row")).drop("_null", "_p", "_q", "_row", "_base")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, n, target from source, source_size, n."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    src = written(ranked(sizes, "source", "_rank").withColumn("_w", w).drop("_rank"), "sources")
    total, left_w = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    rest, capped = share * total, 0
    while True:
        even = F.col("_w") * F.lit(rest) / F.lit(max(left_w, 1))
        full = src.where(F.col("source_size") * cap < even)
        n, taken, own_w = full.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
        if n == capped:
            return src.withColumn("target", F.least((F.col("source_size") * cap).cast("double"), even)).drop("_w")
        capped, rest = n, share * total - cap * taken
        left_w = src.agg(F.sum("_w")).first()[0] - own_w


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, sources): doc_id, source, size of each row, written; source, source_size, n, target, seed."""
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), "sizes")
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "source-sizes")
    src = written(targets(sums), "targets")
    rows = attach(sized, src, sized.count())
    frac = F.col("_rate") - F.floor("_rate")
    extra = rows.withColumn("_rate", _rate()).groupBy("source").agg(*[F.sum(F.when(draw(F.col("doc_id"), k) < frac * TWO32, F.col("size")).otherwise(0)).alias(f"x{k}") for k in range(DRAWS)])
    base = F.floor(_rate()) * F.col("source_size")
    off = F.array(*[F.struct(F.abs(base + F.col(f"x{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)])
    extra = extra.withColumnRenamed("source", "_s")
    seeds = src.join(extra, src["source"].eqNullSafe(extra["_s"])).withColumn("seed", F.array_min(off)["k"])
    return sized, written(seeds.select("source", "source_size", "n", "target", "seed"), "seeds")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def attach(rows: DataFrame, src: DataFrame, total: int, key: str = "source", spread: str = "doc_id") -> DataFrame:
    """rows with the columns of their source."""
    if src.count() <= MANY:
        s = F.broadcast(src.withColumnRenamed("source", "_s"))
        return rows.join(s, rows[key].eqNullSafe(s["_s"])).drop("_s", "n")
    return salted_lookup(rows, src.withColumnRenamed("source", "_src"), key, "n", total, spread) if key == "_src" else salted_lookup(rows.withColumn("_src", F.col(key)), src.withColumnRenamed("source", "_src"), "_src", "n", total, spread).drop("_src")


def copies() -> Column:
    """How often a document is taken; needs doc_id, target, source_size, seed."""
    u = F.element_at(F.array(*[draw(F.col("doc_id"), k) for k in range(DRAWS)]), F.col("seed") + 1)
    return F.floor(_rate()) + F.when(u < (_rate() - F.floor(_rate())) * TWO32, 1).otherwise(0)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns as they are."""
    _, src = plan(docs)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id"), F.col("source"))
    rows = attach(rows, src, src.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies().cast("int"))))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in names])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, src = plan(table(spark, sf_dir, "documents"))
    rows = attach(sized, src, sized.count())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken"))


_DRAWS = ", ".join(f"CAST(('0x' || substr(md5('{k // 4}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), {k % 4 * 8 + 1}, 8)) AS BIGINT)" for k in range(DRAWS))
ORACLES = {
    "op2_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) ss FROM d GROUP BY source),
 w AS (SELECT source, ss, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] w FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * ss / w, source) k, sum(ss) OVER () tot, sum(w) OVER () sw,
   coalesce(sum(ss) OVER (ORDER BY 2.0 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) c,
   coalesce(sum(w) OVER (ORDER BY 2.0 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) cw FROM w),
 stop AS (SELECT 1.5 * CAST(tot AS DOUBLE) - 2 * CAST(c AS DOUBLE) rest, CAST(sw - cw AS DOUBLE) wl FROM o
   WHERE NOT 2.0 * ss < w * (1.5 * CAST(tot AS DOUBLE) - 2 * CAST(c AS DOUBLE)) / CAST(sw - cw AS DOUBLE) ORDER BY k LIMIT 1),
 t AS (SELECT source, ss, least(2.0::DOUBLE * ss, CAST(w AS DOUBLE) * rest / wl) target FROM w, stop),
 r AS (SELECT d.*, ss, target, CASE WHEN ss > 0 THEN target / ss ELSE 0.0::DOUBLE END rate, [{_DRAWS}] u
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 x AS (SELECT source, k, any_value(floor(rate)) * any_value(ss) + sum(CASE WHEN CAST(u[k + 1] AS DOUBLE) < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN size ELSE 0 END) got, any_value(target) target
   FROM r, range({DRAWS}) q(k) GROUP BY source, k),
 best AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(got - target), k) n FROM x) WHERE n = 1)
SELECT doc_id, size, ss AS source_size, CAST(target AS DOUBLE) AS target,
 CAST(size * (floor(rate) + CASE WHEN CAST(u[k + 1] AS DOUBLE) < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN best ON r.source IS NOT DISTINCT FROM best.source"""
}
QUERIES = {"op2_mixing": op2_mixing}
