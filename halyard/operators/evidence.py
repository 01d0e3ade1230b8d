"""Evidence lines for facets: code lines that name a facet's keywords, ranked per file and facet.

Plain expressions over lines; only the multi-line import list needs the running state of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.text import line_words

EXCERPT, LINES, FILES = 240, 6, 3
IMPORT = r"^(import\b|export\s+(type\s+)?[*{]|from\s+\S+\s+import\b|use\s|package\s|#include\b|(const|let|var)\s+[^=]+=\s*require\s*\(|require\s*\()"
COMMENT = "^(//|/\\*|\\*|#|\"\"\"|''')"
EXPORTED = (
    r"^\s*export\s+(default\s+)?(declare\s+)?(abstract\s+)?(async\s+)?(class|const|enum|function|interface|let|type|var)\b|^\s*(module\.)?exports\b|^(async\s+)?def\s+[A-Za-z]|^class\s+[A-Za-z]"
    r"|^func\s+(\([^)]*\)\s*)?[A-Z]|^type\s+[A-Z]|^\s*pub(\([^)]*\))?\s+(async\s+)?(const|enum|fn|struct|trait|type)\b"
)


def code_only(line: Column) -> Column:
    """The line with string and template literals blanked."""
    return F.regexp_replace(line, r""""(\\.|[^"\\])*"|'(\\.|[^'\\])*'|`(\\.|[^`\\])*`""", " ")


def code_lines(lines: DataFrame) -> DataFrame:
    """The lines (path, line, text) that are code: no blanks, comments, imports, or rows of an open import list."""
    t = F.trim("text")
    n = lambda c: F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))
    x = lines.withColumn("t", t).withColumn("imp", F.col("t").rlike(IMPORT) & ~F.col("t").rlike(COMMENT))
    opens = F.when(F.col("imp") & (n("{") > n("}")), "}").when(F.col("imp") & (n("(") > n(")")), ")")
    x = x.withColumn("opens", opens)
    w = Window.partitionBy("path").orderBy("line")
    # an opener counts until the first later line with its closer; nested openers inside a list are part of the list
    x = x.withColumn("from", F.last(F.when(F.col("opens").isNotNull(), F.struct("line", "opens")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    shut = F.max(F.when(F.contains("t", F.col("from.opens")), F.col("line"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("shut", shut)
    inside = F.col("from").isNotNull() & (F.coalesce("shut", F.lit(0)) <= F.col("from.line"))
    return x.where((F.col("t") != "") & ~F.col("t").rlike(COMMENT) & ~F.col("imp") & ~inside).select("path", "line", "text", "t")


def evidence(lines: DataFrame, facets: DataFrame) -> DataFrame:
    """facet, path, line, excerpt, hits, score: lines that name a keyword (as a prefix of a word) or export a declaration.

    facets: facet, keywords (array): a list that fits in a task, all of it counts. Repeated excerpts of a file count once, at their first line.
    """
    x = code_lines(lines).withColumn("words", line_words(code_only(F.col("t"))))
    x = x.join(F.broadcast(facets))
    hits = F.size(F.filter("keywords", lambda k: F.exists("words", lambda w: F.startswith(w, k))))
    exported = F.col("text").rlike(EXPORTED)
    x = x.withColumn("hits", hits).where((F.col("hits") > 0) | exported).withColumn("excerpt", F.substring("t", 1, EXCERPT))
    x = x.withColumn("score", F.col("hits") + F.when(exported, 2).otherwise(0))
    first = Window.partitionBy("facet", "path", "excerpt").orderBy("line")
    return x.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("facet", "path", "line", "excerpt", "hits", "score")


def selected(found: DataFrame, most: int = LINES) -> DataFrame:
    """The best `most` lines of each file and facet: keyword lines if there are any, by score, then line."""
    both = Window.partitionBy("facet", "path")
    k = found.withColumn("_k", F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).over(both)).where((F.col("hits") > 0) | (F.col("_k") == 0))
    return k.withColumn("_r", F.row_number().over(both.orderBy(F.desc("score"), "line"))).where(f"_r <= {most}").drop("_r", "_k")


def ranked_files(found: DataFrame, most: int = FILES) -> DataFrame:
    """facet, rank, path, keyword_lines: the files with the most keyword lines per facet, then the shallower, then by path."""
    n = found.where("hits > 0").groupBy("facet", "path").agg(F.count("*").alias("keyword_lines"))
    w = Window.partitionBy("facet").orderBy(F.desc("keyword_lines"), F.size(F.split("path", "/")), "path")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).select("facet", "rank", "path", "keyword_lines")
