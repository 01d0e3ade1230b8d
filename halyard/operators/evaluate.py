"""Baselines by plain search, comparisons with them, and the scoreboard of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.text import js_round, normalized_path


def grep(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """query, path, line, text: lines that contain a query, case aside; `queries` is a list that fits in a task, and all of it counts."""
    return lines.join(F.broadcast(queries.select("query")), F.contains(F.lower("text"), F.lower("query")))


def baseline(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """query, total_matches, files, estimated_tokens (a quarter of the matched characters, rounded up)."""
    m = grep(lines, queries).groupBy("query").agg(F.count("*").alias("m"), F.countDistinct("path").alias("f"), F.sum(F.length("text")).alias("c"))
    r = queries.select("query").join(m, "query", "left")
    return r.select("query", F.coalesce("m", F.lit(0)).alias("total_matches"), F.coalesce("f", F.lit(0)).alias("files"), F.ceil(F.coalesce("c", F.lit(0)) / 4).alias("estimated_tokens"))


def comparison(pairs: DataFrame) -> DataFrame:
    """query, speedup_factor, noise_reduction_ratio, token_savings_pct; each 0 (speed-up: 1) where there is no gain to state.

    pairs: query, ms, matches, tokens and base_ms, base_matches, base_tokens.
    """
    gain = lambda base, own: F.when(F.col(base) > F.col(own), js_round((F.col(base) - F.col(own)) / F.col(base) * 1000) / 1000).otherwise(0.0)
    speed = F.when(F.col("ms") > 0, js_round(F.col("base_ms") / F.col("ms") * 100) / 100).otherwise(1.0)
    return pairs.select("query", speed.alias("speedup_factor"), gain("base_matches", "matches").alias("noise_reduction_ratio"), gain("base_tokens", "tokens").alias("token_savings_pct"))


def routing_matches(actual: Column, expected: Column) -> Column:
    """An expectation that is unset fits anything; `symbol` stands for the structural index."""
    return F.when(expected.isNull() | (expected == ""), True).otherwise(actual == F.when(expected == "symbol", "structure").otherwise(expected))


def covers(actual: Column, expected: Column) -> Column:
    """True where every expected name is among the actual ones."""
    return F.size(F.array_except(F.coalesce(expected, F.array().cast("array<string>")), actual)) == 0


def scoreboard(reports: DataFrame) -> DataFrame:
    """One row: totals, drift counts, averages over the reports that have the figure.

    reports: passed, drift, duration_ms, noise_ratio (null without a baseline), savings_pct.
    """
    mean = lambda c, cond: F.coalesce(js_round(F.avg(F.when(cond, c)) * 10) / 10, F.lit(0.0))
    of = lambda s: F.count_if(F.col("drift") == s)
    known = ["VERIFIED_EXACT", "VERIFIED_DRIFTED", "STALE_OR_MODIFIED"]
    return reports.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), *[of(s).alias(s.lower()) for s in known],
        F.count_if(F.col("drift").isNull() | ~F.col("drift").isin(known)).alias("na"), mean(F.col("duration_ms"), F.lit(True)).alias("average_duration_ms"),
        mean(F.col("noise_ratio") * 100, F.col("noise_ratio").isNotNull()).alias("average_noise_reduction_pct"), mean(F.col("savings_pct"), F.col("savings_pct") > 0).alias("average_token_savings_pct"),
    )


def exact_grep(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """query, path, line, text: lines that contain a query as it stands, files with a NUL (binary ones) left out; `queries` is
    a list that fits in a task, and all of it counts."""
    binary = lines.where(F.contains("text", F.lit("\0"))).select("path").distinct()
    return lines.join(binary, "path", "left_anti").join(F.broadcast(queries.select("query")), F.contains("text", F.col("query"))).select("query", "path", "line", F.trim("text").alias("text"))


def chosen(prompts: DataFrame, id: str | None = None, category: str | None = None) -> DataFrame:
    """The prompts of an id, and of a category that holds `category`, case aside."""
    p = prompts if id is None else prompts.where(F.col("id") == id)
    return p if category is None else p.where(F.contains(F.lower("category"), F.lit(category.lower())))


def reported_path(path: Column) -> Column:
    """The path within the repository; null for what is empty, absolute or leads out of it."""
    n = normalized_path(path)
    return F.when(n["error"].isNull(), n["path"])


def matches_file(actual: Column, expected: Column) -> Column:
    """An unset expectation fits anything; else both must be paths of the repository, and equal."""
    return expected.isNull() | F.coalesce(reported_path(actual) == reported_path(expected), F.lit(False))


def contains_symbol(answer: Column, symbol: Column) -> Column:
    """True where a text holds the symbol as a whole word."""
    quoted = F.concat(F.lit(r"(^|[^\p{L}\p{N}_$])\Q"), F.replace(symbol, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E($|[^\p{L}\p{N}_$])"))
    return F.coalesce(F.rlike(answer, quoted), F.lit(False))


def names_in(answer: Column) -> Column:
    """The values of all `name` fields of an answer in JSON, wherever they are."""
    return F.regexp_extract_all(answer, F.lit(r'"name"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))


def graph_names(answer: Column, direction: str) -> Column:
    """The names after `callers:` or `callees:` in a flat listing; none for None; null where there is no such line."""
    line = F.regexp_extract_all(answer, F.lit(rf"(?im)^{direction}:[ \t]*([^\n]*)$"), F.lit(1))
    names = F.filter(F.transform(F.split(F.try_element_at(line, F.lit(1)), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(line) > 0, F.when(F.trim(F.try_element_at(line, F.lit(1))) == "None", F.array().cast("array<string>")).otherwise(names))


def target_symbol(query: Column) -> Column:
    """The name that a question asks about; null where none follows the words that ask."""
    return F.nullif(F.regexp_extract(query, r"(?i)\b(?:callees of|definition of|trace|where is|who calls)\s+([\p{L}_$][\p{L}\p{N}_$]*)", 1), F.lit(""))


def path_in_text(text: Column) -> Column:
    """The first path of a source file in a text; null where there is none."""
    return F.nullif(F.replace(F.regexp_extract(text, r"(?i)(?:^|\s)((?:[\w.-]+[\\/])*[\w.-]+\.(?:cjs|js|json|jsx|md|mjs|py|ts|tsx))(?:\s|\z)", 1), F.lit("\\"), F.lit("/")), F.lit(""))


def histogram(reports: DataFrame) -> DataFrame:
    """classification, count."""
    return reports.groupBy("classification").agg(F.count("*").alias("count"))


def at_rank(values: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """key, value at place floor(n * share) of the sorted values (the last at most), without interpolation; nulls don't count.

    From counts per distinct value and their running sums; no key's values are gathered.
    """
    n = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    total = n.groupBy(key).agg(F.sum("c").alias("n"))
    upto = n.withColumn("upto", F.sum("c").over(Window.partitionBy(key).orderBy(value)))
    place = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return upto.join(total, key).where(F.col("upto") > place).groupBy(key).agg(F.min(value).alias("value"))
