"""Operators over outlines: filters, section ends, row names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions import outlines


def by_name(symbols: DataFrame, part: str) -> DataFrame:
    """The symbols whose name holds `part`, case aside."""
    return symbols.where(F.contains(F.lower("name"), F.lit(part.lower())))


def any_term(name: Column, terms: Column) -> Column:
    """True where a name holds one of the terms, case aside, or there are no terms."""
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(F.lower(name), F.lower(t)))


def section_ends(headings: DataFrame, levels: int = 6) -> DataFrame:
    """headings (path, line, level, last_line) with end: the line before the next heading of its level or above, else last_line.

    One window per path; no self-join.
    """
    w = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(w) for k in range(1, levels + 1)]
    h = headings.withColumn("_next", F.array(*nexts))
    return h.withColumn("end", F.coalesce(F.element_at("_next", F.col("level").cast("int")) - 1, F.col("last_line"))).drop("_next")


def discover(files: DataFrame, part: str | None = None) -> DataFrame:
    """path, name, kind, start_line, start_column, end_line, end_column, error: the outlines of files (path, text).

    A file that has none for a reason gives one row with its error code.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                try:
                    rows += [(path, s.name, s.kind, s.start, s.column, s.end, s.end_column, None) for s in outlines.outline(path, text or "", part)]
                except outlines.OutlineError as e:
                    rows.append((path, None, None, None, None, None, None, e.code))
            got = pd.DataFrame(rows, columns=["path", "name", "kind", "start_line", "start_column", "end_line", "end_column", "error"])
            yield got.astype({c: "Int64" for c in ("start_line", "start_column", "end_line", "end_column")})

    return files.select("path", "text").mapInPandas(run, "path string, name string, kind string, start_line long, start_column long, end_line long, end_column long, error string")
