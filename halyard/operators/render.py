"""Answers as text: envelopes, outlines, call trees, the facet map, session events. Column expressions and grouped joins;
only call trees and lists whose length is capped by their operator are gathered into one row.

Nulls are absent parts of a text; an empty table gives no text rows, except where a text says that there is nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.text import js_round
from halyard.operators.session import WHOLE_FILE

STEPS = ("ast", "path", "fuzzy", "memory", "total")


def clean_name(name: Column) -> Column:
    """A name that can't break its line."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\r\n]+\z", ""), r"[\r\n]+", " ")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def optional(before: str, value: Column, after: str = "") -> Column:
    """before, value, after; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(before), value.cast("string"), F.lit(after)), F.lit(""))


def timings(ms: Column) -> Column:
    """`ast: 3ms | total: 5ms` of a map from step to milliseconds, in the order of the steps."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{s}: "), ms[s].cast("string"), F.lit("ms")) for s in STEPS])


def diagnostics(tiers: Column, remote: Column, sound: Column) -> Column:
    """One line for developers: the tiers asked, where, and whether the invariants held."""
    where = F.coalesce(F.concat(F.lit(" | ipc: "), F.when(remote.cast("boolean"), "daemon").when(~remote.cast("boolean"), "in-process")), F.lit(""))
    return F.concat(F.lit("[dev] tiers: ["), F.array_join(tiers, " -> "), F.lit("]"), where, F.when(F.coalesce(sound.cast("boolean"), F.lit(False)), " | invariants: OK").otherwise(" | invariants: FAILED"))


def answer(status: Column, provider: Column, name: Column, path: Column, line: Column, score: Column, confidence: Column, shape: Column, tokens: Column, reason: Column, pruned: Column) -> Column:
    """The text of a hit, a junction or a miss; pruned: notes removed on the way (array, may be null)."""
    place = F.concat(path, F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")))
    told = optional(" (score: ", score, ")")
    detail = F.when(provider == "fuzzy-lexical", F.concat(clean_name(name), F.lit(" -> "), place, told)).otherwise(F.concat_ws(" ", name, place))
    hit = F.concat(F.lit("[hit: "), provider, F.lit("]"), optional(" (confidence: ", confidence, ")"), F.lit("\n"), detail)
    signal = F.when(shape.isNotNull(), F.concat(F.lit("\nSignal: "), shape, F.when(F.size(tokens) > 0, F.concat(F.lit(" ("), F.array_join(tokens, ", "), F.lit(")"))).otherwise(""))).otherwise("")
    junction = F.concat(F.lit("[junction] Recommended: "), F.coalesce(provider, F.lit("unknown")), signal, F.when(name.isNotNull(), F.concat(F.lit("\nResult: "), clean_name(name), F.coalesce(F.concat(F.lit(" in "), place), F.lit("")), told)).otherwise(""))
    gone = F.when(F.size(pruned) > 0, F.concat(F.lit("\n[memory] pruned stale entries: "), F.array_join(pruned, "; "))).otherwise("")
    miss = F.concat(F.lit("[miss] "), F.coalesce(reason, F.lit("No match")))
    return F.concat(F.when(status == "hit", hit).when(status == "junction", junction).otherwise(miss), gone)


def symbol_line(name: Column, kind: Column, start: Column, end: Column) -> Column:
    """`name: kind L3-L9` of an outline."""
    return F.concat(clean_name(name), F.lit(": "), kind, F.lit(" L"), start.cast("string"), F.when(end != start, F.concat(F.lit("-L"), end.cast("string"))).otherwise(""))


def outlines(symbols: DataFrame) -> DataFrame:
    """path, text: the outline of each file (path, name, kind, start_line, end_line), in line order; an outline is of one
    file, whose size its extractor bounds."""
    line = symbol_line(F.col("name"), F.col("kind"), F.col("start_line"), F.col("end_line"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name", line.alias("t")))), lambda x: x["t"])
    g = symbols.groupBy("path").agg(F.count("*").alias("n"), F.array_join(rows, "\n").alias("rows"))
    return g.select("path", F.concat(F.lit("[symbols: "), "path", F.lit("] ("), plural(F.col("n"), "symbol", "symbols"), F.lit(")\n"), "rows").alias("text"))


def multi_symbol(items: DataFrame) -> DataFrame:
    """One row, text: a multi-symbol answer (question, status, path, line, kind); the list is the caller's own."""
    row = F.when(F.col("status") == "hit", F.concat("question", F.lit(": "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(" ("), F.coalesce("kind", F.lit("symbol")), F.lit(")"))).otherwise(F.concat("question", F.lit(": [miss] (not found)")))
    g = items.agg(F.count_if(F.col("status") == "hit").alias("h"), F.count_if(F.col("status") != "hit").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question", row.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    head = F.concat(F.lit("[multi-symbol] ("), plural(F.col("h"), "hit", "hits"), F.lit(", "), plural(F.col("m"), "miss", "misses"), F.lit(")"))
    return g.select(F.concat_ws("\n", head, F.nullif("rows", F.lit(""))).alias("text"))


def _reasons(missing: Column, stale: Column, left: str, right: str, between: str) -> Column:
    part = lambda label, files: F.when(F.size(files) > 0, F.concat(F.lit(f"{left}{label}: "), F.array_join(files, ", "), F.lit(right)))
    return F.concat_ws(between, part("missing", missing), part("changed", stale))


NEXT_STEP = {
    "drifted": "Next: heal the map, verify its drafts, then chart what they support.", "empty": "Next: bootstrap the map, verify its drafts, then chart what they support.",
    "incomplete": "Next: bootstrap the map, verify its drafts, then chart what they support.", "healthy": None,
}


def _facet_rows(facets: DataFrame, row: Column, between: str) -> tuple[DataFrame, Column]:
    """Totals of a facet map (a fixed, short list) with its rows as one text, and its status."""
    done = F.col("status").isin("active", "not_applicable")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("t")))), lambda x: x["t"])
    g = facets.agg(F.count("*").alias("n"), F.count_if(done).alias("a"), F.count_if(F.col("status") == "drifted").alias("d"), F.array_join(rows, between).alias("rows"))
    status = F.when(F.col("d") > 0, "drifted").when(F.col("a") == F.col("n"), "healthy").when(F.col("a") == 0, "empty").otherwise("incomplete")
    return g.withColumn("status", status), F.concat(F.col("a").cast("string"), F.lit("/"), F.col("n").cast("string"))


def map_status(facets: DataFrame, advise: bool = True) -> DataFrame:
    """One row, text: the facet map's health. facets: facet, k, status, files, missing, stale (arrays)."""
    files = F.array_join("files", ", ")
    why = _reasons(F.col("missing"), F.col("stale"), "[", "]", " ")
    row = F.concat(F.lit("- "), "facet", F.lit(": "), F.when(F.col("status") == "active", F.concat(F.lit("active"), F.when(F.size("files") > 0, F.concat(F.lit(" ("), files, F.lit(")"))).otherwise("")))
                   .when(F.col("status") == "not_applicable", F.concat(F.lit("not_applicable ("), files, F.lit(")"))).when(F.col("status") == "drifted", F.concat(F.lit("drifted "), F.when(why == "", "[no files cited]").otherwise(why))).otherwise("missing"))
    g, completion = _facet_rows(facets, row, "\n")
    percent = js_round(F.col("a") / F.col("n") * 100).cast("long").cast("string")
    head = F.concat(F.lit("[semantic-map: "), completion, F.lit(" facets active ("), percent, F.lit("%)]\n"), "rows")
    step = F.create_map(*[F.lit(x) for k, v in NEXT_STEP.items() if v for x in (k, v)])[F.col("status")]
    return g.select((F.concat(head, F.coalesce(F.concat(F.lit("\n"), step), F.lit(""))) if advise else head).alias("text"))


def map_export(facets: DataFrame, title: str = "Architecture map") -> DataFrame:
    """One row, text: the facet map as Markdown; facets also has details (null where there are none)."""
    body = F.coalesce(F.concat(F.lit("\n\n"), "details", F.lit("\n")), F.lit(""))
    row = F.concat(F.lit("## Facet: `"), "facet", F.lit("`\n- **Status**: "), "status", F.lit("\n- **Files**: "), F.when(F.size("files") > 0, F.array_join("files", ", ")).otherwise("None"), body)
    g, completion = _facet_rows(facets, row, "\n")
    return g.select(F.concat(F.lit(f"# {title}\nStatus: "), "status", F.lit(" ("), completion, F.lit(" facets active)\n\n"), "rows").alias("text"))


def repair(kind: str, drafts: DataFrame, pruned: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row, text: what bootstrap or heal did. drafts: facet, k, question, files (array), evidence (array of file, line,
    excerpt); pruned: facet, k, id, missing, stale. Both have at most a row a facet."""
    why = _reasons(F.col("missing"), F.col("stale"), "", "", "; ")
    gone = F.concat(F.lit("- "), "facet", F.lit(" ("), F.col("id").cast("string"), F.lit(")"), F.when(why == "", "").otherwise(F.concat(F.lit(" ["), why, F.lit("]"))))
    listed = lambda row: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("t")))), lambda x: x["t"]), "\n")
    p = pruned.agg(F.count("*").alias("pn"), listed(gone).alias("pt"))
    quotes = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("\n  "), e["file"], F.lit(":"), e["line"].cast("string"), F.lit(": "), e["excerpt"])), "")
    draft = F.concat(F.lit("## "), "facet", F.lit(": "), "question", F.lit("\nfiles: "), F.when(F.size("files") > 0, F.array_join("files", ", ")).otherwise("None"), quotes)
    d = drafts.agg(F.count("*").alias("dn"), listed(draft).alias("dt"))
    entries = plural(F.col("pn"), "drifted entry", "drifted entries")
    healed = F.when(F.col("pn") == 0, "No drifted facet entry to remove.").otherwise(F.concat(F.lit("Would remove " if dry_run else "Removed "), entries, F.lit(":\n"), "pt"))
    scaffold = F.when(F.col("dn") == 0, "No drafts: nothing missing or drifted has evidence in the sources.").otherwise(F.concat(F.lit("Unverified drafts ("), F.col("dn").cast("string"), F.lit("), each to be checked against its lines:\n"), "dt"))
    head = F.lit(f"[{kind}] Status: OK{' (dry-run)' if dry_run else ''}")
    return p.crossJoin(d).select(F.concat_ws("\n", head, *([healed] if kind == "heal" else []), scaffold).alias("text"))  # one row each


def call_tree(nodes: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """qid, text: the capped traversal of each root (operators.graph) as an indented tree. A root has at most the cap's
    nodes, so its text is bounded."""
    flat = nodes.where("depth > 0")
    first = Window.partitionBy("qid", "direction", "parent", "depth").orderBy("place")
    flat = flat.withColumn("_lead", F.row_number().over(first) == 1)
    keyed = flat.where("depth = 1").withColumn("key", F.array("place"))
    level = keyed
    for d in range(2, depth + 1):
        up = level.select("qid", "direction", F.col("node").alias("parent"), F.col("key").alias("_up"))
        level = flat.where(f"depth = {d}").join(up, ["qid", "direction", "parent"]).withColumn("key", F.array_append("_up", F.col("place"))).drop("_up").select(*keyed.columns)
        keyed = keyed.unionByName(level)
    pad = lambda n: F.repeat(F.lit(" "), n)
    head = F.when(F.col("_lead"), F.concat(pad(F.col("depth") * 4 - 2), F.lit("↳ "), "direction", F.lit(":\n"))).otherwise("")
    row = F.concat(head, pad(F.col("depth") * 4 + 2), F.lit("- "), clean_name(F.col("node")))
    body = keyed.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("direction") == "callees").alias("o"), "key", row.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    none = f"  (no {'callers or callees' if direction == 'both' else direction} found)"
    roots = nodes.where("depth = 0").select("qid", "node", "truncated").join(body, "qid", "left")
    cut = F.when(F.col("truncated"), " (truncated)").otherwise("")
    return roots.select("qid", F.concat(F.lit(f"[call-graph: depth {depth}]"), cut, F.lit("\n"), "node", F.lit("\n"), F.coalesce("rows", F.lit(none))).alias("text"))


def event(e: DataFrame) -> Column:
    """One event of a session as lines; e: time, query, caller, status, route, symbol, path, line, score, tokens, full, latency."""
    col = lambda c: F.col(c) if c in e.columns else F.lit(None)
    tokens, full = F.coalesce(col("tokens"), F.lit(0)), F.coalesce(col("full"), F.lit(WHOLE_FILE))
    match = F.when(col("path").isNotNull(), F.concat(F.lit("\n match: "), F.coalesce(F.concat(col("symbol"), F.lit(" -> ")), F.lit("")), col("path"), optional(":", col("line")), optional(" (score: ", col("score"), ")"))).otherwise("")
    saved = F.coalesce(F.greatest(F.lit(0), js_round((1 - F.try_divide(tokens, full)) * 100)), F.lit(0)).cast("long").cast("string")
    return F.concat(
        F.lit("["), F.coalesce(col("time").cast("string"), F.lit("")), F.lit("] "), F.coalesce(col("query").cast("string"), F.lit("")), F.lit("\n source: "), F.upper(F.coalesce(col("caller").cast("string"), F.lit(""))), F.lit(" | status: "), F.upper(col("status")),
        optional("\n tiers: ", col("route")), match, F.lit("\n payload: ~"), tokens.cast("string"), F.lit(" tokens | whole file: ~"), full.cast("string"), F.lit(" tokens\n latency: "), F.coalesce(col("latency"), F.lit(0)).cast("string"), F.lit("ms | saved: "), saved, F.lit("%"),
    )


def session_summary() -> Column:
    """The figures of operators.session.stats as lines."""
    s = lambda c: F.col(c).cast("string")
    return F.concat(
        F.lit("queries: "), s("total"), F.lit(" (hits: "), s("hits"), F.lit(", junctions: "), s("junctions"), F.lit(", misses: "), s("misses"), F.lit(")\nhit rate: "), s("hit_rate_pct"), F.lit("%\nmean latency: "), s("avg_latency_ms"),
        F.lit("ms\ntokens: "), s("total_tokens"), F.lit("\nwhole files: "), (F.col("total_tokens") + F.col("saved_tokens")).cast("string"), F.lit("\nsaved: "), s("net_savings_pct"), F.lit("%"),
    )


ROUTES = {"structure": "Tier 1: structure", "path": "Tier 2: path", "fuzzy-lexical": "Tier 3: fuzzy", "memory": "Tier 4: memory"}


def telemetry(answers: DataFrame, payload: Column) -> DataFrame:
    """Session events of router answers: the tier that answered, what matched, and the tokens saved against a whole file."""
    route = F.when(F.col("status") == "hit", F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])[F.col("provider")]).when(F.col("status") == "junction", "Discovery junction")
    tokens = F.greatest(F.lit(1), F.ceil(F.length(payload) / 4))
    found = F.col("status").isin("hit", "junction")
    return answers.select(
        "qid", F.col("question").alias("query"), "status", F.coalesce(route, F.lit("Miss")).alias("route"), F.when(found, F.col("name")).alias("symbol"), F.when(found, F.col("path")).alias("path"), F.when(found, F.col("line")).alias("line"), F.when(found, F.col("score")).alias("score"),
        tokens.cast("long").alias("tokens"), F.lit(WHOLE_FILE).cast("long").alias("full"), F.greatest(F.lit(0.0), js_round((1 - tokens / WHOLE_FILE) * 1000) / 10).alias("saved_pct"),
    )


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one line of JSON."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def digest(text: Column, most: int) -> Column:
    """The text cut to `most` characters, with an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
