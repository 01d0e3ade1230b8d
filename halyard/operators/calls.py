"""Call sites of JavaScript and TypeScript files, names qualified by their containers, and call graphs from both.

Call sites come from a scanner over text with strings and comments blanked, which keeps places and tolerates errors:
`name(...)`, `receiver.name(...)` and `new Name(...)`; declarations and keywords aren't calls. Files over MAX_BYTES and null
texts have none. Everything after the scan is joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halyard.functions.braces import masked
from halyard.functions.text import extension, is_test_file
from halyard.operators import graph, symbols

MAX_BYTES, FALLBACK_FILES = 1 << 20, 2000
SCRIPTS, FALLBACK = ["cjs", "cts", "js", "jsx", "mjs", "mts", "ts", "tsx"], ["cjs", "cts", "mjs", "mts", "toml"]
CONTAINERS, CALLABLE = ["class", "contract", "enum", "interface", "record", "struct", "trait"], ["constructor", "function", "method"]
_NO_CALL = set("await case catch delete do else for function if in instanceof of return super switch throw typeof void while with yield import".split())
_ID = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"(?<![\w$.])(?:(?P<new>new)\s+)?(?P<path>(?:{_ID}\s*\??\.\s*)*)(?P<name>#?{_ID})\s*(?:<[\w\s,.\[\]|&]*>)?\(")
_BEFORE = re.compile(r"(?:\bfunction\b\s*\*?|\b(?:get|set|static|async)\s)\s*$")


def call_sites(text: str | None) -> list[tuple[str, str | None, int, int]]:
    """callee, receiver (None, `new`, or the text before the last dot), line from 1, column from 0."""
    if not text or len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return []
    plain = masked(text, "typescript")
    starts = [0, *[m.end() for m in re.finditer("\n", plain)]]
    found, line = [], 0
    for m in _CALL.finditer(plain):
        name, path = m["name"], re.sub(r"[\s?]", "", m["path"])[:-1]
        if not path and name in _NO_CALL or name.startswith("#"):
            continue
        if _BEFORE.search(plain, 0, m.start()) or (not m["new"] and not path and _declares(plain, m.end())):
            continue
        if m["new"] and path:
            continue
        while line + 1 < len(starts) and starts[line + 1] <= m.start():
            line += 1
        found.append((name, "new" if m["new"] else path or None, line + 1, m.start() - starts[line]))
    return found


def _declares(plain: str, at: int) -> bool:
    """True where the parenthesis before `at` closes before a brace: a method's head, not a call."""
    depth = 1
    for k in range(at, min(len(plain), at + 20_000)):
        depth += {"(": 1, ")": -1}.get(plain[k], 0)
        if not depth:
            return re.match(r"\s*(?::\s*[\w$.<>\[\]|&\s,]+)?\{", plain[k + 1 : k + 400]) is not None
    return False


def extract(files: DataFrame) -> DataFrame:
    """path, callee, receiver, line, column of the script files among files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *c) for p, t in zip(b["path"], b["text"]) for c in call_sites(t)]
            yield pd.DataFrame(rows, columns=["path", "callee", "receiver", "line", "column"])

    scripts = files.where(F.coalesce(extension(F.col("path")).isin(SCRIPTS), F.lit(False)))
    return scripts.select("path", "text").mapInPandas(run, "path string, callee string, receiver string, line long, column long")


def qualify(found: DataFrame) -> DataFrame:
    """Outline symbols (path, name, kind, start_line, start_column, end_line, end_column) with qualified: a member's name behind
    its innermost container's, a TOML key by its whole path and its last part as name; containers keep their own."""
    s = found.withColumn("_id", F.monotonically_increasing_id())
    toml = F.lower("path").endswith(".toml")
    box = found.where(F.col("kind").isin(CONTAINERS)).select(F.col("path").alias("_p"), F.col("name").alias("_owner"), F.struct("start_line", "start_column").alias("_a"), F.struct("end_line", "end_column").alias("_z"))
    inner, outer = F.struct("start_line", "start_column"), F.struct("end_line", "end_column")
    own = s.where(~F.col("kind").isin(CONTAINERS) & ~toml).join(box, (F.col("path") == F.col("_p")) & (F.col("_a") <= inner) & (F.col("_z") >= outer))
    best = own.groupBy("_id").agg(F.max_by("_owner", F.struct("_a", "_owner")).alias("_owner"))
    bare = F.regexp_replace("name", r"^\[+|\]+\z", "")
    r = s.join(best, "_id", "left")
    qualified = F.when(toml, bare).when(F.col("_owner").isNotNull(), F.concat("_owner", F.lit("."), "name")).otherwise(F.col("name"))
    return r.select(*[c for c in found.columns if c != "name"], F.when(toml, F.element_at(F.split(bare, r"\."), -1)).otherwise(F.col("name")).alias("name"), qualified.alias("qualified"))


def fallback_files(files: DataFrame, most: int = FALLBACK_FILES) -> DataFrame:
    """The files (path, ord, ...) of the fallback index: five extensions, the first `most` in walk order (its stated limit)."""
    return files.where(F.coalesce(extension(F.col("path")).isin(FALLBACK), F.lit(False))).orderBy("ord", "path").limit(most)


def mentioning(files: DataFrame, names: DataFrame) -> DataFrame:
    """The script files whose text holds one of `names` (name): found by the words of the text, so no file meets every name."""
    words = files.where(F.coalesce(extension(F.col("path")).isin(SCRIPTS), F.lit(False))).select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w$]+)"), F.lit(1)))).alias("name"))
    hit = words.join(names.select("name").distinct(), "name", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_semi")


def edges(calls: DataFrame, found: DataFrame) -> DataFrame:
    """src and dst (`path:line:name`) of every call that resolves for certain; a call outside any function is its module's.

    calls: path, callee, receiver, line. found: qualified symbols (path, name, qualified, kind, start_line, end_line).
    """
    c = calls.withColumn("call_id", F.monotonically_increasing_id())
    spans = found.where(F.col("kind").isin(CALLABLE)).select("path", F.struct("start_line", "qualified").alias("name"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    held = symbols.enclosing(c.select("path", "line", "call_id", "callee", "receiver"), spans)
    held = held.withColumn("caller", F.col("owner.qualified")).withColumn("owner_line", F.col("owner.start_line"))
    owner = F.when(F.contains("caller", F.lit(".")), F.substring_index("caller", ".", 1))
    ask = held.select("call_id", "callee", "receiver", "path", owner.alias("owner"))
    hits = symbols.resolve(ask, found.select("name", "qualified", "kind", "path", F.col("start_line").alias("line")))
    src = F.when(F.col("caller").isNull(), F.concat(F.lit("module:"), "path")).otherwise(F.concat_ws(":", "path", "owner_line", "caller"))
    return held.join(hits, "call_id").select(src.alias("src"), F.concat_ws(":", "def_path", "def_line", "qualified").alias("dst"), "path", "def_path")


def call_graph(names: DataFrame, found: DataFrame, links: DataFrame, depth: int = 1, direction: str = "both", exclude_tests: bool = False, cap: int = graph.CAP) -> DataFrame:
    """The traversal of each name's (qid, name) one callable definition; names with none or several have no rows. Modules are
    reached, never gone on from; exclude_tests leaves out what test files hold."""
    roots = found.where(F.col("kind").isin(CALLABLE)).select(F.concat_ws(":", "path", "start_line", "qualified").alias("node"), "name", "qualified")
    keyed = roots.select("node", F.explode(F.array_distinct(F.array("name", "qualified"))).alias("name"))
    one = names.join(keyed, "name").groupBy("qid").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").select("qid", "node")
    if exclude_tests:
        links = links.where(~is_test_file(F.col("path")) & ~is_test_file(F.col("def_path")))
    return graph.traverse(one, links.select("src", "dst"), depth, direction, cap)


def discovered(questions: DataFrame, table: DataFrame) -> DataFrame:
    """qid, name, path, line, kind, qualified: every definition of each name in the repository. Where the primary index
    answers, the fallback's definitions join it but for those at a place it has."""
    got = symbols.lookup(questions, table, widen=True).select("qid", "stage", "name", "path", "line", "kind", "qualified")
    primary = got.where(F.col("stage").isin("direct", "qualified")).select("qid", "path", "line").distinct()
    asked = questions.join(primary.select("qid").distinct(), "qid", "left_semi").select("qid", F.trim("question").alias("want"))
    more = table.where("tier = 'fallback'").withColumn("want", F.explode(F.array_distinct(F.array("name", "qualified"))))
    right = F.when(F.contains("want", F.lit(".")), F.col("want") == F.col("qualified")).otherwise(F.col("want") == F.col("name"))
    more = more.where(right).join(asked, "want").join(primary, ["qid", "path", "line"], "left_anti")
    return got.drop("stage").unionByName(more.select("qid", "name", "path", "line", "kind", "qualified"))


def fuzzy_pool(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """name, path, line, kind: the primary candidates, and fallback symbols whose place and name aren't among them."""
    cols = ["name", "path", "line", "kind"]
    return primary.select(*cols).unionByName(fallback.join(primary.select("path", "line", "name").distinct(), ["path", "line", "name"], "left_anti").select(*cols).distinct())


def architecture(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """files (path, language, lines, symbols) with the fallback's language and symbols where the language is unknown."""
    s = summaries.select("path", F.col("language").alias("_l"), F.col("symbols").alias("_s"))
    blank = F.col("language").isNull() | F.col("language").isin("", "unknown")
    fill = blank & F.col("_l").isNotNull()
    r = files.join(s, "path", "left")
    return r.select("path", F.when(fill, F.col("_l")).otherwise(F.col("language")).alias("language"), "lines", F.when(fill, F.col("_s")).otherwise(F.col("symbols")).alias("symbols"))


def summaries(found: DataFrame) -> DataFrame:
    """path, language, symbols of indexed symbols (path, language, ...)."""
    return found.groupBy("path", "language").agg(F.count("*").alias("symbols"))


def first_per_place(found: DataFrame) -> DataFrame:
    """One row per path and line, the first by name."""
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("path", "line").orderBy("name"))).where("_r = 1").drop("_r")
