"""Column functions over question text, paths and names; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists are kept sorted; only membership matters.
EXTENSIONS = sorted(
    "adoc bash bat c cc cfg cjs cmd conf cpp cs css csv cts cxx dart editorconfig el elm ex exs fish go gql graphql h hcl hpp html ini ipynb java jsx js "
    "json json5 jsonc justfile_ kt kts less lock lua m md mdx mjs mk ml mli mod mts php prisma properties proto ps1 py pyi rb res rs rst sass scala scss sh "
    "sol sql sum svg swift tf tfvars toml ts tsv tsx txt xml yaml yml zig zsh".replace("justfile_ ", "").split()
)
BUILD_FILES = sorted(["procfile", "makefile", "justfile", "jenkinsfile", "dockerfile"])
STOP = sorted(set(
    "a all am an and any are as at be been being both but by call callee callees caller callers calls can class code declaration declarations declared defined "
    "definition definitions did do does each else entrypoint entrypoints few file find for from function get give had has have hierarchy how if implementation "
    "implementations implemented in interface is just locate located me method module more most no nor not now of on or other should show signature some such symbol "
    "tell that the then these this those to too trace tracing very was were what when where which who whom why will with work works".split()
))
MEMORY_STOP = sorted(set(
    "a an and are by callees callers calls class declaration declared defined definition did do does find for from function how implementation implemented in is locate me "
    "method of on or please show symbol tell that the to was were what when where which who why with".split()
))
TRACE_STOP = sorted("and call calls does function functions in is method of path the to trace what where which who".split())
DEFINITION_STOP = sorted(
    "are class declaration declared defined definition find function implementation implemented in interface is lines locate located method numbers of signature symbol the where".split()
)

#: Skipped at any depth, and at the root only; a tool's own state folders are given to `skipped` besides.
SKIP_ANY = sorted(
    ".claude .codex .git .next .nuxt .qmd .venv .zed __pycache__ build coverage dist node_modules out venv".split()
)
SKIP_ROOT = sorted("claude codex eval evidence experiments next nuxt qmd sandbox scratch tmp vendor zed".split())

TEST_DIR = r"(?i)(^|/)(__tests__|benches|benchmarks?|examples|fixtures|spec|testdata|testing|tests?)/"
TEST_FILE = r"(?i)[._-](bench|spec|test)\.[^/]+\z"

FAMILIES = {
    "js": "cjs cts js jsx mjs mts ts tsx", "go": "go", "rust": "rs", "jvm": "java kt kts scala", "python": "pxd pxi py pyi pyx",
    "c_cpp": "c cc cpp cxx h hpp", "csharp": "cs", "ruby": "rb", "php": "php", "swift": "swift",
}


def js_round(x: Column) -> Column:
    """Halves go up, below zero too."""
    return F.floor(x + 0.5)


def js_trim(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The POSIX directory of a path without a trailing slash."""
    cut = F.regexp_replace(path, r"/+[^/]*\z", "")
    return F.when(~path.contains("/"), ".").when(cut == "", "/").otherwise(cut)


def folded(path: Column) -> Column:
    """POSIX normalisation of a relative path: empty and `.` segments go, `..` takes the one before with it."""
    up = lambda acc: F.when((acc == "") | (F.substring_index(acc, "/", -1) == ".."), F.concat(acc, F.when(acc == "", "..").otherwise("/.."))).otherwise(F.regexp_replace(acc, r"(^|/)[^/]+\z", ""))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.when(acc == "", x).otherwise(F.concat(F.lit("/"), x))))
    whole = F.aggregate(F.split(path, "/"), F.lit(""), step)
    return F.when(whole == "", F.when(path.endswith("/"), "./").otherwise(".")).otherwise(F.concat(whole, F.when(path.endswith("/"), "/").otherwise("")))


def normalized_path(raw: Column) -> Column:
    """struct(path, error): the repository-relative path, or INVALID_PATH."""
    slash = F.replace(raw, F.lit("\\"), F.lit("/"))
    norm = folded(slash)
    bad = raw.isNull() | (raw == "") | raw.contains("\0") | slash.startswith("/") | slash.rlike("^[A-Za-z]:") | norm.isin(".", "..") | norm.startswith("../")
    return F.struct(F.when(~bad, F.regexp_replace(norm, r"^\./", "")).alias("path"), F.when(bad, "INVALID_PATH").alias("error"))


def skipped(path: Column, state: tuple[str, ...] = (), root_state: tuple[str, ...] = ()) -> Column:
    """True for paths that a walk leaves out; state: further folder names, at any depth and at the root only."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    name = F.element_at(parts, -1)
    return (
        F.arrays_overlap(dirs, F.array(*map(F.lit, [*SKIP_ANY, *state])))
        | ((F.size(parts) > 1) & F.element_at(parts, 1).isin([*SKIP_ROOT, *root_state]))
        | (name == ".DS_Store") | name.endswith(".log") | name.endswith(".tsbuildinfo")
    )


def is_test_file(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.rlike(TEST_DIR) | p.rlike(TEST_FILE)


def extension(path: Column) -> Column:
    """The lower-case extension without its dot; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(basename(path), r"[^/]\.([^./]+)\z", 1)), F.lit(""))


def language_family(path: Column) -> Column:
    pairs = [F.lit(x) for family, exts in FAMILIES.items() for e in exts.split() for x in (e, family)]
    return F.element_at(F.create_map(*pairs), extension(path))


def plausible_edge(caller: Column, callee: Column, name: Column) -> Column:
    """False where a call can't be: other language families, or a Go name private to another directory."""
    a, b = language_family(caller), language_family(callee)
    same = a.isNull() | b.isNull() | (a == b) | ((a == "python") & (b == "c_cpp")) | ((a == "c_cpp") & (b == "python"))
    private = F.coalesce((a == "go") & (b == "go") & F.substring_index(name, ".", -1).rlike("^[a-z]") & (dirname(caller) != dirname(callee)), F.lit(False))
    return caller.isNull() | callee.isNull() | (same & ~private)


def literal_text(question: Column) -> Column:
    q = F.regexp_replace(js_trim(question), r"^['\"`]+|['\"`]+\z", "")
    return F.regexp_replace(F.replace(q, F.lit("\\"), F.lit("/")), r"^\./", "")


def literal_intent(question: Column) -> Column:
    """struct(is_literal, normalized, is_explicit, could_be_symbol) of a question that may be a path."""
    q = F.regexp_replace(js_trim(question), r"^['\"`]+|['\"`]+\z", "")
    norm = literal_text(question)
    low = F.lower(norm)
    has_ext = F.regexp_extract(low, r"\.([a-z0-9]+)[?!.,;)]*\z", 1).isin(EXTENSIONS)
    explicit = norm.contains("/") | q.startswith("./") | q.startswith(".\\") | q.startswith("/")
    literal = norm.contains("/") | has_ext | low.startswith(".") | low.isin(BUILD_FILES)
    dotted = q.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)+(\(\))?\z")
    return F.struct(literal.alias("is_literal"), norm.alias("normalized"), explicit.alias("is_explicit"), (literal & ~explicit & has_ext & dotted).alias("could_be_symbol"))


NARRATIVE = r"(?i)^(describe|explain|how|why|tell\s+me)\b"
NARRATIVE_ANY = r"(?i)\b(explain\s+how|how\s+can|how\s+do|how\s+does|how\s+to|what\s+does)\b"
ARCH_ANY = r"(?i)\bwhat\s+(are|is)\s+(the\s+)?(main\s+)?entry\s*points?\b"
ARCH = r"(?i)\b(codebase|project|repo|system)\s+architecture\b|\b(display|dump|get|show)\s+(the\s+)?architecture\b|^architecture\??\z|entrypoint|entry point|high-level structure|hotspots|overview of the repo|project topology"
TRACE = r"(?i)call hierarchy|callees of|callers of|trace |trace path|what calls|which functions call|who calls|\bwhat does \w+ call\b"
SYMBOL = (
    r"(?i)where is (class|function|interface|method)|find (function|method|symbol)|locate symbol|line numbers of|ast node|method signature"
    r"|(declaration|definition|implementation) of|(declared|defined) in|\bimplemented\s+in\b|\b(declared|defined)\s+in\b|\b(declaration|definition|implementation)\s+of\b"
    r"|\bwhere\s+is\s+[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*\s+(declared|defined|implemented|located)\b|\bwhere\s+is\s+[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*\s*\??\z"
)
BARE = r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)?(\(\))?\??\z"
NAME = r"([A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*)"


def names_in(question: Column, stop: list[str]) -> Column:
    found = F.regexp_extract_all(question, F.lit(NAME), F.lit(1))
    return F.filter(found, lambda t: ~F.lower(t).isin(stop) & (F.length(t) > 1))


def is_narrative(question: Column) -> Column:
    q = js_trim(question)
    return q.rlike(NARRATIVE) | q.rlike(NARRATIVE_ANY)


def intent(question: Column) -> Column:
    """struct(tool, target, requires_parser): the first rule group that fits."""
    q = js_trim(question)
    told = q.rlike(NARRATIVE) | (q.rlike(r"(?i)^what\s+is\b") & ~q.rlike(r"(?i)entry\s*point|main\s+entry|architecture"))
    arch = (~told & q.rlike(ARCH)) | q.rlike(ARCH_ANY)
    trace, symbol = q.rlike(TRACE), q.rlike(SYMBOL)
    bare = ~literal_intent(q)["is_literal"] & q.rlike(BARE)
    last, first = names_in(q, TRACE_STOP), names_in(q, DEFINITION_STOP)
    cut = lambda c: F.regexp_replace(c, r"[?().]+\z", "")
    pick = lambda names, at: F.when(F.size(names) > 0, F.try_element_at(names, F.lit(at))).otherwise(q)
    tool = F.when(arch, "get_architecture").when(trace, "trace_path").otherwise("search_graph")
    target = F.when(arch, F.lit(None)).when(trace, cut(pick(last, -1))).when(symbol, cut(pick(first, 1))).when(bare, cut(q))
    return F.struct(tool.alias("tool"), target.alias("target"), (arch | trace | symbol | bare).alias("requires_parser"))


def identifier_like(token: Column) -> Column:
    """A hump after a lower-case letter, an underscore or a dot, in more than one character."""
    t = js_trim(token)
    return (F.length(t) > 1) & t.rlike(r"[a-z].*[A-Z]|[_.]")


def tokens(question: Column) -> Column:
    """struct(shape, candidates, plain): identifier-shaped tokens, and other content words, in order of first use."""
    clean = F.regexp_replace(question, r"[?(),;:!'\"\[\]{}<>/\\`]", " ")
    clean = F.regexp_replace(clean, r"(?<![A-Za-z0-9_])\.|\.(?![A-Za-z0-9_])", " ")
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    cand = F.array_distinct(F.filter(words, identifier_like))
    plain = F.array_distinct(F.filter(words, lambda w: ~identifier_like(w) & ~F.lower(w).isin(STOP) & (F.length(w) > 2)))
    return F.struct(F.when(F.size(cand) > 0, "identifier-like").otherwise("narrative").alias("shape"), cand.alias("candidates"), plain.alias("plain"))


def memory_terms(text: Column) -> Column:
    """The content terms of a text with humps split, in order, repeats included."""
    low = F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda t: (F.length(t) > 1) & ~t.isin(MEMORY_STOP))


def exact_question(text: Column) -> Column:
    return F.regexp_replace(F.lower(js_trim(text)), r"[?.,!]+\z", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4))


def is_not_applicable(text: Column) -> Column:
    t = js_trim(text)
    return t.rlike(r"(?im)^\s*status\s*:\s*[\"']?not_applicable[\"']?\s*$") | t.rlike(r"(?i)^\[?not_applicable\]?(\s*\z|\s*[:\-—.]|\s+-\s)")


def line_words(line: Column) -> Column:
    """Lower-case words with camelCase and snake_case split."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+)"), F.lit(1)), F.lower)


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    k = F.length(text) - (n - 1)
    return F.when(k < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.substring(text, i, n))))


def is_subsequence(needle: Column, haystack: Column) -> Column:
    """True where the characters of needle occur in haystack in this order."""
    rest = F.aggregate(F.split(needle, ""), haystack, lambda acc, c: F.when(acc.isNull() | (c == ""), acc).otherwise(F.when(F.instr(acc, c) > 0, F.substring(acc, F.instr(acc, c) + 1, F.length(acc)))))
    return rest.isNotNull()


def facet_tag(question: Column) -> Column:
    return F.upper(F.regexp_extract(question, r"(?i)\[facet:([a-z_]+)\]", 1))


def facet_question(question: Column, facet: Column, known: list[str]) -> Column:
    """struct(question, facet, error): the question with one canonical tag in front. Tags in the question and `facet` must
    name one known facet, case aside; INVALID_ARGUMENT else."""
    tags = F.transform(F.regexp_extract_all(question, F.lit(r"(?i)\[facet:([^\]]*)\]"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    asked = F.lower(js_trim(F.coalesce(facet, F.lit(""))))
    named = F.array_distinct(F.concat(F.when(asked != "", F.array(asked)).otherwise(F.array().cast("array<string>")), tags))
    bad = (F.size(named) > 1) | F.exists(named, lambda x: ~x.isin(known))
    bare = js_trim(F.regexp_replace(F.regexp_replace(question, r"(?i)\[facet:[^\]]*\]", " "), r"\s+", " "))
    one = F.try_element_at(named, F.lit(1))
    text = F.when(one.isNull(), bare).otherwise(F.rtrim(F.concat(F.lit("[FACET:"), F.upper(one), F.lit("] "), bare)))
    return F.struct(F.when(~bad, text).alias("question"), F.when(~bad, one).alias("facet"), F.when(bad, "INVALID_ARGUMENT").alias("error"))


def unique_files(files: Column) -> Column:
    """struct(files, error): cited paths with plain slashes, distinct and sorted; UNSAFE_PATH where one holds a comma."""
    plain = F.array_sort(F.array_distinct(F.transform(files, lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^\./", ""))))
    bad = F.exists(plain, lambda x: F.contains(x, F.lit(",")))
    return F.struct(F.when(~bad, plain).alias("files"), F.when(bad, "UNSAFE_PATH").alias("error"))


def file_terms(question: Column) -> Column:
    """What a question about one file filters its symbols by: the target of its intent, else its identifiers, else its content
    words, else itself; nothing for an empty question."""
    t, tok, q = intent(question)["target"], tokens(question), js_trim(question)
    own = F.when(t.isNotNull(), F.array(t)).when(F.size(tok["candidates"]) > 0, tok["candidates"]).when(F.size(tok["plain"]) > 0, tok["plain"]).otherwise(F.array(q))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(own)
