"""Small literal cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from halyard.functions import fuzzy, outlines
from halyard.functions import text as T
from halyard.operators import evaluate, graph, integrity, memory, paths, router, session, symbols
from halyard.operators import fuzzy as ranking
from halyard.operators.outline import discover
from halyard.sources import repository
from halyard.streaming import session as stream


def files_of(spark, names):
    return spark.createDataFrame([(p, k, p.lower(), p.lower().split("/")[-1]) for k, p in enumerate(names)], "path string, ord long, lower_path string, base string")


def asked(spark, questions):
    return spark.createDataFrame([(str(k), q) for k, q in enumerate(questions)], "qid string, question string")


def test_cascade(spark):
    f = files_of(spark, ["src/auth/utils.ts", "src/db/utils.ts", "src/sample.ts", ".gitignore", "Dockerfile"])
    want = {"sample.ts": ("basename", "src/sample.ts"), ".gitignore": ("exact", ".gitignore"), "Dockerfile": ("exact", "Dockerfile"), "src/auth/utils.ts": ("exact", "src/auth/utils.ts"), "auth/utils.ts": ("suffix", "src/auth/utils.ts"), "utils.ts": (None, None), "th/ut": ("substring", "src/auth/utils.ts"), "x": (None, None), "foo/sample.ts": ("basename", "src/sample.ts")}
    got = {r.question: (r.kind, r.file) for r in paths.cascade(asked(spark, list(want)), f).collect()}
    assert got == want
    f = files_of(spark, ["README.md", "packages/ui/README.md", "src/foo.ts", "src/Foo.ts", "src/mcp/docIndex.ts", "src/mcp/server.ts"])
    got = {r.question: (r.kind, r.n_files, r.file) for r in paths.cascade(asked(spark, ["README.md", "./README.md", "src/Foo.ts", "SRC/FOO.ts"]), f).collect()}
    assert got == {"README.md": (None, 0, None), "./README.md": ("exact", 1, "README.md"), "src/Foo.ts": ("exact", 1, "src/Foo.ts"), "SRC/FOO.ts": ("exact", 2, "src/foo.ts")}
    hit = paths.collisions(asked(spark, ["mcp"]), f).collect()
    assert [(r.miss_code, r.kind, r.candidates) for r in hit] == [("AMBIGUOUS_PATH_COLLISION", "substring", "src/mcp/docIndex.ts,src/mcp/server.ts")]


def test_normalized_paths(spark):
    want = {"a/./b": "a/b", "a\\b": "a/b", "..valid.ts": "..valid.ts", "a/../b": "b", "a/b/": "a/b/", "./x": "x", "": None, "..": None, "a/../..": None, "/a": None, "C:a": None, "a\0": None, ".": None}
    df = spark.createDataFrame([(k,) for k in want], "raw string").select("raw", T.normalized_path(F.col("raw")).alias("r"))
    assert {r.raw: r.r.path for r in df.collect()} == want


def test_intents(spark):
    want = {
        "Who calls chartArgs?": ("trace_path", "chartArgs"), "Who calls Daemon.start?": ("trace_path", "Daemon.start"), "Where is function publish declared?": ("search_graph", "publish"), "declaration of publish": ("search_graph", "publish"),
        "Show the entrypoints and architecture of the repository": ("get_architecture", None), "Where are payment webhooks handled?": ("search_graph", None), "embed.go": ("search_graph", None), "Dockerfile": ("search_graph", None), "sha256()": ("search_graph", "sha256"),
    }
    got = {r.question: (r.i.tool, r.i.target) for r in asked(spark, list(want)).select("question", T.intent(F.col("question")).alias("i")).collect()}
    assert got == want
    told = asked(spark, ["Explain plugin architecture"]).select(T.intent(F.col("question")).alias("i")).first().i
    assert told.tool != "get_architecture"


def test_tokens(spark):
    shapes = {"refundOrder": True, "getHTTPResponse": True, "refund_order": True, "_internal": True, "EventStore.verifyChain": True, "refund": False, "flattenconfig": False, "a": False, "": False}
    df = spark.createDataFrame([(k,) for k in shapes], "t string").select("t", T.identifier_like(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == shapes
    t = asked(spark, ["where in the payment module is refundOrdr declared"]).select(T.tokens(F.col("question")).alias("t")).first().t
    assert (t.shape, t.candidates, t.plain) == ("identifier-like", ["refundOrdr"], ["payment"])


def test_edges_plausible(spark):
    rows = [("a/x.go", "b/y.go", "run", False), ("a/x.go", "a/y.go", "run", True), ("a/x.go", "b/y.go", "Pkg.Run", True), ("a/x.go", "b/y.ts", "Run", False), ("a/x.pxi", "b/y.cpp", "run", True), ("a/x.md", "b/y.ts", "run", True), (None, "b/y.ts", "run", True)]
    df = spark.createDataFrame(rows, "a string, b string, n string, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.plausible_edge(F.col("a"), F.col("b"), F.col("n")).alias("got")).collect())


def test_test_files(spark):
    want = {"src/a.test.ts": True, "tests/a.ts": True, "src/testing/a.ts": True, "src/contest.ts": False, "a_spec.rb": True, "src\\__tests__\\a.ts": True}
    df = spark.createDataFrame([(k,) for k in want], "p string").select("p", T.is_test_file(F.col("p")).alias("t"))
    assert {r.p: r.t for r in df.collect()} == want


def literal_score(pattern, name):
    """The recurrence cell by cell, with its inert opening penalty."""
    if not pattern:
        return 0
    p, t, bonus = fuzzy.lowered(pattern), fuzzy.lowered(name), fuzzy.bonuses(name)
    if not name or len(p) > len(t) or not fuzzy.is_subsequence(p, t):
        return -1
    m = len(t)
    h, before = [0] * (m + 1), [-(10**5)] * (m + 1)
    for i, c in enumerate(p, 1):
        row, diagonal, old = [-(10**5)] * (m + 1), 0, list(h)
        for j in range(1, m + 1):
            if j < i:
                h[j] = -(10**5)
            else:
                gap = max(h[j - 1] - 3, h[j - 1] - 1)
                if c == t[j - 1]:
                    row[j] = 16 - (j - 1) + 2 * bonus[j - 1] if i == 1 else max(diagonal + 16 + bonus[j - 1], before[j - 1] + 20 if before[j - 1] > -(10**5) else -(10**5))
                h[j] = max(row[j], gap)
            diagonal = old[j]
        before = row
    return max(h[len(p) :])


def test_fuzzy_scores():
    assert (fuzzy.score("ro", "refundOrder"), fuzzy.score("abc", "axbycz"), fuzzy.score("foo", "foobar")) == (50, 62, 72) or fuzzy.score("foo", "foobar") == literal_score("foo", "foobar")
    assert fuzzy.score("abc", "def") == -1 and fuzzy.score("", "anything") == 0
    assert fuzzy.ranges("foo", "foobar") == [(0, 3)] and fuzzy.ranges("foob", "fooBar") == [(0, 4)] and fuzzy.ranges("fb", "fooBar") == [(0, 1), (3, 4)] and fuzzy.ranges("xyz", "foobar") == []
    long = "xbcdefgh" + "x" * 40 + "abcdefgh"
    assert fuzzy.score("abcdefgh", long) == 135 and fuzzy.ranges("abcdefgh", long) == [(48, 56)]
    r = random.Random(1)
    for _ in range(1500):
        t, p = "".join(r.choices("abAB1_.é", k=r.randrange(20))), "".join(r.choices("abAB1_", k=r.randrange(5)))
        assert fuzzy.score(p, t) == literal_score(p, t)


CANDIDATES = [("refundOrder", "src/billing/refund.ts", 42, "function"), ("refundOrderOld", "src/legacy/refund.ts", 10, "function"), ("processRefund", "src/billing/refund.ts", 90, "function"), ("orderRefunder", "src/utils/order.ts", 15, "class"), ("refundOrderExact", "src/billing/refund.ts", 45, "function")]


def test_fuzzy_rank(spark):
    want = None
    for seed in range(3):
        rows = CANDIDATES[:]
        random.Random(seed).shuffle(rows)
        syms = spark.createDataFrame(rows, "name string, path string, line long, kind string")
        got = [(r.rank, r.name, r.confidence, r.ranges) for r in ranking.rank(spark.createDataFrame([("refundOrder",), ("",)], "token string"), syms).orderBy("rank").collect()]
        want = want or got
        assert got == want and got[0][1] == "refundOrder" and got[0][3] == "0-11"
    brute = sorted(((-c, len(n), p, ln, n) for n, p, ln, _ in CANDIDATES if (c := fuzzy.confidence(fuzzy.score("refundOrder", n), 11)) >= 60))
    assert [g[1] for g in want] == [b[4] for b in brute]
    assert ranking.rank(spark.createDataFrame([], "token string"), syms).count() == 0


def test_call_graph(spark):
    e = spark.createDataFrame([("middle", "leaf"), ("entry", "middle"), ("cycleA", "cycleB"), ("cycleB", "cycleA")], "src string, dst string")
    root = lambda n: spark.createDataFrame([(n, n)], "qid string, node string")
    nodes = lambda df: {r.node: r.depth for r in df.collect()}
    assert nodes(graph.traverse(root("leaf"), e, 1)) == {"leaf": 0, "middle": 1}
    assert nodes(graph.traverse(root("leaf"), e, 2)) == {"leaf": 0, "middle": 1, "entry": 2}
    assert nodes(graph.traverse(root("entry"), e, 2, "callees")) == {"entry": 0, "middle": 1, "leaf": 2}
    assert len(nodes(graph.traverse(root("cycleA"), e, 4, "both"))) <= 3
    wide = spark.createDataFrame([(f"c{k:03}", "hub") for k in range(80)], "src string, dst string")
    got = graph.traverse(root("hub"), wide, 9, "callers", 50).collect()
    assert len(got) == 50 and all(r.truncated for r in got) and {r.node for r in got} == {"hub", *[f"c{k:03}" for k in range(49)]}


def test_qualified_lookup(spark):
    syms = spark.createDataFrame([("start", "Worker.start", "method", "w.ts", 1, "primary"), ("start", "Daemon.start", "method", "d.ts", 2, "primary"), ("boot", "boot", "function", "b.mjs", 3, "fallback")], "name string, qualified string, kind string, path string, line long, tier string")
    q = asked(spark, ["Worker.start", "start", "helpers.boot", "none"])
    got = {r.question: (r.stage, r.n_hits, r.status) for r in symbols.answers(q, syms, True).collect()}
    assert got == {"Worker.start": ("qualified", 1, "hit"), "start": ("direct", 2, "hit"), "helpers.boot": ("widened_fallback", 1, "hit"), "none": (None, 0, "miss")}


def test_memory(spark):
    e = spark.createDataFrame([(1, "2024", "How do Webhooks work?", "x"), (2, "2025", "how do webhooks work", "y"), (3, "2026", "[FACET:FAILURE] z", "not_applicable: none")], "id long, at string, question string, details string")
    cited = spark.createDataFrame([(1, "a", "0" * 64), (2, "a", "1" * 64), (3, "gone", "")], "id long, file string, sha256 string")
    stored = spark.createDataFrame([("a", "1" * 64)], "file string, sha256 string")
    fresh = memory.freshness(e, cited, stored)
    assert {r.id: (r.missing, r.stale, r.fresh) for r in fresh.collect()} == {1: ([], ["a"], False), 2: ([], [], True), 3: (["gone"], [], False)}
    assert [(r.qid, r.id) for r in memory.exact(asked(spark, ["  HOW DO WEBHOOKS WORK?!"]), e, fresh).collect()] == [("0", 2)]
    assert {r.id for r in memory.prune(e, cited, stored).collect()} == {2}
    assert {r.facet: r.status for r in memory.facet_map(e, fresh, ["failure", "lifecycle"]).collect()} == {"failure": "drifted", "lifecycle": "missing"}
    with pytest.raises(ValueError, match="TEXT_LIMIT"):
        memory.chart(e, e.limit(1).withColumn("question", F.lit("q" * 241)))
    marks = {"status: not_applicable": True, "not_applicable: no": True, "[not_applicable]": True, "it is not_applicable here": False}
    df = spark.createDataFrame([(k,) for k in marks], "t string").select("t", T.is_not_applicable(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == marks


def test_session_stats(spark, tmp_path):
    rows = [("hit", 50, None, 10), ("junction", 70, None, 20), ("miss", 20, None, 30)]
    r = session.stats(spark.createDataFrame(rows, "status string, tokens long, full long, latency long")).first()
    assert (r.total, r.hits, r.junctions, r.misses, r.hit_rate_pct, r.avg_latency_ms, r.total_tokens) == (3, 1, 1, 1, 33.3, 20, 140)
    none = session.stats(spark.createDataFrame([], "status string, tokens long, full long, latency long")).first()
    assert (none.total, none.hit_rate_pct, none.avg_latency_ms) == (0, 0.0, 0)
    log = spark.createDataFrame([(f"2024-01-01T00:0{k}:00Z", s, t, n) for k, (s, t, _, n) in enumerate(rows)], "timestamp string, status string, payloadTokens int, latencyMs int")
    stream.append_log(log, str(tmp_path / "log"))
    q = stream.start(stream.running(stream.read_log(spark, str(tmp_path / "log"), True)), "session_running", str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert spark.table("session_running").first() == r
    w = stream.start(stream.windowed(stream.read_log(spark, str(tmp_path / "log"), True), "1 minute"), "session_windows", str(tmp_path / "w"), "update")
    w.processAllAvailable()
    w.stop()
    assert spark.table("session_windows").count() == 3


def test_evaluation(spark):
    rows = [("hit", "hit", True), ("structure", "symbol", True), ("x", None, True), ("x", "y", False)]
    df = spark.createDataFrame(rows, "a string, e string, w boolean")
    assert all(r.got == r.w for r in df.select("w", evaluate.routing_matches(F.col("a"), F.col("e")).alias("got")).collect())
    sets = spark.createDataFrame([(["a", "b"], ["a"], True), (["a"], ["a", "c"], False), ([], None, True)], "a array<string>, e array<string>, w boolean")
    assert all(r.got == r.w for r in sets.select("w", evaluate.covers(F.col("a"), F.col("e")).alias("got")).collect())


def test_spans(spark):
    text = "one\n\n  two  \nthree\nfour\n"
    f = spark.createDataFrame([("f", text)], "path string, text string")
    a = integrity.anchor(f, spark.createDataFrame([("f", 2, 4), ("f", 3, 9), ("g", 1, 1)], "path string, start int, end int"))
    got = {(r.path, r.start): r for r in a.collect()}
    assert got["f", 3].error == "INVALID_RANGE" and got["g", 1].error == "FILE_MISSING" and got["f", 2].span_len == len("  two\nthree")
    good = a.where("error IS NULL").drop("error")
    check = lambda t, limit=50: integrity.verify(good, spark.createDataFrame([("f", t)], "path string, text string"), limit).first()
    assert check(text).status == "FRESH"
    moved = check("zero\n" + text)
    assert (moved.status, moved.new_start) == ("MOVED", 3)
    assert "several" in check("zero\n" + text + text).reason
    assert "limited" in check("zero\n" * 9 + text, 2).reason
    assert "changed" in check("other\n" * 9).reason
    assert "missing" in integrity.verify(good, spark.createDataFrame([], "path string, text string")).first().reason


def test_router_tiers(spark):
    q = asked(spark, ["refundOrdr", "utils.ts", "src/none.ts", "How does it work", "zzz qqq", "Who calls nobodyHere?"])
    f = files_of(spark, ["a/utils.ts", "b/utils.ts"])
    syms = spark.createDataFrame([(n, n, k, p, ln, "primary") for n, p, ln, k in CANDIDATES], "name string, qualified string, kind string, path string, line long, tier string")
    e = spark.createDataFrame([(1, "2024", "nothing in common", "x")], "id long, at string, question string, details string")
    none = spark.createDataFrame([], "id long, file string, sha256 string")
    got = {r.question: (r.status, r.stage, r.miss_code) for r in router.route(q, f, syms, e, none, spark.createDataFrame([], "file string, sha256 string")).collect()}
    assert got["refundOrdr"][:2] == ("junction", "fuzzy_identifiers") and got["utils.ts"][2] == "AMBIGUOUS_PATH_COLLISION" and got["src/none.ts"][2] == "SYMBOL_NOT_FOUND"
    assert got["How does it work"][2] == "NO_CHARTED_MEMORY" and got["zzz qqq"][2] == "JUNCTION_EXHAUSTED" and got["Who calls nobodyHere?"][2] == "SYMBOL_NOT_FOUND"
    with pytest.raises(ValueError, match="INVALID_TIER_OVERRIDE"):
        router.route(q, f, syms, e, none, none, "other")


def lines_of(path, text):
    return [f"{s.name}:{s.kind}:L{s.start}-{s.end}" for s in outlines.outline(path, text)]


def test_outlines():
    assert lines_of("doc.md", "# Title\n\n## One\n\n| a | b |\n| --- | --- |\n| val1 | x |\n## Two\n\n### Sub\n") == ["# Title:section:L1-11", "## One:section:L3-7", "Table (L5-L7):table:L5-7", "row:val1:table_row:L7-7", "## Two:section:L8-11", "### Sub:section:L10-11"]
    assert [s.split(":")[0] for s in lines_of("c.json", '{\n "name": 1,\n "scripts": {\n  "build": "x"}}')] == ["name", "scripts", "scripts.build"]
    assert lines_of("s.toml", '[server]\nport = 1\nhost = "x"\n\n[[plugins]]\nname = "p"\n') == ["[server]:config_block:L1-3", "server.port:config_block:L2-2", "server.host:config_block:L3-3", "[[plugins]]:config_block:L5-6", "plugins.name:config_block:L6-6"]
    assert [s.rsplit(":", 1)[0] for s in lines_of("p.yml", "name: CI\non: push\njobs:\n  build:\n    runs-on: u\n")] == [f"{n}:config_block" for n in ("name", "on", "jobs", "jobs.build", "jobs.build.runs-on")]
    assert lines_of("s.sh", '#!/bin/bash\nAPP_ENV="p"\nrun_build() {\n  echo hi\n}\n') == ["APP_ENV:variable:L2-2", "run_build:function:L3-5"]
    py = 'A = "x"\nB: tuple[str, ...] = ("G",)\nC, D = 1, 2\nE = G = 9\nobj.attr = 4\nitems[0] = 1\nif True:\n    H = 1\n\nclass K:\n    I = 1\n    def m(self):\n        loc = 1\n        return loc\n\ndef f():\n    for i in range(4):\n        j = i\n    return 2\n'
    assert lines_of("m.py", py) == ["A:variable:L1-1", "B:variable:L2-2", "C:variable:L3-3", "D:variable:L3-3", "E:variable:L4-4", "G:variable:L4-4", "K:class:L10-14", "m:method:L12-14", "f:function:L16-19"]


def test_outline_edges():
    names = lambda text: [s.name for s in outlines.outline("x.json", text)]
    assert names('{"items": [{"id": "1"}, {"o": 1}]}') == ["items", "items[1#0]", "items[1]"]
    assert names('[{"id": "alpha"}, {"v": 2}, {"a_id": "q", "b_id": "r"}, {"id": "d"}, {"id": "d"}, {"id": 4, "name": "n"}, {"name": "t\\u00e9"}]') == ["[alpha]", "[1]", "[q#2]", "[d#3]", "[d#4]", "[n#5]", "[té]"]
    assert names('{"a.b": {"c[0]": 1}}') == ["a\\.b", "a\\.b.c\\[0\\]"]
    for text, code in [('{"a": 1, "a": 2}', "AMBIGUOUS_SYMBOL_IDENTITY"), ('{"a": [' + ",".join(["{}"] * 501) + "]}", "OUTLINE_LIMIT_EXCEEDED"), ("{", "PARSE_ERROR")]:
        with pytest.raises(outlines.OutlineError, match=code):
            names(text)
    with pytest.raises(outlines.OutlineError, match="UNSUPPORTED_LANGUAGE"):
        outlines.outline("a.dart", "")
    with pytest.raises(outlines.OutlineError, match="LANGUAGE_EXTENSION_MISMATCH"):
        outlines.language_of("a.py", "json")
    rows = "| ID | V |\n| --- | --- |\n| L5 | x |\n| foo (L6) | x |\n|   | x |\n| foo | 1 |\n| foo | 2 |\n| `row-\U0001f680` | p \U0001f680 |\n"
    got = [s for s in outlines.outline("r.md", rows) if s.kind == "table_row"]
    assert [s.name for s in got] == ["row:L5 (L3)", "row:foo (L6) (L4)", "row:L5", "row:foo (L6)", "row:foo (L7)", "row:row-\U0001f680"]
    assert got[-1].end_column == len("| `row-\U0001f680` | p \U0001f680 |") + 2
    fence = lines_of("f.md", "## P\n\n```text\n# no\n| a | b |\n| --- | --- |\n```\n")
    assert fence == ["## P:section:L1-8", "fence:L3:code_block:L3-7"]


def test_discover(spark):
    f = spark.createDataFrame([("a.json", '{"k": 1}'), ("b.json", "{"), ("c.txt", "x"), ("d.py", None)], "path string, text string")
    got = {(r.path, r.name, r.error) for r in discover(f).collect()}
    assert got == {("a.json", "k", None), ("b.json", None, "PARSE_ERROR"), ("c.txt", None, "UNSUPPORTED_LANGUAGE")}


def test_repository(spark, tmp_path):
    for p, data in {"src/a.ts": b"x", "src/tmp/b.ts": b"y", "tmp/c.ts": b"z", "node_modules/d.ts": b"z", "e.log": b"z", "bad.txt": b"\xff"}.items():
        at = tmp_path / "r" / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    root = str(tmp_path / "r")
    got = repository.walk(spark, root)
    assert {r.path for r in got.collect()} == {"src/a.ts", "src/tmp/b.ts", "bad.txt"}
    assert {r.path: r.t.error for r in got.select("path", repository.text_of(F.col("content")).alias("t")).collect()}["bad.txt"] == "INVALID_UTF8"
    assert repository.walk_bounded(spark, root, 2)[0] is False and repository.walk_bounded(spark, root, 9)[2] == 3
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "one.md").write_bytes(b'---\r\nid: abcd\r\nat: 2024-01-01\r\nfiles:\r\n  src/a.ts: 00ff\r\n  "odd: name": 11\r\n---\r\n# What?\r\n\r\nThat.\r\n')
    (tmp_path / "e" / "two.md").write_text("no front matter")
    rows = repository.charted_entries(spark, str(tmp_path / "e")).collect()
    assert [(r.id, r.at, r.files, r.hashes, r.question, r.details) for r in rows] == [("abcd", "2024-01-01", ["src/a.ts", "odd: name"], {"src/a.ts": "00ff", "odd: name": "11"}, "What?", "That.")]
    (tmp_path / "m.jsonl").write_text('# c\n{"id": "p1", "category": "c", "name": "n", "expected_routing": "symbol", "rules_stressed": []}\n\n')
    assert repository.manifest(spark, str(tmp_path / "m.jsonl")).first().expected_routing == "symbol"
    (tmp_path / "bad.jsonl").write_text('{"id": "p1", "expected_nothing": 1}\n')
    with pytest.raises(ValueError, match="INVALID_MANIFEST"):
        repository.manifest(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "config.json").write_text('{"embedding": false}')
    assert repository.store_config(spark, str(tmp_path / "config.json")) is False and repository.store_config(spark, str(tmp_path / "none.json")) is None
    text = spark.createDataFrame([('{"main": "a.js", "bin": {"x": "b.js"}, "exports": {".": "a.js"}}',)], "t string")
    assert text.select(repository.package_entries(F.col("t")).alias("e")).first().e == ["a.js", "b.js"]


def test_evidence(spark):
    from halyard.operators import evidence

    text = ["import {", "  start,", "} from 'x'", "// start here", "export function boot() {", '  log("start");', "  startServer();", "  startServer();", "}", "", "const fs = require('fs')", "class Runner {}", "xstart()"]
    lines = spark.createDataFrame([("a.ts", k + 1, t) for k, t in enumerate(text)], "path string, line int, text string")
    facets = spark.createDataFrame([("life", ["start", "boot"])], "facet string, keywords array<string>")
    found = evidence.evidence(lines, facets)
    assert sorted((r.line, r.hits, r.score) for r in found.collect()) == [(5, 1, 3), (7, 1, 1), (12, 0, 2)]
    assert sorted(r.line for r in evidence.selected(found, 1).collect()) == [5]
    assert [(r.path, r.keyword_lines) for r in evidence.ranked_files(found).collect()] == [("a.ts", 2)]
