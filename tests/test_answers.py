"""Rendered trees and repairs, facet drafts, call sites, the store and routing options: goldens and edge cases."""

import pytest
from pyspark.sql import functions as F

from halyard.operators import calls as K
from halyard.operators import evaluate as E
from halyard.operators import graph, memory, outline, render, repair, router
from halyard.sources import store

NODES = "src string, dst string"


def one(df):
    (row,) = df.collect()
    return row[0]


def test_call_tree(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("a", "x"), ("x", "y"), ("x", "a")], NODES)
    roots = spark.createDataFrame([(1, "a"), (2, "lone")], "qid long, node string")
    got = {r.qid: r.text for r in render.call_tree(graph.traverse(roots, e, 2, "both", 50), 2).collect()}
    assert got[1] == "[call-graph: depth 2]\na\n  ↳ callers:\n      - b\n      ↳ callers:\n          - d\n      - c\n      - x"  # x is seen as a caller first
    assert got[2] == "[call-graph: depth 2]\nlone\n  (no callers or callees found)"
    cut = {r.qid: r.text for r in render.call_tree(graph.traverse(roots, e, 1, "callers", 2), 1).collect()}
    assert cut[1] == "[call-graph: depth 1] (truncated)\na\n  ↳ callers:\n      - b"
    assert render.call_tree(graph.traverse(roots.limit(0), e, 1, "both", 50), 1).count() == 0


def test_texts(spark):
    row = spark.createDataFrame([({"ast": 3, "total": 9}, ["ast", "path"], True, "a\r\nb\r\n", "x" * 10)], "t map<string, int>, l array<string>, b boolean, n string, x string")
    c = F.col
    got = row.select(render.timings(c("t")), render.diagnostics(c("l"), c("b"), c("b")), render.diagnostics(c("l"), F.lit(None), F.lit(None)), render.clean_name(c("n")), render.digest(c("x"), 4), render.digest(c("x"), 10)).first()
    assert tuple(got) == ("ast: 3ms | total: 9ms", "[dev] tiers: [ast -> path] | ipc: daemon | invariants: OK", "[dev] tiers: [ast -> path] | invariants: FAILED", "a b", "xxxx…", "x" * 10)
    syms = spark.createDataFrame([("p.ts", "b\r", "function", 5, 9), ("p.ts", "a", "class", 1, 1)], "path string, name string, kind string, start_line long, end_line long")
    assert render.outlines(syms).first().text == "[symbols: p.ts] (2 symbols)\na: class L1\nb: function L5-L9"
    items = spark.createDataFrame([("A", "hit", "p", 3, "class"), ("B", "miss", None, None, None)], "question string, status string, path string, line long, kind string")
    assert one(render.multi_symbol(items)) == "[multi-symbol] (1 hit, 1 miss)\nA: p:3 (class)\nB: [miss] (not found)"
    assert one(render.multi_symbol(items.limit(0))) == "[multi-symbol] (0 hits, 0 misses)"
    assert render.json_lines(items).first().value == '{"question":"A","status":"hit","path":"p","line":3,"kind":"class"}'


CODE = [
    ("src/server.ts", "import { main } from './x';\n// main in a comment\nexport function start() {\n  launch(1);\n}\nlet text = 'shutdown';\n"),
    ("src/main.ts", "export const app = 1;\n"),
    ("deep/a/b/boot.ts", "launch();\nspawn();\nlaunch();\n"),
    ("test/boot.test.ts", "launch();\n"),
    ("src/types.d.ts", "launch();\n"),
    ("src/errors.ts", "export class Nothing {}\n"),
    ("notes.txt", "launch();\n"),
    ("src/none.ts", None),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(CODE, "path string, text string")


def test_candidates(sources):
    got = [(r.path, r.entry) for r in repair.candidates(sources).orderBy(F.desc("entry"), "depth", "path").collect()]
    assert got == [("src/main.ts", True), ("src/errors.ts", False), ("src/server.ts", False), ("deep/a/b/boot.ts", False)]
    assert repair.candidates(sources, most=1).count() == 1 and repair.candidates(sources, most_bytes=25).count() == 2
    assert repair.candidates(sources.limit(0)).count() == 0


def test_drafts(spark, sources):
    got = {r.facet: r for r in repair.drafts(repair.candidates(sources), repair.facet_table(spark)).collect()}
    life = got["lifecycle"]
    assert life.files == ["deep/a/b/boot.ts", "src/server.ts"]  # keyword lines and a hint, against keyword lines alone
    assert [(e.file, e.line) for e in life.evidence] == [("deep/a/b/boot.ts", 1), ("deep/a/b/boot.ts", 2), ("src/server.ts", 3), ("src/server.ts", 4)]
    assert got["failure"].files == ["src/errors.ts"]  # no keyword line: the file named for it, by what it exports
    assert got["data_state"].files == ["src/main.ts"]  # nor such a file: the entry file
    assert repair.drafts(repair.candidates(sources.limit(0)), repair.facet_table(spark)).count() == 0


def test_heal(spark, sources):
    entries = spark.createDataFrame([("e1", "2020", "[FACET:LIFECYCLE] q", "d"), ("e2", "2020", "[FACET:FAILURE] q", "d"), ("e3", "2020", "plain", "d")], "id string, at string, question string, details string")
    cited = spark.createDataFrame([("e1", "f", "0" * 64), ("e2", "g", "1" * 64)], "id string, file string, sha256 string")
    stored = spark.createDataFrame([("f", "2" * 64), ("g", "1" * 64)], "file string, sha256 string")
    fresh = memory.freshness(entries, cited, stored)
    facets = memory.facet_map(entries, fresh, list(repair.FACETS))
    left, gone, drafts = repair.heal(entries, facets, fresh, repair.candidates(sources), repair.facet_table(spark))
    assert sorted(r.id for r in left.collect()) == ["e2", "e3"] and [(r.facet, r.id, r.stale) for r in gone.collect()] == [("lifecycle", "e1", ["f"])]
    assert "failure" not in {r.facet for r in drafts.collect()}
    assert repair.heal(entries, facets, fresh, repair.candidates(sources), repair.facet_table(spark), True)[0].count() == 3
    text = one(render.repair("heal", drafts.where("facet = 'lifecycle'"), gone))
    assert text.startswith("[heal] Status: OK\nRemoved 1 drifted entry:\n- lifecycle (e1) [changed: f]\nUnverified drafts (1)") and "  src/server.ts:4: launch(1);" in text
    assert one(render.repair("bootstrap", drafts.limit(0), gone.limit(0))) == "[bootstrap] Status: OK\nNo drafts: nothing missing or drifted has evidence in the sources."
    new = spark.createDataFrame([("n1", "[FACET:FAILURE] q", ["f"]), ("n2", "[FACET:FAILURE] q", ["f", "gone"]), ("n3", "[FACET:FAILURE] q", []), ("n4", "plain", [])], "id string, question string, files array<string>")
    assert {r.id: r.error for r in repair.validated(new, stored).collect()} == {"n1": None, "n2": "INVALID_BACKING_FILES", "n3": "INVALID_BACKING_FILES", "n4": None}


SCRIPT = """class Store {
  load(key) { return this.read(key); }
  read(key) { return helper(key) + `${helper(1)}`; }
}
// helper() here is a comment
function helper(k) { if (k) { return new Store().load("helper()"); } }
export default async function main() { await helper(2); const s = new Store(); s.load(3); }
main();
"""


def test_call_sites():
    assert [(c, r) for c, r, _, _ in K.call_sites(SCRIPT)] == [("read", "this"), ("helper", None), ("Store", "new"), ("helper", None), ("Store", "new"), ("load", "s"), ("main", None)]
    assert K.call_sites(None) == [] and K.call_sites("") == [] and K.call_sites("f();" * 400_000) == []
    assert K.call_sites("a.b.c(1)\n  d?.e()") == [("c", "a.b", 1, 0), ("e", "d", 2, 2)]
    assert K.call_sites("broken( {{ ok(1)") == [("broken", None, 1, 0), ("ok", None, 1, 11)]


def test_call_graph_from_files(spark):
    files = spark.createDataFrame([("a.mts", SCRIPT), ("b.ts", "helper(9);\n"), ("c.ts", "nothing(1)\n"), ("d.toml", "x = 1\n[t]\ny = 2\n")], "path string, text string")
    found = K.qualify(outline.discover(files).where("error IS NULL"))
    assert {r.qualified for r in found.where("path = 'a.mts'").collect()} >= {"Store", "Store.load", "Store.read", "helper", "main"}
    assert sorted((r.name, r.qualified) for r in found.where("path = 'd.toml'").collect()) == [("t", "t"), ("x", "x"), ("y", "t.y")]
    links = K.edges(K.extract(files), found)
    got = {(r.src.split(":")[-1], r.dst.split(":")[-1]) for r in links.collect()}
    assert {("Store.load", "Store.read"), ("Store.read", "helper"), ("main", "helper"), ("b.ts", "helper"), ("a.mts", "main")} <= got
    names = spark.createDataFrame([(1, "helper"), (2, "Store.load"), (3, "unknown")], "qid long, name string")
    up = K.call_graph(names, found, links, 2, "callers").where("depth > 0").collect()
    assert {r.node.split(":")[-1] for r in up if r.qid == 1} == {"Store.read", "main", "b.ts", "Store.load", "a.mts"}
    assert {r.qid for r in up} == {1, 2}
    mention = K.mentioning(files, spark.createDataFrame([("helper",)], "name string"))
    assert sorted(r.path for r in mention.collect()) == ["a.mts", "b.ts"]
    order = spark.createDataFrame([("z.toml", 1), ("a.ts", 2), ("b.MJS", 3), ("c.cts", 4)], "path string, ord long")
    assert [r.path for r in K.fallback_files(order, 2).collect()] == ["z.toml", "b.MJS"]
    assert K.edges(K.extract(files.limit(0)), found).count() == 0


def test_store(spark, tmp_path):
    at, stored = f"file://{tmp_path}/s", spark.createDataFrame([("f.ts", "1" * 64), ("g.ts", "2" * 64)], "file string, sha256 string")
    q = spark.createDataFrame([(1, "How are widgets painted?"), (2, "zebra crossing")], "qid long, question string")
    assert {r.reason for r in store.recall(spark, at, q, stored).collect()} == {"STORE_UNINITIALIZED"}
    new = "question string, details string, facet string, files array<string>"
    rows = [("How are widgets painted", "with a brush", None, ["./f.ts"]), ("q", "a", "failure", ["g.ts"]), ("q", "a", "failure", ["none.ts"]), ("q", "a", "bogus", ["f.ts"]), ("", "a", None, []), ("q", "x" * 4001, None, []), ("q", "a", None, ["a,b"])]
    got = store.publish(spark, at, spark.createDataFrame(rows, new), stored, list(repair.FACETS), "2020").collect()
    assert sorted(str(r.error) for r in got) == ["INVALID_ARGUMENT", "INVALID_BACKING_FILES", "None", "None", "TEXT_LIMIT", "TEXT_LIMIT", "UNSAFE_PATH"]
    assert store.read(spark, at).count() == 2 and store.versions(spark, at) == [1, 2]
    first = next(r.id for r in got if r.question == "How are widgets painted")
    assert {r.qid: (r.id, r.reason) for r in store.recall(spark, at, q, stored).collect()} == {1: (first, None), 2: (None, "NO_CHARTED_MEMORY")}
    store.publish(spark, at, spark.createDataFrame([("newer", "b", "failure", ["g.ts"])], new), stored, list(repair.FACETS), "2021")
    assert sorted(r.question for r in store.read(spark, at).collect()) == ["How are widgets painted", "[FACET:FAILURE] newer"]
    left, gone = store.listed(spark, at, stored.where("file != 'g.ts'"))
    assert left.count() == 1 and "missing: g.ts" in gone.first().text and store.read(spark, at).count() == 1
    with pytest.raises(store.StoreError, match="UNKNOWN_ID"):
        store.unchart(spark, at, spark.createDataFrame([("nope",)], "id string"))
    store.unchart(spark, at, spark.createDataFrame([("nope",), (first,)], "id string"), if_exists=True)
    assert store.read(spark, at).count() == 0


def test_migrate(spark, tmp_path):
    old, at = tmp_path / "old", f"file://{tmp_path}/new"
    (old / "entries").mkdir(parents=True)
    (old / "entries" / "0a1b2c3d.md").write_text("---\nid: 0a1b2c3d\nat: 2020\nfiles:\n  a.ts: " + "1" * 64 + "\n---\n\n# what\n\nbody\n")
    with pytest.raises(store.StoreError, match="NOT_LEXICAL"):
        store.migrate(spark, f"file://{old}", at)
    (old / "config.json").write_text('{"embedding": false}')
    with pytest.raises(store.StoreError, match="SOURCE_INVALID"):
        store.migrate(spark, f"file://{old}", f"file://{old}")
    assert store.migrate(spark, f"file://{old}", at) == 1
    r = store.read(spark, at).first()
    assert (r.id, r.question, r.details, [(f.file, f.sha256) for f in r.files]) == ("0a1b2c3d", "what", "body", [("a.ts", "1" * 64)])
    with pytest.raises(store.StoreError, match="NOT_EMPTY"):
        store.migrate(spark, f"file://{old}", at)
    (old / "config.json").write_text("{")
    with pytest.raises(store.StoreError, match="NOT_LEXICAL"):
        store.migrate(spark, f"file://{old}", f"file://{tmp_path}/other")


def test_citing(spark):
    a = spark.createDataFrame([(1, "e", "./f.ts"), (2, "e", "g.ts"), (3, "e", None)], "qid long, id string, path string")
    got = {r.qid: (r.id, r.miss_code) for r in router.citing(a, spark.createDataFrame([("e", "f.ts")], "id string, file string")).collect()}
    assert got == {1: ("e", None), 2: (None, "NO_CHARTED_MEMORY"), 3: ("e", None)}


def test_ranks_without_lists(spark):
    rows = [("a", v) for v in (5, 1, 3, 3, 9)] + [("b", 7), ("c", None)]
    v = spark.createDataFrame(rows, "k string, v long")
    for share, want in ((0.5, {"a": 3, "b": 7}), (0.95, {"a": 9, "b": 7}), (0.0, {"a": 1, "b": 7})):
        assert {r.k: r.value for r in E.at_rank(v, "k", "v", share).collect()} == want


def test_names_in_answers(spark):
    row = spark.createDataFrame([('{"name":"a","c":[{"name":"b\\"x"}]}',)], "t string")
    assert row.select(E.names_in(F.col("t"))).first()[0] == ["a", 'b\\"x']
    bin_ = spark.createDataFrame([("p", 1, "needle"), ("q", 1, "\0"), ("q", 2, "needle")], "path string, line long, text string")
    assert [r.path for r in E.exact_grep(bin_, spark.createDataFrame([("needle",)], "query string")).collect()] == ["p"]
