"""Queries that once left a part of their input out, against brute force over the whole of it."""

from collections import defaultdict

from halyard.functions import fuzzy
from halyard.operators import evaluate, evidence
from halyard.plans import catalog, router_queries
from halyard.sources import corpus as C


def test_flat_graph_has_all_edges(spark, small):
    ins, outs = defaultdict(set), defaultdict(set)
    for r in C.edges(spark, small).collect():
        ins[r.dst].add(r.src)
        outs[r.src].add(r.dst)
    lists = lambda s: ", ".join(sorted(s)) or "None"
    want = {
        n: f"function: {n}\ndirection: both\ncallees_total: {len(outs.get(n, ()))}\ncallees: {lists(outs.get(n, ()))}\ncallers_total: {len(ins.get(n, ()))}\ncallers: {lists(ins.get(n, ()))}"
        for n in {*ins, *outs}
    }
    rows = catalog.QUERIES["render_flat_graph"](spark, small).collect()
    assert len(rows) == len(want) and {r.node: r.text for r in rows} == want
    assert any(n.startswith("customer:") for n in want) and any(n.startswith("order:") for n in want)


def test_outline_filter_reads_whole_lines(spark, small):
    want = []
    for r in C.lines(spark, small).where("text IS NOT NULL").collect():
        terms = [t for t in r.path.split("/")[0].split("src") if t] + ["tion"]
        low = r.text.lower()
        if "ent" in low and any(t.lower() in low for t in terms):
            want.append((r.path, r.line, r.text))
    got = [(r.path, r.line, r.name) for r in catalog.QUERIES["outline_filter"](spark, small).collect()]
    assert sorted(got) == sorted(want)
    assert any("ent" not in t[:40].lower() for _, _, t in want)


def test_fuzzy_rank_over_both_tiers(spark, small):
    syms = [(r.name, r.path, r.line, r.kind) for r in C.symbols(spark, small).collect()]
    names = {s[0] for s in syms}
    tokens = {f for n in names for f in (n, n[:3] + n[4:], n.replace("_", ""), n.lower())} - {""}
    want = set()
    for t in tokens:
        score = {n: fuzzy.confidence(fuzzy.score(t, n), len(t)) for n in names if fuzzy.is_subsequence(t.lower(), n.lower())}
        best = sorted((-score[n], len(n), p, ln, n, k) for n, p, ln, k in syms if score.get(n, 0) >= 60)[:5]
        want |= {(t, i, n, p, ln, k, -c) for i, (c, _, p, ln, n, k) in enumerate(best, 1)}
    got = {tuple(r)[:7] for r in catalog.QUERIES["fuzzy_rank"](spark, small).collect()}
    assert got == want and any(".mjs" in w[3] for w in want)


def test_route_batch_asks_of_both_tiers(spark, small):
    asked = {r.qid for r in router_queries.batch(spark, small).where("qid LIKE 's:%'").collect()}
    assert asked == {f"s:{r.qualified}:{k}" for r in C.symbols(spark, small).select("qualified").distinct().collect() for k in range(5)}


def test_long_lists_count_in_full(spark):
    lines = spark.createDataFrame([("a.ts", 1, "only word here")], "path string, line int, text string")
    asked = spark.createDataFrame([(f"q{i}",) for i in range(1500)] + [("word",)], "query string").coalesce(1)
    got = {r.query: r.total_matches for r in evaluate.baseline(lines, asked).collect()}
    assert len(got) == 1501 and got["word"] == 1 and sum(got.values()) == 1
    facets = spark.createDataFrame([(f"f{i}", ["zzz"]) for i in range(150)] + [("last", ["word"])], "facet string, keywords array<string>").coalesce(1)
    assert [r.facet for r in evidence.evidence(lines, facets).collect()] == ["last"]
