"""Mixing and licences: the SQL, brute force and edge cases; the pipeline stage by stage."""

import hashlib
import re

import corpus_pipeline
from halyard.llm import license, mixing, registry
from tests.conftest import same
from tests.llm.test_similarity import brute_fp, brute_hits


def test_sql(spark, duck, small):
    for name, sql in registry.ORACLES.items():
        same(registry.QUERIES[name](spark, small), duck.sql(sql))


def fill(sizes):
    """Targets by the rule: shares by weight, what is over a cap goes round again."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    rest, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        each = (rest - 2 * sum(sizes[s] for s in capped)) / max(1, sum(w[s] for s in free))
        over = {s for s in free if 2 * sizes[s] < w[s] * each}
        if not over:
            return {s: 2 * sizes[s] if s in capped else w[s] * each for s in names}
        capped |= over


def test_mix(make):
    rows = [(k, "w " * (k % 7), "en", [None, "a", "é", "b", "Z", "a"][k % 6]) for k in range(400)] + [(5, None, "en", "b"), (5, "x y", "en", "b"), (None, "u v w", "en", "a"), (900, " ", "en", "empty")]
    docs = make(rows)
    sized, src = mixing.plan(docs)
    got = {r.source: r for r in src.collect()}
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    assert {s: r.source_size for s, r in got.items()} == sizes
    assert all(abs(got[s].target - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
    full = mixing.mixed(docs)
    assert full.columns == docs.columns
    taken = {}
    for r in full.collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    for s in sizes:
        assert abs(taken.get(s, 0) - want[s]) <= max(8, 0.05 * want[s])
    again = sorted(str(r) for r in mixing.mixed(docs).collect())
    assert again == sorted(str(r) for r in full.collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_many_sources(make, monkeypatch):
    """The salted join gives what the broadcast gives."""
    docs = make([(k, "w " * (k % 5), "en", None if k % 3 else f"s{k % 11}") for k in range(200)])
    want = sorted(str(r) for r in mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "MANY", 0)
    from halyard.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    assert sorted(str(r) for r in mixing.mixed(docs).collect()) == want


def test_license(make):
    mit = dict(license.KNOWN[:1])["MIT"]
    texts = [mit, mit.upper(), "Copyright (c) 2020 Some One\n\n" + mit.replace("“", '"').replace(",", " ,"), " * " + mit.replace("\n", "\r\n"), mit.replace("sublicense", "sublicence"), mit + " x", None, "", "(c) 2020", "text\nReleased under the MIT Licence!\nLICENSED UNDER CC BY NC 4.0\nmore"]
    docs = make([(k, t, "en", "s") for k, t in enumerate(texts)] + [(0, mit, "en", "s"), (None, mit, None, None)])
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.license, r.notices) for r in license.scan(docs).collect())
    assert [g[:2] for g in got] == [(-1, "MIT"), (0, "MIT"), (0, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "MIT"), (5, None), (6, None), (7, None), (8, None), (9, None)]
    assert got[-1][2] == "CC-BY-NC-4.0,MIT"
    digests = {r.doc_id: r.digest for r in license.scan(docs).collect()}
    assert digests[6] is None and digests[7] == digests[8] == hashlib.sha256(b"").hexdigest()
    assert license.scan(docs.limit(0)).count() == 0


def test_license_is_native(make):
    plan = license.scan(make([(1, "x", "en", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark, small):
    """Each stage against what brute force makes of its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, small)
        if name != "tokens":
            assert out.columns == names
        rows = out.collect()
        ids = sorted(r.doc_id for r in rows)
        if name == "simhash":
            fps = [(r.doc_id, brute_fp(r.text)) for r in before]
            root = {i: i for i, _ in fps}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i, f in fps:
                for j, g in fps:
                    if (f ^ g).bit_count() <= 3:
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
            assert ids == sorted(i for i, _ in fps if find(i) == i)
        elif name == "decontaminate":
            assert ids == sorted(r.doc_id for r in before if not brute_hits(r.text, items)[4])
        elif name == "mix":
            sizes = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in before}
            per = {}
            for r in before:
                per[r.source] = per.get(r.source, 0) + sizes[r.doc_id]
            taken = {src: sum(sizes[r.doc_id] for r in rows if r.source == src) for src in per}
            for src, target in fill(per).items():
                rate, most = target / per[src], max(sizes[r.doc_id] for r in before if r.source == src)
                assert abs(taken[src] - target) <= max(3 * most, 0.05 * target)
                copies = {ids.count(r.doc_id) for r in before if r.source == src}
                assert copies <= {int(rate), min(2, int(rate) + 1)}
        elif name == "tokens":
            assert len(rows) == len(before) and {r.doc_id for r in rows} == {r.doc_id for r in before}
        docs = spark.createDataFrame(rows, out.schema)


def test_pipeline_edges(odd, small, spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), small).count() == 0
        before, rows = [r.doc_id for r in odd.collect()], stage(spark, odd, small).collect()
        ids = [r.doc_id for r in rows]
        if name in ("toxicity", "decontaminate", "tokens"):  # nothing there is toxic or of the benchmark
            assert sorted(ids, key=str) == sorted(before, key=str)
        elif name == "simhash":  # equal texts, and all without a word, are one each
            assert sorted(ids) == [1, 2, 5, 6]
        else:
            assert set(ids) <= set(before) and all(ids.count(i) <= 2 * before.count(i) for i in before)
