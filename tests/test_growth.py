"""Steps whose rows once grew faster than their input: same results, from fewer rows."""

import random
import re
import unicodedata

import duckdb
from pyspark.sql import functions as F

from halyard.functions import fuzzy, trie
from halyard.functions.substrings import holders
from halyard.operators import fuzzy as ranking
from halyard.operators import integrity, memory, paths, router, symbols
from halyard.plans import catalog
from halyard.sources import corpus as C
from tests.conftest import same


def test_call_targets_are_counts(spark):
    """Calls and definitions of one name: a row a call, whatever the number of definitions."""
    kinds = ["class", "function", "method", "constructor", "import"]
    defs = [("f", f"c{i % 3}.f", kinds[i % 5], f"p{i % 4}.ts", i) for i in range(60)] + [("g", "c1.g", "method", "p1.ts", 1), ("g", "g", "function", "p2.ts", 2), ("h", None, "class", "p.ts", 3)]
    syms = spark.createDataFrame(defs, "name string, qualified string, kind string, path string, line long")
    asked = [(n, r, p, o) for n in ("f", "g", "h", "none") for r in (None, "new", "this", "c1", "x") for p in ("p1.ts", "p9.ts") for o in (None, "c1")]
    calls = spark.createDataFrame([(str(k), *a) for k, a in enumerate(asked)], "call_id string, callee string, receiver string, path string, owner string")
    want = symbols.resolve(calls, syms).groupBy("call_id").agg(F.count("*").alias("n"), F.min("qualified"), F.min("def_path"))
    got = symbols.targets(calls, syms)
    assert got.count() == got.select("call_id").distinct().count()
    assert sorted(map(str, got.collect())) != [] and sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.collect())


def test_call_resolve_of_odd_parts(spark, small, tmp_path):
    """Parts without a brand, repeated lines and keys below zero."""
    for t in ("supplier", "customer"):
        C.table(spark, small, t).write.parquet(f"{tmp_path}/{t}.parquet")
    p = C.table(spark, small, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")))
    p.write.parquet(f"{tmp_path}/part.parquet")
    li = C.table(spark, small, "lineitem")
    li.union(li.where("l_suppkey % 2 = 0")).union(li.withColumn("l_suppkey", -F.col("l_suppkey"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("supplier", "customer", "part", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    same(catalog.QUERIES["call_resolve"](spark, str(tmp_path)), c.sql(catalog.ORACLES["call_resolve"]))


def test_holders():
    r = random.Random(3)
    word = lambda k: "".join(r.choices("abc_é", k=r.randrange(k)))
    texts, terms = [None, *[word(40) for _ in range(200)]], {word(20) for _ in range(200)} | {"", "zz", "a" * 17}
    assert holders(terms, texts) == {t: [k for k, x in enumerate(texts) if x is not None and t in x] for t in terms}


def test_scoped_heads(spark):
    """As the full lists, cut to the first few; names repeated in a file, null names, files that aren't there."""
    syms = [(f"f{i % 2}.ts", n, i // 3) for i in range(60) for n in [("fooBar", "barFoo", "sup_01", None, "x")[i % 5]]]
    s = spark.createDataFrame(syms, "path string, name string, start_line long")
    asked = [("where is fooBar", "f0.ts"), ("where is foobar", "f1.ts"), ("", "f0.ts"), ("what about sup_01 or fooBar", "f0.ts"), ("zzz qqq", "f1.ts"), ("", "no.ts"), (None, "f0.ts"), ("", None)]
    q = spark.createDataFrame([(str(k), *a) for k, a in enumerate(asked)], "qid string, question string, path string")
    got = {r.qid: r for r in router.scoped_heads(q, s, 3).collect()}
    assert len(got) == len(asked) and any(r.n > 3 for r in got.values()) and got["0"].terms == ["fooBar"] and got["2"].terms == []
    for k, (_, path) in enumerate(asked):
        r = got[str(k)]
        held = lambda n: r.terms == [] or n is not None and r.terms is not None and any(t is not None and t.lower() in n.lower() for t in r.terms)  # noqa: B023, E731
        names = [n for _, _, n in sorted((ln, n is not None, n) for p, n, ln in syms if p == path and held(n))]
        assert (r.n, r.names, r.status, r.miss_code) == (len(names), names[:3], *(("hit", None) if names else ("miss", "SYMBOL_NOT_FOUND")))


def test_path_questions_by_distinct_text(spark):
    """Questions that many ask, and names that many files bear, against brute force; short, empty, null and long ones too."""
    r = random.Random(5)
    names = sorted({"/".join(r.choice(["ab", "Ab", "src", "x.ts", "y.ts", "é", "longer_name_of_a_file.ts", ""]) for _ in range(r.randrange(1, 4))) for _ in range(120)})
    low = lambda t: (t.lower(), t.lower().split("/")[-1])
    f = spark.createDataFrame([(p, k, *low(p)) for k, p in enumerate(names)], "path string, ord long, lower_path string, base string")
    texts = ["", None, "a", "/", "é", "ts", ".TS", "b/x", "x.ts", "./x.ts", "longer_name", "longer_name_of_a_file.tss", *r.sample(names, 15), *[p[1:-1] for p in r.sample(names, 15)]] * 3
    q = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "qid string, question string")
    wants = paths.prepared(q).select("lower_path")
    got = [(x.lower_path, x.path, x.at_end) for x in paths.containing(wants, f).collect()]
    asked = {x.lower_path for x in wants.collect()} - {None, ""}
    assert sorted(got) == sorted((w, p, p.lower().endswith(w)) for w in asked for p in names if w in p.lower())
    want = set()
    for k, t in enumerate(texts):
        norm = None if t is None else t.removeprefix("./")
        if norm:
            named, ends, held = ([p for p in names if fits(p.lower())] for fits in (lambda p: p.split("/")[-1] == norm.lower().split("/")[-1], lambda p: p.endswith(norm.lower()), lambda p: norm.lower() in p))  # noqa: B023
            for kind, found in (("basename", named), ("suffix", ends), ("substring", held)):
                if len(found) > 1:
                    want.add((str(k), t, "AMBIGUOUS_PATH_COLLISION", kind, len(found), ",".join(found[:10])))
                    break
    assert {tuple(x) for x in paths.collisions(q, f).collect()} == want and len(want) > 20


def test_questions_are_spread_and_made_once_a_name(spark, small, tmp_path):
    """Small files are one split; what is made of their rows is for all cores. Most parts bear one name."""
    p = C.table(spark, small, "part").withColumn("p_brand", F.lit("Brand#1")).withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise("hot bolt"))
    p.write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for t in ("supplier", "customer", "conversations"):
        C.table(spark, small, t).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("intent_classify", "token_partition"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
        same(df, c.sql(catalog.ORACLES[name]))


def test_trie_and_scores():
    r = random.Random(7)
    word = lambda k, of="abAB1_.é\U0001f600": "".join(r.choices(of, k=r.randrange(k)))
    names = sorted({word(14) for _ in range(400)} | {"", "a", "ab", "ab_" + "x" * 30})
    t = trie.Trie(names)
    for want in {fuzzy.lowered(word(6)) for _ in range(300)} - {""}:
        got = sorted(n for node in t.matches(want) for n in names[node[trie.LO] : node[trie.HI]])
        assert got == [n for n in names if fuzzy.is_subsequence(want, fuzzy.lowered(n))]
    pairs = [(p, n) for n in names for p in (word(6), n[:3], n) if fuzzy.is_subsequence(fuzzy.lowered(p), fuzzy.lowered(n))]
    assert fuzzy.scores(pairs, 500) == [fuzzy.score(p, n) for p, n in pairs]
    assert all(fuzzy.ranges(n, n) == ([(0, len(fuzzy.units(n)))] if n else []) for n in names)


def test_rank_where_many_names_score_the_same(spark):
    """Names that share all that a token matches are settled together; the order among them is as before."""
    syms = [(f"Customer_{k:04}", f"lib/{k % 3}.mjs", k, "function") for k in range(300)] + [("cosmeTer", "a.ts", 1, "class"), ("Customer_x", "b.ts", 2, "class"), ("ter", "z.ts", 3, "class"), ("ter", "y.ts", 9, "class")]
    s = spark.createDataFrame(syms, "name string, path string, line long, kind string")
    tokens = ["ter", "cust", "c1", "customer_0007", "omer_x", "zz", "Customer0001"]
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    for caller in (None, "lib/1.mjs"):
        want = set()
        for t in tokens:
            best = []
            for n, p, ln, k in syms:
                raw, near = fuzzy.score(t, n), 0 if caller is None else 20 if p.startswith("lib/") else 10
                if raw >= 0 and (c := fuzzy.confidence(raw + near, len(t))) >= 60:
                    best.append((-c, len(n), p, ln, n, k))
            want |= {(t, i, n, p, ln, k, -c) for i, (c, _, p, ln, n, k) in enumerate(sorted(best)[:5], 1)}
        assert {tuple(x)[:7] for x in ranking.rank(asked, s, caller=caller).collect()} == want


def test_only_texts_that_nfc_may_change_go_to_python(spark):
    r = random.Random(9)
    pool = "aeé\u0301\u0323\u0327\u1100\u1161\u11a8\uac00\u09c7\u09be\u212b\u2126\ufb1d\U0001d15e\U0001f600\n "
    texts = ["", None, "déjà vu, ç, ü\n日本語 한국어 \U0001f600", *["".join(r.choices(pool, k=r.randrange(1, 6))) for _ in range(600)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x.n for x in df.select(integrity.nfc(F.col("t")).alias("n")).collect()] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    may = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in integrity.composable()) + "]")
    assert not may.search(texts[2]) and all(may.search(t) or unicodedata.normalize("NFC", t) == t for t in texts if t)
    odd = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert {x.t for x in df.where(F.col("t").rlike(integrity._pattern())).collect()} == {t for t in odd if may.search(t)}


def test_best_names_are_found_without_meeting_all():
    """Digits that most names hold: as brute force has it, from a small part of the names; odd alphabets too."""
    r = random.Random(11)
    for of in ("abAB1_.é", "0123456789_Ca", "ab"):
        names = sorted({"".join(r.choices(of, k=r.randrange(14))) for _ in range(150)} | {f"Customer_{r.randrange(3000):06}" for _ in range(100)})
        t, place = trie.Trie(names), list(range(len(names)))
        r.shuffle(place)
        for top, least in ((1, 60), (5, 60), (3, 1)):
            first = {}
            for _ in range(40):
                want = "".join(r.choices(of + "0123", k=r.randrange(1, 7))) if r.random() < 0.7 else r.choice(names) or "a"
                grade = lambda raw, n=len(want): fuzzy.confidence(raw, n)
                full = sorted((-grade(s), place[k], s) for k, n in enumerate(names) if (s := fuzzy.score(want, n)) >= 0 and grade(s) >= least)
                assert t.best(fuzzy.lowered(want), top, place, grade, least, first) == full[:top]
    names = [f"Customer_{k:09}" for k in range(30_000)]
    t, place, graded = trie.Trie(names), list(range(30_000)), []
    for want in ("1024", "100", "2999"):
        grade = lambda raw, n=len(want): graded.append(raw) or fuzzy.confidence(raw, n)
        (_, k, raw), *_ = t.best(want, 1, place, grade, 60, {})
        held = [(-fuzzy.confidence(s, len(want)), k, s) for k, (n, s) in enumerate(zip(names, fuzzy.scores([(want, n) if fuzzy.is_subsequence(want, n) else ("", "") for n in names]))) if s > 0]
        assert min(held)[1:] == (k, raw)
    assert len(graded) < 3_000


def test_tokens_that_are_names_and_tokens_that_fit_nowhere(spark):
    """Names that are the token, case aside, come first whether joined or searched; the Kelvin sign is a k."""
    syms = [("Ab_cd", "p.ts", 1, "class"), ("aB_cd", "a.ts", 2, "class"), ("AB_CD_x", "a.ts", 1, None), ("oK_1", "k.ts", 1, "class"), ("ok_12", "k.ts", 2, "class"), ("\U0001f600ab_cd", "e.ts", 1, "class"), (None, "n.ts", 1, "class"), ("", "n.ts", 2, "class"), ("ok_1", None, None, "class")] + [("many", "m.ts", k, "class") for k in range(9)]
    s = spark.createDataFrame(syms, "name string, path string, line long, kind string")
    tokens = ["ab_cd", "AB_CD", "ok_1", "oK_1", "many", "Many", "zzz", "ab_cd_xy", "\U0001f600ab", "m", "ab_cd" * 9]
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    for top in (1, 2, 5):
        want = set()
        for t in tokens:
            full = []
            for n, p, ln, k in syms:
                if n and (raw := fuzzy.score(t, n)) >= 0 and (c := fuzzy.confidence(raw, len(fuzzy.units(t)))) >= 60:
                    full.append((-c, len(n), p is not None, p or "", ln or 0, n, p, ln, k))
            want |= {(t, i, n, p, ln, k, -c) for i, (c, _, _, _, _, n, p, ln, k) in enumerate(sorted(full, key=lambda x: x[:6])[:top], 1)}
        assert {tuple(x)[:7] for x in ranking.rank(asked, s, top=top).collect()} == want


def test_questions_with_the_same_shared_terms(spark):
    """BM25 scores a set of terms once, whatever the number of questions that come to it."""
    docs = spark.createDataFrame([(k, f"alpha {'beta ' * (k % 3)}gamma{k}") for k in range(30)], "id long, body string")
    texts = ["alpha", "beta alpha", "gamma7 beta", "none"]
    few = {r.qid: (r.id, r.rank, r.score) for r in memory.bm25(spark.createDataFrame([(t, t) for t in texts], "qid string, question string"), docs, 1).collect()}
    asked = spark.createDataFrame([(f"{t}:{k}", f"x{k}y {t}") for t in texts for k in range(200)], "qid string, question string")
    got = memory.bm25(asked, docs, 1).collect()
    assert len(got) == 600 and all((r.id, r.rank, r.score) == few[r.qid.split(":")[0]] for r in got)
