"""Classifiers by held-out accuracy on the small table, and their edge cases."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from halyard.llm import language, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(ship):
    return ship.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(ship):
    return ship.read.parquet(f"{DATA}/labels.parquet")


def test_held_out_rows_never_teach(docs, labels, ship):
    """Other labels and texts of held-out rows leave the model as it is."""
    flipped = labels.withColumn("toxic", F.when(toxicity.allowed(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = toxicity.train(docs, labels, toxicity.allowed()), toxicity.train(docs, flipped, toxicity.allowed())
    assert all((x == y).all() for x, y in zip(a, b))


def test_toxicity(docs, labels):
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels, toxicity.allowed())).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    clean = [s for s, y in held if not y]
    assert np.mean([s >= 0.5 for s in clean]) < 0.05
    assert np.mean([s for s, y in held if y]) > np.mean(clean)


def test_toxicity_scores_are_sums_of_weights(docs, labels):
    """Scores by brute force: the weights of a text's distinct hashed words, pairs and skip pairs."""
    at, w = toxicity.train(docs, labels, toxicity.allowed())
    weight = dict(zip(at.tolist(), w.tolist()))
    mask = (1 << 64) - 1

    def coordinate(a, b, salt):
        x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + salt * 0x165667B19E3779F9) & mask
        x ^= x >> 31
        x = x * 0xBF58476D1CE4E5B9 & mask
        return (x ^ x >> 29) >> (64 - toxicity.BITS)

    for r in toxicity.score(docs.limit(60), (at, w)).join(docs.select("doc_id", "text"), "doc_id").collect():
        clean = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (r.text or "").lower())
        h = [xxhash.xxh64_intdigest(x.encode()) for x in re.split("[ \t-\r]+", clean) if x]
        own = {coordinate(x, 0, 1) for x in h} | {coordinate(x, y, 2) for x, y in zip(h, h[1:])} | {coordinate(x, y, 3) for x, y in zip(h, h[2:])}
        want = 1 / (1 + np.exp(-(weight[toxicity.BIAS] + sum(weight.get(c, 0.0) for c in own))))
        assert abs(r.score - want) < 1e-4


def test_repeated_ids_teach_once(ship, labels):
    """However many rows an id has, the training task gets one."""
    rows = [(k % 3, f"text {k}", "x") for k in range(300)]
    docs = ship.createDataFrame(rows, "doc_id long, text string, y string")
    some = ship.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    once = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    a, b = toxicity.train(docs, some, F.lit(True)), toxicity.train(once, some, F.lit(True))
    assert all((x == y).all() for x, y in zip(a, b))
    a, b = quality.train(docs, some, F.lit(True)), quality.train(once, some, F.lit(True))
    assert all((a[k] == b[k]).all() for k in a)


def brute_probability(m, text):
    b = text.encode()
    blocks = max(2, -(-len(b) // 128))
    b = b + bytes(blocks * 128 + 6 - len(b))
    at = [[sum(float(m["e"][b[2 * i + k]] @ m["w"][8 * k : 8 * k + 8, f]) for k in range(8)) for f in range(quality.FILTERS)] for i in range(64 * blocks)]
    hidden = []
    for c in range(blocks - 1):
        top = np.maximum([max(at[i][f] for i in range(64 * c, 64 * c + 128)) + m["b"][f] for f in range(quality.FILTERS)], 0)
        hidden.append(np.maximum(top @ m["v"] + m["c"], 0))
    z = np.concatenate((np.mean(hidden, 0), np.max(hidden, 0))) @ m["u"] + m["d"][0]
    return 1 / (1 + np.exp(-z))


def test_quality_is_the_whole_network():
    """Probabilities by brute force: every filter at every place, chunk maxima, hidden layer, one output."""
    m = {k: v.astype(np.float64) for k, v in quality.initial(5).items()}
    for text in ["", "short", "Some text, é and more. " * 30, "x" * 700]:
        assert abs(quality.probability(m, text) - brute_probability(m, text)) < 1e-6


def test_language_is_the_largest_cosine(docs):
    """Predictions by brute force over the learned prototypes."""
    model = language.train(docs, F.lit(True))
    names, protos = model
    unit = protos / np.linalg.norm(protos, axis=1, keepdims=True)
    mean = unit.mean(0)
    p = language.Profiler()
    for r in language.predict(docs.limit(60), model).join(docs.select("doc_id", "text"), "doc_id").collect():
        v = p.vector(r.text)
        if v is None:
            assert r.lang_pred == "und"
            continue
        v = v / np.linalg.norm(v) - mean
        cos = {n: float((u - mean) @ v / np.linalg.norm(u - mean) / np.linalg.norm(v)) for n, u in zip(names, unit)}
        assert r.lang_pred == max(cos, key=cos.get) and abs(r.score - min(1, max(0, cos[r.lang_pred]))) < 1e-6


def test_languages_are_bounded(make):
    docs = make([(k, "abc def ghi " * 3, f"l{k % 5}", "s") for k in range(23)])
    assert language.train(docs, F.lit(True), max_langs=3)[0] == ["l0", "l1", "l2"]


def test_toxicity_fit():
    r = np.random.default_rng(1)
    rows = []
    for k in range(400):
        y = int(k % 4 == 0)
        words = [f"w{i}" for i in r.integers(0, 300, 60)] + (["awful"] if y else [])
        rows.append((np.unique(toxicity.features(" ".join(words))), y))
    w = toxicity.fit(list(rows))
    p = np.array([w[toxicity.BIAS] + w[f].sum() > 0 for f, _ in rows])
    assert (p == np.array([y for _, y in rows])).mean() > 0.97
    assert (w != 0).sum() < 2000


def test_toxicity_edges(odd, labels, ship):
    none = toxicity.train(odd, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    some = ship.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, some, F.lit(True))
    kept = toxicity.keep_clean(odd, model, 2.0)
    assert kept.count() == odd.count() and kept.columns == odd.columns
    assert toxicity.score(odd.limit(0), model).count() == 0
    scores = toxicity.score(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in scores) and len(scores) == odd.count()


def test_quality_learns():
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows = [(" ".join(word() + ("%%%" if k % 3 == 0 else "") for _ in range(40)), int(k % 3 != 0)) for k in range(150)]
    m = quality.fit(rows[:100], epochs=4)
    assert np.mean([(quality.probability(m, t) >= 0.5) == bool(y) for t, y in rows[100:]]) > 0.95


def test_quality_gradients():
    """The hand-written gradients agree with differences."""
    m = {k: v.astype(np.float64) for k, v in quality.initial(3).items()}
    text = "Some text, with bytes é and more of it. " * 9
    g, _ = quality.gradients(m, text, 1)
    loss = lambda: -np.log(quality.probability(m, text))
    r = np.random.default_rng(4)
    for k in m:
        for at in [tuple(r.integers(0, s) for s in m[k].shape) for _ in range(6)]:
            if k == "e":
                at = (r.choice(list(text.encode())), at[1])
            old, step = m[k][at], 1e-6
            m[k][at] = old + step
            up = loss()
            m[k][at] = old - step
            down = loss()
            m[k][at] = old
            assert abs((up - down) / (2 * step) - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_quality_slices():
    """Slicing a long text changes nothing."""
    m = quality.initial(1)
    text = "word %% other | thing\n" * 4000
    whole = quality.SLICE
    a = quality.probability(m, text)
    quality.SLICE = 3
    try:
        assert abs(quality.probability(m, text) - a) < 1e-6
    finally:
        quality.SLICE = whole


def test_quality_edges(odd, labels, ship):
    assert quality.train(odd, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.0}
    some = ship.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score(odd, quality.train(odd, some, F.lit(True))).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id in (2, 3)]
    assert same[0] == same[1]


def test_language(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs, ~held)).collect()}
    rows = docs.where(held).where("lang IS NOT NULL").collect()
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(odd, make):
    model = language.train(odd, F.lit(True))
    assert model[0] == ["de", "en"]
    got = language.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 3, 4))
    assert all(r.lang_pred in ("de", "en") for r in got if r.doc_id in (1, 5, 6))
    assert {r.lang_pred for r in language.predict(odd, language.train(odd.limit(0), F.lit(True))).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0
    assert [r.lang_pred for r in language.predict(make([(1, "123 !?", "en", "s")]), model).collect()] == ["und"]


def test_language_vectors():
    """A text's vector is the sum of its n-grams' bound and rotated letter vectors."""
    p, v = language.Profiler(), language.letters().astype(int)
    text = "Ab, a"
    slots = [0, *[1 + ord(c) % 251 for c in "ab"], 0, 1 + ord("a") % 251, 0]
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(slots, slots[1:], slots[2:]))
    assert (p.vector(text) == want).all()
    held = language.HELD
    language.HELD = 2
    try:
        assert (language.Profiler().vector(text) == want).all()
    finally:
        language.HELD = held
