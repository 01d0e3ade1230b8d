"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs one word apart, hashed to BUCKETS coordinates. Training runs
over a bounded sample (`max_train`, documented: rows of labelled documents, chosen by a hash of the id) in one task,
with a learning rate per coordinate; the L1 term leaves few non-zero weights, which is what is broadcast, never more
than BUCKETS of them. Every row is then scored over its whole text.

Cases: null and empty texts score as the bias alone; repeated label rows of a document count as the largest of them,
null labels as none, and of documents with one id the smallest text is learned from; without any labelled row every score
is 0; a null doc_id is never labelled; very long texts are scored whole; repeated rows stay rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import bounded_sample, crc_mod, mix, table, tidy, words_of

BITS = 20
BUCKETS = 1 << BITS
BIAS = BUCKETS
MAX_TRAIN = 16_000
ALPHA, BETA, L1, L2, EPOCHS, LEAST = 1.0, 1.0, 5.0, 0.0, 6, 4


def features(text: str | None) -> np.ndarray:
    """The hashed coordinates of a text's words, word pairs and skip pairs, with repeats."""
    words = words_of(text.lower() if text else "")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    zero = np.zeros(1, np.uint64)
    parts = [mix(h, zero, 1), mix(h[:-1], h[1:], 2), mix(h[:-2], h[2:], 3)]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, least: int = LEAST) -> np.ndarray:
    """FTRL-proximal weights, the bias last; rows: distinct coordinates and label, which are used up.

    Coordinates are taken in once `least` rows have them.
    """
    seen = np.zeros(BUCKETS, np.int32)
    for at, _ in rows:
        seen[at] += 1
    for k, (at, y) in enumerate(rows):
        rows[k] = (at[seen[at] >= least], y)
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for at, y in rows:
            w = weights(at)
            wb = -z[BIAS] / ((beta + np.sqrt(n[BIAS])) / alpha)  # the bias isn't regularised
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - y
            g2 = g * g
            old = n[at]
            z[at] += g - (np.sqrt(old + g2) - np.sqrt(old)) / alpha * w
            n[at] = old + g2
            z[BIAS] += g - (np.sqrt(n[BIAS] + g2) - np.sqrt(n[BIAS])) / alpha * wb
            n[BIAS] += g2
    w = weights(slice(None))
    w[BIAS] = -z[BIAS] / ((beta + np.sqrt(n[BIAS])) / alpha)
    return w


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(np.unique(features(t)), int(y)) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    if not rows:
        return
    w = fit(rows)
    at = np.flatnonzero(w)
    at = at if BIAS in at[-1:] else np.append(at, BIAS)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["at", "w"])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights of the model; labels come from rows with `allowed` only."""
    own = labels.where(allowed & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = bounded_sample(own, max_train).select(F.col("doc_id").alias("_id"), "y")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one row an id, however often it comes
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "text").select("text", "y")
    got = rows.mapInArrow(tidy(_train), "at int, w double").toArrow()
    return got["at"].to_numpy(), got["w"].to_numpy()


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        dense = np.zeros(BUCKETS, np.float32)
        bias = float(w[-1]) if len(w) else -np.inf
        dense[at[:-1]] = w[:-1]
        for b in batches:
            out = np.empty(b.num_rows)
            for i, x in enumerate(b.column(1)):
                f = features(x.as_py())
                f = f[dense[f] != 0]
                out[i] = bias + float(dense[np.unique(f)].sum(dtype=np.float64))
            score = 1 / (1 + np.exp(-np.clip(out, -35, 35))) if len(w) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:1], pa.array(score), *b.columns[2:]], ["doc_id", "score", *b.schema.names[2:]])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_scorer(shared)), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """The rows scored under the threshold, all columns kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = _scorer(shared)
    k = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(k)], ["doc_id", "text"])
            (got,) = run(iter([plain]))
            yield b.filter(pa.array(got.column(1).to_numpy() < threshold))

    return docs.mapInArrow(tidy(choose), docs.schema)


def allowed(col: str = "doc_id") -> Column:
    return crc_mod(F.col(col), 5) != 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = score(docs, train(docs, labels, allowed()))
    return got.select("doc_id", (~allowed()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}  # a trained model isn't SQL: tests measure held-out accuracy
