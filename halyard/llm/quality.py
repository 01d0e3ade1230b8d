"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded, FILTERS learned filters of SPAN bytes run over the whole text every STRIDE bytes, and are
max-pooled over chunks of two BLOCKs of positions, each overlapping the next by one. A hidden layer reads each chunk's
maxima; its mean and its maximum over all chunks give one probability.

Training is Adam by hand-written gradients in one task, over a bounded sample (`max_train`, documented: rows of labelled
documents, chosen by a hash of the id), with whole texts. Scoring covers every whole text, in slices that overlap so
that no position is lost, with bounded memory.

Cases: null and empty texts are scored as padding alone; repeated label rows of a document count as the largest, null
labels as none, and of documents with one id the smallest text is learned from; without any labelled row every score is 0; a null doc_id is never labelled; repeated rows stay rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import bounded_sample, crc_mod, table, tidy

EMBED, SPAN, STRIDE, FILTERS, HIDDEN, BLOCK = 8, 8, 2, 32, 16, 64
MAX_TRAIN, EPOCHS, BATCH, RATE, SLICE = 4000, 5, 16, 0.004, 256  # SLICE: blocks at a time


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return {
        "e": f(256, EMBED, scale=0.5), "w": f(SPAN * EMBED, FILTERS, scale=(2 / (SPAN * EMBED)) ** 0.5), "b": np.zeros(FILTERS, np.float32),
        "v": f(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), "c": np.zeros(HIDDEN, np.float32), "u": f(2 * HIDDEN, scale=0.2), "d": np.zeros(1, np.float32),
    }


def padded(text: str | None) -> np.ndarray:
    """The text's bytes with zeros behind, for a whole number of blocks, two at least."""
    b = (text or "").encode("utf-8", "surrogatepass")
    blocks = max(2, -(-len(b) // (BLOCK * STRIDE)))
    return np.frombuffer(b.ljust(blocks * BLOCK * STRIDE + SPAN - STRIDE, b"\0"), np.uint8)


def _windows(x: np.ndarray) -> np.ndarray:
    n = (len(x) - SPAN) // STRIDE + 1
    s = x.strides[0]
    return np.lib.stride_tricks.as_strided(x, (n, SPAN * EMBED), (s * STRIDE, x.strides[1]), writeable=False)


def _blocks(m: dict[str, np.ndarray], x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's maximum in each block of positions, and the position of it."""
    tops, at = [], []
    step = SLICE * BLOCK * STRIDE
    for lo in range(0, len(x) - (SPAN - STRIDE), step):
        r = (_windows(m["e"][x[lo : lo + step + SPAN - STRIDE]]) @ m["w"]).reshape(-1, BLOCK, FILTERS)
        tops.append(r.max(1))
        if where:
            k = r.argmax(1)
            at.append(k + (np.arange(len(k)) * BLOCK + lo // STRIDE)[:, None])
    return np.concatenate(tops), np.concatenate(at) if where else None


def probability(m: dict[str, np.ndarray], text: str | None) -> float:
    top, _ = _blocks(m, padded(text))
    h = np.maximum(np.maximum(np.maximum(top[:-1], top[1:]) + m["b"], 0) @ m["v"] + m["c"], 0)
    z = float(np.concatenate((h.mean(0), h.max(0))) @ m["u"] + m["d"][0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(m: dict[str, np.ndarray], text: str | None, y: int) -> tuple[dict[str, np.ndarray], float]:
    """The loss's gradients for one document, and the loss."""
    x = padded(text)
    top, at = _blocks(m, x, True)
    later = top[1:] > top[:-1]
    best, place = np.where(later, top[1:], top[:-1]) + m["b"], np.where(later, at[1:], at[:-1])
    a = np.maximum(best, 0)
    pre = a @ m["v"] + m["c"]
    h = np.maximum(pre, 0)
    k = h.argmax(0)
    feats = np.concatenate((h.mean(0), h.max(0)))
    p = 1 / (1 + np.exp(-np.clip(float(feats @ m["u"] + m["d"][0]), -30, 30)))
    dz = np.float32(p - y)
    dh = np.repeat(dz * m["u"][None, :HIDDEN] / len(h), len(h), 0)
    dh[k, np.arange(HIDDEN)] += dz * m["u"][HIDDEN:]
    dh *= pre > 0
    da = dh @ m["v"].T * (best > 0)
    c, f = np.nonzero(da)
    g = da[c, f]
    byte = x[place[c, f][:, None] * STRIDE + np.arange(SPAN)]
    win = m["e"][byte].reshape(len(g), -1)
    dw = np.zeros_like(m["w"])
    de = np.zeros((256, EMBED), np.float32)
    if len(g):
        order = np.argsort(f, kind="stable")
        starts = np.flatnonzero(np.diff(f[order], prepend=-1))
        dw[:, f[order][starts]] = np.add.reduceat((win * g[:, None])[order], starts, 0).T
        back = (m["w"].T[f] * g[:, None]).reshape(-1, EMBED)
        flat = byte.ravel()
        for j in range(EMBED):
            de[:, j] = np.bincount(flat, back[:, j], 256)
    loss = -np.log(max(p if y else 1 - p, 1e-9))
    return {"e": de, "w": dw, "b": da.sum(0), "v": a.T @ dh, "c": dh.sum(0), "u": dz * feats, "d": np.array([dz])}, float(loss)


def fit(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray]:
    m = initial(seed)
    one, two = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    r = np.random.default_rng(seed)
    t = 0
    total = epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            part = [gradients(m, *rows[i])[0] for i in order[lo : lo + BATCH]]
            rate = RATE * (1 - t / total)
            t += 1
            for k in m:
                g = sum(p[k] for p in part) / len(part)
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m[k] = (m[k] - rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(t, int(y)) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    if rows:
        yield pa.record_batch([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", max_train: int = MAX_TRAIN) -> dict[str, np.ndarray] | None:
    """The network; labels come from rows with `allowed` only."""
    own = labels.where(allowed & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = bounded_sample(own, max_train).select(F.col("doc_id").alias("_id"), "y")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one row an id, however often it comes
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "text").select("text", "y")
    got = rows.mapInArrow(tidy(_train), "model binary").collect()
    return pickle.loads(got[0].model) if got else None


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            score = [float(probability(m, t.as_py())) if m else 0.0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_scorer(shared)), "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    allowed = crc_mod(F.col("doc_id"), 3) != 1
    return score(docs, train(docs, labels, allowed)).select("doc_id", (~allowed).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}  # a trained model isn't SQL: tests measure held-out accuracy
