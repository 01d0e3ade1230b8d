"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly: exclusive-or and bit counts in numpy over tiles. Two fingerprints at most RADIUS bits
apart have population counts at most RADIUS apart, in every part of the word and in sum over the parts. That prunes
twice: the population counts of the two 32-bit halves make the cells that tasks are formed of, and those of the four
16-bit quarters, as intervals over each tile, skip tile pairs inside a task.

Work grows with the square of the number of distinct fingerprints, as in any exact tiled comparison; what moves between
tasks grows in proportion (13 cells a fingerprint). Cells larger than `block` are split in a grid, so that a task's rows
stay bounded. A task hands on a spanning forest of the links it found, not the pairs.

Cases: null and blank texts have fingerprint zero and are linked like any other; repeated rows stay rows; a null doc_id
takes part, and a component of null ids only has a null component_id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import LOWER, salted_lookup, table, tidy, words_of, written

RADIUS, SHINGLE, SEED, TILE, BLOCK = 3, 3, 42, 512, 250_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; 0 where there are no words."""
    words = words_of(text, LOWER)
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(body, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    digest = xxhash.xxh64_digest
    h = b"".join([digest(body[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())])
    n = len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = np.frombuffer(h, np.uint8, min(n - at, 1 << 16) * 8, at * 8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: dict[str | None, int] = {}
        out = np.empty(b.num_rows, np.uint64)
        for i, x in enumerate(b.column(1)):
            text = x.as_py()
            fp = seen.get(text)
            if fp is None:
                fp = seen[text] = fingerprint(text)
            out[i] = fp
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(_fingerprints), "doc_id long, fp long")


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        keep = label[u] != label[v]
        u, v = u[keep], v[keep]
    return label


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None] >> np.array([48, 32, 16, 0], np.uint64) & np.uint64(0xFFFF)).astype(np.int8)


def _tiles(x: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by population counts, and each tile's least and largest ones."""
    q = _quarters(x)
    order = np.lexsort(q.T[::-1])
    at = np.arange(0, len(x), tile)
    return order, np.minimum.reduceat(q[order], at), np.maximum.reduceat(q[order], at)


def tile_links(own: np.ndarray, other: np.ndarray, within: bool, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at `radius` bits or fewer between own and other, and inside own if `within`.

    Returned as two arrays of fingerprints. Every tile pair whose population counts allow a link is compared in full.
    """
    if not len(own):
        return own[:0], own[:0]
    o1, low1, high1 = _tiles(own, tile)
    a = own[o1]
    sides = [(a, low1, high1, 0)] if within else []
    if len(other):
        o2, low2, high2 = _tiles(other, tile)
        sides.append((other[o2], low2, high2, len(a)))
    else:
        o2 = np.empty(0, np.int64)
    every = np.concatenate((a, other[o2]))
    us, vs, held = [], [], 0
    for k in range(len(low1)):
        x = a[k * tile : (k + 1) * tile]
        for y, low, high, shift in sides:
            gap = np.maximum(0, np.maximum(low.astype(np.int16) - high1[k], low1[k].astype(np.int16) - high)).sum(1)
            ok = gap <= radius
            if shift == 0:
                ok[:k] = False
            for j in np.flatnonzero(ok):
                p, r = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, j * tile : (j + 1) * tile]) <= radius)
                p, r = p + k * tile, r + j * tile + shift
                keep = p != r
                us.append(p[keep])
                vs.append(r[keep])
                held += int(keep.sum())
                if held > 2_000_000:
                    label = forest(np.concatenate(us), np.concatenate(vs), len(every))
                    far = np.flatnonzero(label != np.arange(len(every)))
                    us, vs, held = [far], [label[far]], 0
    if not us:
        return own[:0], own[:0]
    label = forest(np.concatenate(us), np.concatenate(vs), len(every))
    far = np.flatnonzero(label != np.arange(len(every)))
    return every[far], every[label[far]]


def _group(radius: int, tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        own = pdf["own"].to_numpy(bool)
        u, v = tile_links(fp[own], fp[~own], bool(pdf["first"].iloc[0]), radius, tile)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """u, v: links among the distinct fingerprints `fp` that connect all that lie within `radius` bits of another.

    Every two fingerprints within the radius are connected over the links; other pairs never are linked directly.
    """
    spark = nodes.sparkSession
    half = lambda k: F.bit_count(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    n = nodes.select("fp", half(32).alias("p"), half(0).alias("q"))
    sizes = {(r.p, r.q): r["count"] for r in n.groupBy("p", "q").count().collect()}  # 33 x 33 cells at most
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) > (0, 0)]
    rows = []
    for (p, q), c in sizes.items():
        splits = -(-c // block)
        visitors = sum(sizes.get((p + i, q + j), 0) for i, j in steps) + (c if splits > 1 else 0)
        rows.append((p, q, splits, max(1, -(-visitors // (12 * block)))))
    cells = F.broadcast(spark.createDataFrame(rows, "p int, q int, splits int, bins int"))
    salt = lambda of, by: F.pmod(F.xxhash64(F.lit(of), "fp"), F.col(by)).cast("int")
    own = n.join(cells, ["p", "q"]).select("p", "q", salt("own", "splits").alias("a"), F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("b"), "fp", F.lit(True).alias("own"), (F.col("splits") == 1).alias("whole"))
    own = own.select("p", "q", "a", "b", "fp", "own", (F.col("whole") & (F.col("b") == 0)).alias("first"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in [(0, 0), *steps]])
    to = n.withColumn("d", F.explode(near)).select((F.col("p") - F.col("d.i")).alias("p"), (F.col("q") - F.col("d.j")).alias("q"), "fp", ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("home"))
    visit = to.join(cells, ["p", "q"]).where(~F.col("home") | (F.col("splits") > 1))
    visit = visit.select("p", "q", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("a"), salt("visit", "bins").alias("b"), "fp", F.lit(False).alias("own"), F.lit(False).alias("first"))
    # `first` holds for all own rows of a group or for none; visitors carry false, so own rows lead
    grouped = own.unionByName(visit).groupBy("p", "q", "a", "b")
    run = _group(radius, tile)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.assign(first=bool(pdf["first"].any())))

    return grouped.applyInPandas(call, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label: the smallest node reachable, for each node of an edge (u, v).

    Smallest-neighbour labels with pointer jumping, a written table each round; only a count comes to the driver.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), name + "-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), name)
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = written(step, name)
        up = step.select(F.col("node").alias("up"), F.col("label").alias("top"))
        step = step.join(up, step["label"] == up["up"], "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        step = written(step, name)
        moved = step.where("label != old").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (the smallest doc_id reachable)."""
    fps = written(fingerprints(docs, text, doc_id), "simhash-fp")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    labels = components(links(nodes, radius), "simhash-cc")
    nodes = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    best = nodes.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("component_id"))
    nodes = nodes.join(best, nodes["label"] == best["l"]).select("fp", "n", "component_id")
    return salted_lookup(fps, nodes, "fp", "n", fps.count(), "doc_id").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}  # XXH64 isn't in SQL: tests compare with brute force
