"""Distributed positional inverted index; benchmark decontamination by phrase search.

The training documents are indexed in segments, one after another in each task: a segment closes at `segment_words`
words, so a task's memory is bounded but for a single longer document. All tokens are stored: a row (segment, term,
n, postings) per term, postings being the word numbers within the segment (documents follow each other with GAP numbers
between, so that no phrase spans two), delta-coded. A search is local to a segment: of each phrase the
rarest term's list is taken first, moved by that term's offset, and intersected with the others from rare to frequent.

The phrases come in blocks of bounded size, each of them matched against all segments.

Cases: null and wordless texts have no words and no hits; items without words have no window; repeated rows stay rows
(each is a document of its own); very long texts are a segment of their own; ties in rarity go to the first word; null
ids are kept as they are; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import remove, shared_path, table, tidy, words_of, written

WINDOW, SEGMENT_WORDS, GAP, BLOCK_BYTES = 10, 1_500_000, 1 << 10, 4_000_000

DOC_COLUMNS = "segment string, number int, doc_id long, start long, n_words long"
SCHEMA = DOC_COLUMNS + ", term binary, n long, postings binary"


def unpack(blob: bytes) -> np.ndarray:
    """The word numbers of one list: little-endian 32-bit differences."""
    return np.cumsum(np.frombuffer(blob, "<u4").astype(np.int64))


class _Segment:
    def __init__(self) -> None:
        self.name, self.ids = uuid.uuid4().hex, defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.docs: list[tuple] = []
        self.terms: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.next, self.words = 0, 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = words_of(text)
        n = len(words)
        self.docs.append((doc_id, self.next, n))
        if n:
            self.terms.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, n))
            self.at.append(np.arange(self.next, self.next + n, dtype=np.int64))
        self.next += n + GAP
        self.words += n

    def batches(self) -> Iterator[pa.RecordBatch]:
        k = len(self.docs)
        ids, starts, ns = (list(x) for x in zip(*self.docs))
        yield _batch([self.name] * k, list(range(k)), ids, starts, ns, [None] * k, [None] * k, [None] * k)
        if not self.words:
            return
        terms, at = np.concatenate(self.terms), np.concatenate(self.at)
        order = np.argsort(terms, kind="stable")
        at = at[order]
        counts = np.bincount(terms, minlength=len(self.ids))
        ends = np.cumsum(counts)
        steps = np.diff(at, prepend=0)
        steps[ends - counts] = at[ends - counts]  # each term's list begins anew
        data = pa.py_buffer(steps.astype("<u4"))
        offsets = np.concatenate(([0], ends)).astype(np.int32) * 4
        names = list(self.ids)
        for lo in range(0, len(names), 50_000):
            k = min(50_000, len(names) - lo)
            none = [None] * k
            lists = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(offsets[lo : lo + k + 1]), data])
            yield _batch([self.name] * k, none, none, none, none, names[lo : lo + k], counts[lo : lo + k], lists)


def _batch(*columns) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], ["segment", "number", "doc_id", "start", "n_words", "term", "n", "postings"])


def _index(segment_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _Segment()
        for b in batches:
            for d, t in zip(b.column(0), b.column(1)):
                seg.add(d.as_py(), t.as_py())
                if seg.words >= segment_words or len(seg.docs) >= segment_words // 8:
                    yield from seg.batches()
                    seg = _Segment()
        if seg.docs:
            yield from seg.batches()

    return run


def build_index(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", segment_words: int = SEGMENT_WORDS) -> None:
    """Write the index of all tokens of docs to `path`: rows of documents (term null) and of postings."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(_index(segment_words)), SCHEMA)
    rows.withColumn("kind", F.when(F.col("term").isNull(), "documents").otherwise("postings")).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The index's rows of one kind, documents or postings; none where nothing was indexed."""
    return spark.read.schema(SCHEMA + ", kind string").parquet(path).where(F.col("kind") == kind)


class Postings:
    """The lists of one segment for the terms of a block of phrases."""

    def __init__(self, terms: list[bytes], blobs: list[bytes], counts: list[int]) -> None:
        self.blobs = {bytes(t): b for t, b in zip(terms, blobs)}
        self.counts = {bytes(t): n for t, n in zip(terms, counts)}
        self.lists: dict[bytes, np.ndarray] = {}

    def of(self, term: bytes) -> np.ndarray:
        if term not in self.lists:
            self.lists[term] = unpack(bytes(self.blobs[term]))
        return self.lists[term]

    def phrase(self, words: tuple[bytes, ...]) -> np.ndarray:
        """The numbers of the first words of all exact occurrences."""
        if any(w not in self.blobs for w in words):
            return np.empty(0, np.int64)
        order = sorted(range(len(words)), key=lambda i: (self.counts[words[i]], i))
        at = self.of(words[order[0]]) - order[0]
        for i in order[1:]:
            if not len(at):
                break
            own, want = self.of(words[i]), at + i
            k = np.searchsorted(own, want)
            k[k == len(own)] = 0
            at = at[own[k] == want]
        return at

    def near(self, words: tuple[bytes, ...], span: int) -> np.ndarray:
        """The numbers of the rarest word's occurrences with all the words within `span` words of it, either way."""
        if any(w not in self.blobs for w in words):
            return np.empty(0, np.int64)
        order = sorted(dict.fromkeys(words), key=lambda w: self.counts[w])
        at = self.of(order[0])
        for w in order[1:]:
            own = self.of(w)
            k = np.searchsorted(own, at - span)
            k2 = np.minimum(k, len(own) - 1)
            at = at[(k < len(own)) & (own[k2] <= at + span)]
        return at


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of `size` words; the whole where there are fewer, but not none."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def blocks(items: DataFrame, text: str, item_id: str, size: int, most: int = BLOCK_BYTES) -> Iterator[dict[tuple[bytes, ...], list[int | None]]]:
    """The items' windows with their item ids, in blocks of about `most` bytes; rows come to the driver one at a time."""
    got: dict[tuple[bytes, ...], list] = {}
    held = 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        for w in windows(words_of(r.t), size):
            ids = got.setdefault(w, [])
            if r.i not in ids[-1:]:
                ids.append(r.i)
                held += sum(map(len, w))
            if held >= most:
                yield got
                got, held = {}, 0
    if got:
        yield got


def search(index: str, spark: SparkSession, phrases: dict[tuple[bytes, ...], list[int | None]], span: int | None = None) -> DataFrame:
    """segment, at (word number), length, item_id for all occurrences of the phrases, a bounded block of them.

    With `span`, proximity matches instead: all words of the phrase within that many words of its rarest one.
    """
    post = read_index(spark, index, "postings").select("segment", "term", "n", "postings")
    known = spark.createDataFrame(pd.DataFrame({"t": sorted({w for p in phrases for w in p})}), "t binary")  # bounded with the block
    wanted = post.join(F.broadcast(known), post["term"] == known["t"], "left_semi")
    shared = spark.sparkContext.broadcast(list(phrases.items()))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = Postings(pdf["term"].tolist(), pdf["postings"].tolist(), pdf["n"].tolist())
        out: list[tuple] = []
        for words, ids in shared.value:
            at = lists.phrase(words) if span is None else lists.near(words, span)
            out += [(int(a), len(words), i) for a in at for i in ids]
        got = pd.DataFrame(out, columns=["at", "length", "item_id"]).astype({"item_id": "Int64"})
        got.insert(0, "segment", pdf["segment"].iloc[0])
        return got

    return wanted.groupBy("segment").applyInPandas(match, "segment string, at long, length long, item_id long")


def _ranges(pdf: pd.DataFrame) -> int:
    """How many words the ranges [at, at + length) cover."""
    ends = np.maximum.accumulate((pdf["at"] + pdf["length"]).to_numpy())
    return int((ends - np.maximum(pdf["at"].to_numpy(), np.concatenate(([0], ends[:-1])))).clip(0).sum())


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _by_document(key: tuple, docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
    docs = docs.sort_values("number")
    n_hit, n_items, sha = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), [_digest([])] * len(docs)
    if len(hits):
        starts = docs["start"].to_numpy()
        hits = hits.assign(doc=np.searchsorted(starts, hits["at"].to_numpy(), "right") - 1)
        for d, own in hits.sort_values(["doc", "at", "length"]).groupby("doc"):
            n_hit[d] = _ranges(own)
            ids = [str(int(i)) for i in own["item_id"].dropna().unique()]
            n_items[d] = len(ids) + int(own["item_id"].isna().any())
            sha[d] = _digest(ids)
    return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_words": docs["n_words"], "n_hit": n_hit, "n_items": n_items, "items_sha256": sha, "contaminated": n_hit > 0})


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", keep_index: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0).

    keep_index: a folder in which the index stays; else it goes once the result is written.
    """
    spark = docs.sparkSession
    path = keep_index or shared_path(spark, "invindex")
    build_index(docs, path, text, doc_id)
    hits = None
    for block in blocks(items, item_text, item_id, window):
        found = written(search(path, spark, block), "hits")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], "segment string, at long, length long, item_id long")
    rows = read_index(spark, path, "documents").select("segment", "number", "doc_id", "start", "n_words")
    found = rows.groupBy("segment").cogroup(hits.groupBy("segment")).applyInPandas(_by_document, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    found = written(found, "decontaminated")
    if keep_index is None:
        remove(path)
    return found


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op4_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, {_WORDS} w FROM documents),
 b AS (SELECT item_id, {_WORDS} w FROM benchmark),
 win AS (SELECT DISTINCT item_id, len(w[i:i + 9]) k, array_to_string(w[i:i + 9], ' ') s
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT k FROM win),
 sh AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') s
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, sizes WHERE len(w) >= k)),
 hit AS (SELECT r, i, sh.k, item_id FROM sh JOIN win ON sh.s = win.s AND sh.k = win.k),
 words AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(i, i + k)) p FROM hit) GROUP BY r),
 ids AS (SELECT r, count(*) n_items, sha256(string_agg(x, ',' ORDER BY x)) h FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)"""
}
QUERIES = {"op4_decontaminate": op4_decontaminate}
