"""Fuzzy ranking of symbols for tokens: scores first, matched ranges for the few that remain.

Names are scored once each, whatever the number of symbols that bear them. They are kept in files of bounded size; a task
takes a share of the tokens through a trie of one file, best first, so a token meets few of the names that hold it as a
subsequence. Tokens that are names themselves are joined where that settles them, and tokens that can't fit go first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from halyard.functions import fuzzy
from halyard.functions.text import dirname
from halyard.functions.trie import HI, LO, LONGEST, Trie
from halyard.plans.cut import cut, kept, spread

THRESHOLD, TOP = 60, 5
#: Names of a file, and the most and the fewest tokens of a share: a task has one of each in memory. Pairs scored at a time;
#: names that are scored without a search for the best.
CHUNK, BLOCK, FEW, PAIRS, HANDFUL = 200_000, 200_000, 1_000, 50_000, 16


def _key(path: str | None, line: int | None, name: str) -> tuple:
    return len(name), path is not None, path or "", line is not None, line or 0, name


def _kept(df: DataFrame, name: str) -> tuple[str, list[str]]:
    """The folder of the rows, and its files."""
    folder = kept(df, name)
    fs, at = pafs.FileSystem.from_uri(folder)
    return folder, sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".parquet"))


def _facts(folder: str, files: list[str]):
    """file, chars, longest: of each file of names the characters that occur, case aside, and the longest name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            names = pq.read_table(files[k], filesystem=fs, columns=["name"]).column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"file": [k], "chars": ["".join(sorted(set().union(*map(fuzzy.lowered, names))))], "longest": [max(map(len, names), default=0)]})

    return run


def _fit(facts: list[tuple[set[str], int]]):
    """The tokens that some file's names may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [fuzzy.lowered(t) for t in b.column(0).to_pylist()]
            yield b.filter(pa.array([any(len(t) <= n and of.issuperset(t) for of, n in facts) for t in low], pa.bool_()))

    return run


def _score(folder: str, files: list[str], asked: str, shares: list[str], threshold: int, top: int | None):
    """The (token, name, raw, n) that reach the threshold, a file of names and a share of the tokens at a time, so that a
    trie is built once a share; with `top` only those names of each token that may be among the best of the file, by the
    confidence and the name's first symbol. Those are searched for best first, but where a long token finds a handful of
    names that is all. Names with characters beyond the basic plane, and all where no `top` is given, are met as the trie
    finds them."""

    def settled(pairs: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        size = [len(fuzzy.units(t)) for t, _ in pairs]
        few = [(*p, raw, n) for p, raw, n in zip(pairs, fuzzy.scores(pairs), size) if raw >= 0 and fuzzy.confidence(raw + (20 if top is None else 0), n) >= threshold]
        pairs.clear()
        if few:
            yield _batch(few)

    def cell(file: str, share: str) -> Iterator[pa.RecordBatch]:
        tokens = pq.read_table(share, filesystem=pafs.FileSystem.from_uri(asked)[0], columns=["token"]).column(0).to_pylist()
        rows = pq.read_table(file, filesystem=pafs.FileSystem.from_uri(folder)[0], columns=["name", "path", "line"]).to_pylist()
        rows.sort(key=lambda r: r["name"])
        plain = [r for r in rows if top is not None and (not r["name"] or max(r["name"]) <= "\uffff")]
        odd = [r["name"] for r in rows if top is None or r["name"] and max(r["name"]) > "\uffff"]
        got, pairs = [], []
        if plain:
            key = [_key(r["path"], r["line"], r["name"]) for r in plain]
            order = sorted(range(len(key)), key=key.__getitem__)
            rank, first = [0] * len(key), {}
            for place, k in enumerate(order):
                rank[k] = place
            trie, grades = Trie([r["name"] for r in plain]), {}
            for t in tokens:
                n, low = len(t), fuzzy.lowered(t)
                if max(t) > "\uffff":  # no name here holds it
                    continue
                if 2 * n > trie.root[LONGEST]:
                    nodes, held = [], 0
                    for node in trie.matches(low):
                        nodes.append(node)
                        held += node[HI] - node[LO]
                        if held > HANDFUL:
                            break
                    if held <= HANDFUL:
                        pairs += [(t, name) for node in nodes for name in trie.names[node[LO] : node[HI]]]
                        if len(pairs) >= PAIRS:
                            yield from settled(pairs)
                        continue
                if n not in grades:
                    grades[n] = functools.cache(functools.partial(fuzzy.confidence, n=n))
                for _, place, raw in trie.best(low, top, rank, grades[n], threshold, first):
                    got.append((t, trie.names[order[place]], raw, n))
                if len(got) >= PAIRS:
                    yield _batch(got)
                    got = []
        if odd:
            trie = Trie(odd)
            for t in tokens:
                for node in trie.matches(fuzzy.lowered(t)):
                    for k in range(node[LO], node[HI]):
                        pairs.append((t, trie.names[k]))
                        if len(pairs) >= PAIRS:
                            yield from settled(pairs)
        yield from settled(pairs)
        if got:
            yield _batch(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            yield from cell(files[k % len(files)], shares[k // len(files)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["token", "name", "raw", "n"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [fuzzy.ranges(t, n) for t, n in zip(b.column("token").to_pylist(), b.column("name").to_pylist())]
        text = pa.array([",".join(f"{a}-{z}" for a, z in r) for r in got], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "ranges"])


def _searched(tokens: DataFrame, symbols: DataFrame, threshold: int, top: int | None) -> DataFrame:
    """token, name, raw, n: what `_score` finds for all tokens in all names."""
    spark = symbols.sparkSession
    found = "token string, name string, raw long, n long"
    line = F.col("line").cast("long").alias("line")
    names = cut(symbols.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("path", line)).alias("m")).select("name", "m.path", "m.line"))
    folder, files = _kept(names.repartitionByRange(max(1, -(-names.count() // CHUNK)), "name"), "names")
    if not files:
        return spark.createDataFrame([], found)
    facts = [(set(r.chars), r.longest) for r in spark.range(0, len(files), 1, len(files)).mapInArrow(_facts(folder, files), "file long, chars string, longest long").collect()]  # alphabets, a row a file
    left = cut(tokens.mapInArrow(_fit(facts), "token string"))
    n = left.count()
    # shares enough for all cores, unless few tokens would be in one
    parts = max(-(-n // BLOCK), min(-(-3 * spark.sparkContext.defaultParallelism // len(files)), -(-n // FEW)), 1)
    asked, shares = _kept(left.repartition(parts), "tokens")
    if not shares or not n:
        return spark.createDataFrame([], found)
    cells = len(files) * len(shares)
    return spark.range(0, cells, 1, cells).mapInArrow(_score(folder, files, asked, shares, threshold, top), found)


def rank(tokens: DataFrame, symbols: DataFrame, threshold: int = THRESHOLD, top: int = TOP, caller: str | None = None) -> DataFrame:
    """token, rank, name, path, line, kind, confidence, ranges: the best `top` symbols of each distinct token.

    Order: confidence, then the shorter name, then path and line. A caller's path favours symbols near it (20 for its
    directory, 10 for its directory's siblings, before the share is taken).
    """
    s = symbols.select("name", "path", "line", "kind").where("name IS NOT NULL")
    asked = cut(spread(tokens.select("token").where("token != ''").distinct(), "token"))
    order = [F.length("name"), "path", "line", "name"]
    out = ["token", "name", "path", "line", "kind", "confidence"]
    whole = None
    if caller is None:  # of a name, only the first few by path and line can be among the best
        s = s.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("path", "line"))).where(f"_r <= {top}").drop("_r")
        near = F.lit(0)
    else:
        own, theirs = F.lit(caller), F.replace("path", F.lit("\\"), F.lit("/"))
        near = F.when(dirname(own) == dirname(theirs), 20).when(dirname(dirname(own)) == dirname(dirname(theirs)), 10).otherwise(0)
    if caller is None and threshold <= 100:
        # names that are the token, case aside, score in full and no others are as short: enough of them leave nothing to search
        plain = asked.where(F.col("token").rlike(r"\A[\x00-\x7F]+\z"))
        hit = plain.withColumn("_low", F.lower("token")).join(s.withColumn("_low", F.lower("name")), "_low").drop("_low").withColumn("confidence", F.lit(100).cast("long"))
        w = Window.partitionBy("token")
        hit = hit.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order))).where(f"_n >= {top} AND _r <= {top}")
        whole = cut(hit.select(*out))
        asked = asked.join(whole.select("token").distinct(), "token", "left_anti")
    every = _searched(asked, symbols, threshold, top if caller is None else None)
    best = 32 + 20 * (F.col("n") - 1)
    hit = every.join(s, "name").withColumn("confidence", F.least(F.lit(100), F.floor((F.col("raw") + near) / best * 100 + 0.5)).cast("long")).where(F.col("confidence") >= threshold)
    hit = hit.select(*out) if whole is None else hit.select(*out).unionByName(whole)
    w = Window.partitionBy("token").orderBy(F.desc("confidence"), *order)
    hit = hit.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("token", "rank", "name", "path", "line", "kind", "confidence")
    return hit.mapInArrow(_ranges, T.StructType([*hit.schema.fields, T.StructField("ranges", T.StringType())]))
