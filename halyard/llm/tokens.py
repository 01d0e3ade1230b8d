"""Token ids in Arrow files: equal-length sequences and masks for zero-copy random access.

Documents are range-partitioned by id, tokenised, and their ids packed one after another into sequences of SEQUENCE
ids. A partition makes one shard: an Arrow IPC file with record batches of two fixed-size-list columns, `ids` and `mask`
(false where the last sequence is padded), and beside it a directory of its documents (doc_id, start, n_tokens in the
shard). Any sequence is at a computed place of a memory-mapped file. Ids are stored in 16 bits where the vocabulary
allows, else in 32.

Files get names of their own in each attempt of a task; the manifest, committed by Spark, names those that count.

The tokenizer sees each distinct piece about once: a text may be cut before a single space or line feed between two
characters that aren't white space, as no match of the pre-tokenizer's pattern goes on over such a place nor looks back
over it. Texts that hold the string of an added token go to the tokenizer whole, which gives that token's id
(`special_as_text`: such strings are ordinary text instead).

Cases: null text is the empty text, which has the end id only; ids sort ascending, nulls last, repeated ids by a hash of
their text; very long texts are whole, one at a time; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import open_fs, shared_path, table, tidy, written

SEQUENCE, ROWS, END, MOST_PIECES, CHUNK = 2048, 512, 2, 800_000, 8 << 20
HEAD, MARK = "\0", "\1"
#: White space but " \n\t\r", and the two signs above: texts that hold them are cut by CUT.
RARE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if (c.isspace() and c not in " \n\t\r") or c in HEAD + MARK) + "]"
#: Texts whose white space isn't all single spaces and line feeds between other characters.
ODD = r"^\z|^[ \n]|[ \n][ \n]|[ \n]\z|[\t\r]"
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Letters, and punctuation behind them, that are pieces of their own to the pre-tokenizer.
LETTERS, MARKS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+", r"[!-/:-@\[-`{-~]+"
FULL = r"[^\s\pZ\x00\x0b\x1c-\x1f\x{85}]"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def lists_of(ids: np.ndarray, counts: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), pa.array(ids))


def lead(sign: str, texts: pa.Array) -> pa.Array:
    """The texts with a sign before each."""
    return pc.binary_join_element_wise(pa.scalar(sign, pa.large_string()), texts, pa.scalar("", pa.large_string()))


def key_of(piece: str) -> str:
    if piece[1:2].strip() and piece[1] != HEAD:
        return piece[1:] if piece[0] == " " else piece if piece[0] == "\n" else HEAD + piece
    return HEAD + piece


class Encoder:
    """Texts to ids, with a bounded memory of pieces: `keys`, their `ids`, and the turn when each was last `used`.

    A piece's key is the piece without its leading space; with it where that is a line feed; and behind HEAD where the
    piece begins with something else, as a text's first does.
    """

    def __init__(self, vocabulary: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # a byte-level token has a character a byte
        self.width[list(vocab.values())] = [len(t) for t in vocab]
        self.keys, self.ids = pa.array([HEAD], pa.large_string()), lists_of(np.zeros(0, self.dtype), np.zeros(1, np.int64))
        self.used, self.turn = np.zeros(1, np.int32), 0

    def runs(self, pieces: pa.Array) -> pa.LargeListArray:
        """The ids of pieces that each begin with one space or line feed before other characters: many go to a text,
        which is cut again where the tokens' widths add up to the pieces'."""
        n = len(pieces)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, n, 256), n], pa.int32()), pieces), pa.scalar("", pa.large_string())).to_pylist() if n else []
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], self.dtype)
        ends, want = np.cumsum(self.width[ids]), np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))
        at = np.searchsorted(ends, want) + 1
        if n and not np.array_equal(ends[at - 1], want):
            raise ValueError("tokens don't end where pieces do")
        return lists_of(ids, np.diff(at, prepend=0))

    def whole(self, texts: list[str]) -> pa.LargeListArray:
        got = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return lists_of(np.concatenate([np.zeros(0, self.dtype), *got]), np.array([len(g) for g in got], np.int64))

    def learn(self, keys: pa.Array) -> None:
        """Add distinct new keys; the pieces that used to be asked for last make room."""
        if len(self.keys) > MOST_PIECES:
            least = np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
            stay = pa.array(np.flatnonzero((self.used > least) | (self.used == self.turn) | (np.arange(len(self.used)) == 0)))
            self.keys, self.ids, self.used = self.keys.take(stay), self.ids.take(stay), self.used[stay.to_numpy()]
        joins = pc.match_substring_regex(keys, f"(?s)^\\n?{FULL}(.*{FULL})?\\z")
        run, apart = keys.filter(joins), keys.filter(pc.invert(joins))
        found = [self.runs(pc.if_else(pc.starts_with(run, "\n"), run, lead(" ", run))), self.whole([k[1:] if k[0] == HEAD else k if k[0] == "\n" else " " + k for k in apart.to_pylist()])]
        self.keys, self.ids = pa.concat_arrays([self.keys, run, apart]), pa.concat_arrays([self.ids, *found])
        self.used = np.concatenate([self.used, np.full(len(keys), self.turn, np.int32)])

    def places(self, keys: pa.Array) -> np.ndarray:
        """Where keys are in `self.keys`; new ones are learnt."""
        at = pc.index_in(keys, self.keys)
        if at.null_count:
            self.used[at.drop_null().to_numpy()] = self.turn
            self.learn(pc.unique(keys.filter(pc.is_null(at))))
            at = pc.index_in(keys, self.keys)
        got = at.to_numpy()
        self.used[got] = self.turn
        return got

    def gathered(self, keys: pa.Array) -> pa.LargeListArray:
        """The ids of keys, each distinct one looked up once, and words apart from the punctuation behind them."""
        self.turn += 1
        coded = keys.dictionary_encode()
        each = coded.dictionary
        ended = pc.match_substring_regex(each, f"^{LETTERS}{MARKS}\\z")
        mine = each.filter(ended)
        stems = pc.replace_with_mask(each, ended, pc.replace_substring_regex(mine, MARKS + r"\z", ""))
        tails = lead(HEAD, pc.replace_substring_regex(mine, "^" + LETTERS, ""))
        at = self.places(pa.concat_arrays([stems, tails]))
        pairs = np.zeros((len(each), 2), np.int64)  # place 0 has no ids
        pairs[:, 0] = at[: len(each)]
        pairs[ended.to_numpy(zero_copy_only=False), 1] = at[len(each) :]
        both = self.ids.take(pa.array(pairs.ravel()))
        return pa.LargeListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values).take(coded.indices)

    def encode(self, texts: pa.Array) -> pa.LargeListArray:
        """The ids of each text; nulls are empty texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        rare, odd = (pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in (RARE, ODD))
        kind = np.where(whole, 3, np.where(rare, 2, np.where(odd, 1, 0)))
        parts, order = [], []
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            order.append(at)
            part = texts if len(at) == len(texts) else texts.take(pa.array(at))
            if k == 3:
                parts.append(self.whole(part.to_pylist()))
                continue
            if k == 2:
                cut = [[*map(key_of, filter(None, CUT.split(t)))] or [HEAD] for t in part.to_pylist()]
                keys, offsets = pa.array([p for c in cut for p in c], pa.large_string()), np.cumsum([0, *map(len, cut)])
            else:
                part = lead(HEAD, part)
                if k == 1:
                    for between, to in ((" ", MARK), ("\n", MARK + "\n")):
                        for _ in range(2):  # a match takes the character that the next would begin with
                            part = pc.replace_substring_regex(part, rf"([^ \n\t\r\x00\x01]){between}([^ \n\t\r])", rf"\1{to}\2")
                    cut = pc.split_pattern(part, MARK)
                else:
                    cut = pc.split_pattern(pc.replace_substring(part, "\n", " \n"), " ")
                offsets = cut.offsets.to_numpy()
                keys, offsets = cut.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
            got = self.gathered(keys)
            parts.append(pa.LargeListArray.from_arrays(pa.array(got.offsets.to_numpy()[offsets], pa.int64()), got.values))
        if not parts:
            return lists_of(np.zeros(0, self.dtype), np.zeros(0, np.int64))
        if len(parts) == 1:
            return parts[0]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary: str, special_as_text: bool = False) -> Encoder:
    """One encoder for all tasks of a worker."""
    key = (vocabulary, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class ShardWriter:
    def __init__(self, folder: str, dtype: np.dtype, length: int) -> None:
        self.fs, at = open_fs(folder)
        self.fs.create_dir(at, recursive=True)
        self.path, self.name = f"{at}/{(name := uuid.uuid4().hex)}", name
        self.dtype, self.length = dtype, length
        self.kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.path + ".arrow", compression=None)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.open = bytearray()
        self.total = 0
        self.docs: list[pa.RecordBatch] = []

    def add(self, doc_ids: pa.Array, lists: pa.LargeListArray, end: int | None) -> None:
        """Documents by the lists of their ids; each gets the end id."""
        ids, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if end is not None:
            ids, ends = np.insert(ids, ends[1:], end), ends + np.arange(len(ends))
        counts, starts = np.diff(ends), self.total + ends[:-1]
        self.docs.append(pa.record_batch([doc_ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "start", "n_tokens"]))
        self.total += len(ids)
        self.open += ids.tobytes()
        step = self.length * ROWS * self.dtype.itemsize
        at = 0
        while len(self.open) - at >= step:
            self._write(bytes(self.open[at : at + step]), self.length * ROWS)
            at += step
        del self.open[:at]

    def _write(self, data: bytes, real: int) -> None:
        ids = pa.Array.from_buffers(self.kind, len(data) // self.dtype.itemsize, [None, pa.py_buffer(data)])
        mask = pa.array(np.arange(len(ids)) < real)
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(ids, self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if self.open:
            real = len(self.open) // self.dtype.itemsize
            self._write(bytes(self.open) + b"\0" * (-real % self.length * self.dtype.itemsize), real)
        self.file.close()
        self.sink.close()
        with self.fs.open_output_stream(self.path + ".docs.arrow", compression=None) as sink, pa.ipc.new_file(sink, self.docs[0].schema) as f:
            for b in self.docs:
                f.write_batch(b)


class ShardReader:
    """Random access to the sequences of one shard."""

    def __init__(self, path: str) -> None:
        fs, at = open_fs(path)
        local = fs.type_name == "local"
        self.reader = pa.ipc.open_file(pa.memory_map(at + ".arrow") if local else fs.open_input_file(at + ".arrow"))
        self.docs = pa.ipc.open_file(pa.memory_map(at + ".docs.arrow") if local else fs.open_input_file(at + ".docs.arrow")).read_all()
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.flat = -1, None

    def batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def ids(self, start: int, n: int) -> np.ndarray:
        step, parts = self.length * ROWS, []
        while n:
            k, off = divmod(start, step)
            part = self.batch(k)[off : off + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k and its mask."""
        b, r = divmod(k, ROWS)
        got = self.reader.get_batch(b)
        return got.column(0)[r].values.to_numpy(), got.column(1)[r].values.to_numpy(zero_copy_only=False)


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, number) of rows that have about `most` bytes of text, a longer text by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > lo and held + n > most:
            yield lo, k - lo
            lo, held = k, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes) - lo


def _writer(folder: str, vocabulary: str, end: int | None, length: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, special_as_text)
        out: ShardWriter | None = None
        for b in batches:
            for lo, n in chunks(b.column(1)):
                out = out or ShardWriter(folder, enc.dtype, length)
                out.add(b.column(0).slice(lo, n), enc.encode(b.column(1).slice(lo, n)), end)
        if out:
            out.close()
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.name]), pa.array([out.total], pa.int64())], ["part", "shard", "n"])

    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int | None = END, length: int = SEQUENCE, text: str = "text", doc_id: str = "doc_id", special_as_text: bool = False) -> DataFrame:
    """Write the shards to `folder`; returns the manifest: shard, base (ids in the shards before it)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    shards = written(rows.mapInArrow(tidy(_writer(folder, vocabulary or default_vocabulary(), end, length, special_as_text)), "part int, shard string, n long"), "token-manifest")
    base, rows = 0, []
    for r in sorted(shards.collect()):  # one row a partition
        rows.append((r.shard, base))
        base += r.n
    return docs.sparkSession.createDataFrame(rows, "shard string, base long")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = ShardReader(f"{folder}/{shard}")
                starts, counts = r.docs["start"].to_numpy(), r.docs["n_tokens"].to_numpy()
                crc = np.fromiter((zlib.crc32(r.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())), np.int64, len(starts))
                yield pa.RecordBatch.from_arrays([r.docs["doc_id"].combine_chunks(), pa.array(starts + base), pa.array(counts), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(tidy(_reader(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    return read_tokens(folder, write_tokens(table(spark, sf_dir, "documents"), folder))


QUERIES = {"op3_tokens": op3_tokens}
ORACLES: dict[str, str] = {}  # tokenisation isn't in SQL: tests compare with brute force
