"""Lossless WebP (VP8L) in numpy, and media columns of whole texts.

The decoder handles all that the format has: prefix codes (simple and normal, several groups by an entropy image),
back-references with the distance map, the colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. A stream of literals whose only real prefix code is the green one - what the encoder here writes - is decoded
by table look-ups at all bit offsets at once and a walk along them; all else goes pixel by pixel.

A text is stored as grey samples, 192 to a row, subtract-green leaving red and blue empty; after MAX_ROWS rows the next
image follows in the same value: its first image is a file that any reader opens, the others only `array_of` does.

Cases: null is the empty text, stored as one row of spaces; equal texts give equal values; repeated rows stay rows; a
null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import table, tidy, written

ROW, MAX_ROWS, LIMIT = 192, 1024, 12
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: Distances 1 to 120 as (column, row) steps back, by length of the step and the format's order among equals.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


EIGHT = np.arange(8, dtype=np.uint32)


class BitWriter:
    """Bits from the least significant one on."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


class BitReader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at
        self._load()

    def _load(self) -> None:
        self.base = self.at & ~7
        self.value = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 96], "little")

    def peek(self, n: int) -> int:
        if self.at - self.base + n > 768:
            self._load()
        return self.value >> (self.at - self.base) & (1 << n) - 1

    def get(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > len(self.data) * 8:
            raise ValueError("the stream ends too early")
        return v


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Prefix code lengths of at most `limit` bits; one used symbol has length 1."""
    used = [i for i, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            lengths[i] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(counts[i], floor), i) for i in used]
        heapq.heapify(heap)
        parent: dict[int, int] = {}
        nodes = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = nodes
            heapq.heappush(heap, (a[0] + b[0], nodes))
            nodes += 1
        level = {nodes - 1: 0}
        for i in range(nodes - 2, len(counts) - 1, -1):
            level[i] = level[parent[i]] + 1
        depth = {i: level[parent[i]] + 1 for i in used}
        if max(depth.values()) <= limit:
            for i, d in depth.items():
                lengths[i] = d
            return lengths
        floor *= 2


def canonical(lengths: list[int] | tuple[int, ...]) -> list[int]:
    """Each symbol's code, bits reversed as they stand in the stream."""
    count = [0] * 17
    for n in lengths:
        count[n] += 1
    count[0] = 0
    code, first = 0, [0] * 17
    for n in range(1, 16):
        code = (code + count[n - 1]) << 1
        first[n] = code
    out = [0] * len(lengths)
    for i, n in enumerate(lengths):
        if n:
            out[i] = int(f"{first[n]:0{n}b}"[::-1], 2)
            first[n] += 1
    return out


def put_code(w: BitWriter, lengths: list[int]) -> None:
    """Write a prefix code; a code of one symbol below 256 or of none is written as a simple code."""
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) < 2 and (not used or used[0] < 256):
        s = used[0] if used else 0
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(s > 1), 1)
        w.put(s, 8 if s > 1 else 1)
        return
    runs: list[tuple[int, int, int]] = []  # code, extra bits' value, their number
    i, last = 0, max(used)
    while i <= last:
        n, k = lengths[i], i
        while k <= last and lengths[k] == n:
            k += 1
        run = k - i
        i = k
        if n:
            runs.append((n, 0, 0))
            run -= 1
        while run:
            if n == 0 and run >= 11:
                r = min(run, 138)
                runs.append((18, r - 11, 7))
            elif n == 0 and run >= 3:
                r = min(run, 10)
                runs.append((17, r - 3, 3))
            elif n and run >= 3:
                r = min(run, 6)
                runs.append((16, r - 3, 2))
            else:
                r = 1
                runs.append((n, 0, 0))
            run -= r
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    own = code_lengths(counts, 7)
    codes = canonical(own)
    single = sum(map(bool, own)) == 1  # such a code takes no bits
    n = max(i for i, s in enumerate(ORDER) if own[s]) + 1
    n = max(n, 4)
    w.put(0, 1)
    w.put(n - 4, 4)
    for s in ORDER[:n]:
        w.put(own[s], 3)
    w.put(1, 1)
    k = len(runs) - 2
    if k < 0:  # max_symbol is 2 at least
        runs.append((0, 0, 0)) if own[0] else None
    bits = max(2, (max(k, 0).bit_length() + 1) // 2 * 2)
    w.put((bits - 2) // 2, 3)
    w.put(max(k, 0), bits)
    for s, extra, m in runs:
        if not single:
            w.put(codes[s], own[s])
        w.put(extra, m)


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """0 to 2**bits - 1, each with its bits in reverse."""
    v, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for _ in range(bits):
        out = out << 1 | v & 1
        v = v >> 1
    return out


@lru_cache(maxsize=256)
def tables(lengths: tuple[int, ...]) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, symbol, length) by the next `bits` bits."""
    n = np.array(lengths, np.uint8)
    used = np.flatnonzero(n)
    if len(used) < 2:
        return 0, used[:1].astype(np.int16) if len(used) else np.zeros(1, np.int16), np.zeros(1, np.uint8)
    order = used[np.argsort(n[used], kind="stable")]
    bits = int(n[order[-1]])
    wide = 1 << (bits - n[order]).astype(np.int64)
    if wide.sum() != 1 << bits:
        raise ValueError("a prefix code isn't complete")
    at = _reversed(bits)
    return bits, np.repeat(order, wide)[at].astype(np.int16), np.repeat(n[order], wide)[at]


def take(r: BitReader, code: tuple[int, np.ndarray, np.ndarray]) -> int:
    bits, symbol, length = code
    v = r.peek(bits)
    r.get(int(length[v]))
    return int(symbol[v])


def get_code(r: BitReader, size: int) -> tuple[int, ...]:
    """The code lengths of a prefix code over `size` symbols."""
    lengths = [0] * size
    if r.get(1):
        two = r.get(1)
        lengths[r.get(8 if r.get(1) else 1)] = 1
        if two:
            lengths[r.get(8)] = 1
        return tuple(lengths)
    own = [0] * 19
    for s in ORDER[: 4 + r.get(4)]:
        own[s] = r.get(3)
    most = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else size
    bits, symbol, length = (x.tolist() if isinstance(x, np.ndarray) else x for x in tables(tuple(own)))
    i, before, low = 0, 8, (1 << bits) - 1
    while i < size and most:
        most -= 1
        v = r.peek(14)  # a symbol and its extra bits
        n = length[v & low]
        s, v = symbol[v & low], v >> n
        if s < 16:
            lengths[i] = s
            i += 1
            before = s or before
        else:
            value, m, least = ((before, 2, 3), (0, 3, 3), (0, 7, 11))[s - 16]
            run = least + (v & (1 << m) - 1)
            n += m
            if i + run > size:
                raise ValueError("a run of code lengths is too long")
            lengths[i : i + run] = [value] * run
            i += run
        r.at += n
    r.get(0)
    return tuple(lengths)


def _prefixed(r: BitReader, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.get(extra) + 1


def _walk(data: bytes, r: BitReader, code: tuple[int, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """n green literals, all other codes being empty."""
    bits, symbol, length = code
    if bits == 0:
        return np.full(n, symbol[0], np.int64)
    out = np.empty(n, np.int16)
    done = 0
    while done < n:
        lo = r.at >> 3
        raw = np.frombuffer(data, np.uint8, min(len(data) - lo, 1 << 17), lo)
        pad = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.uint32)
        word = pad[:-3] | pad[1:-2] << np.uint32(8) | pad[2:-1] << np.uint32(16)
        v = (word[:, None] >> EIGHT & np.uint32((1 << bits) - 1)).ravel()
        count = len(v)
        one = np.minimum(np.arange(count, dtype=np.int32) + length[v], count - 1)
        two = one[one]
        four = two[two]
        hop = memoryview(four[four])
        last = count - (0 if lo + len(raw) == len(data) else 32)
        p, left, lead = r.at - lo * 8, n - done, []
        safe = last - 8 * bits
        add = lead.append
        while left >= 8 and p < safe:
            add(p)
            p = hop[p]
            left -= 8
        at = np.array(lead, np.int64)
        at = np.stack((at, four[at]), 1).ravel()
        at = np.stack((at, two[at]), 1).ravel()
        at = np.stack((at, one[at]), 1).ravel()
        rest = []
        while left and p < last:
            rest.append(p)
            p += int(length[v[p]])
            left -= 1
        at = np.concatenate((at, np.array(rest, np.int64)))
        if not len(at):
            raise ValueError("the stream ends too early")
        out[done : done + len(at)] = symbol[v[at]]
        done += len(at)
        r.at = lo * 8 + p
        if r.at > len(data) * 8:
            raise ValueError("the stream ends too early")
        r._load()
    return out.astype(np.int64)


def _image(data: bytes, r: BitReader, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as ARGB values."""
    cache_bits = r.get(4) if r.get(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, shift, meta = 1, 0, None
    if top and r.get(1):
        shift = r.get(3) + 2
        meta = _image(data, r, -(-width >> shift), -(-height >> shift), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
        meta = meta.tolist()
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [tuple(tables(get_code(r, s)) for s in (280 + cache_size, 256, 256, 256, 40)) for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and not any(codes[0][k][0] for k in (1, 2, 3)) and codes[0][0][1].max() < 256:
        green = _walk(data, r, codes[0][0], n)
        return int(codes[0][3][1][0]) << 24 | int(codes[0][1][1][0]) << 16 | green << 8 | int(codes[0][2][1][0])
    out = [0] * n
    cache = [0] * cache_size
    columns = -(-width >> shift)
    own = codes[0]
    i = 0
    while i < n:
        if meta is not None:
            own = codes[meta[(i // width >> shift) * columns + (i % width >> shift)]]
        s = take(r, own[0])
        if s < 256:
            red, blue, alpha = take(r, own[1]), take(r, own[2]), take(r, own[3])
            out[i] = v = alpha << 24 | red << 16 | s << 8 | blue
            run = 1
        elif s < 280:
            run = _prefixed(r, s - 256)
            d = _prefixed(r, take(r, own[4]))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i or i + run > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(i, i + run):
                out[k] = out[k - d]
        else:
            out[i] = cache[s - 280]
            run = 1
        if cache_bits:
            for k in range(i, i + run):
                cache[(0x1E35A7BD * out[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
        i += run
    return np.array(out, np.int64)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _unpredict(px: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Add the predictions; px: height x width x 4 (ARGB) of residuals."""
    h, w, _ = px.shape
    rows = px.tolist()
    pick = (modes >> 8 & 15).tolist()
    black = (255, 0, 0, 0)

    def clamp(v: int) -> int:
        return 0 if v < 0 else 255 if v > 255 else v

    for y in range(h):
        row, above = rows[y], rows[y - 1] if y else None
        for x in range(w):
            if y == 0:
                p = row[x - 1] if x else black
            elif x == 0:
                p = above[0]
            else:
                m = pick[y >> shift][x >> shift]
                left, top, tl = row[x - 1], above[x], above[x - 1]
                tr = above[x + 1] if x + 1 < w else row[0]
                if m == 1:
                    p = left
                elif m == 2:
                    p = top
                elif m == 3:
                    p = tr
                elif m == 4:
                    p = tl
                elif m == 5:
                    p = [((a + c) // 2 + b) // 2 for a, b, c in zip(left, top, tr)]
                elif m == 6:
                    p = [(a + b) // 2 for a, b in zip(left, tl)]
                elif m == 7:
                    p = [(a + b) // 2 for a, b in zip(left, top)]
                elif m == 8:
                    p = [(a + b) // 2 for a, b in zip(tl, top)]
                elif m == 9:
                    p = [(a + b) // 2 for a, b in zip(top, tr)]
                elif m == 10:
                    p = [((a + b) // 2 + (c + d) // 2) // 2 for a, b, c, d in zip(left, tl, top, tr)]
                elif m == 11:
                    to_left = sum(abs(b - d) for b, d in zip(top, tl))
                    to_top = sum(abs(a - d) for a, d in zip(left, tl))
                    p = left if to_left < to_top else top
                elif m == 12:
                    p = [clamp(a + b - d) for a, b, d in zip(left, top, tl)]
                elif m == 13:
                    half = [(a + b) // 2 for a, b in zip(left, top)]
                    p = [clamp(a + int((a - d) / 2)) for a, d in zip(half, tl)]
                else:
                    p = black
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p)]
    return np.array(rows, np.int32)


def _uncross(px: np.ndarray, elements: np.ndarray, shift: int) -> np.ndarray:
    h, w, _ = px.shape
    e = elements[np.arange(h)[:, None] >> shift, np.arange(w)[None] >> shift]
    signed = lambda v: (v & 255 ^ 128) - 128
    delta = lambda t, c: signed(t) * signed(c) >> 5
    green = px[..., 2]
    red = (px[..., 1] + delta(e, green)) & 255
    blue = (px[..., 3] + delta(e >> 8, green) + delta(e >> 16, red)) & 255
    return np.stack([px[..., 0], red, green, blue], -1)


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, height x width x 4 in the order ARGB."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a simple lossless WebP file")
    body = data[20 : 20 + struct.unpack("<I", data[16:20])[0]]
    r = BitReader(body, 8)
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    undo, w = [], width
    while r.get(1):
        kind = r.get(2)
        if kind in [u[0] for u in undo]:
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            shift = r.get(3) + 2
            bw, bh = -(-w >> shift), -(-height >> shift)
            undo.append((kind, w, shift, _image(body, r, bw, bh, False).reshape(bh, bw)))
        elif kind == PALETTE:
            n = r.get(8) + 1
            colours = np.cumsum(_channels(_image(body, r, n, 1, False)), 0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, w, pack, colours))
            w = -(-w >> pack)
        else:
            undo.append((kind, w, 0, None))
    px = _channels(_image(body, r, w, height, True)).reshape(height, w, 4)
    for kind, w, k, extra in reversed(undo):
        if kind == GREEN:
            px[..., 1] = (px[..., 1] + px[..., 2]) & 255
            px[..., 3] = (px[..., 3] + px[..., 2]) & 255
        elif kind == PREDICTOR:
            px = _unpredict(px, extra, k)
        elif kind == CROSS:
            px = _uncross(px, extra, k)
        else:
            each = 8 >> k
            index = px[..., 2]
            if k:
                x = np.arange(w)
                index = index[:, x >> k] >> (x & (1 << k) - 1) * each & (1 << each) - 1
            full = np.zeros((256, 4), np.int32)
            full[: len(extra)] = extra
            px = full[index]
    return px


def container(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def encode_grey(samples: np.ndarray) -> bytes:
    """A grey image (height x width of bytes) as a lossless WebP file."""
    h, w = samples.shape
    flat = samples.ravel()
    lengths = code_lengths(np.bincount(flat, minlength=280).tolist(), LIMIT)
    if sum(map(bool, lengths)) == 1:
        bits = np.zeros(256, np.int64)
    else:
        bits = np.array(lengths[:256])
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(0, 4)
    out.put(1, 1)
    out.put(GREEN, 2)
    out.put(0, 1)  # no more transforms
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one group of codes
    put_code(out, lengths)
    for symbol in (0, 0, 255, 0):
        put_code(out, [int(i == symbol) for i in range(256)])
    codes = np.array(canonical(lengths)[:256], np.uint32)
    size = bits[flat]
    ends = np.cumsum(size)
    n = int(ends[-1])
    start = ends - size + out.n % 8
    v = codes[flat] << (start & 7).astype(np.uint32) if n else np.zeros(0, np.uint32)
    tail = np.zeros((out.n % 8 + n + 7) // 8 + 3)
    if n:
        at = start >> 3
        for k in range(3):
            tail += np.bincount(at + k, v >> np.uint32(8 * k) & np.uint32(255), len(tail))
    head = bytearray(out.bytes())
    tail = tail[:-3].astype(np.uint8)
    if out.n % 8:
        if len(tail):
            tail[0] |= head[-1]
            head = head[:-1]
    return container(bytes(head) + tail.tobytes())


def store(payload: bytes, row: int = ROW, rows: int = MAX_ROWS) -> bytes:
    """A payload, a multiple of `row` bytes, as one grey image after another."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, row)
    return b"".join(encode_grey(px[k : k + rows]) for k in range(0, len(px), rows))


def pictures(media: bytes) -> Iterator[np.ndarray]:
    """The pixels (height x width x ARGB) of the images in a stored value, one after another."""
    at = 0
    while at < len(media):
        n = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield decode(media[at : at + n])
        at += n


def grey(px: np.ndarray) -> bool:
    return bool((px[..., 1] == px[..., 2]).all() and (px[..., 3] == px[..., 2]).all() and (px[..., 0] == 255).all())


def array_of(media: bytes) -> np.ndarray:
    """The samples of a stored value, images of one width below each other: height x width of grey ones, else
    height x width x RGBA."""
    parts = list(pictures(media))
    if all(map(grey, parts)):
        return np.concatenate([p[..., 2] for p in parts]).astype(np.uint8)
    return np.concatenate([p[..., [1, 2, 3, 0]] for p in parts]).astype(np.uint8)


def load(media: bytes) -> np.ndarray:
    """The samples of a stored payload, rows below each other."""
    px = array_of(media)
    if px.ndim != 2:
        raise ValueError("not a grey image")
    return px


def feature(px: np.ndarray) -> str:
    """Rows, mean, entropy and a 16-bin histogram (per mille) of the samples."""
    c = np.bincount(px.ravel(), minlength=256)
    p = c[c > 0] / px.size
    bins = c.reshape(16, 16).sum(1) * 1000 // px.size
    return f"rows={len(px)};mean={px.mean():.3f};entropy={abs(float((p * -np.log2(p)).sum())):.4f};bins={'.'.join(map(str, bins.tolist()))}"


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and the bytes padded with spaces to a positive multiple of ROW."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b.ljust(max(1, math.ceil(len(b) / ROW)) * ROW)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part, seen, out = b.slice(lo, 1000), {}, []
            for t in part.column(1).to_pylist():
                if t not in seen:
                    n, data = payload(t)
                    seen[t] = (n, store(data))
                out.append(seen[t])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["doc_id", "n_bytes", "media"])


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen, out = {}, []
        for media in b.column(2).to_pylist():
            if media is None:
                out.append((None,) * 7)
                continue
            sha = hashlib.sha256(media).hexdigest()
            if sha not in seen:
                px = array_of(media)
                seen[sha] = (len(media), sha, px.shape[1], px.shape[0], 1 if px.ndim == 2 else 4, px.tobytes(), feature(px))
            out.append(seen[sha])
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "width", "height", "channels", "pixels", "feature"])


def write_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media (WebP bytes) of every row, written to the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(tidy(_store), "doc_id long, n_bytes long, media binary"), "media")


def pixels(media: DataFrame) -> DataFrame:
    """The pixel arrays of any lossless WebP column (doc_id, n_bytes, media): width, height, channels (1: grey, 4: RGBA),
    pixels (bytes, row by row), and media_bytes, media_sha256, feature. A null value has nulls; a broken one raises."""
    kept = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media")
    return kept.mapInArrow(tidy(_pixels), "doc_id long, n_bytes long, media_bytes long, media_sha256 string, width int, height int, channels int, pixels binary, feature string")


def write_pixels(media: DataFrame, path: str) -> None:
    """Write the pixel arrays as Parquet."""
    pixels(media).write.option("compression", "zstd").parquet(path)


def read_media(media: DataFrame) -> DataFrame:
    """The stored values decoded: payload_bytes, payload_sha256, tail_crc32 of their pixel arrays, media_bytes,
    media_sha256, feature."""
    px = F.col("pixels")
    digests = [F.octet_length(px).cast("long").alias("payload_bytes"), F.sha2(px, 256).alias("payload_sha256"), F.crc32(F.substring(px, -16, 16)).alias("tail_crc32")]
    return pixels(media).select("doc_id", "n_bytes", *digests, "media_bytes", "media_sha256", "feature")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(write_media(table(spark, sf_dir, "documents")))


QUERIES = {"op10_media": op10_media}
ORACLES: dict[str, str] = {}  # the stored form isn't SQL: tests compare round trips with brute force
