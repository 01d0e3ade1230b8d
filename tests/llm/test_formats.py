"""Token files, archives and media: exact round trips and brute force."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from halyard.llm import tokens, warc, webp


def test_tokens(odd, ship, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    folder = str(tmp_path / "t")
    manifest = tokens.write_tokens(odd, folder, length=64)
    got = sorted(tokens.read_tokens(folder, manifest).collect(), key=lambda r: r.start)
    want = [[*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd.collect()]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda x: (x is None, x or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(w), crc(w)) for w in want)
    for m in manifest.collect():
        r = tokens.ShardReader(f"{folder}/{m.shard}")
        total = sum(r.docs["n_tokens"].to_pylist())
        n = -(-total // 64)
        flat = [r.sequence(k) for k in range(n)]
        assert sum(int(mask.sum()) for _, mask in flat) == total and all(len(ids) == 64 for ids, _ in flat)
    assert tokens.read_tokens(folder, tokens.write_tokens(odd.limit(0), folder)).count() == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_pieces_are_whole_texts(special_as_text, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MOST_PIECES", 300)  # so that pieces are forgotten too
    own = Tokenizer.from_file(tokens.default_vocabulary())
    own.encode_special_tokens = special_as_text
    e = tokens.Encoder(tokens.default_vocabulary(), special_as_text)
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "Bc", " ", "  ", "\n", "'s", ",", "1", "é", "　", "\x1c", "<|endoftext|>", "the ", "\t"]) for _ in range(r.randrange(40))) for _ in range(3000)]
    for signs in (["a", " ", "b", "\n", "é", "Word,", " it's", "\t", "\0", "\1", "."], ["a", " b", "\nc", " d.", " é!?", " 12", "\nx"]):
        texts += ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(2000)]
    for lo in range(0, len(texts), 700):
        for t, got in zip(texts[lo : lo + 700], e.encode(pa.array(texts[lo : lo + 700])).to_pylist()):
            assert got == own.encode(t, add_special_tokens=False).ids, repr(t)
    assert e.encode(pa.array([None, ""], pa.string())).to_pylist() == [[], []] and len(e.encode(pa.array([], pa.string()))) == 0


PAGES = [(5, "http://www.Example.com/A?b=1", "same"), (3, "https://sub.example.com:8080/x y", "same"), (3, "https://sub.example.com:8080/x y", "same"), (9, None, "same"), (1, "http://a.org/", None), (2, "http://a.org/", ""), (4, "notaurl\t\r\n", "é\r\n\r\nü"), (None, "http://a.org/", "own"), (None, "http://a.org/", "same"), (11, "http://a.com/x\u2028y", "l"), (12, "http://a.com/x\x85y", "m"), (13, "http://a.com/\x0b\x0c\x1c\x1d\x1ez", "n" * 300_000)]


def test_archives(ship, tmp_path):
    pages = ship.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, file string")
    a, i = str(tmp_path / "a"), str(tmp_path / "i")
    manifest = warc.write_index(warc.write_archives(pages, a), i, lines=2)
    got = sorted(map(str, (tuple(r) for r in warc.read_archives(ship, i, manifest, a).collect())))
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        refers = first if first is not None and first != page else None
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert got == sorted(map(str, want))
    urls = ship.createDataFrame([("http://A.org/",), ("https://sub.example.com:8080/x y",), ("http://none.net",), ("http://a.com/x\u2028y",)], "url string")
    found = warc.lookup(urls, i, manifest, a).collect()
    assert sorted((r.url, r.page_id or -1) for r in found) == [("http://A.org/", -1), ("http://A.org/", -1), ("http://A.org/", 1), ("http://A.org/", 2), ("http://a.com/x\u2028y", 11), ("https://sub.example.com:8080/x y", 3), ("https://sub.example.com:8080/x y", 3)]
    empty = warc.write_index(warc.write_archives(pages.limit(0), a), i)
    assert warc.read_archives(ship, i, empty, a).count() == 0
    assert all(r.record_type == "response" for r in warc.read_archives(ship, i, warc.write_index(warc.write_archives(pages, a, least=100), i), a).collect())


def test_surt():
    assert warc.surt("http://www.Example.com:80/A?B=1#f") == "com,example)/a?b=1"
    assert warc.surt(None) == "" and warc.surt("http://[bad") == "http://[bad"


def test_media(odd, ship):
    rows = {(r.doc_id, r.text) for r in odd.collect()}
    got = webp.read_media(webp.write_media(odd)).collect()
    want = set()
    for d, t in rows:
        p = (t or "").encode()
        n = len(p)
        p += b" " * (192 - n if n < 192 else -n % 192)
        c = [p.count(bytes([k])) for k in range(256)]
        entropy = -sum(k / len(p) * math.log2(k / len(p)) for k in c if k)
        mean = sum(k * i for i, k in enumerate(c)) / len(p)
        bins = ".".join(str(sum(c[k : k + 16]) * 1000 // len(p)) for k in range(0, 256, 16))
        want.add((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), f"rows={len(p) // 192};mean={mean:.3f};entropy={abs(entropy):.4f};bins={bins}"))
    assert len(got) == odd.count() and {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got} == want
    held = webp.write_media(odd).collect()
    assert all(m.media[:4] == b"RIFF" and m.media[8:16] == b"WEBPVP8L" for m in held)
    assert {(r.doc_id, r.media_bytes, r.media_sha256) for r in got} == {(m.doc_id, len(m.media), hashlib.sha256(m.media).hexdigest()) for m in held}
    by_payload = {(r.payload_sha256, r.media_sha256, r.media_bytes, r.feature) for r in got}
    assert len(by_payload) == len({r.payload_sha256 for r in got})
    assert webp.read_media(webp.write_media(odd.limit(0))).count() == 0


def test_pixel_arrays(image, ship, tmp_path):
    """Any lossless image becomes a written pixel array; nulls stay null."""
    w = webp.BitWriter()
    _head(w, 13, 9)
    w.put(0, 1)
    w.put(0, 1)
    w.put(0, 1)
    _literals(w, _argb(image))
    colour, own = webp.container(w.bytes()), webp.store(b"ab" * 192)
    media = ship.createDataFrame([(1, 0, colour, "x"), (2, 0, own, "x"), (3, None, None, "x")], "doc_id long, n_bytes long, media binary, pixels string")
    webp.write_pixels(media, str(tmp_path / "px"))
    got = {r.doc_id: r for r in ship.read.parquet(str(tmp_path / "px")).collect()}
    assert (got[1].width, got[1].height, got[1].channels) == (13, 9, 4) and got[1].pixels == image[..., [1, 2, 3, 0]].astype(np.uint8).tobytes()
    assert (got[2].width, got[2].height, got[2].channels) == (192, 2, 1) and got[2].pixels == b"ab" * 192
    assert got[3].pixels is None and got[3].width is None


def _literals(w, px, cache_bits=0, runs=None):
    """Write an entropy-coded image of ARGB values: codes, then pixels; runs: {index: (length, distance code)}."""
    runs = runs or {}
    ops, i = [], 0
    cache = {}
    index = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(px):
        if i in runs:
            ops.append(("run", *runs[i]))
            step = runs[i][0]
        elif cache_bits and cache.get(index(px[i]), 0) == px[i]:
            ops.append(("cache", index(px[i])))
            step = 1
        else:
            ops.append(("px", px[i]))
            step = 1
        for v in px[i : i + step]:
            if cache_bits:
                cache[index(v)] = v
        i += step

    def prefix(v):
        if v <= 4:
            return v - 1, 0, 0
        v -= 1
        n = v.bit_length() - 1
        second = v >> (n - 1) & 1
        return 2 * n + second, v & (1 << (n - 1)) - 1, n - 1

    counts = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
    for o in ops:
        if o[0] == "px":
            for c, s in zip(counts, (8, 16, 0, 24)):
                c[o[1] >> s & 255] += 1
        elif o[0] == "cache":
            counts[0][280 + o[1]] += 1
        else:
            counts[0][256 + prefix(o[1])[0]] += 1
            counts[4][prefix(o[2])[0]] += 1
    lengths = [webp.code_lengths(c, 15) for c in counts]
    codes = [webp.canonical(x) for x in lengths]
    for x in lengths:
        webp.put_code(w, x)

    def put(k, s):
        if sum(map(bool, lengths[k])) > 1:
            w.put(codes[k][s], lengths[k][s])

    for o in ops:
        if o[0] == "px":
            for k, s in enumerate((8, 16, 0, 24)):
                put(k, o[1] >> s & 255)
        elif o[0] == "cache":
            put(0, 280 + o[1])
        else:
            p, extra, n = prefix(o[1])
            put(0, 256 + p)
            w.put(extra, n)
            p, extra, n = prefix(o[2])
            put(4, p)
            w.put(extra, n)


def _head(w, width, height):
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def _argb(px):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for a, r, g, b in px.reshape(-1, 4)]


def _decoded(w):
    return webp.decode(webp.container(w.bytes()))


@pytest.fixture
def image():
    r = np.random.default_rng(3)
    return r.integers(0, 256, (9, 13, 4)) // 16 * 16


def test_plain_cache_and_runs(image):
    for cache_bits in (0, 1, 6, 11):
        w = webp.BitWriter()
        _head(w, 13, 9)
        w.put(0, 1)
        w.put(int(cache_bits > 0), 1)
        if cache_bits:
            w.put(cache_bits, 4)
        w.put(0, 1)
        _literals(w, _argb(image), cache_bits)
        assert (_decoded(w) == image).all()
    copy = image.copy()
    flat = copy.reshape(-1, 4)
    flat[20:45] = flat[19]  # a run one pixel back: distance code 2
    for k in range(60, 80):
        flat[k] = flat[k - 13]  # the row above: distance code 1
    for k in range(90, 117):
        flat[k] = flat[k - 50]  # farther: 120 + 50
    w = webp.BitWriter()
    _head(w, 13, 9)
    w.put(0, 1)
    w.put(1, 1)
    w.put(5, 4)
    w.put(0, 1)
    _literals(w, _argb(copy), 5, {20: (25, 2), 60: (20, 1), 90: (27, 170)})
    assert (_decoded(w) == copy).all()


def test_groups_of_codes(image):
    """An entropy image picks one of two groups for blocks of 4 x 4."""
    meta = np.array([[0, 1, 0, 1], [1, 0, 1, 0], [0, 0, 1, 1]])
    w = webp.BitWriter()
    _head(w, 13, 9)
    for bit in (0, 0, 1):
        w.put(bit, 1)
    w.put(0, 3)
    w.put(0, 1)
    _literals(w, [int(m) << 8 for m in meta.ravel()])
    groups = [[], []]
    for y in range(9):
        for x in range(13):
            groups[meta[y // 4][x // 4]].append(image[y, x])
    lengths = [[webp.code_lengths(np.bincount([p[c] for p in g], minlength=n).tolist(), 15) for c, n in ((2, 280), (1, 256), (3, 256), (0, 256))] + [[0] * 40] for g in groups]
    for g in lengths:
        for x in g:
            webp.put_code(w, x)
    codes = [[webp.canonical(x) for x in g] for g in lengths]
    for y in range(9):
        for x in range(13):
            k = meta[y // 4][x // 4]
            for j, c in enumerate((2, 1, 3, 0)):
                s = image[y, x, c]
                if sum(map(bool, lengths[k][j])) > 1:
                    w.put(codes[k][j][s], lengths[k][j][s])
    assert (_decoded(w) == image).all()


def _forward_predict(px, modes, shift):
    """Residuals for the predictor, written apart from the decoder: each pixel's prediction by its mode's formula."""
    h, w, _ = px.shape
    p = px.astype(int)
    out = np.zeros_like(p)
    avg = lambda a, b: (a + b) // 2
    for y in range(h):
        for x in range(w):
            if x == 0 and y == 0:
                q = np.array([255, 0, 0, 0])
            elif y == 0:
                q = p[y, x - 1]
            elif x == 0:
                q = p[y - 1, x]
            else:
                left, top, tl = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
                tr = p[y - 1, x + 1] if x + 1 < w else p[y, 0]
                pick = abs(left + top - tl - left).sum() < abs(left + top - tl - top).sum()
                half = avg(left, top)
                q = [
                    lambda: np.array([255, 0, 0, 0]), lambda: left, lambda: top, lambda: tr, lambda: tl, lambda: avg(avg(left, tr), top), lambda: avg(left, tl), lambda: avg(left, top),
                    lambda: avg(tl, top), lambda: avg(top, tr), lambda: avg(avg(left, tl), avg(top, tr)), lambda: left if pick else top, lambda: np.clip(left + top - tl, 0, 255),
                    lambda: np.clip(half + np.trunc((half - tl) / 2).astype(int), 0, 255),
                ][modes[y >> shift][x >> shift]]()
            out[y, x] = (p[y, x] - q) & 255
    return out


def test_transforms(image):
    r = np.random.default_rng(9)
    for base in (0, 4, 8, 10):
        modes = r.integers(base, min(14, base + 4), (3, 4))
        elements = r.integers(0, 256, (3, 4, 3))
        w = webp.BitWriter()
        _head(w, 13, 9)
        w.put(1, 1)
        w.put(webp.PREDICTOR, 2)
        w.put(0, 3)
        w.put(0, 1)
        _literals(w, [int(m) << 8 for m in modes.ravel()])
        w.put(1, 1)
        w.put(webp.CROSS, 2)
        w.put(0, 3)
        w.put(0, 1)
        _literals(w, [int(a) << 16 | int(b) << 8 | int(c) for a, b, c in elements.reshape(-1, 3)])
        w.put(1, 1)
        w.put(webp.GREEN, 2)
        w.put(0, 1)
        px = _forward_predict(image, modes, 2)
        signed = lambda v: int(v) - 256 if v > 127 else int(v)
        for y in range(9):
            for x in range(13):
                a, red, green, blue = map(int, px[y, x])
                e = elements[y // 4][x // 4]  # red to blue, green to blue, green to red
                px[y, x, 1] = (red - (signed(e[2]) * signed(green) >> 5)) & 255
                px[y, x, 3] = (blue - (signed(e[1]) * signed(green) >> 5) - (signed(e[0]) * signed(red) >> 5)) & 255
        px[..., 1] = (px[..., 1] - px[..., 2]) & 255
        px[..., 3] = (px[..., 3] - px[..., 2]) & 255
        w.put(0, 1)
        w.put(0, 1)
        _literals(w, _argb(px))
        assert (_decoded(w) == image).all()


@pytest.mark.parametrize("n", [2, 4, 16, 40])
def test_palette(n):
    r = np.random.default_rng(n)
    colours = r.integers(0, 256, (n, 4))
    index = r.integers(0, n, (9, 13))
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    w = webp.BitWriter()
    _head(w, 13, 9)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(n - 1, 8)
    w.put(0, 1)
    _literals(w, _argb(np.diff(colours, axis=0, prepend=0) & 255))
    for _ in range(3):
        w.put(0, 1)
    packed = np.zeros((9, -(-13 >> pack)), int)
    for x in range(13):
        packed[:, x >> pack] |= index[:, x] << (x & (1 << pack) - 1) * (8 >> pack)
    _literals(w, [int(v) << 8 for v in packed.ravel()])
    assert (_decoded(w) == colours[index]).all()


def test_broken_files():
    good = webp.encode_grey(np.zeros((2, 192), np.uint8))
    for bad in (b"", good[:12], b"RIFX" + good[4:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    text = webp.store(webp.payload("some text, long enough " * 20)[1])
    with pytest.raises(ValueError):
        webp.load(text[:30] + bytes(20))
