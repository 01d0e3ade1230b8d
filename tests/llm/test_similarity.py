"""SimHash and the inverted index against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from halyard.llm import invindex, simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [(i, f) for i, f in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(fps[i][0])
    return sorted((str(fps[i][0]), fps[i][1], min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(fps)))


def test_fingerprint():
    for t in [None, "", " ", "One", "one TWO", "a b c", "É É é", "x " * 500, "the cat sat on the mat. The cat!", "".join(chr(random.Random(3).randint(32, 900)) for _ in range(400))]:
        assert simhash.fingerprint(t) == brute_fp(t)


def test_odd_rows(odd, make, ship):
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect())
    want = brute_components([(r.doc_id, brute_fp(r.text)) for r in odd.collect()])
    assert got == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_tiles_find_every_link():
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(12)} | {0, 2**64 - 1, 7})
    own, other = np.array(fps[::2], np.uint64), np.array(fps[1::2], np.uint64)
    for tile in (1, 7, 512):
        u, v = simhash.tile_links(own, other, True, tile=tile)
        assert all((int(a) ^ int(b)).bit_count() <= 64 for a, b in zip(u, v))
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u.tolist(), v.tolist()):
            root[find(a)] = find(b)
        for i, a in enumerate(fps[::2]):
            for b in fps[1::2] + fps[::2][:i]:
                if (a ^ b).bit_count() <= 3:
                    assert find(a) == find(b)


def test_split_cells(ship):
    """Small blocks give a grid of tasks with the same components."""
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = sorted({(b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4)))) & (1 << 64) - 1 for b in base for _ in range(10)})
    nodes = ship.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    labels = {x.node % 2**64: x.label for x in simhash.components(simhash.links(nodes, block=4)).collect()}
    want = {f: c for _, f, c in brute_components([(i, f) for i, f in enumerate(fps)])}
    groups = defaultdict(set)
    for f in fps:
        groups[want[f]].add(labels.get(f, f - (f >> 63 << 64)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def brute_hits(text, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = word.findall(low(text))
    hit, ids = set(), set()
    for i, t in items:
        iw = word.findall(low(t))
        for s in range(max(1, len(iw) - size + 1)) if iw else []:
            win = iw[s : s + size]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontamination(make, ship):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["É", "x-y", "Zeta", "9"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([30, 12, 10, 9, 3, 1, 25])] + [(7, None), (8, "..."), (8, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(80))), "en", "s") for i in range(25)]
    docs += [(100 + k, "pre " + (t or "").upper().replace(" ", "  ") + " post", "en", "s") for k, (_, t) in enumerate(items)] + [(200, None, None, None), (200, "", None, None), (None, items[0][1], "en", "s")]
    table = ship.createDataFrame(items, "item_id long, text string")
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in invindex.decontaminate(make(docs), table).collect())
    assert got == sorted((str(d[0]), *brute_hits(d[1], items)) for d in docs)
    assert invindex.decontaminate(make(docs).limit(0), table).count() == 0
    assert not any(x.contaminated for x in invindex.decontaminate(make(docs[:3]), table.limit(0)).collect())


def test_phrase_and_proximity(make, ship, tmp_path):
    docs = make([(1, "the red fox ran over the hill", "en", "s"), (2, "fox red the", "en", "s"), (3, "the red dog and then a fox", "en", "s")])
    invindex.build_index(docs, str(tmp_path / "i"), segment_words=5)
    w = (b"red", b"fox")
    exact = invindex.search(str(tmp_path / "i"), ship, {w: [1]}).collect()
    near = invindex.search(str(tmp_path / "i"), ship, {w: [1]}, span=5).collect()
    assert len(exact) == 1 and exact[0].length == 2
    assert len(near) == 3
