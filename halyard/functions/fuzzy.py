"""Alignment scores of a pattern in a name, and the matched ranges; numpy over the name, plain Python over the pattern.

Scores follow fzf's published bonuses. Gaps cost one a character (opening one costs no more), the first matched character
loses one per character before it, and a run earns its own bonus in place of the contextual one where that is more.
"""

from __future__ import annotations

import numpy as np

MATCH, GAP, BOUNDARY, CAMEL, RUN = 16, 1, 8, 7, 4
NONE = -100_000
EDGES = frozenset("/\\_-.: \t")


def units(text: str) -> str:
    """The text with characters beyond the basic plane as their two UTF-16 halves."""
    if not text or max(text) <= "\uffff":
        return text
    data = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(data[k] | data[k + 1] << 8) for k in range(0, len(data), 2))


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def bonuses(name: str) -> list[int]:
    out, before = [], ""
    for c in name:
        if not before or before in EDGES:
            out.append(BOUNDARY)
        elif "A" <= c <= "Z" and "a" <= before <= "z" or "0" <= c <= "9" and not "0" <= before <= "9":
            out.append(CAMEL)
        else:
            out.append(0)
        before = c
    return out


def is_subsequence(pattern: str, name: str) -> bool:
    at = 0
    for c in pattern:
        at = name.find(c, at) + 1
        if not at:
            return False
    return True


def _decayed(row: np.ndarray) -> np.ndarray:
    """The best of each place and all before it, less one for each step between."""
    k = np.arange(len(row))
    return np.maximum.accumulate(row + k) - k


def score(pattern: str, name: str) -> int:
    """The best alignment's score; -1 where the pattern isn't a subsequence; 0 for an empty pattern.

    Rows after the first keep 0 before the name, from which a decayed score may start without any match: that is how the
    rules score, and the ranges may then differ.
    """
    pattern, name = units(pattern), units(name)
    n, m = len(pattern), len(name)
    if not n:
        return 0
    if not m or n > m:
        return -1
    low, want = lowered(name), lowered(pattern)
    if not is_subsequence(want, low):
        return -1
    bonus = np.array(bonuses(name))
    codes = np.array([ord(c) for c in low])
    h = np.zeros(m + 1, np.int64)
    runs = np.full(m + 1, NONE, np.int64)
    for i, c in enumerate(want, 1):
        hit = codes == ord(c)
        if i == 1:
            s = MATCH - np.arange(m) * GAP + 2 * bonus
        else:
            s = np.maximum(h[:-1] + MATCH + bonus, np.where(runs[:-1] > NONE, runs[:-1] + MATCH + RUN, NONE))
        now = np.full(m + 1, NONE, np.int64)
        now[1:][hit] = s[hit]
        now[1:i] = NONE
        row = now.copy()
        row[: i] = NONE
        row[i - 1] = 0 if i == 1 else NONE  # place 0 stays 0; places before i hold nothing
        h = _decayed(row)
        h[:i] = NONE
        h[0] = 0
        runs = now
    return int(h[n:].max())


def scores(pairs: list[tuple[str, str]], cells: int = 1 << 20) -> list[int]:
    """`score` of each pattern and name of which it is a subsequence, many at a time."""
    out, order = [0] * len(pairs), sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    known: dict[str, tuple[list[int], list[int]]] = {}
    while order:
        width = len(pairs[order[-1]][1])
        many, order = order[-max(1, cells // (width + 1)) :], order[: -max(1, cells // (width + 1))]
        plain = []
        for k in many:
            p, t = pairs[k]
            if p and t and max(p) <= "\uffff" and max(t) <= "\uffff":
                plain.append(k)
            else:
                out[k] = score(p, t)
        if not plain:
            continue
        n, m = (np.array([len(pairs[k][c]) for k in plain]) for c in (0, 1))
        low, bonus = np.full((len(plain), m.max()), -1, np.int32), np.zeros((len(plain), m.max()), np.int32)
        want = np.full((len(plain), n.max()), -2, np.int32)
        for r, k in enumerate(plain):
            p, t = pairs[k]
            if t not in known:
                known[t] = [ord(c) for c in lowered(t)], bonuses(t)
            low[r, : len(t)], bonus[r, : len(t)] = known[t]
            want[r, : len(p)] = [ord(c) for c in lowered(p)]
        known.clear()
        place = np.arange(m.max() + 1, dtype=np.int32)
        h, runs = np.zeros((len(plain), m.max() + 1), np.int32), np.full((len(plain), m.max() + 1), NONE, np.int32)
        for i in range(1, n.max() + 1):
            if i == 1:
                s = MATCH - place[:-1] * GAP + 2 * bonus
            else:
                s = np.maximum(h[:, :-1] + MATCH + bonus, np.where(runs[:, :-1] > NONE, runs[:, :-1] + MATCH + RUN, NONE))
            now = np.full_like(h, NONE)
            now[:, 1:] = np.where(low == want[:, i - 1 : i], s, NONE)
            now[:, 1:i] = NONE
            row = now.copy()
            row[:, :i] = NONE
            if i == 1:
                row[:, 0] = 0
            row = np.maximum.accumulate(row + place, axis=1) - place
            row[:, :i] = NONE
            row[:, 0] = 0
            more = (n >= i)[:, None]
            h, runs = np.where(more, row, h), np.where(more, now, runs)
        best = np.where((place >= n[:, None]) & (place <= m[:, None]), h, NONE - 1).max(1)
        for r, k in enumerate(plain):
            out[k] = int(best[r]) if n[r] <= m[r] else -1
    return out


def ranges(pattern: str, name: str) -> list[tuple[int, int]]:
    """The matched runs [start, end) of the best alignment, or none where the steps back don't agree."""
    pattern, name = units(pattern), units(name)
    n, m = len(pattern), len(name)
    if not n or not m:
        return []
    low, want, bonus = lowered(name), lowered(pattern), bonuses(name)
    if low == want:  # there is no other alignment
        return [(0, n)]
    h = [[0] * (m + 1)] + [[NONE] * (m + 1) for _ in range(n)]
    hits = [[NONE] * (m + 1) for _ in range(n + 1)]
    runs = [[False] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(i, m + 1):
            if want[i - 1] == low[j - 1]:
                if i == 1:
                    best = MATCH - (j - 1) * GAP + 2 * bonus[j - 1]
                else:
                    best = h[i - 1][j - 1] + MATCH + bonus[j - 1]
                    before = hits[i - 1][j - 1]
                    if before > NONE and before + MATCH + RUN > best:
                        best, runs[i][j] = before + MATCH + RUN, True
                hits[i][j] = best
            h[i][j] = max(hits[i][j], h[i][j - 1] - GAP)
    j = max(range(n, m + 1), key=lambda k: (h[n][k], -k), default=m)
    i, found, must = n, [], False
    while i and j:
        same = want[i - 1] == low[j - 1] and hits[i][j] > NONE
        if same and (must or h[i][j] == hits[i][j]):
            found.append(j - 1)
            must = runs[i][j]
            i, j = i - 1, j - 1
        elif must:
            return []
        elif h[i][j] in (h[i][j - 1] - GAP, h[i][j - 1] - 3):
            j -= 1
        else:
            return []
    out: list[tuple[int, int]] = []
    for k in reversed(found):
        if out and out[-1][1] == k:
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out


def confidence(raw: int, n: int) -> int:
    """The share of the best possible score for a pattern of n characters, 0 to 100, halves up."""
    if raw < 0 or n <= 0:
        return 0
    return min(100, int(np.floor(raw / (MATCH + 2 * BOUNDARY + (n - 1) * (MATCH + RUN)) * 100 + 0.5)))
