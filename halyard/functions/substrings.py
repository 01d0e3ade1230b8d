"""Which texts hold which terms, from the rarest run of characters of each term."""

from __future__ import annotations


def size(n: int) -> int:
    """The length of the runs that a term of n characters is looked up by: the largest power of two in it, 16 at most."""
    return 1 << min(n, 16).bit_length() - 1


def _runs(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def holders(terms: set[str], texts: list[str | None]) -> dict[str, list[int]]:
    """The places of the texts that hold each term, in order; null texts hold none."""
    runs = {t: _runs(t, size(len(t))) for t in terms if t}
    sizes = sorted({size(len(t)) for t in runs})
    count = dict.fromkeys((g for own in runs.values() for g in own), 0)
    for x in texts:
        for n in sizes if x else ():
            for g in _runs(x, n):
                if g in count:
                    count[g] += 1
    rare = {t: min(own, key=lambda g: (count[g], g)) for t, own in runs.items()}
    at: dict[str, list[int]] = {g: [] for g in rare.values() if count[g]}
    for k, x in enumerate(texts):
        for n in sizes if x else ():
            for g in _runs(x, n):
                if g in at:
                    at[g].append(k)
    found = {t: [k for k in at.get(g, ()) if t in texts[k]] for t, g in rare.items()}
    if "" in terms:
        found[""] = [k for k, x in enumerate(texts) if x is not None]
    return found
