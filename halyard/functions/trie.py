"""A compressed trie over sorted names that finds all names of which a pattern is a subsequence, case aside.

A walk goes down only where what is left of the pattern may still fit: enough characters, and none that doesn't occur.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from halyard.functions.fuzzy import BOUNDARY, CAMEL, EDGES, GAP, MATCH, NONE, RUN, lowered

DEPTH, LO, HI, CHILDREN, BELOW, LONGEST, WHOLE = range(7)


def _bit(c: str) -> int:
    k = ord(c)
    return 1 << (k if k < 128 else 128 + (k & 63))


def mask(text: str) -> int:
    """The classes of characters that occur, a bit each: those of ASCII are their own, others go by their code modulo 64."""
    m = 0
    for c in set(text):
        m |= _bit(c)
    return m


DIGITS = mask("0123456789")


class Trie:
    """names: sorted and distinct. A node is a list: its depth, its names from LO to HI, its children, the classes of
    characters below it and with its edge, and the length of its longest name."""

    def __init__(self, names: list[str]):
        self.names, self.low = names, [lowered(n) for n in names]
        self.root = self._built() if names else None

    def _closed(self, node: list, child: list) -> None:
        """Take a finished child in."""
        child[WHOLE] = child[BELOW] | mask(self.low[child[LO]][node[DEPTH] : child[DEPTH]])
        node[CHILDREN].append(child)
        node[HI] = child[HI]
        node[BELOW] |= child[WHOLE]
        node[LONGEST] = max(node[LONGEST], child[LONGEST])

    def _built(self) -> list:
        names, open_ = self.names, []
        last = [len(names[0]), 0, 1, (), 0, len(names[0]), 0]
        for k in range(1, len(names)):
            a, b = names[k - 1], names[k]
            same, most = 0, min(len(a), len(b))
            while same < most and a[same] == b[same]:
                same += 1
            while open_ and open_[-1][DEPTH] > same:
                self._closed(open_[-1], last)
                last = open_.pop()
            if not (open_ and open_[-1][DEPTH] == same):
                open_.append([same, last[LO], last[HI], [], 0, 0, 0])
            self._closed(open_[-1], last)
            last = [len(b), k, k + 1, (), 0, len(b), 0]
        while open_:
            self._closed(open_[-1], last)
            last = open_.pop()
        last[WHOLE] = last[BELOW] | mask(self.low[last[LO]][: last[DEPTH]])
        return last

    def matches(self, want: str) -> Iterator[list]:
        """The highest nodes all names of which hold `want`, which is lower-case, as a subsequence."""
        n = len(want)
        need = [0] * (n + 1)
        for k in range(n - 1, -1, -1):
            need[k] = need[k + 1] | _bit(want[k])
        if self.root is None or need[0] & ~self.root[WHOLE] or n > self.root[LONGEST]:
            return
        todo = [(self.root, 0, 0)]
        while todo:
            node, at, pos = todo.pop()
            depth, text = node[DEPTH], self.low[node[LO]]
            while pos < n:
                at = text.find(want[pos], at, depth) + 1
                if not at:
                    break
                pos += 1
            if pos == n:
                yield node
                continue
            left, must = n - pos, need[pos]
            if must & ~node[BELOW] or left > node[LONGEST] - depth:
                continue
            for c in node[CHILDREN]:
                room = c[LONGEST] - depth
                if left < room and not must & ~c[WHOLE] or left == room and self.low[c[LO]][depth] == want[pos]:
                    todo.append((c, depth, pos))

    def best(self, want: str, top: int, rank: list[int], grade: Callable[[int], int], least: int, first: dict) -> list[tuple[int, int, int]]:
        """The first `top` of (-grade of its score, rank, score) over all names that hold `want` as a subsequence and reach
        `least`, as `fuzzy.score` has it; rank gives each name's place among equals, `first` keeps nodes' best names.

        Scores grow column by column on the way down. The node that may hold the best score goes first, and a node that
        can't better what is found is left, so a pattern meets few of the names that hold it. No character may be beyond
        the basic plane."""
        n, low, names = len(want), self.low, self.names
        have: list[tuple[int, int, int]] = []
        every = mask(want)
        if self.root is None or every & ~self.root[WHOLE] or n > self.root[LONGEST]:
            return have
        need, places = [0] * (n + 1), {}
        for k in range(n - 1, -1, -1):  # last places first: a row is read before the same column changes it
            need[k] = need[k + 1] | _bit(want[k])
            places.setdefault(want[k], []).append(k + 1)

        def top_of(node: list) -> list[int]:
            if id(node) not in first:
                first[id(node)] = heapq.nsmallest(top, range(node[LO], node[HI]), key=rank.__getitem__)
            return first[id(node)]

        def hopeless(node: list, score: int) -> bool:
            g = grade(score)
            if g < least or len(have) == top and -g > have[-1][0]:
                return True
            return len(have) == top and -g == have[-1][0] and rank[top_of(node)[0]] > have[-1][1]

        # rows: the best score that ends with each place of the pattern, plus the column, so that gaps cost nothing to pass
        todo: list[tuple] = []
        step = 0

        def enter(node: list, depth: int, pos: int, rows: list[int], runs: dict, found: int) -> None:
            nonlocal step
            text, name, end, own = low[node[LO]], names[node[LO]], node[DEPTH], False
            for j in range(depth, end):
                c = text[j]
                if pos < n and c == want[pos]:
                    pos += 1
                at = places.get(c)
                if at is None:
                    if runs:
                        runs = {}
                    continue
                if not own:
                    rows, own = rows[:], True
                b, a, x = 0, name[j - 1] if j else "", name[j]
                if not a or a in EDGES:
                    b = BOUNDARY
                elif "A" <= x <= "Z" and "a" <= a <= "z" or "0" <= x <= "9" and not "0" <= a <= "9":
                    b = CAMEL
                now = {}
                for i in at:
                    if i > j + 1:
                        continue
                    s = MATCH - j * GAP + 2 * b if i == 1 else rows[i - 1] - j + MATCH + b
                    if i - 1 in runs and runs[i - 1] + MATCH + RUN > s:
                        s = runs[i - 1] + MATCH + RUN
                    now[i] = s
                    if s + j + 1 > rows[i]:
                        rows[i] = s + j + 1
                    if i == n and s > found:
                        found = s
                runs = now
            ahead = NONE
            if node[CHILDREN]:
                left, below = node[LONGEST] - end, node[BELOW]
                if pos < n and (need[pos] & ~below or n - pos > left):
                    return
                if below & every:
                    plain = not below & ~DIGITS and end and "0" <= text[end - 1] <= "9"  # digits after a digit earn no bonus
                    b = 0 if plain else BOUNDARY
                    most = max(MATCH + RUN, MATCH + b)
                    if left >= n and not every & ~below:
                        ahead = MATCH - end + 2 * b + (n - 1) * most
                    for i in range(max(1, n - left), n):
                        if not need[i] & ~below:
                            s = max(rows[i] - end + MATCH + b, runs[i] + most if i in runs else NONE)
                            ahead = max(ahead, s + (n - i - 1) * most)
            elif pos < n:
                return
            if pos == n and ahead <= found:  # all names from here on score the same
                g = grade(found)
                if found >= 0 and g >= least:
                    for k in top_of(node):
                        if len(have) == top and (-g, rank[k]) >= have[-1][:2]:
                            break
                        have.append((-g, rank[k], found))
                        have.sort()
                        del have[top:]
                return
            bound = max(found, ahead)
            if not hopeless(node, bound):
                step += 1
                heapq.heappush(todo, (-bound, step, node, pos, rows, runs, found))

        enter(self.root, 0, 0, [0, 0] + [NONE] * (n - 1), {}, -1)
        while todo:
            bound, _, node, pos, rows, runs, found = heapq.heappop(todo)
            if hopeless(node, -bound):
                continue
            depth, left = node[DEPTH], n - pos
            for c in node[CHILDREN]:
                room = c[LONGEST] - depth
                if not left or left < room and not need[pos] & ~c[WHOLE] or left == room and low[c[LO]][depth] == want[pos]:
                    enter(c, depth, pos, rows, runs, found)
        return have
