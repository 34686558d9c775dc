"""Regexes over bytes compiled together into one minimal deterministic automaton.

The syntax is what secret rules need: literals, escapes, ``[...]``, ``(...)``, ``|``, ``? * +``, ``{m} {m,} {m,n}``.
A rule is parsed to a tree, the trees to one NFA, the NFA by subset construction to a DFA over classes of bytes,
and that is minimised by refining partitions. ``Automaton.rows`` then has, for each state, the next state by byte.
"""

from __future__ import annotations

import numpy as np

Node = tuple


def _escaped(c: str, rest: str, i: int) -> tuple[frozenset[int], int]:
    if c == "x":
        return frozenset([int(rest[i : i + 2], 16)]), i + 2
    if c == "n":
        return frozenset([10]), i
    return frozenset([ord(c)]), i


def parse(pattern: str, fold: bool = False) -> Node:
    """The tree: ("set", bytes), ("cat", nodes), ("alt", nodes), ("rep", node, least, most or None)."""

    def lit(s: frozenset[int]) -> Node:
        if fold:
            s = s | {b ^ 32 for b in s if 65 <= (b & ~32) <= 90}
        return ("set", s)

    def alt(i: int) -> tuple[Node, int]:
        options, parts = [], []
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                options.append(("cat", parts))
                parts, i = [], i + 1
                continue
            node, i = atom(i)
            while i < len(pattern) and pattern[i] in "?*+{":
                if pattern[i] == "{":
                    end = pattern.index("}", i)
                    least, _, most = pattern[i + 1 : end].partition(",")
                    bounds = (int(least), int(most) if most else None if "," in pattern[i:end] else int(least))
                    i = end
                else:
                    bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[i]]
                node, i = ("rep", node, *bounds), i + 1
            parts.append(node)
        options.append(("cat", parts))
        return (options[0] if len(options) == 1 else ("alt", options)), i

    def atom(i: int) -> tuple[Node, int]:
        c = pattern[i]
        if c == "(":
            node, i = alt(i + 3 if pattern.startswith("(?:", i) else i + 1)
            return node, i + 1
        if c == "[":
            return cls(i + 1)
        if c == "\\":
            s, i = _escaped(pattern[i + 1], pattern, i + 2)
            return lit(s), i
        return lit(frozenset([ord(c)])), i + 1

    def cls(i: int) -> tuple[Node, int]:
        negated = pattern[i] == "^"
        i, found = i + negated, set()
        while pattern[i] != "]":
            if pattern[i] == "\\":
                s, i = _escaped(pattern[i + 1], pattern, i + 2)
            else:
                s, i = frozenset([ord(pattern[i])]), i + 1
            if pattern[i] == "-" and pattern[i + 1] != "]":
                s, i = frozenset(range(min(s), ord(pattern[i + 1]) + 1)), i + 2
            found |= s
        return lit(frozenset(range(256)) - found if negated else frozenset(found)), i + 1

    return alt(0)[0]


def reverse(node: Node) -> Node:
    kind = node[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in node[1]][::-1])
    if kind == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), *node[2:]) if kind == "rep" else node


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.free) - 1

    def add(self, node: Node, start: int) -> int:
        """Wire ``node`` behind ``start``; returns the state at its end."""
        kind = node[0]
        if kind == "set":
            mid, end = self.state(), self.state()
            self.free[start].append(mid)
            self.on[mid] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(x, own)].append(end)
            return end
        _, body, least, most = node
        for _ in range(least):
            start = self.add(body, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(body, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(body, start)
        self.free[start].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.on[s] is not None or not self.free[s])


class Automaton:
    """The minimal DFA of all ``nodes`` together.

    ``floating``: a match may begin anywhere. State 0 is the start; states from ``first_final`` on accept, each
    the rules in ``accepts``; with no rule left alive an anchored automaton goes to ``dead`` (None if there is none).
    """

    def __init__(self, nodes: list[Node], floating: bool):
        nfa = _Nfa()
        begin = nfa.state()
        ends = {nfa.add(node, begin): k for k, node in enumerate(nodes)}
        self.table, accepts, self.classes = self._subsets(nfa, begin, ends, floating)
        self._minimise(accepts)
        self.rows = [self.table[s][self.classes].tolist() for s in range(len(self.table))]

    @staticmethod
    def _subsets(nfa: _Nfa, begin: int, ends: dict[int, int], floating: bool) -> tuple[np.ndarray, list[frozenset[int]], np.ndarray]:
        marks = np.zeros((256, 1), dtype=np.int64)
        for s in {x[0] for x in nfa.on if x is not None}:
            inside = np.isin(np.arange(256), list(s)).astype(np.int64)
            marks = np.unique(np.column_stack([marks[:, 0], inside]), axis=0, return_inverse=True)[1].reshape(-1, 1)
        classes = marks[:, 0]
        sample = [int(np.argmax(classes == k)) for k in range(classes.max() + 1)]
        start = nfa.closed({begin})
        numbers, todo, rows = {start: 0}, [start], []
        while todo:
            now, row = todo.pop(0), []
            for b in sample:
                to = {nfa.on[s][1] for s in now if nfa.on[s] is not None and b in nfa.on[s][0]}
                nxt = nfa.closed(to) | start if floating else nfa.closed(to)
                if nxt not in numbers:
                    numbers[nxt] = len(numbers)
                    todo.append(nxt)
                row.append(numbers[nxt])
            rows.append(row)
        accepts = [frozenset(ends[s] for s in state if s in ends) for state in numbers]
        return np.array(rows), accepts, classes

    def _minimise(self, accepts: list[frozenset[int]]) -> None:
        kinds = {a: k for k, a in enumerate(dict.fromkeys(accepts))}
        part = np.array([kinds[a] for a in accepts])
        while True:
            new = np.unique(np.column_stack([part, part[self.table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == part.max():
                break
            part = new
        first = [int(np.argmax(part == k)) for k in range(part.max() + 1)]
        order = sorted(range(len(first)), key=lambda k: (bool(accepts[first[k]]), k != part[0], k))
        number = {k: i for i, k in enumerate(order)}
        self.table = np.array([[number[part[t]] for t in self.table[first[k]]] for k in order])
        self.accepts = [accepts[first[k]] for k in order]
        self.first_final = sum(not a for a in self.accepts)
        self.start = number[part[0]]
        stays = [i for i, a in enumerate(self.accepts) if not a and (self.table[i] == i).all()]
        self.dead = stays[0] if stays else None

    def scan(self, data: bytes) -> list[list[int]]:
        """[first end, last end, state] of each stretch in one final state, in one pass over the bytes."""
        rows, first, s, out = self.rows, self.first_final, self.start, [[0, 0, -1]]
        row = rows[s]
        for i, b in enumerate(data):
            s = row[b]
            row = rows[s]
            if s >= first:
                last = out[-1]
                if last[1] == i and last[2] == s:
                    last[1] = i + 1
                else:
                    out.append([i + 1, i + 1, s])
        return out[1:]

    def longest(self, data: bytes, start: int, stop: int, step: int = 1) -> int | None:
        """The furthest position at which the anchored automaton accepts, read from ``start`` towards ``stop``."""
        s, found, i = self.start, None, start
        if s >= self.first_final:
            found = i
        while i != stop:
            s = self.rows[s][data[i if step > 0 else i - 1]]
            i += step
            if s == self.dead:
                break
            if s >= self.first_final:
                found = i
        return found
