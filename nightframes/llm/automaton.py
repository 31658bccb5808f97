"""Regular expressions to one minimised deterministic automaton, run over bytes in lockstep.

The dialect is what secret rules need: literals, classes, groups, alternation, the
quantifiers ?, * and +, and {n}, {n,}. Rules are compiled together, so one pass over the
bytes follows all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

# Bytes one lane of the lockstep run takes; the loop runs that often whatever the text's size.
LANE = 512
SETS = {"d": range(48, 58), "x": [*range(48, 58), *range(97, 103)]}


class Parser:
    """Thompson construction into (edges by state, empty moves by state)."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def rule(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.text, self.at, self.fold = pattern, 0, fold
        out = self.either()
        if self.at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.at}")
        return out

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def either(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.empty[start].append(a)
            self.empty[b].append(end)
            if self.peek() != "|":
                return start, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self.atom()
            low, high = self.quantifier()
            stop = self.at
            copies = [(a, b)]
            for _ in range(max(low, 1 if high is None else high) - 1):
                self.at = begin
                copies.append(self.atom())
            self.at = stop
            for i, (a, b) in enumerate(copies):
                self.empty[end].append(a)
                if i >= low:
                    self.empty[end].append(b)
                if high is None and i == len(copies) - 1:
                    self.empty[b].append(a)
                end = b
        return start, end

    def quantifier(self) -> tuple[int, int | None]:
        c = self.peek()
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c != "{":
            return 1, 1
        stop = self.text.index("}", self.at)
        low, comma, _ = self.text[self.at + 1 : stop].partition(",")
        self.at = stop + 1
        return int(low), None if comma else int(low)

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        self.at += 1
        if c == "(":
            inner = self.either()
            self.at += 1
            return inner
        chars = self.members() if c == "[" else self.escaped() if c == "\\" else [ord(c)]
        if self.fold:
            chars = [y for x in chars for y in {x, ord(chr(x).lower()), ord(chr(x).upper())}]
        start, end = self.state(), self.state()
        self.edges[start].append((frozenset(chars), end))
        return start, end

    def escaped(self) -> list[int]:
        c = self.peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return [int(self.text[self.at - 2 : self.at], 16)]
        return [*SETS["d"]] if c == "d" else [ord(c)]

    def members(self) -> list[int]:
        found: list[int] = []
        while self.peek() != "]":
            c = self.peek()
            self.at += 1
            low = self.escaped()[0] if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                high = ord(self.text[self.at + 1])
                self.at += 2
                found += range(low, high + 1)
            else:
                found.append(low)
        self.at += 1
        return found


class Automaton:
    """``table[state * 256 + byte]`` is the next state; ``accepts[state]`` has a bit for each rule.

    A searching automaton begins a match at every byte; else matches begin at the first.
    State 0 is where a search begins, or what nothing leads out of in a matching automaton.
    """

    def __init__(self, rules: Iterable[tuple[str, bool]], search: bool = True):
        nfa = Parser()
        ends, starts = [], []
        for pattern, fold in rules:
            a, b = nfa.rule(pattern, fold)
            starts.append(a)
            ends.append(b)
        table, accepts, start = subsets(nfa, starts, ends, search)
        self.table, self.accepts, self.start = minimised(table, accepts, start)
        self.states = len(self.accepts)

    def run(self, data: np.ndarray) -> np.ndarray:
        """The state after each byte.

        The bytes are cut into lanes that advance together, each from the starting state. A
        lane whose true first state turns out to be another runs again until it meets its
        former course.
        """
        n = len(data)
        lanes = max(1, -(-n // LANE))
        padded = np.zeros((lanes, LANE), np.uint8)
        padded.reshape(-1)[:n] = data
        columns = np.ascontiguousarray(padded.T)
        out = np.empty((LANE, lanes), np.int32)
        todo, entry = np.arange(lanes), np.full(lanes, self.start, np.int32)
        entered = entry.copy()
        first = True
        while len(todo):
            state, lane = entry[todo].astype(np.int32), todo
            for i in range(LANE):
                state = self.table[state * 256 + columns[i, lane]]
                if not first:
                    differs = state != out[i, lane]
                    if not differs.all():
                        state, lane = state[differs], lane[differs]
                        if not len(lane):
                            break
                out[i, lane] = state
            entered[todo] = entry[todo]
            first = False
            entry[1:] = out[-1, :-1]
            todo = np.flatnonzero(entry != entered)
        return out.T.reshape(-1)[:n]


def subsets(nfa: Parser, starts: list[int], ends: list[int], search: bool):
    """Subset construction; -1 stands for the empty set in a matching automaton."""

    def closure(states: Iterable[int]) -> frozenset:
        seen, stack = set(states), list(states)
        while stack:
            for x in nfa.empty[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(seen)

    begin = closure(starts)
    number, queue, rows, accepts = {begin: 0}, [begin], [], []
    while queue:
        current = queue.pop(0)
        accepts.append(sum(1 << i for i, e in enumerate(ends) if e in current))
        targets: dict[int, set] = {}
        for s in current:
            for chars, to in nfa.edges[s]:
                for c in chars:
                    targets.setdefault(c, set()).add(to)
        row, seen = np.zeros(256, np.int64), {}
        row[:] = number[begin] if search else -1
        for c, to in targets.items():
            key = frozenset(to)
            if key not in seen:
                full = closure(key | begin) if search else closure(key)
                if full not in number:
                    number[full] = len(number)
                    queue.append(full)
                seen[key] = number[full]
            row[c] = seen[key]
        rows.append(row)
    table = np.stack(rows)
    if not search:  # state 0 is the dead one
        table = np.vstack([np.zeros((1, 256), np.int64), table + 1])
        accepts = [0, *accepts]
    return table, np.array(accepts, np.int64), 0 if search else 1


def minimised(table: np.ndarray, accepts: np.ndarray, start: int):
    """Merge states that no continuation tells apart, by refining blocks until none splits."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    count = block.max() + 1
    while True:
        rows = np.column_stack([block, block[table]])
        _, first, block = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        block = block.reshape(-1)
        if len(first) == count:
            break
        count = len(first)
    order = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    block = rank[block]
    keep = first[order]
    return block[table[keep]].astype(np.int32).reshape(-1), accepts[keep], int(block[start])
