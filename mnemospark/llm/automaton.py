"""Regular expressions over bytes as one deterministic automaton in arrays.

A pattern becomes the positions of its byte sets with their followers; subsets of positions are the states, which
are then merged by refining partitions. Patterns are literals, ``\\xHH``, escaped characters, classes, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``, in ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Node = tuple


def parsed(pattern: str, caseless: bool = False) -> Node:
    """The tree of a pattern: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)."""
    at = 0

    def peek() -> str:
        return pattern[at : at + 1]

    def character() -> int:
        nonlocal at
        c, at = pattern[at], at + 1
        if c == "\\":
            c, at = pattern[at], at + 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
            if c.isalnum():
                raise ValueError(f"no such escape: \\{c}")
        return ord(c)

    def widened(codes: set[int]) -> Node:
        if not max(codes, default=0) < 128:
            raise ValueError("patterns are ASCII")
        if caseless:
            codes = codes | {ord(f(chr(c))) for c in codes for f in (str.lower, str.upper)}
        return ("set", frozenset(codes))

    def one_of() -> Node:
        nonlocal at
        codes: set[int] = set()
        negated = peek() == "^"
        at += negated
        while peek() != "]":
            first = last = character()
            if peek() == "-" and pattern[at + 1] != "]":
                at += 1
                last = character()
            codes |= set(range(first, last + 1))
        at += 1
        node = widened(codes)
        return ("set", frozenset(range(256)) - node[1]) if negated else node

    def atom() -> Node:
        nonlocal at
        if peek() == "(":
            at += 1
            node = either()
            at += 1
            return node
        if peek() == "[":
            at += 1
            return one_of()
        return widened({character()})

    def repeated() -> Node:
        nonlocal at
        node = atom()
        while (c := peek()) and c in "?*+{":
            at += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                least, most, at = int(low), int(high) if high else None if comma else int(low), end + 1
            node = ("rep", node, least, most)
        return node

    def row() -> Node:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def either() -> Node:
        nonlocal at
        parts = [row()]
        while peek() == "|":
            at += 1
            parts.append(row())
        return ("alt", parts)

    node = either()
    if at < len(pattern):
        raise ValueError(f"unbalanced at {at}: {pattern}")
    return node


class Positions:
    """The byte set of each position, and the positions that may follow it."""

    def __init__(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def add(self, node: Node) -> tuple[bool, set[int], set[int]]:
        """Whether the part may be empty, and its first and last positions."""
        kind, body = node[:2]
        if kind == "set":
            self.sets.append(body)
            self.follow.append(set())
            return False, {len(self.sets) - 1}, {len(self.sets) - 1}
        if kind == "alt":
            parts = [self.add(p) for p in body]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind == "cat":
            return self._row([self.add(p) for p in body])
        _, _, least, most = node
        needed = [self.add(body) for _ in range(least)]
        if most is None:
            empty, first, last = needed.pop() if needed else (True, *self.add(body)[1:])
            for p in last:
                self.follow[p] |= first
            return self._row([*needed, (empty, first, last)])
        return self._row([*needed, *((True, *self.add(body)[1:]) for _ in range(most - least))])

    def _row(self, parts: list[tuple[bool, set[int], set[int]]]) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for e, f, l in parts:
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
        return empty, first, last


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte]`` is the next state; ``accepts[state]`` has bit k for pattern k. State 0 is the start.
    ``dead`` is the state from which nothing is accepted, or -1."""

    table: np.ndarray
    accepts: np.ndarray
    dead: int


def compiled(nodes: list[Node], everywhere: bool) -> Automaton:
    """The minimal automaton of all patterns (32 at most): of texts that end with a match if ``everywhere``, else of whole matches.
    The start accepts nothing: an empty match is none."""
    if len(nodes) > 32:
        raise ValueError("32 patterns at most go into one automaton")
    positions, firsts, lasts = Positions(), set(), []
    for node in nodes:
        _, first, last = positions.add(node)
        firsts |= first
        lasts.append(last)
    # Bytes that all sets treat alike are one column.
    member = np.array([[b in s for s in positions.sets] for b in range(256)], bool).reshape(256, -1)
    rows, column = np.unique(member, axis=0, return_inverse=True)
    holds = [{int(p) for p in np.flatnonzero(r)} for r in rows]
    begin, numbers, todo, table = object(), {}, [], []

    def number(state: object) -> int:
        if state not in numbers:
            numbers[state] = len(numbers)
            todo.append(state)
        return numbers[state]

    number(begin)
    for state in todo:
        after = firsts if state is begin else set().union(*(positions.follow[p] for p in state))
        if everywhere:
            after = after | firsts
        table.append([number(frozenset(after & h)) for h in holds])
    accepts = np.array([0 if s is begin else sum(1 << k for k, last in enumerate(lasts) if last & s) for s in numbers], np.uint32)
    return minimal(np.array(table, np.int32), accepts, column.ravel())


def minimal(table: np.ndarray, accepts: np.ndarray, column: np.ndarray) -> Automaton:
    """States that no rest of a text tells apart are merged, by refining the partition by what is accepted until it holds."""
    label = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        refined = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)[1].ravel()
        if refined.max() == label.max():
            break
        label = refined
    _, one = np.unique(label, return_index=True)
    order = np.argsort(one != one[label[0]], kind="stable")  # the start comes first
    place = np.empty(len(one), np.int32)
    place[order] = np.arange(len(one))
    small, accepting = place[label[table[one[order]]]], accepts[one[order]]
    stuck = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (accepting == 0))
    return Automaton(np.ascontiguousarray(small[:, column]), accepting, int(stuck[0]) if len(stuck) else -1)
