"""Secrets in texts: all rules as one deterministic automaton, in one pass over the bytes.

A rule is a head, a byte class that follows it (the tail), and the least bytes of the tail. The heads with a tail
of all rules are compiled into one minimal automaton, whose transition array is walked once over all bytes, in lanes side by side: bytes
after which it is at its start from whatever state ("quiet" bytes) cannot lie in a match, so lanes may begin behind them.
Most lanes accept nothing and are done. Of the others, the rules that were accepted find their matches by the
automaton of their head, from left to right, each from where the one before has ended; then short tails are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .automaton import Automaton, compiled, parsed


@dataclass(frozen=True)
class Rule:
    """A match is a head and all tail bytes behind it, one at least, at the leftmost place that is not in the match before. Of
    several ends of the head it is the last that a tail byte follows. It counts if the tail has ``least`` bytes."""

    kind: str
    head: str
    tail: str
    least: int
    caseless: bool = False


#: The base rules, in the order in which spans of equal starts are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, caseless=True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
#: Shapes of keys that public services hand out, logins and private keys.
RULES = BASE + (
    Rule("github", "gh[opsur]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abeprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("npm", "npm_", "[A-Za-z0-9]", 36),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
    Rule("bearer", r"bearer\x20+", "[A-Za-z0-9._~+/=-]", 20, caseless=True),
    Rule("private", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY", "-", 5),
)
#: Tail bytes of a rule without a head that the automaton counts; more are counted where a match is found.
PROBE = 8
#: Bytes of a lane, about; fewer lanes than this are walked one by one.
LANE, FEW = 256, 24


class Scanner:
    """The automaton of some rules, and how their matches are found."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        tails = [parsed(r.tail, r.caseless) for r in rules]
        probes = [("cat", [parsed(r.head, r.caseless), ("rep", tail, 1 if r.head else min(r.least, PROBE), None)]) for r, tail in zip(rules, tails)]
        every = compiled(probes, everywhere=True)
        self.table = (every.table.astype(np.int32) << 8).ravel()  # states times 256, so that a byte is added to look one up
        self.accepts = every.accepts
        self.quiet = (every.table == 0).all(axis=0)
        self.heads: list[Automaton | None] = [compiled([parsed(r.head, r.caseless)], everywhere=False) if r.head else None for r in rules]
        self.tails = [frozenset(parsed(r.tail, r.caseless)[1][0][1][0][1]) for r in rules]
        self._rows: list[list[list[int]] | None] = [h.table.tolist() if h else None for h in self.heads]
        self._walk: list[int] | None = None

    def lanes(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, rules as bits) of the lanes where rules were accepted. No match reaches beyond its lane."""
        ends = np.flatnonzero(self.quiet[raw]) + 1
        near = np.unique(np.searchsorted(ends, np.arange(LANE, len(raw), LANE)))
        starts = np.unique(np.concatenate([at[:-1], ends[near[near < len(ends)]]]))
        starts = starts[starts < len(raw)]
        if not len(starts):
            return
        size = np.diff(np.append(starts, len(raw)))
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")  # lanes longer than t
        state, met = np.zeros(len(size), np.int32), np.zeros(len(size), np.uint32)
        t = 0
        for t, k in enumerate(active.tolist()):
            if k < FEW:
                break
            state[:k] = self.table[state[:k] + raw[starts[:k] + t]]
            met[:k] |= self.accepts[state[:k] >> 8]
        else:
            t = int(size[0])
        if t < size[0]:
            self._walk = self._walk or self.table.tolist()
            walk, accepts = self._walk, self.accepts.tolist()
            for lane in range(int(active[t])):
                s, m = int(state[lane]), int(met[lane])
                for b in raw[starts[lane] + t : starts[lane] + size[lane]].tobytes():
                    s = walk[s + b]
                    m |= accepts[s >> 8]
                met[lane] = m
        for lane in np.flatnonzero(met):
            yield int(starts[lane]), int(starts[lane] + size[lane]), int(met[lane])

    def matches(self, rule: int, data: bytes) -> Iterator[tuple[int, int]]:
        """Start and end of what counts, from left to right."""
        rows, tail, least = self._rows[rule], self.tails[rule], self.rules[rule].least
        head, at, n = self.heads[rule], 0, len(data)
        while at < n:
            body = at if rows is None and data[at] in tail else -1
            if rows is not None:
                state, dead, accepts = rows[0][data[at]], head.dead, head.accepts
                end = at + 1
                while state != dead and end < n:
                    if accepts[state] and data[end] in tail:
                        body = end
                    state, end = rows[state][data[end]], end + 1
            if body < 0:
                at += 1
                continue
            end = body + 1
            while end < n and data[end] in tail:
                end += 1
            if end - body >= least:
                yield at, end
            at = end

    def spans(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, start, rule, end) of all texts, in order; starts and ends are code points of the text."""
        found = []
        for first, last, bits in self.lanes(raw, at):
            data = raw[first:last].tobytes()
            found += [(first + a, k, first + b) for k in range(len(self.rules)) if bits >> k & 1 for a, b in self.matches(k, data)]
        if not found:
            return []
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        start, rule, end = np.array(sorted(found)).T
        text = np.searchsorted(at, start, side="right") - 1
        zero = points[at[text]]
        return list(zip(text.tolist(), (points[start] - zero).tolist(), rule.tolist(), (points[end] - zero).tolist()))


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One for each set of rules and Python worker."""
    return Scanner(rules)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row of ``docs``: kind, start and end (exclusive) of each match in code points, by start and then by the order of rules.

    Texts are scanned whole, however long. Null and empty texts have no spans; a null id is kept; repeated rows give repeated rows; an
    empty table gives none; other columns are not read. A row is scanned where it is read, so nothing is shuffled.
    """
    common.small_batches(docs.sparkSession)
    rules = tuple(rules)
    scanner(rules)  # a pattern that is none is told here

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            for part, raw, at in common.slices(batch):
                found = scan.spans(raw, at)
                text = np.array([x[0] for x in found], np.int64)
                flat = pa.StructArray.from_arrays([pa.array([rules[x[2]].kind for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())], names=["kind", "start", "end"])
                offsets = pa.array(np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "spans"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", SPANS)])
    return docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text")).mapInArrow(common.lean(task), schema)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each document the number of matches of the base rules and the digest of their spans, and all spans in text form."""
    base = [r.kind for r in BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs, rules).select(
        F.col("id").alias("doc_id"), *map(count, base), F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
