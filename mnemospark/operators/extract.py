"""Claim extraction from observation texts, as a Python table function's pure core and its Spark surfaces."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that negate a predicate within three tokens before it; tokens of the window at each side.
NEGATIONS = ["not", "won't", "wont", "isn't", "isnt", "wasn't", "wasnt", "no longer", "wouldn't", "wouldnt", "doesn't", "doesnt", "didn't", "didnt", "shouldn't", "shouldnt", "haven't", "havent", "never"]
LOOKBEHIND, WINDOW = 3, 20


@dataclass(frozen=True)
class Predicate:
    name: str
    phrases: tuple[str, ...]
    kind: str  # date, enum, person or freeform
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    predicates: tuple[Predicate, ...] = (
        Predicate("launch-date", ("launch", "ships on"), "date"),
        Predicate("status", ("status:", "is now"), "enum", ("green", "yellow", "red", "unknown")),
        Predicate("owner", ("owner", "owned by"), "person"),
        Predicate("decision", ("decision:", "decided"), "freeform"),
    )
    projects: dict[str, list[str]] = field(default_factory=dict)
    stop: frozenset[str] = frozenset({"API", "URL", "HTTP", "JSON", "TODO", "FYI"})


def topic_keys(body: str, config: Config) -> list[str]:
    """Projects named in a text: those of the configuration, else words in capitals with digits at their end only."""
    if config.projects:
        low = body.lower()
        return [f"project:{p.lower()}" for p, names in config.projects.items() if any(re.search(rf"\b{re.escape(n.lower())}\b", low) for n in [p, *names])]
    words = re.findall(r"\b[^\W\d_a-z][^\W_a-z]+\b", body)
    fit = [w for w in words if len(w) >= 3 and w.upper() == w and w not in config.stop and re.fullmatch(r"[^\W\d_]+\d*", w)]
    return [f"project:{w.lower()}" for w in dict.fromkeys(fit)]


def value_of(predicate: Predicate, window: str, after: str) -> str | None:
    """The value in a window, in one form for each meaning."""
    if predicate.kind == "date":
        m = re.search(r"\b(\d{4})-(\d{2})-(\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?\b", window)
        try:
            return datetime.date(*map(int, m.groups())).isoformat() if m else None
        except ValueError:
            return None
    if predicate.kind == "enum":
        low = window.lower()
        return next((v for v in predicate.values if re.search(rf"\b{re.escape(v)}\b", low)), "unknown" if "unknown" in predicate.values else None)
    if predicate.kind == "person":
        m = re.search(r"@?([A-Z][a-zA-Z0-9._-]+)", after)
        return m[1].lower() if m else None
    return window.strip().lower()[:2000] or None


def extract(body: str | None, keys: list[str] = (), config: Config = Config()) -> list[tuple[str, str, str, str]]:
    """(topic, predicate, value, window) of a text: the first that is not negated for each topic and predicate."""
    body = body or ""
    topics = [*topic_keys(body, config), *keys]
    out: dict[tuple[str, str], tuple[str, str]] = {}
    for p in config.predicates if topics else ():
        places = sorted((m.start(), m.end()) for phrase in p.phrases for m in re.finditer((r"\b" if phrase[0].isalnum() else "") + re.escape(phrase) + (r"\b" if phrase[-1].isalnum() else ""), body, re.IGNORECASE))
        for start, end in places:
            before = re.findall(r"\S+", body[:start])
            near = " ".join(before[-LOOKBEHIND:]).lower()
            if any(re.search(rf"\b{re.escape(n)}\b", near) for n in NEGATIONS):
                continue
            window = " ".join(x for x in (" ".join(before[-WINDOW:]), body[start:end], " ".join(re.findall(r"\S+", body[end:])[:WINDOW])) if x)
            value = value_of(p, window, body[end : end + 200])
            for t in topics if value is not None else ():
                out.setdefault((t, p.name), (value, window))
    return [(t, p, v, w) for (t, p), (v, w) in out.items()]


SCHEMA = "event_id string, topic_key string, claim_subject string, value string, raw string"


def claims(events: DataFrame, extractor: Callable[[str | None], list[tuple[str, str, str, str]]] = extract, fallback: Callable | None = None) -> DataFrame:
    """Claims of events (event_id, body). A fallback is asked for events from which the extractor gets nothing;
    if it fails on one, that event gives no claim and the others go on."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for event, body in zip(frame["event_id"], frame["body"]):
                found = extractor(body)
                if not found and fallback is not None:
                    try:
                        found = fallback(body)
                    except Exception:  # noqa: BLE001  one event's failure is its own
                        found = []
                rows += [(event, *f) for f in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return events.select(F.col("event_id").cast("string"), "body").mapInPandas(task, SCHEMA)


def optional_keys(person: Column, channel: Column, kind: Column) -> Column:
    """Topics from optional fields; a missing one is no error."""
    return F.array_compact(F.array(F.concat(F.lit("person:"), F.lower(person)), F.concat(F.when(kind == "channel", "team:").otherwise("channel:"), F.lower(channel))))


def variants(queries: DataFrame, expand: Callable[[str], list[str]], n: int) -> DataFrame:
    """(qid, variant, query): each query and up to ``n`` paraphrases, repeats dropped; a failing provider gives none."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for qid, q in zip(frame["qid"], frame["query"]):
                try:
                    more = expand(q)[:n]
                except Exception:  # noqa: BLE001  expansion is a help, not a need
                    more = []
                seen = dict.fromkeys(x.strip().lower() for x in more if x.strip() and x.strip().lower() != q.strip().lower())
                rows += [(qid, k, v) for k, v in enumerate([q, *seen])]
            yield pd.DataFrame(rows, columns=["qid", "variant", "query"])

    return queries.select("qid", "query").mapInPandas(task, "qid long, variant int, query string")


class Registry:
    """Functions of tables by namespace; one that fails does not stop the others."""

    def __init__(self) -> None:
        self._of: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, namespace: str, run: Callable[[DataFrame], DataFrame]) -> None:
        if namespace in self._of:
            raise ValueError(f"{namespace} has a function already")
        self._of[namespace] = run

    def unregister(self, namespace: str) -> None:
        self._of.pop(namespace, None)

    def namespaces(self) -> list[str]:
        return sorted(self._of)

    def run_all(self, table: DataFrame) -> tuple[dict[str, DataFrame], dict[str, str]]:
        out, errors = {}, {}
        for name in self.namespaces():
            try:
                out[name] = self._of[name](table)
            except Exception as e:  # noqa: BLE001  namespaces are independent
                errors[name] = str(e)
        return out, errors
