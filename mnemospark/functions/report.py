"""Column functions of the activity reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug

# What a harness's name contains, in the order of the tests; and the phases' key words.
HARNESS_MARKS = [("claude", "claude-code"), ("openclaw", "openclaw"), ("hermes", "hermes"), ("codex", "codex"), ("cursor", "cursor"), ("opencode", "opencode"), ("windsurf", "windsurf")]
PHASES = [
    ("plan", "plan|design|spec"), ("review", "review|audit|security"), ("qa", "test|qa|verify|benchmark"), ("ship", "ship|deploy|release"),
    ("debug", "debug|investigate|failure"), ("memory", "reflect|memory|learn|dream"),
]


def _ladder(cases: list[tuple[Column, str]], other: Column) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(other)


def harness(value: Column) -> Column:
    key = slug(value)
    cases = [(key.contains(mark), name) for mark, name in HARNESS_MARKS] + [(key.isin("pi", "pi_coding_agent"), "pi"), (key.contains("antigravity"), "antigravity")]
    return _ladder(cases, key)


def phase(action: Column, skill: Column) -> Column:
    key = F.lower(F.concat_ws(" ", action, skill))
    return _ladder([(key.rlike(words), name) for name, words in PHASES], F.lit("analysis"))


def workflow(action: Column, skill: Column) -> Column:
    found = phase(action, skill)
    return F.when(found != "analysis", found).otherwise(slug(F.coalesce(F.nullif(skill, F.lit("")), action), "analysis"))


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC with microseconds, unless they are zero."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.000000Z$", "Z")


def bucket(ts: Column, size: str) -> Column:
    """Start of the hour, day, week (from Monday) or month; null is ``unknown``."""
    return F.coalesce(F.date_format(F.date_trunc(size, ts), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("unknown"))


def hashed_id(value: Column) -> Column:
    return F.substring(F.sha2(F.nullif(value, F.lit("")), 256), 1, 16)


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.85, "0.85+").when(score >= 0.70, "0.70-0.85").when(score >= 0.50, "0.50-0.70").otherwise("<0.50")


def compact(value: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1.2k, whole numbers plain, others with two digits at most; null as n/a."""
    fixed = lambda x, digits: F.format_string(f"%.{digits}f", x)
    size = F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(fixed(value, 2), "0+$", ""), r"\.$", "")
    return F.when(value.isNull() | F.isnan(value), "n/a").when(size >= 1e6, F.concat(fixed(value / 1e6, 1), F.lit("M"))).when(size >= 1e3, F.concat(fixed(value / 1e3, 1), F.lit("k"))).when(value == F.floor(value), F.floor(value).cast("string")).otherwise(plain)


def bar(value: Column, most: Column, width: int = 18) -> Column:
    share = F.when(most > 0, F.bround(F.coalesce(value, F.lit(0.0)) / most * width)).otherwise(0)
    filled = F.greatest(F.lit(0), F.least(F.lit(width), share.cast("int")))
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled))
