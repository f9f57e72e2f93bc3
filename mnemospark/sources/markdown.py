"""Markdown documents with frontmatter: scan, split, parse; tolerant block lists; repair of scalars."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.score import excluded, glob_pattern

#: Fixed value: larger frontmatter counts as malformed.
LIMIT = 256 * 1024


def discover(spark: SparkSession, root: str, include: str = "**/*.md", exclude: list[str] | None = None) -> DataFrame:
    """(path, text) of the files below ``root`` that match, but for empty and excluded ones.

    Spark lists and reads the files; links that lead out of ``root`` are not followed by its readers.
    """
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = re.escape(root.rstrip("/").split("://")[-1].removeprefix("file:"))
    rows = whole.select(F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{base}/", "").alias("path"), F.col("value").alias("text"))
    return rows.where(F.col("path").rlike(glob_pattern(include)) & ~excluded(F.col("path"), exclude or []) & (F.trim("text") != ""))


def block(text: Column) -> Column:
    """The frontmatter between the first two lines of dashes; empty if there is none."""
    return F.regexp_extract(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?s)\A---[ \t]*\n(.*?)\n?---[ \t]*(?:\n|\z)", 1)


def body(text: Column) -> Column:
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(plain, r"(?s)\A---[ \t]*\n(.*?)\n?---[ \t]*(?:\n|\z)", "")


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_yaml(blocks: pd.Series) -> pd.Series:
    """Top-level entries of a YAML mapping as text; what is no mapping, or malformed, is empty. Dates stay as written."""
    try:
        import yaml
    except ImportError:
        yaml = None

    def one(text: str | None) -> dict[str, str]:
        if not text or len(text.encode()) > LIMIT:
            return {}
        if yaml is None:
            return {k: v if isinstance(v, str) else ", ".join(v) for k, v in simple_front(text).items()}
        try:
            found = yaml.load(text, yaml.BaseLoader)
        except yaml.YAMLError:
            return {}
        return {str(k): v if isinstance(v, str) else str(v) for k, v in found.items()} if isinstance(found, dict) else {}

    return blocks.map(one)


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``frontmatter`` and ``body``. A malformed block leaves the whole text as body."""
    found = docs.withColumn("frontmatter", parse_yaml(block(F.col(text))))
    return found.withColumn("body", F.when(F.size("frontmatter") > 0, body(F.col(text))).otherwise(F.col(text)))


def title(frontmatter: Column, text: Column, path: Column) -> Column:
    """The name in the frontmatter, else the first heading, else the file's stem."""
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1)
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(F.trim(F.try_element_at(frontmatter, F.lit("name"))), F.lit("")), F.nullif(heading, F.lit("")), stem)


def simple_front(text: str) -> dict[str, str | list[str]]:
    """A tolerant reading of ``key: value``, ``key: [a, b]`` and lists of dashes below a key."""
    out: dict[str, str | list[str]] = {}
    key = None
    for line in text.split("\n"):
        if m := re.match(r"\s*-\s+(.*)$", line):
            if key is not None and out[key] in ("", []) or isinstance(out.get(key or ""), list):
                out[key] = [*(out[key] or []), m[1].strip().strip("\"'")]
        elif m := re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line):
            key, value = m[1], m[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()]
            else:
                out[key] = value.strip("\"'")
    return out


@pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def parse_simple(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda t: {k: v if isinstance(v, list) else [v] for k, v in simple_front(t or "").items()})


def yaml_safe(value: Column) -> Column:
    """A scalar as YAML reads it back: quoted where bare text would be read as something else."""
    text = F.coalesce(value, F.lit(""))
    risky = text.rlike(r"^$|^[\s\-?:,\[\]{}#&*!|>'\"%@`]|: |:$| #|^\s|\s$|\n|^(?i:true|false|null|yes|no|on|off|~)$|^[\d.+-]+$")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(risky, quoted).otherwise(text)


def index_hooks(lines: Column) -> Column:
    """Stem and hook of index lines ``- [name](path) — hook``; null for other lines and those over 4096 characters."""
    pattern = r"^-\s+\[[^\]]*\]\(([^)]+)\)\s*[—–-]+\s*(.+)$"
    path, hook = F.regexp_extract(F.trim(lines), pattern, 1), F.regexp_extract(F.trim(lines), pattern, 2)
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.when((F.length(lines) <= 4096) & (hook != ""), F.struct(stem.alias("stem"), F.substring(F.trim(hook), 1, 300).alias("hook")))


def feedback(text: Column) -> Column:
    """Claim, why and how-to-apply parts of a feedback note, whichever marker comes first."""
    why, how = r"(?im)\*\*Why:?\*\*|^Why:", r"(?im)\*\*How to apply:?\*\*|^How to apply:"
    w, h = F.regexp_instr(text, F.lit(why)), F.regexp_instr(text, F.lit(how))
    end = lambda at, p: at + F.length(F.regexp_substr(text, F.lit(p)))
    size = F.length(text) + 1
    cut = lambda a, b: F.trim(F.substring(text, a, F.greatest(F.lit(0), b - a)))
    first = F.least(F.when(w > 0, w).otherwise(size), F.when(h > 0, h).otherwise(size))
    return F.struct(
        cut(F.lit(1), first).alias("claim"), F.when(w > 0, cut(end(w, why), F.when(h > w, h).otherwise(size))).otherwise("").alias("why"), F.when(h > 0, cut(end(h, how), F.when(w > h, w).otherwise(size))).otherwise("").alias("how"),
    )


def categorize(name: Column) -> Column:
    """Route of a file by the start of its name."""
    out = F.when(name == "MEMORY.md", "index")
    for start, route in (("feedback_", "feedback"), ("user_", "user"), ("project_", "project"), ("cycle-", "cycle"), ("cycle_", "cycle"), ("reference_", "reference")):
        out = out.when(name.startswith(start), route)
    return out.otherwise("misc")


def detect_format(listing: DataFrame) -> DataFrame:
    """What produced each source (source, path): one aggregation of signals, then the first that fits."""
    some = lambda p: F.bool_or(F.col("path").rlike(p))
    s = listing.groupBy("source").agg(
        some(r"^sessions/.*rollout-[^/]*\.jsonl$").alias("rollout"), (some(r"^history\.jsonl$") & some(r"^config\.toml$")).alias("history"), some(r"^[^/]*\.plan\.md$").alias("plans"), some(r"^MEMORY\.md$").alias("index"),
        some(r"^(feedback_|user_|project_|cycle-|cycle_|reference_)[^/]*\.md$").alias("prefixed"), some(r"^(?!MEMORY\.md$)[^/]*\.md$").alias("bare"), some(r"^(personal|semantic)/").alias("dirs"),
        some(r"^(personal/(profile|notes|references)|semantic/lessons)/").alias("nested"), some(r"\.md$").alias("md"), some(r"\.jsonl$").alias("jsonl"), some(r"^\.cursorrules$").alias("rules"), F.count(F.lit(1)).alias("n"),
    )
    c = F.col
    flat = c("prefixed") | (c("index") & c("bare"))
    tag = (
        F.when(c("rules") & (c("n") == 1), "cursor-rules").when(c("rollout") | c("history"), "codex-cli").when(c("plans") & ~c("index") & ~c("prefixed") & ~c("dirs"), "cursor-plans")
        .when(flat & c("nested"), "claude-code-mixed").when(c("nested"), "claude-code-nested").when(flat, "claude-code-flat").when(c("md"), "unknown").when(c("jsonl"), "unknown").otherwise("empty")
    )
    return s.select("source", tag.alias("format"))
