"""Checks of a memory's references: wiki links, paths, local links, drift between two trees."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Links and paths in text.
WIKI, MD_LINK, TICKS = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", r"(?<!!)\[[^\]]*\]\(([^)]+)\)", r"`([^`]+)`"
ABSOLUTE = r"^(/|~/)[^\s]"
PLACEHOLDER = r"[<>{}$*]|\.\.\.|…|\bpath/to\b|example"


def link_key(target: Column, whole: bool = False) -> Column:
    """A link's key: lower case, blanks as dashes, other marks gone; unless ``whole`` without heading and extension."""
    if not whole:
        target = F.regexp_replace(F.trim(F.regexp_replace(target, r"[#^].*$", "")), r"(?i)\.(md|markdown)$", "")
    dashed = F.regexp_replace(F.lower(F.trim(target)), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, r"[^a-z0-9_\-./]", ""), r"^[-/]+|[-/]+$", "")


def lines(docs: DataFrame) -> DataFrame:
    """(file, line, text) of documents (file, body)."""
    plain = F.regexp_replace("body", r"\r\n?", "\n")
    return docs.select("file", F.posexplode(F.split(plain, "\n")).alias("k", "text")).select("file", (F.col("k") + 1).cast("long").alias("line"), "text")


def wiki_links(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Links (file, line, detail) whose key, with and without heading, is none of the known (name): two anti joins."""
    keys = known.select(link_key(F.col("name"), True).alias("key")).distinct()
    each = lines(docs).select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(WIKI), F.lit(1))).alias("target")).where((F.trim("target") != "") & ~F.col("target").rlike(PLACEHOLDER))
    each = each.select("file", "line", F.trim("target").alias("detail"), link_key(F.col("target")).alias("k1"), link_key(F.col("target"), True).alias("k2"))
    return each.join(keys, each["k1"] == keys["key"], "left_anti").join(keys, F.col("k2") == keys["key"], "left_anti").select("file", "line", F.lit("dead_wikilink").alias("kind"), "detail")


def path_candidates(span: str) -> list[str]:
    """Paths in a span of code: the whole span if it is one, else quoted and bare ones."""
    bare = re.sub(r"\s*\([^)]*\)\s*$", "", span.strip()).rstrip(".,;:) ")
    if re.match(ABSOLUTE, bare):
        return [bare]
    found: list[str] = []

    def take(m: re.Match[str]) -> str:
        quoted = (m[1] if m[1] is not None else m[2]).strip().rstrip(".,;:) ")
        if re.match(ABSOLUTE, quoted):
            found.append(quoted)
            return " " * len(m[0])
        return m[0]

    rest = re.sub(r'"([^"]*)"|\'([^\']*)\'', take, span)
    found += [t.rstrip(".,;:)\"'") for t in re.findall(r"(?:(?<=\s)|^)(?:/|~/)[^\s\"']+", rest)]
    return list(dict.fromkeys(f for f in found if f))


@pandas_udf(T.ArrayType(T.StringType()))
def candidates(spans: pd.Series) -> pd.Series:
    return spans.map(lambda s: path_candidates(s or ""))


def dead_paths(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """Absolute paths in code spans, and local links, that are not in the listing (path). Line references are cut off."""
    text = lines(docs)
    spans = text.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(TICKS), F.lit(1))).alias("span")).select("file", "line", F.lit("dead_path").alias("kind"), F.explode(candidates("span")).alias("detail"))
    links = text.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(MD_LINK), F.lit(1))).alias("t")).where(~F.trim("t").rlike(r"^(https?://|mailto:|#)"))
    local = links.select("file", "line", F.lit("broken_local_link").alias("kind"), F.url_decode(F.trim(F.regexp_replace("t", "#.*$", ""))).alias("detail")).where(F.col("detail").rlike(ABSOLUTE))
    both = spans.union(local).where(~F.col("detail").rlike(PLACEHOLDER)).withColumn("path", F.regexp_replace("detail", r":\d+(-\d+)?$", "")).dropDuplicates(["file", "line", "path"])
    return both.join(listing.select("path"), "path", "left_anti").select("file", "line", "kind", F.col("path").alias("detail"))


def drift(repo: DataFrame, live: DataFrame, unchecked: str = "memory") -> DataFrame:
    """(area, path, status) of files that are missing, stale or extra; extras below ``unchecked`` are the user's own."""
    a = repo.select("area", "path", F.col("sha").alias("want"))
    b = live.select("area", "path", F.col("sha").alias("have"))
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), F.when(F.col("area") != unchecked, "extra")).when(F.col("want") != F.col("have"), "stale")
    return a.join(b, ["area", "path"], "full_outer").withColumn("status", status).where("status is not null").select("area", "path", "status")
