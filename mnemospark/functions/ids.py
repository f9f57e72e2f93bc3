"""Content-derived identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_condition, normalized_claim

NUL = "\x00"
#: Fixed value: the namespace of URLs for version-5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
DEFAULT_ORIGIN = "coding.tool_call"


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them."""
    return F.sha2(F.concat_ws(NUL, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def claim_id(topic: Column, subject: Column, event: Column) -> Column:
    return joined_hash(topic, subject, event)


def fingerprint(topic: Column, subject: Column, value: Column) -> Column:
    return joined_hash(topic, subject, value)


def transition_id(old: Column, new: Column, kind: str, reason: str) -> Column:
    return joined_hash(old, new, F.lit(kind), F.lit(reason))


def event_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)


def content_id(text: Column) -> Column:
    return F.concat(F.lit("c-"), F.substring(F.sha2(text, 256), 1, 16))


def pattern_id(claim: Column, conditions: Column, origin: Column) -> Column:
    """Twelve digits for a claim with its conditions, whose order and spelling play no part."""
    tidy = F.array_sort(F.array_distinct(F.filter(F.transform(conditions, canonical_condition), lambda c: c != "")))
    other = F.when(F.coalesce(origin, F.lit("")).isin("", DEFAULT_ORIGIN), "").otherwise(F.concat(F.lit("||origin="), origin))
    return F.substring(F.md5(F.concat(normalized_claim(claim), F.lit("||"), F.array_join(tidy, "|"), other)), 1, 12)


def uuid5(name: Column) -> Column:
    """Version-5 UUID of a name in the namespace of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
