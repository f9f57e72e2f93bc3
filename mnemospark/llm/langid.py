"""Language identification by Bayesian fusion of evidence.

The log posterior of a language is the sum of
- the text's log likelihood under hashed byte trigrams, scaled to at most ``TEXT_TRIGRAMS`` trigrams, as neighbouring
  trigrams are not independent,
- the log likelihood of the declared language (a markup attribute or a metadata column),
- the log likelihood of the address suffix,
- the log prior of its host, smoothed by that of the host's domain, and that by the
  prior of the whole corpus. These are counts of what the text says alone, by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
#: Rows of each declared language from which its trigram frequencies are learned at most: those whose ids hash lowest.
SAMPLE = 8000
TEXT_TRIGRAMS = 60
#: Languages at most: those of most rows. The table of trigrams is languages x buckets, 67 MB at this bound.
LANGUAGES = 256
#: Pseudo-counts of the parent's prior; chance that a declaration or a suffix is right; least posterior of what is accepted.
SMOOTHING, DECLARED, SUFFIX, ACCEPT = 20.0, 0.9, 0.8, 0.5
# Address suffixes of countries with one main language.
SUFFIXES = {"de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
# Names of languages, as they stand where a tag should.
NAMES = {"english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "spanish": "es", "español": "es", "italian": "it", "italiano": "it", "portuguese": "pt", "português": "pt", "dutch": "nl", "nederlands": "nl", "polish": "pl", "polski": "pl"}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigram_codes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram of letters and blanks (all else is a blank) with two letters at least, and the text it is in."""
    low = common.LOWER[raw]
    letter = _LETTER.take(low)
    low = np.where(letter, low, 32).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(17)
    use = (text[2:] == text[:-2]) & (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2)
    return code[use].astype(np.int64), text[2:][use]


def lettered(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    upto = np.concatenate([[0], np.cumsum(_LETTER.take(raw))])
    return upto[at[1:]] > upto[at[:-1]]


def primary_tag(tag: Column) -> Column:
    """The language of a tag such as ``en-US`` or ``en_gb``, or of a language's name; null for anything else."""
    low = F.lower(F.trim(tag.cast("string")))
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, low), F.nullif(F.regexp_extract(low, r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit("")))


def lowest_of_each(rows: DataFrame, n: int) -> DataFrame:
    """Of the distinct rows (id, declared), for each language the ``n`` whose ids hash lowest. Languages are counted over all
    rows first, so that rows which cannot be among them go before any are sorted."""
    space = 1 << 40
    place = F.pmod(F.xxhash64("id"), F.lit(space))
    sizes = rows.groupBy("declared").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "declared").limit(LANGUAGES)
    bound = F.lit(space * (1.5 * n + 10 * n**0.5 + 20)) / F.col("__n")  # fewer than n below it: beyond ten deviations
    near = rows.join(F.broadcast(sizes), "declared").where((F.col("__n") <= n) | (place < bound))
    rank = F.row_number().over(Window.partitionBy("declared").orderBy(place, "id"))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= n).select("id", "declared")


def learn(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log frequency of each bucket, from rows (id, text, declared).

    Languages are those declared in any row, if need be the ``LANGUAGES`` of most rows; one without a trigram in its sample is left out, as it has no frequencies.
    """
    common.small_batches(rows.sparkSession)
    rows = rows.where("declared is not null and id is not null")
    ids = lowest_of_each(common.written(rows.select("id", "declared").distinct()), sample)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, raw, at in common.slices(batch, limit=1 << 20):
                code, text = trigram_codes(raw, at)
                names = np.array(part.column(1).to_pylist(), dtype=object)
                for name in set(names.tolist()):
                    counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    counts[name] += np.bincount(code[(names == name)[text]], minlength=BUCKETS)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["declared", "bucket", "n"])

    some = rows.join(F.broadcast(ids), ["id", "declared"]).select("text", "declared")
    found = some.mapInArrow(common.lean(task), "declared string, bucket long, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["declared"] for r in found})
    counts = np.full((len(names), BUCKETS), 0.5)
    for r in found:
        counts[names.index(r["declared"]), r["bucket"]] += r["n"]
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts


def text_evidence(rows: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` (id, text, declared, suffix, host, domain, __k1, __k2) with ``ll``, the text's log likelihoods, for text."""
    weights = table.T.astype(np.float64).copy()
    fields = "id long, declared string, suffix string, host string, domain string, __k1 long, __k2 long, ll array<double>, n_trigrams long, lettered boolean"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch, limit=1 << 20):
                code, text = trigram_codes(raw, at)
                n = np.bincount(text, minlength=len(part))
                ll = np.stack([np.bincount(text, weights[code, k], minlength=len(part)) for k in range(len(names))], axis=1).astype(float)
                ll *= np.minimum(1, TEXT_TRIGRAMS / np.maximum(n, 1))[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(names), pa.int32()), pa.array(ll.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(7)] + [lists, pa.array(n.astype(np.int64)), pa.array(lettered(raw, at))], names=[x.split()[0] for x in fields.split(", ")])

    return rows.select("id", "declared", "suffix", "host", "domain", "__k1", "__k2", "text").mapInArrow(common.lean(task), fields)


def _argmax(scores: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(scores, F.array_max(scores)).cast("int"))


def identify(rows: DataFrame, names: list[str], table: np.ndarray, accept: float = ACCEPT) -> DataFrame:
    """id, language, posterior, text_language, accepted, and the row's key, for rows (id, text, declared, suffix, host, domain).

    Null declarations, suffixes and hosts are no evidence (a null host has the corpus prior). Null, empty and
    letterless texts go by the other evidence and are not accepted; texts too short for a trigram go by it and may be.
    Repeated rows are identified, and counted for their host, as often as they come. A tie goes to the language that sorts first. With no declared row at all there are no languages, and nothing is accepted.
    """
    keyed = rows.select("id", common.text_of("text").alias("text"), "declared", "suffix", "host", "domain", *common.row_key("id", common.text_of("text")))
    if not names:
        return keyed.select("id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"), "__k1", "__k2")
    known = common.written(text_evidence(keyed, names, table).withColumn("text_language", F.when(F.col("n_trigrams") > 0, _argmax(F.col("ll"), names))))
    counted = known.where("text_language is not null").groupBy("domain", "host", "text_language").agg(F.count(F.lit(1)).alias("n"))
    wide = common.written(counted.groupBy("domain", "host").agg(*[F.sum(F.when(F.col("text_language") == x, F.col("n")).otherwise(0)).cast("double").alias(f"c{k}") for k, x in enumerate(names)]))
    cs = [f"c{k}" for k in range(len(names))]
    total = wide.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cs]).first()
    whole = [(total[c] + 1) / (sum(total) + len(names)) for c in cs]
    domains = wide.groupBy("domain").agg(*[F.sum(c).alias(f"d{k}") for k, c in enumerate(cs)])
    d_sum = sum((F.col(f"d{k}") for k in range(len(cs))), F.lit(0.0))
    domains = domains.select(F.col("domain").alias("__domain"), *[((F.col(f"d{k}") + SMOOTHING * whole[k]) / (d_sum + SMOOTHING)).alias(f"p{k}") for k in range(len(cs))])
    c_sum = sum((F.col(c) for c in cs), F.lit(0.0))
    hosts = wide.where("host is not null").join(domains, F.col("domain").eqNullSafe(F.col("__domain"))).select(
        "__domain", F.col("host").alias("__host"), F.array(*[F.log((F.col(c) + SMOOTHING * F.col(f"p{k}")) / (c_sum + SMOOTHING)) for k, c in enumerate(cs)]).alias("prior"))
    hosts = common.written(hosts)
    joined = known.join(hosts, (F.col("host") == F.col("__host")) & F.col("domain").eqNullSafe(F.col("__domain")), "left")
    others = max(1, len(names) - 1)

    def told(column: str, right: float, k: int) -> Column:
        c = F.col(column)
        return F.when(c.isin(names), F.when(c == names[k], np.log(right)).otherwise(np.log((1 - right) / others))).otherwise(0.0)

    post = F.array(*[F.element_at("ll", k + 1) + told("declared", DECLARED, k) + told("suffix", SUFFIX, k) + F.coalesce(F.element_at("prior", k + 1), F.lit(float(np.log(whole[k])))) for k in range(len(names))])
    best = F.array_max("post")
    share = 1 / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    out = joined.withColumn("post", post).withColumn("posterior", share)
    return out.select("id", _argmax(F.col("post"), names).alias("language"), "posterior", "text_language", ((F.col("posterior") >= accept) & F.col("lettered")).alias("accepted"), "__k1", "__k2")


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of a corpus table: ``lang`` is declared, ``source`` is the host."""
    host = F.col("source").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), primary_tag(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), host.alias("host"), F.regexp_replace(host, r"\d+$", "").alias("domain"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of raw web pages: the html element's lang, the address's suffix, host and domain."""
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    top = F.element_at(F.split(host, r"\."), -1)
    pairs = [F.lit(x) for kv in SUFFIXES.items() for x in kv]
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = primary_tag(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z_-]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("id"), body.alias("text"), declared.alias("declared"), F.try_element_at(F.create_map(*pairs), top).alias("suffix"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))
