import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.llm import common, langid, licences, lm, media, quality, queries

from .helpers import ODD, docs, words


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_streams_give_back_their_payload(data):
    payload = media.padded(data)
    ts = media.mux(payload)
    s = media.demux(ts)
    units = -(-len(payload) // media.ACCESS_BYTES)
    assert s.payload == payload and len(payload) % media.UNIT == 0 and len(payload) >= max(len(data), media.UNIT)
    assert s.stamps == [k * media.TICKS for k in range(units)]
    assert [t for _, t in s.access] == [k * media.TICKS for k in range(0, units, media.ACCESS_EVERY)]
    for number, _ in s.access:  # a reader can start at such a packet
        assert ts[188 * number] == 0x47 and ts[188 * number + 5] & 0x40


def test_large_time_stamps():
    assert media._stamp(0x1FFFFFFFF) == bytes([0x2F, 0xFF, 0xFF, 0xFF, 0xFF]) and media._stamp(0) == bytes([0x21, 0, 1, 0, 1])


@pytest.mark.parametrize("damage, kind", [(lambda b: b[:188] + b"\0" + b[189:], "sync"), (lambda b: b[: 188 * 3] + b[188 * 4 :], "continuity"), (lambda b: b[:10] + bytes([b[10] ^ 1]) + b[11:], "table"), (lambda b: b[:-1], "cut")])
def test_damaged_streams_are_found(damage, kind):
    good = media.mux(media.padded(b"x" * 5000))
    assert media.demux(good).faults == []
    assert kind in [what for _, what in media.demux(damage(good)).faults]


@pytest.mark.parametrize("extra", [False, True])
def test_media_odd_rows(spark, extra):
    got = media.read_media(media.write_media(docs(spark, ODD, extra))).collect()
    assert len(got) == len(ODD)
    texts = {k: t for k, t in ODD}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = media.padded(data)
        ts = media.mux(payload)
        assert r[1:7] == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(ts), hashlib.sha256(ts).hexdigest()) and r.faults == ""
    assert media.read_media(media.write_media(docs(spark, []))).count() == 0


def test_op7_over_the_whole_table(spark, sf):
    got = {r.doc_id: r for r in queries.op7_transport_stream(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        payload = media.padded(r.text.encode())
        assert got[r.doc_id].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[r.doc_id].n_bytes == len(r.text.encode())


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_op8_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in got.items())
    held = [(got[d].score, y) for d, y in labels.items() if got[d].held_out]
    assert auc(held) > 0.85
    assert sum((s >= 0.3) == bool(y) for s, y in held) / len(held) > 0.85


def test_quality_never_sees_held_out_labels(spark):
    rows = [(k, "good plain words here" if k % 2 else "BAD!! ### $$$") for k in range(200)]
    table = docs(spark, rows)
    labels = [(k, k % 2) for k in range(200)]
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    fits = [quality.train(table, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned)]
    assert np.array_equal(fits[0].weights, fits[1].weights) and fits[0].cut == fits[1].cut


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (6, 1), (6, 0), (8, 0), (9, None), (None, 1), (10, 1), (11, 0)], "doc_id long, quality int")
    table = docs(spark, ODD, extra=True)
    rows = quality.score_documents(table, quality.train(table, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    none = quality.train(table, labels.limit(0))
    assert len({r.score for r in quality.score_documents(table, none).collect()}) == 1
    assert quality.score_documents(docs(spark, []), none).count() == 0


def brute_base(rows, folds=7, hold=2):
    held = {k: k is not None and zlib.crc32(str(k).encode()) % folds == hold for k, _ in rows}
    count = Counter(w for k, t in rows if not held[k] for w in [*words(t), ""])
    n, v = sum(count.values()), len(count)
    out = []
    for k, t in rows:
        w = [*words(t), ""]
        out.append((k, held[k], len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    return out


def same_base(got, want):
    def order(r):
        return (r[0] is None, r[0] or 0, r[2], r[5])

    assert len(got) == len(want)
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=order), sorted(want, key=order)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("head", [4, 1000])
def test_lm_odd_rows(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = lm.score_documents(docs(spark, ODD, extra=True)).collect()
    same_base(rows, brute_base(ODD))
    assert all(r.score < 0 and (r.bits_per_byte is None) == (not dict(ODD)[r.doc_id]) for r in rows)
    assert lm.score_documents(docs(spark, [])).count() == 0


def test_lm_without_training_rows(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:5]
    rows = lm.score_documents(docs(spark, [(k, "some words") for k in held])).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)


def test_op9_base_over_the_whole_table_and_held_out_gain(spark, sf):
    rows = queries.op9_context_mixing(spark, sf).collect()
    same_base(rows, brute_base([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]))
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


START = np.tile(np.array(lm.WEIGHTS, np.float32), (lm.GATES, 1))


def test_mixing_is_a_probability_distribution():
    """Over all sequences of one token and the end, the probabilities sum to one."""
    code = lm.huffman([b"", b"a", b"bb", b"c"], [10, 6, 3, 1], 2)
    assert lm.huffman([b"", b"a", b"bb", b"c"], [10, 6, 3, 1], 2).node.tolist() == code.node.tolist()
    rng = np.random.default_rng(1)
    tables = rng.integers(0, 30, (lm.CONTEXTS, 1 << lm.TABLE_BITS, 2)).astype(np.float32)
    total = 0.0
    for text in ("", "a", "bb", "c", "zzz"):  # zzz: any other token
        raw, at = common.utf8(pa.array([f"a {text}"]))
        s = lm.Slice(code, raw, at)
        bits, _ = lm.mix(s, code, tables, START)
        total += np.exp(bits[s.token == 1].sum())  # the token after "a"; the end for ""
    assert total == pytest.approx(1.0, abs=1e-4)


def test_slices_do_not_depend_on_each_other():
    code = lm.huffman([b"", b"a", b"b", b"c"], [10, 6, 3, 1], 2)
    tables = np.random.default_rng(2).integers(0, 30, (lm.CONTEXTS, 1 << lm.TABLE_BITS, 2)).astype(np.float32)
    texts = ["a b c", "", "b b a q r s t a", "c"]
    alone, segments = [], []
    for t in texts:
        raw, at = common.utf8(pa.array([t]))
        s = lm.Slice(code, raw, at)
        bits, _ = lm.mix(s, code, tables, START)
        alone.append(bits.sum())
        segments.append(s.segments(bits))
    raw, at = common.utf8(pa.array(texts))
    s = lm.Slice(code, raw, at)
    bits, _ = lm.mix(s, code, tables, START)
    assert np.bincount(s.text[s.token], bits) == pytest.approx(np.array(alone), rel=1e-5)
    keys, values, edge = s.segments(bits)
    assert keys.tolist() == [k for x, _, _ in segments for k in x.tolist()]
    assert np.add.reduceat(values, edge[:-1]) == pytest.approx(np.array(alone), rel=1e-5)


def test_huffman_code_is_complete_and_near_the_entropy():
    counts = [50, 30, 10, 5, 3, 1]
    code = lm.huffman([b"", *(bytes([97 + k]) for k in range(5))], counts, 1)
    lengths = np.diff(code.first)
    assert sum(2.0 ** -lengths) == pytest.approx(1)
    p = np.array([*counts, 1]) / 100
    assert (p * lengths).sum() < -(p * np.log2(p)).sum() + 1


def test_op10_over_the_whole_table(spark, sf):
    rows = {r.doc_id: r for r in queries.op10_language(spark, sf).collect()}
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(table)
    assert sum(rows[r.doc_id].text_language == r.lang for r in table) / len(table) > 0.97
    assert sum(rows[r.doc_id].accepted for r in table) / len(table) > 0.99


def test_pages_use_markup_suffix_and_host(spark, sf):
    pages = spark.createDataFrame([(1, "https://u:p@a.b.example.de:80/x?y#z", '<html class=x LANG="fr"><script>the</script><p>x'), (2, None, None), (3, "ftp://host", "")], "page_id long, url string, html string")
    rows = {r.id: r for r in langid.page_rows(pages).collect()}
    assert (rows[1].host, rows[1].suffix, rows[1].domain, rows[1].declared, rows[1].text.strip()) == ("a.b.example.de", "de", "example.de", "fr", "x")
    assert rows[2].host is None and rows[2].suffix is None and rows[3].declared is None
    got = queries.language_of_pages(spark, sf).collect()
    declared = {r.id: r.declared for r in langid.page_rows(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert sum(declared[r.page_id] == r.language for r in got) / len(got) > 0.9


def test_evidence_is_fused_as_by_hand(spark):
    names, table = ["de", "en"], np.log(np.array([[0.7 / langid.BUCKETS] * langid.BUCKETS, [1.0 / langid.BUCKETS] * langid.BUCKETS]))
    rows = [(k, "abc", "en", None, "h1", "d") for k in range(3)] + [(8, "", "de", "de", "h1", "d"), (9, None, None, None, None, None), (10, "123 !", "xx", None, "new", "d")]
    got = {r.id: r for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string"), names, table).collect()}
    whole = np.array([1, 4]) / 5
    domain = (np.array([0, 3]) + langid.SMOOTHING * whole) / (3 + langid.SMOOTHING)
    host = (np.array([0, 3]) + langid.SMOOTHING * domain) / (3 + langid.SMOOTHING)
    text = np.array([0.7, 1.0]) * np.array([0.1, 0.9]) * host
    assert got[0].posterior == pytest.approx(text[1] / text.sum()) and got[0].language == "en" and got[0].accepted
    text = np.array([0.9, 0.1]) * np.array([0.8, 0.2]) * host
    assert got[8].posterior == pytest.approx(text.max() / text.sum()) and not got[8].accepted and got[8].text_language is None
    assert got[9].posterior == pytest.approx(whole[1]) and got[9].language == "en" and not got[9].accepted
    assert got[10].posterior == pytest.approx(whole[1])


def test_language_odd_rows(spark):
    rows = langid.document_rows(docs(spark, [(*r, "en" if k % 2 else None, None if k % 3 else "s1") for k, r in enumerate(ODD)], extra=True))
    got = langid.identify(rows, *langid.learn(rows)).collect()
    assert len(got) == len(ODD)
    empty = langid.document_rows(docs(spark, []))
    assert langid.identify(empty, *langid.learn(empty)).count() == 0
    assert {r.accepted for r in langid.identify(rows, *langid.learn(empty)).collect()} == {False}


def test_licences_and_inheritance(spark):
    files = [
        (1, "a/LICENSE", "MIT License\n\nReleased under the MIT License.\n"), (2, "a/x.py", "print()"), (3, "a/b/c/y.py", "import z"), (4, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
        (5, "a/q.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), (6, "z/w.py", None), (7, None, "x"), (8, "top.py", ""), (8, "top.py", ""), (9, "a/b/z.py", "text\n" * 3000),
        (None, "a/n.py", "null id"), (10, "a/LICENSE.md", "unrelated words only"),
    ]
    got = licences.scan(spark.createDataFrame(files, "id long, path string, text string").selectExpr("*", "1 as k1", "2 as depth", "'x' as dir"))
    by = {r.id: (r.licence, r.origin, r.directory) for r in got.collect()}
    assert got.count() == len(files)
    assert by == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "inherited", "a/b"), 4: ("Apache-2.0", "own", None), 5: ("GPL-3.0", "own", None), 6: (None, "none", None),
        7: (None, "none", None), 8: (None, "none", None), 9: ("Apache-2.0", "inherited", "a/b"), None: ("MIT", "inherited", "a"), 10: ("MIT", "inherited", "a"),
    }
    assert licences.scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


def test_cosine_is_that_of_tf_idf(spark):
    templates = [("A", "alpha beta beta"), ("B", "gamma delta")]
    rows = [(1, "p", "Alpha, beta other"), (2, "q", "gamma delta\nalpha"), (3, "r", "gamma")]
    got = {r.id: r for r in licences.scan(spark.createDataFrame(rows, "id long, path string, text string"), templates=templates).collect()}
    idf = {w: math.log(4 / (1 + n)) + 1 for w, n in {"alpha": 2, "beta": 1, "gamma": 2, "delta": 1}.items()}
    mean = sum(idf.values()) / 4
    dot = idf["alpha"] ** 2 + 2 * idf["beta"] ** 2
    want = dot / math.sqrt(idf["alpha"] ** 2 + 4 * idf["beta"] ** 2) / math.sqrt(idf["alpha"] ** 2 + idf["beta"] ** 2 + mean**2)
    whole = licences.scan(spark.createDataFrame(rows, "id long, path string, text string"), templates=templates, threshold=1.1).where("id = 1").first()
    assert whole.cosine == pytest.approx(want) and whole.scope is None
    # A block may be shorter than the template: here "alpha beta".
    assert got[1].cosine == pytest.approx(dot / math.sqrt(idf["alpha"] ** 2 + 4 * idf["beta"] ** 2) / math.sqrt(idf["alpha"] ** 2 + idf["beta"] ** 2))
    assert got[2].cosine == pytest.approx(1) and got[2].licence == "B" and got[2].scope == "block"


def test_op2_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_licences(spark, sf).collect()
    notices = ("Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.")
    want = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(x in notices for x in r.text.split("\n"))}
    assert {r.doc_id for r in rows if r.origin == "own"} == want and len(rows) == 1000
