import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemospark.llm import common, packing, queries, tokenfile, tokens

from .helpers import ODD, docs

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def exact(path, text, end):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab'st, .\n\t\x0b\x85\xa0　éÉñ×÷̀日12<|>endoftx", max_size=60)), max_size=6))
def test_ids_equal_whole_encoding(path, texts):
    ids, first = tokens.encoder(path).encode(*common.utf8(pa.array(texts, pa.string())), 7)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [exact(path, t, 7) for t in texts]


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 5)
    e = tokens.Encoder(BYTE)
    for text in ("a b c d", "e f g h i j k", "a b c d"):
        ids, _ = e.encode(*common.utf8(pa.array([text])), 1)
        assert ids.tolist() == exact(BYTE, text, 1)


def check_packing(pieces, lengths, capacity):
    seen = {d: [] for d in range(len(lengths))}
    fill = {}
    for d, start, n, s, offset in pieces:
        assert n > 0
        seen[d].append((start, n))
        fill.setdefault(s, []).append((offset, n))
    for d, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[d]
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return fill


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 100, 64]))
def test_pack_covers_each_token_once_in_as_few_sequences_as_possible(lengths, capacity):
    fill = check_packing(packing.pack(lengths, capacity), lengths, capacity)
    assert len(fill) == -(-sum(lengths) // capacity)


def test_pack_takes_cheapest_sequence_with_room():
    # Descending: 60 and 50 open two sequences, 40 joins the cheaper one (50), 30 the one with room.
    pieces = packing.pack([30, 60, 40, 50], 100)
    of = {d: s for d, _, _, s, _ in pieces}
    assert of[1] != of[3] and of[2] == of[3] and of[0] == of[1]


def brute_take(sequences, need):
    fit = [(cost, k) for k, (room, cost) in sequences.items() if room >= need]
    return min(fit) if fit else None


def test_open_sequences_find_the_cheapest():
    rng = random.Random(3)
    tree, plain = packing.OpenSequences(12, 50), {k: (50, 0.0) for k in range(12)}
    for _ in range(300):
        need = rng.randint(1, 30)
        got, want = tree.take(need), brute_take(plain, need)
        if want is None:
            assert got is None
            continue
        room, cost, k = got
        assert (cost, k) == want
        used = rng.randint(1, min(need, room))
        plain[k] = (room - used, cost + used)
        tree.put(room - used, cost + used, k)
        if room == used:
            del plain[k]


@pytest.mark.parametrize("extra", [False, True])
def test_pack_documents_odd_rows(spark, extra):
    rows = packing.pack_documents(docs(spark, ODD, extra), BYTE, 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for key in {k for k, _ in ODD}:
        texts = [t for k, t in ODD if k == key]
        ids = exact(BYTE, texts[0], 1)
        assert sum(r.length for r in by[key]) == len(ids) * len(texts)
        for r in by[key]:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.doc_tokens == len(ids)
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(docs(spark, []), BYTE, 1).count() == 0


def test_op1_over_the_whole_table(spark, sf):
    rows = queries.op1_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = 0
    for d, text in texts.items():
        ids, at = exact(BYTE, text, 1), 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
        total += at
    assert len({r.sequence_id for r in rows}) * 2048 - total < 2048 * 2


@pytest.mark.parametrize("extra", [False, True])
def test_token_file_odd_rows(spark, extra):
    rows = tokenfile.encode_documents(docs(spark, ODD, extra), WORD, 2).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for key, text in order:
        ids = exact(WORD, text, 2)
        want.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert tokenfile.encode_documents(docs(spark, []), WORD, 2).count() == 0


def test_op5_over_the_whole_table(spark, sf):
    got = {r.doc_id: r for r in queries.op5_token_file(spark, sf).collect()}
    at = 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = exact(WORD, r.text, 2)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_shards_are_zstandard_and_serve_single_documents(spark):
    table = docs(spark, [(k, f"text number {k} " * k) for k in range(1, 60)])
    manifest = tokenfile.write_shards(tokenfile.tokenized(table, WORD, 2, 2), 2)
    found = {r.doc_id: r.ids for r in tokenfile.lookup(manifest, spark.createDataFrame([(3,), (58,), (99,)], "doc_id long")).collect()}
    assert found == {k: exact(WORD, f"text number {k} " * k, 2) for k in (3, 58)}
    row = manifest.first()
    store, _ = tokenfile.file_system(row.folder)
    with store.open_input_file(row.path) as f:
        reader, data = tokenfile.Reader(f), f
        data.seek(0)
        whole = data.read()
        parts = dict(reader.documents())
        assert len(parts) == row.n_docs
        # any frame decompresses by itself
        k = len(parts) - 1
        assert zstandard.ZstdDecompressor().decompress(whole[reader.first[k] : reader.first[k + 1]]) == parts[k]


def test_a_damaged_frame_is_found(tmp_path):
    with open(tmp_path / "x.zst", "wb") as f:
        w = tokenfile.Writer(f, 4)
        w.add(1, b"\1\0\0\0" * 50)
        w.add(None, b"")
        w.close()
    class Source:
        def __init__(self, data):
            self.data, self.at = data, 0
        def size(self):
            return len(self.data)
        def seek(self, at):
            self.at = at
        def read(self, n):
            return self.data[self.at : self.at + n]
    good = (tmp_path / "x.zst").read_bytes()
    reader = tokenfile.Reader(Source(good))
    assert reader.ids == [1, None] and dict(reader.documents())[0] == b"\1\0\0\0" * 50
    reader.sums = reader.sums ^ 1
    with pytest.raises(ValueError):
        list(reader.documents())
