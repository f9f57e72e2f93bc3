import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from mnemospark.llm import alignment, queries

from . import helpers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, encoders):
    """Whole texts, common ends of tokens, and counts in a dictionary."""
    a, b = encoders
    level = alignment.byte_level()
    links, out = Counter(), []
    for k, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [bytes(level[c] for c in a.id_to_token(x)) for x in ids_a], [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b.id_to_piece(x)]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            out.append((k, 0, 0, [], ""))
            continue
        ends = [list(accumulate(map(len, p))) for p in parts]
        shared = sorted(set(ends[0]) & set(ends[1]))
        of, at = [dict(zip(e, ids)) for e, ids in zip(ends, (ids_a, ids_b))], [[bisect_right(e, s) for s in [0, *shared]] for e in ends]
        shown = ["|".join(",".join(map(str, ids[c[k] : c[k + 1]])) for c, ids in zip(at, (ids_a, ids_b))) for k in range(len(shared))]
        pairs = [(of[0][e], of[1][e]) for e in shared]
        links.update(pairs)
        out.append((k, len(ids_a), len(ids_b), pairs, hashlib.sha256(";".join(shown).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    return [(k, na, nb, len(p), len(p), sum(links[x] == most[x[1]] for x in p), sum(links[x] for x in p), sha) for k, na, nb, p, sha in out]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = helpers.ODD + [
    (20, "a▁b and <s> </s> <unk> <0x41>"), (21, "  two  blanks   and\n  lines\t tabs "), (22, "naïve café Straße ﬁne é"), (23, "日本語のテキスト、 混ぜて word"), (24, "x" * 30_000 + " " + "ab1" * 10_000), (25, " " * 5000),
    (26, "\x00 nul \x7f   nbsp 　 wide"), (27, "emoji 👩‍👩‍👧 🏳️‍🌈 ok"), (28, "long text, said often. " * 60_000), (20, "a▁b and <s> </s> <unk> <0x41>"),
]


def rows_of(df):
    return sorted(map(repr, map(tuple, df.select(*COLUMNS).collect())))


@pytest.mark.parametrize("head", [alignment.HEAD, 30, 1])
def test_equals_whole_texts(spark, encoders, head):
    got = alignment.align(helpers.docs(spark, ODD, extra=True), A, B, head=head)
    assert got.columns == COLUMNS
    assert rows_of(got) == sorted(map(repr, brute(ODD, encoders)))


def test_whole_table(spark, sf, encoders):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.QUERIES["op11_alignment"](spark, sf)) == sorted(map(repr, brute(rows, encoders)))


def test_empty_table(spark):
    assert alignment.align(helpers.docs(spark, []), A, B).collect() == []


def test_no_texts_with_tokens(spark):
    assert rows_of(alignment.align(helpers.docs(spark, [(1, None), (2, "")]), A, B)) == ["(1, 0, 0, 0, 0, 0, 0, '')", "(2, 0, 0, 0, 0, 0, 0, '')"]


def test_memory_of_chunks_is_bounded(spark, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_CHUNKS", 5)
    one = alignment.Aligner(A, B)
    from mnemospark.llm import common
    import pyarrow as pa

    for k in range(20):
        raw, at = common.utf8(pa.array([f" word{k} some others {k * k}", " again"]))
        per, digests, *_ = one.align(raw, at)
        want = brute([(0, f"word{k} some others {k * k}"), (1, "again")], encoders)
        assert [tuple(p) for p in per.tolist()] == [w[1:4] for w in want] and digests == [w[-1] for w in want]
        assert len(one.memo) < 20


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
def test_components_are_cut_at_common_ends(a, b):
    a, b = list(accumulate(a)), list(accumulate(b))
    end = max(a[-1], b[-1])
    a, b = a + [end] * (a[-1] < end), b + [end] * (b[-1] < end)
    shared = sorted(set(a) & set(b))
    want = [(sum(x <= low for x in a), sum(x <= high for x in a), sum(x <= low for x in b), sum(x <= high for x in b)) for low, high in zip([0, *shared], shared)]
    assert list(zip(*(x.tolist() for x in alignment.components(np.array(a), np.array(b))))) == want
