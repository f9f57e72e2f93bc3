"""Notices wrapped in comments, whole licence texts, and blocks against a plain computation."""

import math
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import common, licences

CODE = "\n".join(f"def function_{k}(argument_{k}):\n    return argument_{k} * {k} + other_{k % 7}" for k in range(60))
NAMED = dict(licences.TEMPLATES)  # of each licence the last template


def longest(name):
    return max((t for n, t in licences.TEMPLATES if n == name), key=len)


def wrapped(text, mark, width=72):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


@pytest.mark.parametrize("name", ["GPL-3.0", "Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "LGPL-2.1", "AGPL-3.0"])
@pytest.mark.parametrize("mark", ["# ", " * ", "// "])
def test_wrapped_notices_above_code(spark, name, mark):
    notice = next(t for n, t in licences.TEMPLATES if n == name and len(t.split()) > 20) if name != "MPL-2.0" else longest(name)
    files = [(1, "a.py", wrapped("Copyright (c) 2021 Some Body", mark) + "\n" + wrapped(notice, mark) + "\n" + CODE), (2, "b.py", CODE), (3, "c.py", CODE + "\n" + CODE)]
    got = {r.id: r for r in licences.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got[1].licence == name and got[1].scope == "block" and got[1].cosine > 0.95
    assert got[2].origin == got[3].origin == "none"


def test_whole_licence_files(spark):
    files = [(k, f"d{k}/LICENSE", f"Some Licence\n\nCopyright 2020 A. Person and others\n\n{textwrap.fill(longest(n), 79)}\n") for k, n in enumerate(("MIT", "BSD-3-Clause", "BSD-2-Clause", "Unlicense"))]
    files += [(10, "d0/x.py", CODE), (11, "d2/sub/y.py", CODE)]
    got = {r.id: r for r in licences.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert [got[k].licence for k in (0, 1, 2, 3, 10, 11)] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "Unlicense", "MIT", "BSD-2-Clause"]


def plain_words(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        w = re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", w).lower()
        out += [w] if w else []
    return out


def plain_best(text, templates, texts):
    """All blocks of all lengths, with dictionaries."""
    vocabulary = {w for _, t in templates for w in plain_words(t)}
    df = Counter(w for t in texts for w in set(plain_words(t)))
    idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in vocabulary}
    mean = sum(idf.values()) / len(idf)

    def cosine(words, template):
        a, b = Counter(words), Counter(plain_words(template))
        weight = {w: n * idf.get(w, mean) for w, n in a.items()}
        other = {w: n * idf[w] for w, n in b.items()}
        length = math.sqrt(sum(x * x for x in weight.values()))
        return sum(weight.get(w, 0) * x for w, x in other.items()) / length / math.sqrt(sum(x * x for x in other.values())) if length else 0.0

    words = plain_words(text)
    whole = max(cosine(words, t) for _, t in templates)
    blocks = [0.0]
    for _, t in templates:
        for size in {min(len(words), max(1, round(s * len(plain_words(t))))) for s in licences.STRETCH}:
            blocks += [cosine(words[k : k + size], t) for k in range(len(words) - size + 1)] if size else []
    return max(whole, max(blocks)) if max(blocks) >= licences.THRESHOLD else whole


def test_blocks_against_a_plain_computation():
    rng = np.random.default_rng(5)
    templates = [("A", "alpha beta gamma delta alpha"), ("B", "delta epsilon"), ("C", "zeta, eta THETA iota kappa zeta lambda mu")]
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "--", "Pi!"]
    texts = [" ".join(rng.choice(words[: rng.integers(3, 17)], rng.integers(0, 40))) for _ in range(150)]
    texts += ["", "alpha " * 500, "x " * 200 + templates[2][1] + " y" * 200, "\n".join(templates[2][1].split()), "# !! ?"]
    raw, at = common.utf8(pa.array(texts))
    vocabulary = licences.Vocabulary(templates)
    n, df = len(texts), np.zeros(len(vocabulary.words))
    for t in texts:
        r, a = common.utf8(pa.array([t]))
        s, e, _ = common.word_spans(r, a)
        found = vocabulary.find(licences._hashes(r, s, e))
        df[np.unique(found[found >= 0])] += 1
    _, best, block = licences.Matcher(vocabulary, n, df).match(raw, at)
    want = [plain_best(t, templates, texts) for t in texts]
    assert best == pytest.approx(want, abs=1e-9)
    assert block.sum() > 10
