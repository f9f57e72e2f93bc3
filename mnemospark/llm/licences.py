"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by directory.

A file is compared with licence templates as a whole, and by its blocks: every run of words of about a template's
length, wherever it begins, so that a notice is found in a comment of several lines, above code, or inside a licence
file. Marks of comments are no words. Words are weighted by the inverse of the number of files that hold them, counted
over all files; words outside the templates' vocabulary, of which no template holds any, only lengthen a vector, at
the vocabulary's mean weight. A file whose best block or whole reaches the threshold has that
licence. A file without one takes the licence of the nearest directory above it that holds
a licence file, found by joining each path's ancestors with the directories of licence files.

Few files need the sliding blocks: a block's cosine is at most the root of the sum of the squared template weights of the words
that the file holds at all, so a file where that sum stays below the squared threshold has no such block. In the others
running sums bound every block's cosine, and only blocks whose bound exceeds the best so far are computed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Least cosine of a match; names of licence files.
THRESHOLD = 0.8
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice)[^/]*$"
#: Lengths of blocks, as shares of the template's.
STRETCH = (0.8, 1.0, 1.25)
#: Texts whose words are counted in one matrix, and blocks computed at once.
ROWS, BLOCKS = 512, 256

# Texts of public licences. Short ones whole, of long ones the notice for headers and the beginning.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_NO_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _GRANT),
    ("MIT", _GRANT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program " + _NO_WARRANTY + " GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", f"{_BSD}: {_BSD_1} {_BSD_3} {_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD}: {_BSD_1} {_BSD_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, lower-cased and without marks at their ends; what has marks alone is 0, no word."""
    low = common.LOWER[raw]
    plain = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    upto = np.concatenate([[0], np.cumsum(plain)])
    after = np.append(np.flatnonzero(plain), len(raw))  # the k-th plain byte
    has = upto[ends] > upto[starts]
    s = np.where(has, after[np.minimum(upto[starts], len(after) - 1)], starts)
    e = np.where(has, after[np.maximum(upto[ends] - 1, 0)] + 1, ends)
    return np.where(has, common.span_hashes(low, s, np.maximum(e, s)), np.uint64(0))


class Vocabulary:
    """The templates' words, by hash, and their counts in each template."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        raw, at = common.utf8(pa.array([t for _, t in templates], pa.string()))
        starts, ends, first = common.word_spans(raw, at)
        h = _hashes(raw, starts, ends)
        self.words = np.unique(h[h > 0])
        self.counts = np.zeros((len(templates), len(self.words)))
        for k in range(len(templates)):
            own = h[first[k] : first[k + 1]]
            np.add.at(self.counts[k], np.searchsorted(self.words, own[own > 0]), 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)


def word_files(files: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """How many files there are, and how many hold each word of the vocabulary."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for part, raw, at in common.slices(batch):
                starts, ends, first = common.word_spans(raw, at)
                word = vocabulary.find(_hashes(raw, starts, ends))
                text = np.repeat(np.arange(len(part)), np.diff(first))
                pairs = np.unique(text[word >= 0] * len(total) + word[word >= 0])
                total += np.bincount(pairs % len(total), minlength=len(total))
                n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.concatenate([[n], total]))], names=["word", "n"])

    sums = files.select("text").mapInArrow(common.lean(task), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary.words) + 1, np.int64)
    for r in sums:
        out[r["word"] + 1] = r["n"]
    return int(out[0]), out[1:]


class Matcher:
    """Cosines of texts and of their blocks to templates, under given document frequencies."""

    def __init__(self, vocabulary: Vocabulary, n: int, df: np.ndarray, threshold: float = THRESHOLD):
        self.vocabulary, self.threshold = vocabulary, threshold
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.mean = float(self.idf.mean())
        target = vocabulary.counts * self.idf
        self.target = (target / np.linalg.norm(target, axis=1, keepdims=True)).T.copy()
        self.sizes = vocabulary.counts.sum(axis=1).astype(int)

    def wholes(self, text: np.ndarray, n: int, h: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``n`` texts and each template the cosine of the whole, and the bound on that of any block."""
        v = len(self.idf)
        cos, reach = np.zeros((n, self.target.shape[1])), np.zeros((n, self.target.shape[1]))
        strange = word < 0
        order = np.lexsort((h[strange], text[strange]))
        t, x = text[strange][order], h[strange][order]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1])
        at = np.flatnonzero(new)
        square = self.mean**2 * np.bincount(t[at], np.diff(np.append(at, len(t))).astype(float) ** 2, minlength=n)
        edge = np.searchsorted(text, np.arange(0, n + ROWS, ROWS))
        for k, (a, b) in enumerate(zip(edge, edge[1:])):
            lo, rows = k * ROWS, min(ROWS, n - k * ROWS)
            known = word[a:b] >= 0
            weight = np.bincount((text[a:b][known] - lo) * v + word[a:b][known], minlength=rows * v).reshape(rows, v) * self.idf
            length = np.sqrt(np.maximum((weight**2).sum(axis=1) + square[lo : lo + rows], 1e-12))
            cos[lo : lo + rows] = weight @ self.target / length[:, None]
            reach[lo : lo + rows] = np.sqrt((weight > 0).astype(float) @ self.target**2)
        return cos, reach

    def best_block(self, h: np.ndarray, word: np.ndarray, k: int, best: float) -> float:
        """The highest cosine of a block of one text's words to template ``k``, if it exceeds ``best``."""
        _, code = np.unique(h, return_inverse=True)
        weight = np.where(word >= 0, self.idf[word], self.mean)
        by_code = np.zeros(code.max() + 1)
        by_code[code] = weight
        dot = np.append(0, np.cumsum(np.where(word >= 0, self.target[word, k] * weight, 0)))
        square = np.append(0, np.cumsum(weight**2))
        for size in {min(len(h), max(1, round(s * self.sizes[k]))) for s in STRETCH}:
            dots = dot[size:] - dot[:-size]
            bound = dots / np.sqrt(square[size:] - square[:-size])  # repeats only lengthen the vector
            todo = np.flatnonzero(bound > best + 1e-12)
            todo = todo[np.argsort(-bound[todo], kind="stable")]
            while len(todo) and bound[todo[0]] > best + 1e-12:
                some, todo = todo[:BLOCKS], todo[BLOCKS:]
                rows = np.sort(code[some[:, None] + np.arange(size)], axis=1).ravel()
                new = np.ones(len(rows), dtype=bool)
                new[1:] = rows[1:] != rows[:-1]
                new[::size] = True
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(rows)))
                length = np.sqrt(np.bincount(at // size, (times * by_code[rows[at]]) ** 2, minlength=len(some)))
                best = max(best, float((dots[some] / length).max()))
        return best

    def match(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best template of each text, its cosine, and whether a block has it (else the whole)."""
        n = len(at) - 1
        starts, ends, first = common.word_spans(raw, at)
        h = _hashes(raw, starts, ends)
        used = h > 0
        text = np.repeat(np.arange(n), np.diff(first))[used]
        h = h[used]
        first = np.searchsorted(text, np.arange(n + 1))
        word = self.vocabulary.find(h)
        cos, reach = self.wholes(text, n, h, word)
        kind = cos.argmax(axis=1)
        best, block = cos.max(axis=1), np.zeros(n, dtype=bool)
        for d, k in zip(*np.nonzero(reach >= self.threshold - 1e-9)):
            own = slice(first[d], first[d + 1])
            found = self.best_block(h[own], word[own], k, max(best[d], self.threshold - 1e-9))
            if found >= self.threshold and found > best[d] + 1e-12:
                best[d], kind[d], block[d] = found, k, True
        return kind, best, block


_WORD = re.compile(rb"[^a-z0-9.]+")
_GNU = re.compile(rb"(affero |lesser |library )?general public license|free documentation license")
_VERSION = re.compile(rb"\bv(?:ersion |ersion|\.? ?)([0-9]+(?:\.[0-9]+)*)\b")
_TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)")
#: What a text has to say of itself to have the licence of a family whose members differ in a few words.
_SELF = {"Apache": re.compile(rb"apache (?:software )?license"), "MPL": re.compile(rb"mozilla public license"), "CC": re.compile(rb"creative ?commons|\bcc by\b")}


def settled(name: str, text: bytes) -> str | None:
    """The member of the family of a matched template that the text names, None if it names none.

    Versions of one family share hundreds of words, so the cosine cannot tell them apart. The first naming of the family in the text and the
    first version behind it do (or before it, if none follows); without a version the name of the family alone is given.
    """
    family = name.split("-")[0]
    if family not in ("GPL", "LGPL", "AGPL", *_SELF):
        return name
    words = _WORD.sub(b" ", text.lower())
    found = (_SELF.get(family) or _GNU).search(words)
    if not found:
        return None
    if family == "CC":
        return name
    if family not in _SELF:
        kind = found[1] or (b"" if b"public" in found[0] else b"free")
        family = {b"": "GPL", b"affero ": "AGPL", b"lesser ": "LGPL", b"library ": "LGPL", b"free": "GFDL"}[kind]
    version = _VERSION.search(words, found.end()) or _VERSION.search(words)
    if not version:
        return family
    number = version[1].decode()
    return f"{family}-{number if '.' in number else number + '.0'}"


def tags(raw: np.ndarray, at: np.ndarray) -> dict[int, str]:
    """The first SPDX tag of each text that has one."""
    out: dict[int, str] = {}
    for m in _TAG.finditer(raw.tobytes()):
        out.setdefault(int(np.searchsorted(at, m.start(), side="right")) - 1, m[1].decode().rstrip("."))
    return out


def best_matches(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns id, path, k1, k2 of ``files`` with licence, cosine and scope (tag, block or file) of the best match, and whether it is the file's
    ``own``: a tag, or a match that reaches the threshold and that the text bears out."""
    common.small_batches(files.sparkSession)
    vocabulary = Vocabulary(templates)
    matcher = Matcher(vocabulary, *word_files(files, vocabulary), threshold)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch):
                kind, best, block = matcher.match(raw, at)
                names, scope = [vocabulary.names[k] for k in kind], np.where(block, "block", "file").tolist()
                for d in np.flatnonzero(best >= threshold):
                    names[d] = settled(names[d], raw[at[d] : at[d + 1]].tobytes())
                own = (best >= threshold) & np.array([n is not None for n in names], bool)
                for d, tag in tags(raw, at).items():
                    names[d], scope[d], own[d] = tag, "tag", True
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(names, pa.string()), pa.array(best), pa.array(scope, pa.string()), pa.array(own)], names=["id", "path", "k1", "k2", "licence", "cosine", "scope", "own"])

    return files.select("id", "path", "k1", "k2", "text").mapInArrow(common.lean(task), "id long, path string, k1 long, k2 long, licence string, cosine double, scope string, own boolean")


def scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """id, path, licence, cosine, scope, origin (own, inherited or none) and directory of each file.

    ``cosine`` is that of the file's own best match: of a block that reaches the threshold, else of the whole file. Equal
    cosines go to the template that stands first. Of families with versions the text's own words settle which it is (``settled``), and a
    text that names another licence than its match has none. An SPDX tag goes before any match. Where licence files of one
    directory disagree, the highest cosine wins, then the first path, then the name of the licence. Null
    and empty texts match nothing but inherit; a null path inherits nothing. Texts of any length are compared whole and
    in all their blocks. Repeated rows give repeated results. Other columns are ignored, whatever their names.
    """
    text = common.text_of(text_col)
    rows = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), *[c.alias(f"k{k + 1}") for k, c in enumerate(common.row_key(id_col, F.coalesce(F.col(path_col).cast("string"), F.lit(""))))], text.alias("text"))
    found = common.written(best_matches(rows, templates, threshold))
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    files_of = found.where("own").where(F.col("path").rlike(LICENCE_FILE)).select(parent.alias("dir"), "licence", "cosine", "path")
    directories = common.written(files_of.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("cosine"), "path", "licence")).alias("dir_licence")))
    steps = F.split(parent, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    bare = found.where(~F.col("own") & F.col("path").isNotNull()).select("k1", "k2", F.posexplode(above).alias("depth", "dir"))
    nearest = bare.join(directories, "dir").groupBy("k1", "k2").agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("from"))
    out = found.join(nearest, ["k1", "k2"], "left")
    origin = F.when(F.col("own"), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", F.when(F.col("own"), F.col("licence")).otherwise(F.col("from.dir_licence")).alias("licence"), "cosine", F.when(F.col("own"), F.col("scope")).alias("scope"), origin.alias("origin"), F.when(~F.col("own"), F.col("from.dir")).alias("directory"))
