"""Versions and families of licences that share most of their words."""

import os

import pytest

from mnemospark.llm import licences

FOLDER = "/usr/share/common-licenses"
WHOLE = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
#: Others are right or none, never a sibling.
OTHER = {"MPL-1.1": "MPL-1.1", "CC0-1.0": None, "Artistic": None, "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3"}
SENTENCE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; {1}."
REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
HEADERS = [
    (SENTENCE.format("General Public License version 2", "no later version") + REST.format("General Public License"), "GPL-2.0"),
    (SENTENCE.format("General Public License", "either version 2 of the License, or (at your option) any later version") + REST.format("General Public License"), "GPL-2.0"),
    (SENTENCE.format("General Public License", "either version 3 of the License, or (at your option) any later version") + REST.format("General Public License"), "GPL-3.0"),
    (SENTENCE.format("Lesser General Public License", "either version 3 of the License, or (at your option) any later version") + REST.format("Lesser General Public License"), "LGPL-3.0"),
    (SENTENCE.format("Lesser General Public License", "either version 2.1 of the License, or (at your option) any later version") + REST.format("Lesser General Public License"), "LGPL-2.1"),
    (SENTENCE.format("Affero General Public License", "either version 3 of the License, or (at your option) any later version") + REST.format("Affero General Public License"), "AGPL-3.0"),
    ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"), ("// SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-only WITH x */", "GPL-2.0-only"),
    ("plain text of no licence at all, with a general public and a version 2", None),
]


def scanned(spark, texts):
    rows = [(k, f"d{k}/file.txt", t) for k, t in enumerate(texts)]
    got = licences.scan(spark.createDataFrame(rows, "id long, path string, text string").repartition(2))
    return [r.licence for r in sorted(got.collect(), key=lambda r: r.id)]


def test_headers_and_tags(spark):
    texts = [t for t, _ in HEADERS] + ["\n".join(f" * {line}" for line in HEADERS[3][0].split(". "))]
    assert scanned(spark, texts) == [n for _, n in HEADERS] + ["LGPL-3.0"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the system's licence texts")
def test_whole_texts_are_no_siblings(spark):
    there = [n for n in [*WHOLE, *OTHER] if os.path.exists(f"{FOLDER}/{n}")]
    got = dict(zip(there, scanned(spark, [open(f"{FOLDER}/{n}", encoding="utf-8", errors="replace").read() for n in there])))
    assert all(got[n] == WHOLE[n] for n in there if n in WHOLE), got
    assert all(got[n] in (OTHER[n], None) for n in there if n in OTHER), got
