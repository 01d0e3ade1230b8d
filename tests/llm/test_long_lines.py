"""Notices count whatever the length of their line."""

import os

import pytest

from halyard.llm import license


def test_padded_notice(make):
    rows = [(1, "x\n# " + "-" * 5000 + " SPDX-License-Identifier: ISC\ny", "en", "s"), (2, "word " * 3000, "en", "s"), (3, "a\nLicensed under the MIT License.", "en", "s")]
    assert {r.doc_id: r.notices for r in license.scan(make(rows)).collect()} == {1: "ISC", 2: "", 3: "MIT"}


def test_more_known_texts(make, spark):
    more = spark.createDataFrame([("Own-1.0", "Copyright (c) 1 Me\n\nUse it as you like."), ("None", None)], "license string, text string")
    rows = [(1, "USE IT, as you LIKE!", "en", "s"), (2, license._BSD3, "en", "s"), (3, license._BSD2 + " x", "en", "s"), (4, None, "en", "s")]
    assert {r.doc_id: r.license for r in license.scan(make(rows), more=more).collect()} == {1: "Own-1.0", 2: "BSD-3-Clause", 3: None, 4: None}


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="no licence files here")
def test_published_texts(make):
    """The digests held for whole licences are those of the published texts, however they are spaced."""
    files = {"GPL-3": "GPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "LGPL-2.1": "LGPL-2.1"}
    rows = []
    for k, name in enumerate(files):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            rows.append((k, f.read().upper().replace("\n", "\r\n  "), "en", "s"))
    assert [r.license for r in license.scan(make(rows)).orderBy("doc_id").collect()] == list(files.values())
