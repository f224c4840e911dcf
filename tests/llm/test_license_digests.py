from collections import Counter

from crashrisk.llm.license_digests import _BSD_HEAD, _BSD_NAME, _BSD_TAIL, _MIT, known_digests, op6, scan_licenses
from tests.llm.conftest import EDGES


def scan(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in scan_licenses(frame, known_digests(spark)).collect()}


def test_whole_texts(spark):
    got = scan(spark, [
        "The MIT Licence (MIT)\n\nCopyright (c) 2019-2021 Some One\nCopyright (c) 2020 An Other\n\n" + _MIT.replace("\n", "\n   "),
        _MIT.upper().replace(",", " ,").replace('"', "``"), _MIT + "\nAnd one thing more.",
        "Copyright 2001 X. All rights reserved.\n\n" + _BSD_HEAD + _BSD_NAME + _BSD_TAIL, _BSD_HEAD + _BSD_TAIL, "all rights reserved"])
    assert [got[i]["license_id"] for i in range(6)] == ["MIT", "MIT", None, "BSD-3-Clause", "BSD-2-Clause", None]


def test_notices(spark):
    got = scan(spark, ["Some text.\nReleased under the MIT License.\nMore text.\n * licensed under  the Apache Licence, version 2.0 *\nreleased under the MIT license",
                       "SPDX-License-Identifier: GPL-3.0-only", "We were released under the MIT License of old.", "This work is licensed under CC BY-NC 4.0."])
    assert [(got[i]["notice_ids"], got[i]["n_notices"]) for i in range(4)] == [("Apache-2.0,MIT", 3), ("GPL-3.0-only", 1), ("", 0), ("CC-BY-NC-4.0", 1)]
    assert got[1]["license_id"] == "GPL-3.0-only"  # a notice that is the whole text


def test_edges(spark, edges, nothing):
    rows = scan_licenses(edges, known_digests(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in EDGES)
    assert all(r["license_id"] is None and r["n_notices"] == 0 for r in rows)
    assert [r["digest"] for r in rows if r["doc_id"] == 2] == [None]
    assert scan_licenses(nothing, known_digests(spark)).count() == 0


def test_only_built_in_functions(spark, sf_dir):
    plan = op6(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
