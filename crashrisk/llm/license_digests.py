"""Licence scan by canonical digests.

A text is brought into a canonical form (lower case, no copyright lines, no punctuation,
one spelling of equivalent words), and the MD5 of the whole form is looked up among the
digests of known licences, brought into the same form. Whole documents are looked up, and
so is every line of them as a text of its own, which finds licence notices.

Everything is DataFrame functions. The known digests are a fixed list of this module (or
one the caller gives), so their side of the hash join is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm.registry import query

# fixed values: public licence texts, without their copyright lines
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _WARRANTY
_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.

"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Whole licences, as (identifier, title or none, text).
TEXTS = [
    ("MIT", "MIT License", _MIT),
    ("MIT", "The MIT License (MIT)", _MIT),
    ("ISC", "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC),
    ("0BSD", "BSD Zero Clause License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted.\n\n" + _ISC),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("Apache-2.0", None, _APACHE_NOTICE),
    ("GPL-3.0-or-later", None, _GPL_NOTICE),
]
#: Names of licences in notices, by identifier.
NAMES = {
    "MIT": ["the MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"],
    "GPL-2.0-only": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2"],
    "GPL-3.0-only": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3", "LGPLv3"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal License"],
} | {f"CC-{kind}-4.0": [f"CC {kind} 4.0", f"a CC {kind} 4.0 License", f"the Creative Commons {kind} 4.0 License"]
     for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")}
#: What may stand before the name in a notice.
OPENINGS = ["Released under", "Licensed under", "Distributed under", "Published under", "Available under", "Made available under",
            "This work is licensed under", "This file is licensed under", "This software is licensed under", "This project is licensed under",
            "Released under the terms of", "Licensed under the terms of", "SPDX-License-Identifier:"]
#: Equivalent words: each is replaced by the one it stands with.
EQUIVALENT = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
              ("noncommercial", "non commercial"), ("favour", "favor"), ("organisation", "organization"), ("recognised", "recognized"),
              ("authorisation", "authorization"), ("judgement", "judgment"), ("fulfil", "fulfill"), ("copyright owner", "copyright holder"),
              ("https", "http"), ("v", "version"), ("ver", "version")]

_COPYRIGHT = r"(^|\n)[^a-z0-9\n]*((copyright[^\n]*([0-9]{4}|\(c\)|©|<year>|\[year\]))|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form of a text: only its words, as they would stand in any copy of the same licence."""
    text = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    text = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for word, same in EQUIVALENT:
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {same} "))
    return F.trim(text)


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of all known licences and notices: texts with and without their titles, openings by names."""
    out = [(i, t) for i, _, t in TEXTS] + [(i, f"{title}\n\n{t}") for i, title, t in TEXTS if title]
    out += [(i, f"{opening} {name}.") for i, names in NAMES.items() for name in [*names, i] for opening in OPENINGS]
    return out


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of known licences, one identifier for each digest."""
    table = spark.createDataFrame(known_texts() if texts is None else texts, "license_id string, text string")
    forms = table.select(canonical(F.col("text")).alias("form"), "license_id").where("form <> ''")  # no words, no licence
    return forms.groupBy(F.md5(F.col("form").cast("binary")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(df: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, digest of the whole text, its license_id, and its lines' licences.

    ``notice_ids`` holds the distinct identifiers of lines that are licence notices, in
    order and separated by commas (empty if there are none), ``n_notices`` the number of
    such lines. A null text has a null digest; texts and lines without a word match nothing.
    Equal rows get equal results; other columns are not read. ``known`` must be small: it
    is the caller's list of licences, not data.
    """
    known = F.broadcast(known.select("digest", "license_id"))
    rows = df.select(F.xxhash64(key, text).alias("row_key"), F.col(key).alias("key"), F.col(text).alias("text"))
    lines = rows.where("text IS NOT NULL").select("row_key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    notices = (lines.select("row_key", "at", F.md5(canonical(F.col("line")).cast("binary")).alias("digest")).join(known, "digest")
               .groupBy("row_key").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notice_ids"),
                                       F.countDistinct("at").alias("n_notices")))
    whole = rows.select("row_key", "key", F.md5(canonical(F.col("text")).cast("binary")).alias("digest")).join(known, "digest", "left")
    return whole.join(notices, "row_key", "left").select(
        F.col("key").alias(key), "digest", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    form = r"' ' || regexp_replace(regexp_replace(lower({0}), " + quoted(_COPYRIGHT) + r", '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    form = form.replace("[0-9]{4}", "[0-9]{{4}}")
    for word, same in EQUIVALENT:
        form = f"replace({form}, ' {word} ', ' {same} ')"
    form = f"trim({form})"
    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known_texts())
    return f"""
        WITH known AS (SELECT md5({form.format('t')}) AS digest, min(i) AS license_id FROM (VALUES {rows}) AS v(i, t) GROUP BY ALL),
        lines AS (SELECT doc_id, {form.format('line')} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
        notices AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids, count(*) AS n_notices
                    FROM lines JOIN known ON md5(form) = digest AND form <> '' GROUP BY doc_id),
        whole AS (SELECT doc_id, md5({form.format('text')}) AS digest FROM documents)
        SELECT w.doc_id, w.digest, k.license_id, coalesce(n.notice_ids, '') AS notice_ids, coalesce(n.n_notices, 0) AS n_notices
        FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN notices n ON n.doc_id = w.doc_id"""


@query("op6_license_digests", _sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))
