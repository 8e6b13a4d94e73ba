"""Licence texts as they are published, wrapped at several widths and in comments, and a plain re-implementation of the scan."""

import re
import textwrap
import time

import duckdb
import pytest

from orbweave.llm import license_scan, queries

MIT = """Copyright (c) 2020 Jane Roe. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
TEXTS = {"MIT": MIT, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "MPL-2.0": MPL, "GPL": GPL3, "ISC": ISC, "Zlib": ZLIB}
OTHERS = {
    "Copyright (c) 2020 X. All rights reserved.": ("COPYRIGHT", ""),
    "// SPDX-License-Identifier: GPL-2.0-only\nint main;": ("SPDX_GPL_2_0_ONLY", "GPL-2.0-only"),
    "// SPDX-License-Identifier: GPL-2.0-only\n\nint main;": ("SPDX_GPL_2_0_ONLY", "GPL-2.0-only"),
    "# SPDX-License-Identifier: MIT": ("SPDX_MIT", "MIT"),
    "Title Without A Stop\nReleased under the MIT License\nNext Line Of Prose": ("MIT_REF", "MIT"),
}


def wrapped(text, width, mark):
    lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
    return "\n".join((mark + x).rstrip() if mark else x for x in lines)


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# "])
def test_published_texts(spark, mark):
    rows = [(name, width, wrapped(text, width, mark)) for name, text in TEXTS.items() for width in (60, 72, 80, 100)]
    df = spark.createDataFrame(rows, "name string, width int, text string")
    found = license_scan.scan_licenses(df.selectExpr("name || width AS doc_id", "text")).collect()
    expected = {f"{name}{width}": [name] for name, width, _ in rows}
    assert {r.doc_id: r.licenses for r in found} == expected


def test_other_lines(spark):
    cases = {k: v for k, v in OTHERS.items() if "\nint" not in k or "\n\n" in k}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (",".join(r.sentences), ",".join(r.licenses)) for r in license_scan.scan_licenses(df).collect()}
    assert got == dict(enumerate(cases.values()))


def plain_scan(text):
    """The scan of one text in plain Python, with the operator's tables and marks."""
    word = r"[^\W_]+"
    keyword = re.compile(license_scan.KEYWORDS, re.I)
    capital = re.compile(r"\n(?=\s*[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")

    def normal(s):
        return " ".join(re.findall(word, s.lower()))

    def matches(sentence, known):
        words, pattern = sentence.split(), known.split()
        reach = {0}
        for k, p in enumerate(pattern):
            if p != "*":
                reach = {i + 1 for i in reach if i < len(words) and words[i] == p}
            elif k in (0, len(pattern) - 1):
                reach = set(range(min(reach), len(words) + 1)) if reach else set()
            else:
                reach = {j for i in reach for j in range(i, len(words) + 1) if len(" ".join(words[i:j])) <= license_scan.MOST_BETWEEN}
        return len(words) in reach

    def identify(s):
        if re.search(r"(?:not|never) (?:be )?(?:licensed|released|distributed) under", normal(s)):
            return license_scan.UNKNOWN
        return next((k for k, known in license_scan.known_sentences() if matches(normal(s), known)), license_scan.UNKNOWN)

    text = re.sub(license_scan.COMMENT_MARKS, "", text or "")
    ids = []
    for s in re.split(license_scan.SENTENCE_END, text):
        if keyword.search(s):
            line = re.search("spdx-license-identifier:[ ]*(.*)", s, re.I)
            named = {x.upper(): license_scan.spdx_identifier(x) for x in license_scan.SPDX}
            terms = [named[t] for t in re.split(r"[\s()]+", line[1].upper()) if t in named] if line else []
            if terms:
                ids += terms
                continue
            one = identify(s)
            parts = [identify(x) for x in capital.split(s) if keyword.search(x)] if one == license_scan.UNKNOWN else []
            ids += parts if any(x != license_scan.UNKNOWN for x in parts) else [one]
    slots = [[x, None] for x in ids]
    for name, seq in license_scan.known_rules():
        at = 0
        while at < len(slots):
            places, k = [], at
            for want in seq:
                while k < len(slots) and slots[k][1] is None and slots[k][0] != want and places and k - places[-1] <= license_scan.GAP:
                    k += 1
                if k >= len(slots) or slots[k][1] is not None or slots[k][0] != want:
                    break
                places.append(k)
                k += 1
            if len(places) == len(seq):
                slots[at : places[-1] + 1] = [[None, name]]
            at += 1
    return ids, [name for _, name in slots if name]


def test_scan_equals_plain_python(spark, sf):
    texts = [wrapped(t, w, m) for t in TEXTS.values() for w in (60, 100) for m in ("", "# ")] + [a + "\n" + b for a in TEXTS.values() for b in (MIT, GPL3)] + list(OTHERS)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan_licenses(df).collect():
        assert (r.sentences, r.licenses) == plain_scan(texts[r.doc_id]), texts[r.doc_id]


def test_query_equals_plain_python(spark, sf):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    found = queries.op1_license_scan(spark, sf).collect()
    assert len(found) == len(texts) and any(r.licenses for r in found)
    for r in found:
        ids, names = plain_scan(texts[r.doc_id])
        assert (r.n_sentences, r.sentences, r.licenses) == (len(ids), ",".join(ids), ",".join(names))


#: Written out, as they stand in files; not made from the operator's tables.
FORMS = {
    "// SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0",
    "# SPDX-License-Identifier: (LGPL-2.1+ AND BSD-3-Clause)": "LGPL-2.1+,BSD-3-Clause",
    "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */\nint main;": "GPL-2.0-or-later",
    "SPDX-License-Identifier: LGPL-2.0-or-later": "LGPL-2.0-or-later",
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "This project is licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "Shared under the Creative Commons Attribution-ShareAlike 4.0 International license.": "CC-BY-SA-4.0",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "MIT-OR-Apache-2.0",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD",
    "Released under the GPLv3.": "GPL-3.0",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": "Apache-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007": "GPL-3.0",
    "We are not licensed under the MIT license.": "",
    "Nothing about licences here, and no SPDX line.": "",
}


def test_forms_in_files(spark):
    df = spark.createDataFrame(list(enumerate(FORMS)), "doc_id long, text string")
    got = {r.doc_id: ",".join(r.licenses) for r in license_scan.scan_licenses(df).collect()}
    assert {k: got[n] for n, k in enumerate(FORMS)} == FORMS


@pytest.mark.parametrize("mark", ["*", "#", "-", "/", ";", "%", "*/", "-->", " "])
def test_long_runs_of_marks_take_little_time(spark, mark):
    text = "license x " + mark * 1_000_000 + "\nlicense\n" + mark * 1_000_000
    began = time.perf_counter()
    assert license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
    spark.createDataFrame([(1, text)], "doc_id long, text string").transform(license_scan.scan_licenses).collect()
    assert time.perf_counter() - began < 30
