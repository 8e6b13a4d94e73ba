"""Licence headers as they stand in files: wrapped, and with semicolons."""

from orbweave.llm import license_scan

GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program."""
CASES = {
    GPL2: ("GPL_GRANT,UNKNOWN,GPL_WARRANTY,UNKNOWN,UNKNOWN,GPL_COPY", "GPL"),
    "This is free and unencumbered software released into the public\ndomain.": ("UNLICENSE", "Unlicense"),
    "If a copy of the MPL was\nnot distributed with this file, You can obtain one at http://mozilla.org/.": ("MPL2_COPY", ""),
}


def test_wrapped_headers(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: (",".join(r.sentences), ",".join(r.licenses)) for r in license_scan.scan_licenses(df).collect()}
    assert list(CASES.values()) == [got[i] for i in range(len(CASES))]
