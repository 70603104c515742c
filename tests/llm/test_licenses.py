"""Licence texts in their published line breaks."""

import time

import duckdb
import pytest

from millrace.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
CASES = [
    (BSD, ["BSD-3-Clause"]),
    (BSD[: BSD.index("3.")], ["BSD-2-Clause"]),
    (MIT, ["MIT"]),
    (GPL, ["GPL-3.0"]),
    (APACHE, ["Apache-2.0"]),
    ("Licensed under the\nMIT License.", ["MIT"]),
    ("// This file is released under the MIT License.", ["MIT"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("# SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause)\nx", ["BSD-3-Clause", "GPL-2.0"]),
    ("SPDX-License-Identifier: MIT-0", []),
    ("Licensed under\n\nthe MIT License.", []),
    ("It is licensed under the MIT License agreement", []),
    ("Licensed under the MIT Licenses", []),
    ("a\nLicensed under CC BY" + " " * 5000 + "4.0\nb", ["CC-BY-4.0"]),
]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_published_texts(spark, mark):
    texts = [mark + t.replace("\n", "\n" + mark) for t, _ in CASES]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(rows).collect()}
    for i, (text, want) in enumerate(CASES):
        assert found[i] == want, text


def test_a_text_of_signs_or_words_only(spark):
    texts = ["." * 100_000, "* " * 50_000, "\n" * 100_000, "licensed under the " * 20_000]
    assert all(r["licenses"] == [] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def test_hostile_texts_take_linear_time(spark):
    n = 1_000_000
    texts = ["." * n, ". " * (n // 2), "* " * (n // 2), "\n" * n, "\n \n" * (n // 3), " " * n + ".", "licensed under the " * (n // 19), "." * n + "a", "Released under the MIT" + " " * n + "License."]
    began = time.time()
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 30
    assert found == {i: ["MIT"] if i == len(texts) - 1 else [] for i in range(len(texts))}


def test_equals_the_sql(spark, tmp_path):
    texts = [m + t.replace("\n", "\n" + m) for t, _ in CASES for m in ("", "# ")] + [None, "", ".", "\n\n.\x01 \n|/", "a\n\n" * 3, *licenses.SENTENCES, " / ".join(licenses.SENTENCES), "\n".join(licenses.SENTENCES)]
    texts += ["SPDX-License-Identifier: MIT OR Apache-2.0 AND nothing", "x SPDX-License-Identifier: GPL-3.0-or-later WITH exception\nAll rights reserved.", "all rights reserved.. All Rights Reserved"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {tuple(r) for r in licenses.op7_licenses(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == set(con.sql(licenses.ORACLES["op7_licenses"]).fetchall())


def test_edge_rows(spark):
    rows = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x")], "doc_id long, text string, licenses string")
    found = sorted((r["doc_id"] or 0, r["licenses"]) for r in licenses.scan(rows).collect())
    assert found == [(0, []), (1, []), (1, ["MIT"]), (1, ["MIT"])]
    assert licenses.scan(rows.limit(0)).count() == 0
