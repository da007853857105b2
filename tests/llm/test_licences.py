"""Licence texts as they stand in files, and the scan against its SQL."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from affinity.llm import license_scan
from affinity.llm.licence_texts import TEXTS

WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
KEPT = """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
MIT = f"MIT License\n\nCopyright (c) 2019 Ada Byron and others\n\n{GRANT}\n\n{KEPT}\n\n{WARRANTY}\n"
BSD = """Copyright (c) 2011, The Example Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CLAUSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version {version}

 Copyright (C) {year} Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  13. Use with the GNU Affero General Public License.
"""
CODE = "\nimport os\n\n\ndef main(argv):\n    for name in argv:\n        print(os.path.abspath(name))\n"


def commented(text: str, sign: str = "#") -> str:
    return "\n".join(f"{sign} {line}".rstrip() for line in text.splitlines()) + "\n"


FILES = [
    ("/mit/LICENSE", MIT, "MIT", "own"),
    ("/mit/src/a/tool.py", CODE, "MIT", "directory"),
    ("/mit/src/header.py", commented(MIT) + CODE, "MIT", "own"),
    ("/gpl3/COPYING", GPL.format(version="3, 29 June 2007", year=2007), "GPL-3.0", "own"),
    ("/gpl3/x.py", CODE, "GPL-3.0", "directory"),
    ("/gpl2/COPYING", GPL.format(version="2, June 1991", year=1989), "GPL-2.0", "own"),
    ("/lgpl/COPYING.LESSER", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nterms", "LGPL-2.1", "own"),
    ("/bsd3/LICENSE.txt", BSD + CLAUSE + DISCLAIMER, "BSD-3-Clause", "own"),
    ("/bsd2/LICENSE.txt", BSD + DISCLAIMER, "BSD-2-Clause", "own"),
    ("/bsd/conditions.c", commented(BSD, " *") + "int main(void) { return 0; }", "BSD", "own"),
    ("/isc/x.js", commented("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without "
                            "fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear "
                            "in all copies.", "//") + "let x = 1;", "ISC", "own"),
    ("/tag/a.rs", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}", "Apache-2.0", "own"),
    ("/tag/b.rs", "// SPDX-License-Identifier: GPL-2.0-or-later\nfn main() {}", "GPL-2.0", "own"),
    ("/tag/c.rs", "// SPDX-License-Identifier: Sunflower\nfn main() {}", "Other", "own"),
    ("/tag/d.rs", "Released under the Sunflower License.", "Other", "own"),
    ("/apache/A.java", "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file "
                       "except in compliance with the License.\n */\nclass A {}", "Apache-2.0", "own"),
    ("/gpl/h.c", commented("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU "
                           "General Public License as published by\nthe Free Software Foundation, either version 3 of the "
                           "License, or\n(at your option) any later version.") + "int x;", "GPL-3.0", "own"),
    ("/open/h.c", "This work is licensed under the GNU General Public License.\nint x;", "GPL", "own"),
    ("/kept/a.html", "Some words of a page\nCopyright (c) 2020 Example. All rights reserved.", "All-Rights-Reserved", "own"),
    ("/kept/b.html", "All rights reserved.", "All-Rights-Reserved", "own"),
    ("/plain/a.txt", "The terms of this work are free and the software is under way", None, None),
    ("/plain/b.txt", None, None, None), ("/plain/c.txt", "", None, None), (None, None, None, None),
]


def licences(spark, files):
    found = license_scan.scan_licences(files, keep=("n",)).collect()
    return {r["n"]: (r["licence"], r["origin"]) for r in found}


@pytest.mark.parametrize("beside", [0, 3000])
def test_real_texts(spark, beside):
    """Alone, and beside many files whose words change the weights."""
    words = "the of work software free version copy notice public general use with code and".split()
    rows = [(i, path, text) for i, (path, text, _, _) in enumerate(FILES)]
    rows += [(1000 + i, f"/other/{i}.txt", "\n".join(" ".join(words[(i * 7 + j * k) % len(words)] + ("" if k % 3 else str(i))
                                                             for k in range(9)) for j in range(4))) for i in range(beside)]
    got = licences(spark, spark.createDataFrame(rows, "n int, path string, text string"))
    assert len(got) == len(rows)
    assert {FILES[i][0]: got[i] for i in range(len(FILES))} == {p: (l, o) for p, _, l, o in FILES}
    assert all(got[1000 + i] == (None, None) for i in range(beside))


def test_long_texts(spark):
    """A notice in the middle of a long text; a text of wordless lines; one line of many words."""
    many = "\n".join(f"line {i} of some text" for i in range(20000))
    rows = [(0, "/a/x", many + "\nReleased under the MIT License.\n" + many), (1, "/b/x", "\n*\n" * 50000),
            (2, "/c/x", "word " * 200000 + "MIT"), (3, "/d/x", "\n".join([TEXTS[0][1]] * 50))]
    got = licences(spark, spark.createDataFrame(rows, "n int, path string, text string"))
    assert got == {0: ("MIT", "own"), 1: (None, None), 2: (None, None), 3: ("MIT", "own")}


def test_sql(spark):
    """Rows and cosines of the query and its SQL over whole texts with nulls, ties and repeats."""
    texts = [text for _, text, _, _ in FILES] * 3
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": ["en", None, "fr"] * len(FILES),
                         "source": ["a", "a", None, "b"] * (len(texts) // 4)})
    sent = [tuple(None if pd.isna(v) else v for v in row) for row in docs.itertuples(index=False)]
    files = license_scan.document_paths(spark.createDataFrame(sent, "doc_id long, text string, lang string, source string"))
    columns = ["doc_id", "path", "own_licence", "cosine", "licence", "origin"]
    found = license_scan.scan_licences(files, keep=("doc_id",)).select(columns).collect()
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(license_scan.oracle()).select(*columns).fetchall()
    assert sorted(map(tuple, found)) == sorted(want)
    assert sum(r["own_licence"] is not None for r in found) > 50
