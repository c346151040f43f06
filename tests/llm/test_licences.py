"""Licence recognition on the licences' own texts, wrapped and commented, and against the SQL form."""

from __future__ import annotations

import random
import textwrap

import duckdb
import pytest

from corvane.llm import licenses

KNOWN = licenses.Known(licenses.SENTENCES)
MIT = """MIT License

Copyright (c) 2020 A. N. Author

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark2} either version {n} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
TEXTS = [
    (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"),
    (GPL.format(mark=":", mark2=",", name="General Public License", n=3), "GPL-3.0-or-later"),
    (GPL.format(mark=";", mark2=";", name="General Public License", n=2), "GPL-2.0-or-later"),
    (GPL.format(mark=":", mark2=",", name="Affero General Public License", n=3), "AGPL-3.0-or-later"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
]


def shapes(text):
    paragraphs = text.split("\n\n")
    for width in (40, 72):
        yield (wrapped := "\n\n".join(textwrap.fill(p, width) for p in paragraphs))
        yield "\n".join(f" * {line}" for line in wrapped.split("\n"))
        yield "\r\n".join(f"# {line}" for line in wrapped.split("\n"))
    yield " ".join(p if p[-1] in ".:" else f"{p}." for p in paragraphs)  # a title needs a mark where it has no line


@pytest.mark.parametrize("text,licence", TEXTS, ids=[x for _, x in TEXTS])
def test_real_notices_in_all_shapes(text, licence):
    assert licenses.scan(text, KNOWN, licenses.RULES)[1] == [licence]
    for shape in shapes(text):
        found = licenses.scan(f"Some words before it.\n{shape}\nint main() {{ return 0; }}", KNOWN, licenses.RULES)[1]
        assert found == [licence]


def test_sentences_begin_and_end_with_atoms():
    scan = lambda t: licenses.scan(t, KNOWN, licenses.RULES)
    assert scan("it is released under the MIT License.") == ([], [])
    assert scan("Released under the MIT License and others.") == ([], [])
    assert scan("Released under\nthe MIT\nLicense") == (["mit"], ["MIT"])
    assert scan(None) == scan("") == scan(" .;\n") == ([], [])


def test_gaps_and_given_sentences():
    # a run taken out keeps its neighbours apart
    text = "Licensed under the GNU General Public License, version 3.\n" + APACHE + "\nor (at your option) any later version."
    assert licenses.scan(text, KNOWN, licenses.RULES)[1] == ["Apache-2.0", "GPL-3.0-only"]
    own = licenses.Known([("x", "Grant of all uses"), ("y", "Grant of all")])
    rules = [("X-Y", ("x", "y")), ("Y", ("y",))]
    assert licenses.scan("Grant of all uses. Grant\nof all.", own, rules) == (["x", "y"], ["X-Y"])
    assert licenses.scan("anything", licenses.Known([]), rules) == ([], [])


def test_query_against_sql(spark):
    rng = random.Random(4)
    words = [licenses.normalise(t) for _, t in licenses.SENTENCES]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            ws = rng.choice(words).split(" ")
            ws = [w + rng.choice(["", "", "", ",", ".", ";", "\n", "\n * ", " . "]) for w in (ws if rng.random() < 0.8 else ws[:-1])]
            parts.append(" ".join(ws) + rng.choice([". ", "\n", " ", "\n\n", "; "]))
        rows.append((i, "".join(parts), "x"))
    rows += [(1000 + k, t, None) for k, (t, _) in enumerate(TEXTS)] + [(2000, None, ""), (2001, "", ""), (2002, ".\n;\n", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()
    con.register("documents", frame)
    assert sorted(map(tuple, licenses.digest(docs).collect())) == sorted(con.execute(licenses.digest_sql()).fetchall())
    assert licenses.scan_licenses(docs).columns == ["doc_id", "text", "sentence_ids", "licenses"]


BSD_FILE = """Copyright (c) 2021, The Authors
All rights reserved.

""" + BSD3 + """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (BSD_FILE, ["BSD-3-Clause"]),
        ("Copyright 2020 A. Firm. All rights reserved.", ["Proprietary"]),
        ("All rights reserved.\nLicensed under the MIT License.", ["MIT"]),
        ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]),
        ("/* SPDX-License-Identifier: Apache-2.0 OR MIT */", ["Apache-2.0", "MIT"]),
        ("# SPDX-License-Identifier:(GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause", ["BSD-3-Clause", "GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: GPL-2.0-only\nAll rights reserved.", ["GPL-2.0-only"]),
        ("SPDX-License-Identifier: Unknown-1.0", []),
        ("SPDX-License-Identifier: MIT and more", []),
        ("SPDX-License-Identifier", []),
        ("Creative Commons Attribution 4.0 International", ["CC-BY-4.0"]),
        ("Mozilla Public License Version 2.0\n==================", ["MPL-2.0"]),
        ("                                 Apache License\n                           Version 2.0, January 2004\n", ["Apache-2.0"]),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.", ["GPL-2.0-only"]),
        ("", []),
        (None, []),
    ],
)
def test_notices(text, found):
    assert sorted(licenses.scan(text, KNOWN, licenses.RULES)[1]) == found


def by_hand(text):
    """The definition read off a string of atoms: at each atom the longest known run of words that ends with one."""
    import re

    norm = lambda s: " ".join(re.findall("[a-z0-9]+", re.sub("[^\\x00-\\x7f]", " ", s).lower()))
    atoms = [norm(a).split() for a in re.split(r"[.!?;:][ \t]+|[.!?;:]?[\r\n]+", text or "")]
    known = {tuple(norm(s).split()): name for name, s in licenses.SENTENCES}
    spdx = {norm(x): f"spdx:{x}" for x in licenses.SPDX}
    exceptions = {norm(x) for x in licenses.EXCEPTIONS}
    ids, k = [], 0
    while k < len(atoms):
        best, took = 0, None
        for end in range(k + 1, len(atoms) + 1) if atoms[k] else ():
            words = tuple(w for a in atoms[k:end] for w in a)
            if len(words) > 200:
                break
            if words in known and atoms[end - 1] and (took is None or len(words) > best):
                best, took = len(words), ([known[words]], end)
            head = " ".join(words[:3]) == "spdx license identifier"
            if head and len(words) > 3 and (end == k + 1 or len(atoms[k]) == 3 and end == k + 2):
                parts, left = [], " ".join(words[3:])
                while left:
                    hit = max((n for n in spdx if left == n or left.startswith(n + " ")), key=len, default=None)
                    if hit is None:
                        break
                    parts.append(spdx[hit])
                    left = left[len(hit) :].strip()
                    if left.startswith("with "):
                        hit = next((e for e in exceptions if left[5:] == e or left[5:].startswith(e + " ")), None)
                        if hit is None:
                            break
                        left = left[5 + len(hit) :].strip()
                    if left and not left.startswith(("or ", "and ")):
                        break
                    left = left.split(" ", 1)[1] if left else left
                if parts and not left:
                    took = (parts, end)
        if took:
            ids += took[0]
            k = took[1]
        else:
            k += 1
    return ids


def test_scan_against_its_definition():
    rng = random.Random(12)
    pool = [s for _, s in licenses.SENTENCES] + ["SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0 OR GPL-2.0-or-later WITH GCC-exception-3.1", "SPDX-License-Identifier: MIT or", "Some prose", "é", "2.0", "All rights", "MIT License extra"]
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice(["\n", ". ", " ", "\n * ", "; ", "\r\n\r\n"]) for _ in range(rng.randrange(0, 7)))
        text = text if rng.random() < 0.5 else textwrap.fill(text, 50)
        assert KNOWN.ids(text) == by_hand(text), text


def test_very_long_and_repeated_texts(spark):
    text = "prose and more prose. " * 40_000 + "\nLicensed under the MIT License.\n" + "x" * 200_000
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 1)], "doc_id long, text string, licenses int")
    assert [(r.doc_id, r.licenses) for r in licenses.digest(docs).orderBy("doc_id").collect()] == [(1, "MIT"), (1, "MIT"), (2, "")]
