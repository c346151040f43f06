"""Licence recognition by sentence rules: known sentences become identifiers, identifier sequences meet ordered rules.

A text is cut into atoms at line ends and sentence marks; of each atom the letters and digits stay, lower-cased,
and everything else (comment signs, quotes, dashes) becomes one space. A known sentence is found where its
words begin with an atom and end with one, whatever line ends and marks lie between: so hard-wrapped notices,
abbreviations and one-line notices are recognised alike. At each atom the longest known sentence counts, and the search goes on
behind it; unknown atoms drop out. The rules are tried in order: a rule whose identifiers follow one another
takes them out of the sequence and leaves a gap, so that a longer rule placed first hides the shorter ones it contains and
neighbours of a gap do not meet. An SPDX line names its licences by an expression, whose identifiers join the sequence
one by one. That all rights are reserved counts only where nothing else is found.

Defined cases: null or empty text has no sentence and no licence. A very long text is scanned whole, by one task.
Rows keep their ids as they are; repeated rows get the same answer. ``scan_licenses`` overwrites input columns called like its results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import pick, small_batches

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}"
_SAME = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; {}"
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; {}"
_LATER = "either version {} of the License, or (at your option) any later version."
# Identifier and sentence, as the licences' own texts and usual notices have it.
SENTENCES = [
    ("apache2", "Licensed under the Apache License, Version 2.0"),
    ("apache2", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache2", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apacheUse", "you may not use this file except in compliance with the License."),
    ("apacheCopy", "You may obtain a copy of the License at"),
    ("apacheAsIs", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apacheLimits", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "The MIT License (MIT)"),
    ("mit", "MIT License"),
    ("apache2", "Apache License Version 2.0"),
    ("apache2", "Apache License Version 2.0, January 2004"),
    ("mitGrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mitAsIs", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mitLiable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsdUse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsdNames", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsdNames", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsdNames", "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd3", "BSD 3-Clause License"),
    ("bsd2", "BSD 2-Clause License"),
    ("bsd3", "Licensed under the BSD 3-Clause License."),
    ("bsd2", "Licensed under the BSD 2-Clause License."),
    ("iscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("iscGrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Licensed under the ISC License."),
    ("gpl3Later", _GNU.format("General Public License", _LATER.format(3))),
    ("gpl3Only", _GNU.format("General Public License", "version 3 of the License.")),
    ("gpl3Only", _GNU.format("General Public License", "version 3.")),
    ("gpl2Later", _SAME.format("General Public License", _LATER.format(2))),
    ("gpl2Only", _SAME.format("General Public License", "version 2 of the License.")),
    ("gpl2Only", _SAME.format("General Public License", "version 2.")),
    ("gpl2Only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl2Only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    ("gpl3Only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("agpl3Later", _GNU.format("Affero General Public License", _LATER.format(3))),
    ("lgpl3Later", _GNU.format("Lesser General Public License", _LATER.format(3))),
    ("lgpl21Later", _LIBRARY.format("Lesser General Public License", _LATER.format("2.1"))),
    ("gnuHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gnuHope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3", "Licensed under the GNU General Public License, version 3."),
    ("gpl2", "Licensed under the GNU General Public License, version 2."),
    ("lgpl3", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl21", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl3", "Licensed under the GNU Affero General Public License, version 3."),
    ("orLater", "or (at your option) any later version."),
    ("mpl2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2", "Mozilla Public License Version 2.0"),
    ("mpl2", "Mozilla Public License, v. 2.0"),
    ("mplCopy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mplCopy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mplCopy", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("unlicenseFree", "This is free and unencumbered software released into the public domain."),
    ("unlicenseAnyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boostGrant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("ccBySa4", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("ccByNc4", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("ccByNd4", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("ccByNcSa4", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("ccBy4", "Creative Commons Attribution 4.0 International"),
    ("ccBySa4", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("ccBy4", "Creative Commons Attribution 4.0 International License"),
    ("ccByNcSa4", "Licensed under CC BY-NC-SA 4.0."),
    ("ccByNc4", "Licensed under CC BY-NC 4.0."),
    ("ccBySa4", "Licensed under CC BY-SA 4.0."),
    ("ccByNd4", "Licensed under CC BY-ND 4.0."),
    ("ccBy4", "Licensed under CC BY 4.0."),
    ("ccBySa4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ccByNc4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("ccBy4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "Released under CC0 1.0."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("allRights", "All rights reserved."),
]
# Licence and its identifiers in order; earlier rules first.
RULES = [
    ("Apache-2.0", ("apache2", "apacheUse", "apacheCopy", "apacheAsIs", "apacheLimits")),
    ("Apache-2.0", ("apache2", "apacheUse", "apacheCopy")),
    ("Apache-2.0", ("apache2", "apacheUse")),
    ("MIT", ("mit", "mitGrant", "mitNotice", "mitAsIs", "mitLiable")),
    ("MIT", ("mitGrant", "mitNotice", "mitAsIs", "mitLiable")),
    ("MIT", ("mitGrant", "mitNotice")),
    ("BSD-3-Clause", ("bsdUse", "bsdSource", "bsdBinary", "bsdNames")),
    ("BSD-2-Clause", ("bsdUse", "bsdSource", "bsdBinary")),
    ("GPL-3.0-or-later", ("gpl3", "orLater")),
    ("GPL-2.0-or-later", ("gpl2", "orLater")),
    ("LGPL-3.0-or-later", ("lgpl3", "orLater")),
    ("LGPL-2.1-or-later", ("lgpl21", "orLater")),
    ("AGPL-3.0-or-later", ("agpl3", "orLater")),
    ("GPL-3.0-or-later", ("gpl3Later", "gnuHope")),
    ("GPL-2.0-or-later", ("gpl2Later", "gnuHope")),
    ("AGPL-3.0-or-later", ("agpl3Later", "gnuHope")),
    ("LGPL-3.0-or-later", ("lgpl3Later", "gnuHope")),
    ("LGPL-2.1-or-later", ("lgpl21Later", "gnuHope")),
    ("MPL-2.0", ("mpl2", "mplCopy")),
    ("Unlicense", ("unlicenseFree", "unlicenseAnyone")),
    ("Apache-2.0", ("apache2",)),
    ("MIT", ("mit",)),
    ("MIT", ("mitGrant",)),
    ("GPL-3.0-or-later", ("gpl3Later",)),
    ("GPL-2.0-or-later", ("gpl2Later",)),
    ("AGPL-3.0-or-later", ("agpl3Later",)),
    ("LGPL-3.0-or-later", ("lgpl3Later",)),
    ("LGPL-2.1-or-later", ("lgpl21Later",)),
    ("GPL-3.0-only", ("gpl3Only",)),
    ("GPL-2.0-only", ("gpl2Only",)),
    ("GPL-3.0-only", ("gpl3",)),
    ("GPL-2.0-only", ("gpl2",)),
    ("LGPL-3.0-only", ("lgpl3",)),
    ("LGPL-2.1-only", ("lgpl21",)),
    ("AGPL-3.0-only", ("agpl3",)),
    ("MPL-2.0", ("mpl2",)),
    ("EPL-2.0", ("epl2",)),
    ("BSD-3-Clause", ("bsd3",)),
    ("BSD-2-Clause", ("bsd2",)),
    ("BSD-unversioned", ("bsdUse",)),
    ("ISC", ("iscGrant",)),
    ("ISC", ("isc",)),
    ("BSL-1.0", ("boostGrant",)),
    ("BSL-1.0", ("boost",)),
    ("Unlicense", ("unlicenseFree",)),
    ("CC-BY-NC-SA-4.0", ("ccByNcSa4",)),
    ("CC-BY-NC-4.0", ("ccByNc4",)),
    ("CC-BY-SA-4.0", ("ccBySa4",)),
    ("CC-BY-ND-4.0", ("ccByNd4",)),
    ("CC-BY-4.0", ("ccBy4",)),
    ("CC0-1.0", ("cc0",)),
    ("Proprietary", ("allRights",)),
]
RESERVED = "Proprietary"  # counts only where no licence is found: most licensed files reserve rights as well
# Licences and exceptions that an SPDX line may name.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 "
    "CC-BY-NC-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only "
    "LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL Unlicense UPL-1.0 WTFPL Zlib"
).split()
EXCEPTIONS = "Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note OpenSSL-exception".split()
RULES += [(licence, (f"spdx:{licence}",)) for licence in SPDX]
SPLIT = r"[.!?;:][ \t]+|[.!?;:]?[\r\n]+"
_split = re.compile(SPLIT)
_other = re.compile(r"[^A-Za-z0-9]+")


def normalise(sentence: str) -> str:
    return _other.sub(" ", sentence).strip(" ").lower()


SPDX_WORDS = "spdx license identifier"
SPDX_BY_WORDS = {normalise(licence): licence for licence in SPDX}
_longest = lambda texts: "|".join(sorted(texts, key=lambda t: (-len(t), t)))
SPDX_TERM = rf"(?:{_longest(SPDX_BY_WORDS)})(?: with (?:{_longest(map(normalise, EXCEPTIONS))}))?"
_expression = re.compile(rf"{SPDX_TERM}(?: (?:or|and) {SPDX_TERM})*")
_named = re.compile(rf"(?:^|(?<= )){SPDX_TERM}(?= |$)")


def spdx_ids(expression: str) -> list[str]:
    """Identifiers of the licences that a normalised expression joins by OR and AND, exceptions left out; none if it holds anything else."""
    if not _expression.fullmatch(expression):
        return []
    return [f"spdx:{SPDX_BY_WORDS[term.split(' with ')[0]]}" for term in _named.findall(expression)]


class Known:
    """Known sentences by their words: those that begin with the same word stand together, longest first."""

    def __init__(self, sentences):
        self.by_first: dict[str, list[tuple[list[str], str]]] = {}
        for name, text in sentences:
            words = normalise(text).split(" ")
            if words != [""]:
                self.by_first.setdefault(words[0], []).append((words, name))
        for held in self.by_first.values():
            held.sort(key=lambda x: -len(x[0]))
        first = "|".join(sorted(map(re.escape, [*self.by_first, "spdx"]), key=len, reverse=True))
        self.start = re.compile(rf"[^A-Za-z0-9]*(?:{first})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)

    def ids(self, text: str) -> list[str]:
        """Identifiers of the known sentences in order."""
        atoms = _split.split(text)
        words: list[list[str] | None] = [None] * len(atoms)

        def of(k: int) -> list[str]:
            if words[k] is None:
                words[k] = normalise(atoms[k]).split()
            return words[k]

        found, k = [], 0
        while k < len(atoms):
            end = 0
            if self.start.match(atoms[k]):  # other atoms begin no known sentence
                if " ".join(of(k)[:3]) == SPDX_WORDS:
                    inside = len(of(k)) > 3
                    named = spdx_ids(" ".join(of(k)[3:] if inside else of(k + 1) if k + 1 < len(atoms) else []))
                    if named:
                        found += named
                        end = k + (1 if inside else 2)
                for wanted, name in self.by_first.get(of(k)[0], ()):
                    end = self._end(of, k, len(atoms), wanted)
                    if end:
                        found.append(name)
                        break
            k = end or k + 1
        return found

    @staticmethod
    def _end(of, k: int, n: int, wanted: list[str]) -> int:
        """The atom behind the sentence ``wanted`` that begins with atom k, or 0."""
        at = 0
        while k < n:
            part = of(k)
            if wanted[at : at + len(part)] != part:
                return 0
            at += len(part)
            k += 1
            if at == len(wanted):
                return k
        return 0


def licences_of(ids: list[str], rules) -> list[str]:
    """Licences in the order of the rules that took their identifiers."""
    left, found = "".join(f"<{i}>" for i in ids), []
    for licence, wanted in rules if ids else ():
        run = "".join(f"<{i}>" for i in wanted)
        if run in left:
            left = left.replace(run, "|")  # a gap: what lay around it does not meet
            if licence not in found:
                found.append(licence)
    return found if found == [RESERVED] else [x for x in found if x != RESERVED]


def scan(text: str | None, known: Known, rules) -> tuple[list[str], list[str]]:
    ids = known.ids(text) if text else []
    return ids, licences_of(ids, rules)


def scan_licenses(docs: DataFrame, sentences=SENTENCES, rules=RULES) -> DataFrame:
    """``docs`` with sentence_ids array<string> and licenses array<string>; input columns of these names give way."""
    small_batches(docs.sparkSession)

    @pandas_udf("sentence_ids array<string>, licenses array<string>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known(sentences)
        for batch in texts:
            yield pd.DataFrame([scan(t, known, rules) for t in batch], columns=["sentence_ids", "licenses"])

    names = [c for c in docs.columns if c.lower() not in ("sentence_ids", "licenses")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), of(F.col("text")).alias("scan"))
    return held.select(*[F.col(f"row.`{c}`") for c in names], "scan.*")


def digest(docs: DataFrame) -> DataFrame:
    found = scan_licenses(pick(docs, "doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def digest_sql() -> str:
    """Atoms as <words>, known sentences as patterns over them, and the rules unrolled in order."""
    known = {normalise(text): name for name, text in SENTENCES}
    longest = sorted(known, key=lambda t: (-len(t.split()), t))
    pattern = "|".join(t.replace(" ", "(?: |><)") for t in longest)
    names = ", ".join(f"('{t}', '{known[t]}')" for t in longest)
    order = [r for r in RULES if r[0] != RESERVED] + [r for r in RULES if r[0] == RESERVED]
    runs = ["".join(f"<{i}>" for i in wanted) for _, wanted in order]
    pattern += f"|{SPDX_WORDS}(?: |><){_expression.pattern}"
    spdx = ", ".join(f"('{w}', 'spdx:{licence}')" for w, licence in SPDX_BY_WORDS.items())
    steps = ",\n".join(f"r{k + 1} AS (SELECT *, replace(left{k}, '{run}', '|') AS left{k + 1}, CASE WHEN contains(left{k}, '{run}') THEN '{lic}' END AS hit{k + 1} FROM r{k})" for k, ((lic, _), run) in enumerate(zip(order, runs)))
    hits = ", ".join(f"hit{k + 1}" for k in range(len(RULES)))
    return f"""
WITH known(sentence, name) AS (VALUES {names}),
marked AS (SELECT doc_id, replace(regexp_replace(regexp_replace(text, '{SPLIT}', chr(1), 'g'), '[^A-Za-z0-9' || chr(1) || ']+', ' ', 'g'), chr(1), ' > < ') AS t FROM documents),
atoms AS (SELECT doc_id, lower(replace(replace(regexp_replace(regexp_replace('< ' || t || ' >', '< *(> *< *)*', '<', 'g'), '(>| )+$', '>', 'g'), ' >', '>'), '> ', '>')) AS t FROM marked),
each_one AS (SELECT doc_id, unnest(found) AS part, generate_subscripts(found, 1) AS pos FROM (
  SELECT doc_id, regexp_extract_all(regexp_replace(t, ' *([<>]) *', '\\1', 'g'), '<(?:{pattern})>') AS found FROM atoms)),
spdx(words, name) AS (VALUES {spdx}),
terms AS (SELECT doc_id, pos, unnest(found) AS term, generate_subscripts(found, 1) AS sub FROM (SELECT doc_id, pos,
  regexp_extract_all(replace(part[2:-2], '><', ' ')[{len(SPDX_WORDS) + 2}:], '{SPDX_TERM}') AS found FROM each_one WHERE starts_with(part, '<{SPDX_WORDS}'))),
named AS (SELECT doc_id, pos, 0 AS sub, name FROM each_one JOIN known ON sentence = replace(part[2:-2], '><', ' ')
  UNION ALL SELECT doc_id, pos, sub, name FROM terms JOIN spdx ON words = string_split(term, ' with ')[1]),
seqs AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY pos, sub) AS ids, string_agg('<' || name || '>', '' ORDER BY pos, sub) AS left0 FROM named GROUP BY doc_id),
r0 AS (SELECT * FROM seqs),
{steps}
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(list_distinct_ordered, ','), '') AS licenses
FROM documents d LEFT JOIN (
  SELECT doc_id, n, ids, list_filter(hits, lambda x, i: x IS NOT NULL AND list_position(hits, x) = i AND (x <> '{RESERVED}' OR len(list_filter(hits, lambda y: y IS NOT NULL)) = 1)) AS list_distinct_ordered
  FROM (SELECT *, [{hits}] AS hits FROM r{len(RULES)})
) USING (doc_id)
"""
