"""Licence scan: windows of the whole normalised text against licence templates by Dice coefficient.

Text is lower-cased and everything but letters and digits, line ends and comment
signs too, becomes one space.  A template of L word pairs is compared with the
windows that begin at one of its bigrams and end at the last of its bigrams within
L pairs, over sets of bigrams: ``2 * |A & B| / (|A| + |B|)``.

Pruning is exact.  A coefficient of at least t needs ``|A & B| >= t / (2 - t) *
|B|``.  So (1) a text must have one of any ``|B| - need + 1`` bigrams of the
template; the longest words' are taken, and a text without any such bigram of any
template is left at once; (2) it must have ``need`` bigrams of the template
somewhere, and (3) a window is only compared if the ``need``-th of the template's
bigrams from its start on lies in it.

All of it happens in one row's expressions, over lists that are gone through a
fixed number of times per template; nothing is shuffled.  Templates travel in the
plan.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_REST = 'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_GNU_REST = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."


def _gnu(what: str, kind: str, version: str, rest: bool = False) -> str:
    return " ".join((_GNU, _GNU_REST)[: 1 + rest]).format(what=what, kind=kind, version=version, colon=":")


#: Texts, notices and grants by which common licences are given.
TEMPLATES = [
    ("MIT", f"{_MIT_GRANT} {_MIT_REST}"),
    ("MIT", _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-3-Clause", _BSD_GRANT),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", f"{_ISC_GRANT} {_ISC_REST}"),
    ("ISC", _ISC_GRANT),
    ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _gnu("program", "General Public License", "3", rest=True)),
    ("GPL-3.0", _gnu("program", "General Public License", "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _gnu("program", "General Public License", "2", rest=True)),
    ("GPL-2.0", _gnu("program", "General Public License", "2")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", _gnu("library", "Lesser General Public License", "3", rest=True)),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1", rest=True)),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", _gnu("program", "Affero General Public License", "3", rest=True)),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
THRESHOLD = 0.8

_OTHER = r"[^\p{L}\p{N}]+"
_MATCH = "array<struct<shared:int,dice:double,template:int,start:int,pairs:int>>"


def template_words(text: str) -> list[str]:
    """A template's words, normalised as texts are."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _template(number: int, text: str, threshold: float) -> tuple[int, list[str], int, int] | None:
    """Number, sorted distinct bigrams, pairs, and the bigrams that a match has to share."""
    words = template_words(text)
    bigrams = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    return (number, bigrams, len(words) - 1, math.ceil(len(bigrams) * threshold / (2 - threshold) - 1e-9)) if bigrams else None


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(b: Column, t: Column, threshold: float) -> Column:
    """Of the windows of bigrams ``b`` that match template ``t`` the best one, in an array."""
    empty = F.array().cast(_MATCH)

    def of_common(common: Column) -> Column:
        at = F.transform(b, lambda x, i: F.when(F.array_contains(common, x), i))
        return F.when(F.size(common) >= t["need"], _let(F.filter(at, lambda i: i.isNotNull()), lambda hits: of_hits(common, hits))).otherwise(empty)

    def of_hits(common: Column, hits: Column) -> Column:
        begins = F.filter(F.transform(hits, lambda i, k: F.struct(i.alias("i"), k.alias("k"))), lambda s: F.get(hits, s["k"] + t["need"] - 1) < s["i"] + t["pairs"])

        def spanned(s: Column) -> Column:
            end = F.array_max(F.filter(F.slice(hits, s["k"] + 1, t["pairs"]), lambda h: h < s["i"] + t["pairs"]))
            return _let(end, lambda e: F.struct(s["i"].alias("i"), F.slice(b, s["i"] + 1, e - s["i"] + 1).alias("w")))

        def scored(x: Column) -> Column:
            shared = F.size(F.array_intersect(common, x["w"]))
            return _let(shared, lambda n: F.struct(n.alias("shared"), (2.0 * n / (F.size(F.array_distinct(x["w"])) + F.size(t["bigrams"]))).alias("dice"), (-t["number"]).alias("template"), (-x["i"]).alias("start"), F.size(x["w"]).alias("pairs")))

        good = F.filter(F.transform(begins, lambda s: _let(spanned(s), scored)), lambda m: m["dice"] >= threshold)
        return _let(F.array_max(good), lambda m: F.when(m.isNotNull(), F.array(m)).otherwise(empty).cast(_MATCH))

    return _let(F.array_intersect(t["bigrams"], b), of_common)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, start, n_words, n_licenses and matches per row of ``docs`` (doc_id, text, ...).

    matches has, for every template that some window matches, its best window:
    shared bigrams, coefficient, template (number), start (word, from 0) and
    n_words.  Better is what shares more bigrams, then what has the higher
    coefficient, then the template listed first, then the earlier window; license
    and the columns after it are those of the best match, null without any, and
    n_licenses is the number of licences that match.  Null and empty texts match
    nothing.  A template without two words is never matched.  Repeated rows are
    returned as often as they come; other columns are ignored; an empty table
    gives an empty result.  Whole texts are read whatever their length.
    """
    templates = TEMPLATES if templates is None else list(templates)
    known = [t for i, (_, text) in enumerate(templates) if (t := _template(i, text, threshold))]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    empty = F.array().cast(_MATCH)
    matches = empty
    if known:
        table = F.array(*[F.struct(F.lit(n).alias("number"), F.array(*map(F.lit, bigrams)).alias("bigrams"), F.lit(pairs).alias("pairs"), F.lit(need).alias("need")) for n, bigrams, pairs, need in known])
        probes = sorted({b for _, bigrams, _, need in known for b in sorted(bigrams, key=lambda x: (-len(x), x))[: len(bigrams) - need + 1]})
        words = F.split(F.trim(F.regexp_replace(F.lower("text"), _OTHER, " ")), " ")

        def pairs_of(w: Column) -> Column:
            return F.slice(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y)), 1, F.size(w) - 1)

        def scan(b: Column) -> Column:
            found = F.flatten(F.transform(table, lambda t: _windows(b, t, threshold)))
            return F.when(F.arrays_overlap(b, F.array(*map(F.lit, probes))), found).otherwise(empty)

        matches = _let(_let(words, pairs_of), scan)
    rows = rows.select("doc_id", F.transform(F.sort_array(matches, asc=False), lambda m: F.struct(m["shared"].alias("shared"), m["dice"].alias("dice"), (-m["template"]).alias("template"), (-m["start"]).alias("start"), (m["pairs"] + 1).alias("n_words"))).alias("matches"))
    names = F.array(*[F.lit(n) for n, _ in templates]) if templates else F.array(F.lit(None).cast("string"))
    best = F.get("matches", F.lit(0))
    licences = F.size(F.array_distinct(F.transform("matches", lambda m: F.get(names, m["template"])))).cast("long")
    return rows.select("doc_id", F.get(names, best["template"]).alias("license"), F.round(best["dice"], 6).alias("dice"), best["start"].cast("long").alias("start"), best["n_words"].cast("long").alias("n_words"), licences.alias("n_licenses"), "matches")


def license_report(docs: DataFrame) -> DataFrame:
    """``scan_licenses`` of the fixed templates without the list of matches."""
    return scan_licenses(docs).drop("matches")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def licenses_sql(templates: list[tuple[str, str]] | None = None) -> str:
    """DuckDB SQL for ``license_report`` of the table documents."""
    values = ", ".join(f"({i}, {_sql_text(n)}, {_sql_text(t)})" for i, (n, t) in enumerate(TEMPLATES if templates is None else templates))
    return f"""
WITH templates(template, license, body) AS (VALUES {values}),
tw AS (SELECT template, license, string_split(trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM templates),
tb AS (SELECT DISTINCT template, w[i] || ' ' || w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tw)),
ts AS (SELECT template, license, len(w) - 1 AS pairs, size FROM tw JOIN (SELECT template, count(*) AS size FROM tb GROUP BY ALL) USING (template)),
docs AS (SELECT row_number() OVER () AS n, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
db AS (SELECT n, i - 1 AS i, w[i] || ' ' || w[i + 1] AS b FROM (SELECT n, w, unnest(range(1, len(w))) AS i FROM docs)),
hits AS (SELECT n, template, i, b FROM db JOIN tb USING (b)),
enough AS (SELECT n, template FROM hits JOIN ts USING (template) GROUP BY n, template, size HAVING count(DISTINCT b) >= ceil(size * 0.8 / 1.2 - 1e-9)),
mine AS (SELECT h.* FROM hits h JOIN enough USING (n, template)),
spans AS (SELECT s.n, s.template, s.i, max(e.i) AS upto, count(DISTINCT e.b) AS shared
  FROM mine s JOIN ts USING (template) JOIN mine e ON e.n = s.n AND e.template = s.template AND e.i >= s.i AND e.i < s.i + ts.pairs GROUP BY ALL),
near AS (SELECT s.* FROM spans s JOIN ts USING (template) WHERE shared >= ceil(size * 0.8 / 1.2 - 1e-9)),
scored AS (SELECT n, s.template, s.i, upto, shared, count(DISTINCT db.b) AS size FROM near s JOIN db USING (n) WHERE db.i BETWEEN s.i AND upto GROUP BY ALL),
found AS (SELECT s.*, license, 2.0::DOUBLE * shared / (s.size + ts.size) AS dice FROM scored s JOIN ts USING (template)),
best AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY shared DESC, dice DESC, template, i) AS k FROM found WHERE dice >= 0.8),
counts AS (SELECT n, count(DISTINCT license)::BIGINT AS n_licenses FROM best GROUP BY n)
SELECT doc_id, license, round(dice, 6) AS dice, b.i::BIGINT AS start, (upto - b.i + 2)::BIGINT AS n_words, coalesce(n_licenses, 0)::BIGINT AS n_licenses
FROM docs LEFT JOIN best b ON b.n = docs.n AND k = 1 LEFT JOIN counts c ON c.n = docs.n
"""
