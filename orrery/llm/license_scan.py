"""License scans: Dice coefficient over word bigrams against licence templates.

A document's segments are its lines, its paragraphs and the whole text, each
normalised to lower-case words.  Licences that end elsewhere, as those of
several paragraphs or amid prose, are found by runs of words: where a bigram of
a template's opening stands, as many words as the template has are compared
with it.  Of the runs from one word the one that shares most bigrams counts,
and of each licence that no segment matches the best run.  Dice is 2|A and B| / (|A| + |B|) over sets of
word bigrams.  It can't reach ``threshold`` unless |A| lies between
t/(2-t) and (2-t)/t times |B|: templates outside these bounds are not compared,
and segments that no template can match are dropped before they are cut.  Nor
can it unless so many of B's bigrams are there that some of any few of them
are: every text that can match holds one of the words in ``anchors``, and texts
and segments without these are not cut at all.

Defined results: null text has no segments; a segment of one word has no
bigrams and matches nothing; segments that repeat in a document count once;
of equal coefficients the template that comes first by name is the best, and of
equal runs the first; a run of words is given joined by blanks; equal rows give
equal rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import let

THRESHOLD = 0.8
WORDS = r"[^\p{L}\p{N}]+"
#: Words of at most so many letters are no anchors by themselves.
SHORT = 4
#: Which bigrams of a template, by place, start a run: some editions change the first words.
OPENING = (0, 2, 4)

# Wordings of public licences.
TEMPLATES = {
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring
        rights to this work.""",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_BSD_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
    OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_MIT_DISCLAIMER = """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
    TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
    TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
    SOFTWARE."""
_ISC_DISCLAIMER = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
    SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
    PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
    THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_NO_WARRANTY = "This program is distributed" + TEMPLATES["GPL-3.0-header"].split("This program is distributed")[1]
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
    version. """ + _NO_WARRANTY
_CC = {"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
TEMPLATES |= {
    "AGPL-3.0-header": _GNU.replace("GNU General", "GNU Affero General"),
    "BSD-2-Clause-disclaimer": TEMPLATES["BSD-2-Clause"] + _BSD_DISCLAIMER,
    "BSD-3-Clause": TEMPLATES["BSD-2-Clause"] + _BSD_3,
    "BSD-3-Clause-disclaimer": TEMPLATES["BSD-2-Clause"] + _BSD_3 + _BSD_DISCLAIMER,
    "ISC-disclaimer": TEMPLATES["ISC"] + _ISC_DISCLAIMER,
    "LGPL-2.1-header": _GNU.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "LGPL-3.0-header": _GNU.replace("GNU General", "GNU Lesser General"),
    "MIT-disclaimer": TEMPLATES["MIT"] + _MIT_DISCLAIMER,
}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _name = "-".join(["Attribution", *(_CC[k] for k in _kind.split("-")[1:])])
    TEMPLATES[f"CC-{_kind}-4.0-notice"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
    TEMPLATES[f"CC-{_kind}-4.0-short"] = f"Licensed under CC {_kind} 4.0."


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def openings(text: str) -> list[tuple[str, int]]:
    """Bigrams that start a run, with how many words of the template stand before them."""
    words = template_words(text)
    return [(f"{words[i]} {words[i + 1]}", i) for i in OPENING if i + 1 < len(words)]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold against ``size``."""
    return math.ceil(threshold / (2 - threshold) * size - 1e-9), math.floor((2 - threshold) / threshold * size + 1e-9)


def anchors(bodies: dict[str, list[str]], threshold: float) -> list[str]:
    """Words, or bigrams of short words, of which each text holds one that reaches the threshold against some template."""
    chosen: set[str] = set()
    for body in bodies.values():
        lo, _ = bounds(len(body), threshold)
        need = max(1, math.ceil(threshold * (lo + len(body)) / 2 - 1e-9))
        # one of any ``least`` bigrams is in a text that holds ``need``
        least = len(body) - need + 1
        left = [b for b in body if b not in chosen and not chosen.intersection(b.split())]
        while (missing := least - len(body) + len(left)) > 0:
            words = {w for b in left for w in b.split() if len(w) > SHORT} or set(left)
            chosen.add(max(words, key=lambda w: (min(missing, sum(w in (b, *b.split()) for b in left)), len(w), w)))
            left = [b for b in left if b not in chosen and not chosen.intersection(b.split())]
    return sorted(chosen)


def words_of(segment: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(segment), WORDS, " "), " "), "")


def bigrams_of(words: Column) -> Column:
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def run_starts(words: Column, templates: dict[str, str]) -> Column:
    """array<struct<k, at>>: which template may stand from which word on."""
    known = [(gram, k, back) for k, (_, text) in enumerate(sorted(templates.items())) for gram, back in openings(text)]
    if not known:
        return F.array().cast("array<struct<k:int,at:int>>")
    grams = sorted({gram for gram, _, _ in known})
    heads = sorted({gram.split()[0] for gram in grams})
    rows = F.array(*(F.struct(F.lit(g).alias("gram"), F.lit(k).alias("k"), F.lit(b).alias("back")) for g, k, b in known))

    def gram_at(i: Column) -> Column:
        return F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))

    places = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda i: F.when(F.get(words, i).isin(heads), gram_at(i).isin(grams)).otherwise(False))

    def from_hit(i: Column) -> Column:
        return let(
            gram_at(i),
            lambda g: F.transform(
                F.filter(rows, lambda r: r["gram"] == g),
                lambda r: F.struct(r["k"].alias("k"), F.greatest(i - r["back"], F.lit(0)).alias("at")),
            ),
        )

    return F.array_distinct(F.flatten(F.transform(hits, from_hit)))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """id and ``matches``: array<struct<dice, license, segment>>, the best first."""
    bodies = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    limits = [bounds(len(b), threshold) for b in bodies.values()]
    least, most = min(lo for lo, _ in limits), max(hi for _, hi in limits)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col), text.alias("_t"))
    segments = F.array_distinct(
        F.concat(F.split("_t", "\n"), F.split("_t", r"\n[\x20\t\r]*\n"), F.array(F.col("_t")))
    )

    marks = anchors(bodies, threshold)

    def marked(text: Column) -> Column:
        def holds(low: Column, word: str) -> Column:
            return low.rlike(word.replace(" ", WORDS)) if " " in word else F.contains(low, F.lit(word))

        return let(F.lower(text), lambda low: reduce(Column.__or__, (holds(low, w) for w in sorted(marks, key=len, reverse=True))))

    def best(grams: Column) -> Column:
        size = F.size(grams)
        scores = [
            F.when(
                size.between(*bounds(len(body), threshold)),
                F.struct(
                    (2.0 * F.size(F.array_intersect(grams, F.array(*map(F.lit, body)))) / (size + len(body))).alias("dice"),
                    F.lit(-k).alias("order"),
                    F.lit(name).alias("license"),
                ),
            )
            for k, (name, body) in enumerate(bodies.items())
        ]
        return F.array_max(F.array(*scores))

    def judged(segment: Column) -> Column:
        def over(words: Column) -> Column:
            # a set has fewer bigrams than its segment has words
            fits = F.size(words) > least
            return F.when(fits, let(bigrams_of(words), lambda g: F.when(F.size(g).between(least, most), best(g))))

        return F.when(marked(segment), let(words_of(segment), over))

    names = F.array(*map(F.lit, bodies))
    grams_of = F.array(*(F.array(*map(F.lit, body)) for body in bodies.values()))
    lengths = F.array(*(F.lit(len(template_words(text))) for _, text in sorted(templates.items())))

    def runs(words: Column) -> Column:
        """Each run that reaches the threshold: array<struct<shared, dice, order, at>>."""

        def compared(s: Column) -> Column:
            body = F.get(grams_of, s["k"])

            def with_body(g: Column) -> Column:
                shared = F.size(F.array_intersect(g, body))
                dice = 2.0 * shared / (F.size(g) + F.size(body))
                return F.struct(shared.alias("shared"), dice.alias("dice"), (-s["k"]).alias("order"), s["at"].alias("at"))

            return let(bigrams_of(F.slice(words, s["at"] + 1, F.get(lengths, s["k"]))), with_body)

        return F.filter(F.transform(run_starts(words, templates), compared), lambda r: r["dice"] >= threshold)

    def best_runs(words: Column, found: Column) -> Column:
        """Of each licence that ``found`` lacks the best run, as matches."""

        def chosen(every: Column) -> Column:
            from_word = lambda at: F.array_max(F.filter(every, lambda r: r["at"] == at))
            tops = F.transform(F.array_distinct(F.transform(every, lambda r: r["at"])), from_word)
            by_dice = F.transform(tops, lambda r: F.struct(r["dice"].alias("dice"), (-r["at"]).alias("back"), r["order"].alias("order")))

            def of_license(rs: Column) -> Column:
                orders = F.array_distinct(F.transform(rs, lambda r: r["order"]))
                return F.transform(orders, lambda o: F.array_max(F.filter(rs, lambda r: r["order"] == o)))

            return let(by_dice, of_license)

        def match(r: Column) -> Column:
            name = F.get(names, -r["order"])
            run = F.array_join(F.slice(words, 1 - r["back"], F.get(lengths, -r["order"])), " ")
            return F.struct(r["dice"].alias("dice"), r["order"].alias("order"), name.alias("license"), run.alias("segment"))

        new = F.filter(F.transform(let(runs(words), chosen), match), lambda m: ~F.exists(found, lambda f: f["license"] == m["license"]))
        return F.concat(found, new)

    def segment_matches(segments: Column) -> Column:
        scored = F.transform(segments, lambda s: F.struct(judged(s).alias("b"), s.alias("segment")))
        hits = F.filter(scored, lambda s: F.coalesce(s["b"]["dice"] >= threshold, F.lit(False)))
        return F.transform(
            hits, lambda s: F.struct(s["b"]["dice"].alias("dice"), s["b"]["order"].alias("order"), s["b"]["license"].alias("license"), s["segment"].alias("segment"))
        )

    none = F.array().cast("array<struct<dice:double,order:int,license:string,segment:string>>")
    whole = let(words_of(F.col("_t")), lambda words: let(segment_matches(segments), lambda found: best_runs(words, found)))
    matches = F.when(marked(F.col("_t")), whole).otherwise(none)
    return cut.select(id_col, F.sort_array(matches, asc=False).alias("matches"))


def op9_license_scan(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    first = F.get("matches", F.lit(0))
    return found.select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_segments"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
        first["license"].alias("best_license"),
        F.round(first["dice"], 9).alias("best_dice"),
    )


def op9_sql() -> str:
    """The same over the view ``documents``, in DuckDB's dialect."""
    rows = ", ".join(
        f"({-k}, '{name}', ['" + "', '".join(template_bigrams(text)) + f"'], {len(template_words(text))})"
        for k, (name, text) in enumerate(sorted(TEMPLATES.items()))
    )
    starts = ", ".join(f"('{name}', '{gram}', {back})" for name, text in sorted(TEMPLATES.items()) for gram, back in openings(text))
    return rf"""
WITH t(ord, license, grams, n) AS (VALUES {rows}),
o(license, gram, back) AS (VALUES {starts}),
seg AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)),
    string_split_regex(text, '\n[\x20\t\r]*\n'), [text]))) AS segment
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
w AS (
  SELECT doc_id, segment, list_filter(string_split(regexp_replace(lower(segment), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '),
    lambda x: x <> '') AS words FROM seg),
g AS (
  SELECT doc_id, segment, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams
  FROM w WHERE len(words) > 1),
s AS (
  SELECT doc_id, segment, max(struct_pack(d := 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)),
    o := ord, l := license)) AS b
  FROM g, t WHERE len(g.grams) BETWEEN 0.6 * len(t.grams) AND 1.7 * len(t.grams) GROUP BY ALL),
found AS (SELECT doc_id, b.d AS d, b.o AS o, b.l AS l FROM s WHERE b.d >= {THRESHOLD}),
wd AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '),
    lambda x: x <> '') AS words FROM documents),
pairs AS (
  SELECT doc_id, unnest(range(1, len(words))) AS p,
    unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram
  FROM wd WHERE len(words) > 1),
starts AS (SELECT DISTINCT doc_id, o.license, greatest(p - 1 - back, 0) AS w0 FROM pairs JOIN o USING (gram)),
runs AS (
  SELECT doc_id, license, ord, w0, t.grams, list_slice(words, w0 + 1, w0 + n) AS run
  FROM starts JOIN t USING (license) JOIN wd USING (doc_id)),
sets AS (
  SELECT doc_id, license, ord, w0, grams,
    list_distinct(list_transform(range(1, len(run)), lambda i: run[i] || ' ' || run[i + 1])) AS g FROM runs),
shared AS (SELECT *, len(list_intersect(g, grams)) AS n FROM sets),
tops AS (
  SELECT doc_id, w0, max(struct_pack(n := n, d := 2.0 * n / (len(g) + len(grams)), o := ord, l := license)) AS b
  FROM shared WHERE 2.0 * n / (len(g) + len(grams)) >= {THRESHOLD} GROUP BY doc_id, w0),
every AS (
  SELECT * FROM found UNION ALL
  SELECT doc_id, max(b.d), b.o, b.l FROM tops
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = tops.doc_id AND f.l = b.l) GROUP BY ALL),
m AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT l, ',' ORDER BY l) AS ls, max(struct_pack(d := d, o := o, l := l)) AS top
  FROM every GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_segments, coalesce(ls, '') AS licenses,
  top.l AS best_license, round(top.d, 9) AS best_dice
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id"""
