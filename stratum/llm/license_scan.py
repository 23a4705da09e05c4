"""License scans: lines of a text compared with licence notices by the Dice coefficient of word bigrams.

Built-in expressions only, and no shuffle: a text's lines stay in its row.  With ``a`` bigrams in a
line and ``b`` in a template the coefficient is at most ``2 min(a, b) / (a + b)``, so only lines of
``b t / (2 - t)`` to ``b (2 - t) / t`` bigrams are compared with a template at all, and lines that no
template's bounds admit are dropped before their bigrams are made.

Null and empty texts, and texts without a line like a template, have a null licence and coefficient
and no matches.  Of templates with equal coefficients the first in ``TEMPLATES`` wins.  Rows are
judged each for itself; other columns play no part.

``scan`` compares line by line, as its SQL does.  ``scan_texts`` compares the whole normalised text,
line breaks included, with ``TEMPLATES`` and ``FULL``, so wrapped notices and notices within longer
sentences are found.  Its unit is the window: a run of neighbouring bigrams that begins and ends with
bigrams of the template and has at most ``(2 - t) / t`` times as many as the template's text.  (What
stands outside such an end could only lower the coefficient.)  In a window, repeats of a template's
bigram count once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import picked

THRESHOLD = 0.8
#: Usual short notices (fixed values), by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("LGPL-2.1-only", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
)
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_GPL = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
#: Longer notices and whole licences, for ``scan_texts``.
FULL = (
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-3-Clause", _TWO + _THREE + _AS_IS),
    ("BSD-2-Clause", _TWO + _AS_IS),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("GPL-2.0-or-later", _GPL.format(2)),
    ("GPL-3.0-or-later", _GPL.format(3)),
)


def template_bigrams(text: str) -> list[str]:
    """The different word bigrams of a template."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(b: int, t: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a line whose coefficient with b bigrams can reach t."""
    return math.ceil(b * t / (2 - t) - 1e-9), math.floor(b * (2 - t) / t + 1e-9)


def matches(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """For each line that is like a template: (dice, number of the template counted down, license)."""
    grams = [template_bigrams(t) for _, t in templates]
    limits = [bounds(len(g), threshold) for g in grams]
    fewest, most = min(lo for lo, _ in limits), max(hi for _, hi in limits)
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\n]+", " ")
    lines = F.transform(F.split(plain, "\n"), lambda line: F.split(F.trim(line), " "))
    # a line of n different bigrams has n + 1 words at least; repeats may add more, so only the lower bound prunes words
    lines = F.filter(lines, lambda w: F.size(w) > fewest)
    pairs = F.transform(lines, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))))
    pairs = F.filter(pairs, lambda g: F.size(g).between(fewest, most))

    def best(line: Column) -> Column:
        def dice(k: int) -> Column:
            common = F.size(F.array_intersect(line, F.array(*map(F.lit, grams[k]))))
            value = F.lit(2.0) * common / (F.size(line) + len(grams[k]))
            # outside its bounds a template isn't compared
            return F.struct(F.when(F.size(line).between(*limits[k]), value).otherwise(0.0).alias("dice"), F.lit(-k).alias("order"), F.lit(templates[k][0]).alias("license"))

        return F.array_max(F.array(*map(dice, range(len(templates)))))

    return F.filter(F.transform(pairs, best), lambda m: m["dice"] >= threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of ``docs``: its id, ``license`` and ``dice`` of the best line, and ``n_matches``, the lines like a template."""
    rows = picked(docs, id_col, text_col).select("id", matches(F.col("text"), templates, threshold).alias("found"))
    rows = rows.select("id", F.array_max("found").alias("best"), F.size("found").cast("bigint").alias("n_matches"))
    return rows.select(F.col("id").alias(id_col), F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), "n_matches")


def anchors(grams: list[str], t: float = THRESHOLD) -> list[str]:
    """Words of which a text like a template has one at least: more of its bigrams have them than may be missing."""
    spare = len(grams) - bounds(len(grams), t)[0]
    out, touched = [], set()
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
        if len(touched) > spare:
            break
        out.append(word)
        touched |= {g for g in grams if word in g.split()}
    return out


def widest(text: str, t: float = THRESHOLD) -> int:
    """Most bigrams, repeats included, of a window that is compared with a template."""
    return bounds(len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split()) - 1, t)[1]


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def windows(text: Column, templates=TEMPLATES + FULL, threshold: float = THRESHOLD) -> Column:
    """For each template that some window of a text is like: (dice, number of the template counted down, license, dice of the whole text)."""
    grams = [template_bigrams(t) for _, t in templates]
    needed = sorted({w for g in grams for w in anchors(g, threshold)})
    known = sorted({x for g in grams for x in g})
    kinds = F.array(*(F.struct(F.lit(-k).alias("order"), F.lit(name).alias("license"), F.lit(bounds(len(g), threshold)[0]).alias("fewest"), F.lit(widest(t, threshold)).alias("widest"), F.lit(g).alias("grams")) for k, ((name, t), g) in enumerate(zip(templates, grams, strict=True))))
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")), " ")

    def dice(common: Column, size: Column, kind: Column) -> Column:
        return F.lit(2.0) * common / (size + F.size(kind["grams"]))

    def of_start(hits: Column, s: Column, kind: Column) -> Column:
        """The best coefficient of the windows that begin with hit s."""
        first = F.element_at(hits, s)["p"]
        now = lambda a: dice(F.size(a["seen"]), a["last"] - first + 1 - a["hits"] + F.size(a["seen"]), kind)
        return F.aggregate(
            F.filter(F.slice(hits, s, kind["widest"]), lambda x: x["p"] < first + kind["widest"]),
            F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("hits"), (first - 1).alias("last"), F.lit(0.0).alias("best")),
            lambda a, x: F.struct(F.array_union(a["seen"], F.array(x["g"])).alias("seen"), (a["hits"] + 1).alias("hits"), x["p"].alias("last"), F.greatest(a["best"], now(a)).alias("best")),
            lambda a: F.greatest(a["best"], now(a)),
        )

    def of_kind(kind: Column, places: Column, size: Column) -> Column:
        def best(hits: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(hits) - kind["fewest"] + 1), lambda s: F.element_at(hits, s + kind["fewest"] - 1)["p"] - F.element_at(hits, s)["p"] < kind["widest"])
            whole = dice(F.size(F.array_distinct(F.transform(hits, lambda x: x["g"]))), size, kind)
            return F.struct(F.array_max(F.transform(starts, lambda s: of_start(hits, s, kind))).alias("dice"), kind["order"].alias("order"), kind["license"].alias("license"), whole.alias("whole"))

        return _let(F.filter(places, lambda x: F.array_contains(kind["grams"], x["g"])), best)

    def of_text(g: Column) -> Column:
        def of_common(different: Column, common: Column) -> Column:
            # templates of which a text has too few bigrams can't be like any window of it
            likely = F.filter(kinds, lambda kind: F.size(F.array_intersect(common, kind["grams"])) >= kind["fewest"])
            places = F.filter(F.transform(g, lambda x, p: F.struct(p.alias("p"), x.alias("g"))), lambda x: F.array_contains(common, x["g"]))
            found = lambda ks: F.when(F.size(ks) > 0, _let(places, lambda at: F.transform(ks, lambda kind: of_kind(kind, at, F.size(different)))))
            return F.filter(_let(likely, found), lambda m: m["dice"] >= threshold)

        return _let(F.array_distinct(g), lambda d: _let(F.array_intersect(d, F.lit(known)), lambda c: of_common(d, c)))

    def of_words(w: Column) -> Column:
        g = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        return F.when((F.size(w) > 1) & F.arrays_overlap(w, F.lit(needed)), _let(g, of_text))

    return _let(words, of_words)


def scan_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + FULL, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of ``docs``: its id, ``license`` and ``dice`` of the best window, ``whole_dice`` of the whole text with the same template, and ``n_templates`` that some window is like."""
    rows = picked(docs, id_col, text_col).select("id", windows(F.col("text"), templates, threshold).alias("found"))
    rows = rows.select("id", F.array_max("found").alias("best"), F.coalesce(F.size("found"), F.lit(0)).cast("bigint").alias("n_templates"))
    return rows.select(F.col("id").alias(id_col), F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), F.col("best.whole").alias("whole_dice"), F.greatest("n_templates", F.lit(0)).cast("bigint").alias("n_templates"))


def query_texts(spark, sf_dir: str) -> DataFrame:
    return scan_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB SQL, comparing every line with every template."""
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(templates))
    words = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "CASE WHEN len(w) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, i, {grams} AS g FROM (SELECT r, i, {words('line')} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d))),
t AS (SELECT k, name, {grams} AS h FROM (SELECT k, name, {words('txt')} AS w FROM (VALUES {values}) v(k, name, txt))),
m AS (SELECT r, i, k, name, 2.0::DOUBLE * len(list_intersect(g, h)) / (len(g) + len(h)) AS dice FROM l, t WHERE len(g) > 0),
b AS (SELECT r, i, max(dice) AS dice, arg_min(name, (-dice, k)) AS name, arg_min(k, (-dice, k)) AS k FROM m WHERE dice >= {threshold} GROUP BY r, i),
f AS (SELECT r, max(dice) AS dice, arg_min(name, (-dice, k)) AS license, count(*) AS n_matches FROM b GROUP BY r)
SELECT doc_id, license, dice, coalesce(n_matches, 0) AS n_matches FROM d LEFT JOIN f USING (r)
"""
