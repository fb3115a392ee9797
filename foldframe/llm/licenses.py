"""Licence scan: Dice coefficient over word bigrams against licence templates, in built-in functions only.

A text is compared as a whole, by paragraphs and by lines. A unit of a bigrams
and a template of t bigrams can reach the coefficient c only if the smaller
count is at least c / (2 - c) of the larger: other templates are not compared.
Everything happens in the row of the document, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least coefficient that counts as a licence, as a fraction so that the size bounds are exact: 4 / 5.
LEAST = (4, 5)

# The wording of common licence statements and texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> Counter[str]:
    own = words(text)
    return Counter(f"{a} {b}" for a, b in zip(own, own[1:], strict=False))


#: Templates by name in order: their bigrams with counts.
GRAMS = {name: bigrams(text) for name, text in sorted(TEMPLATES.items())}


def _fits(n: Column, t: int) -> Column:
    """2 * min / (n + t) >= LEAST, in whole numbers."""
    num, den = LEAST
    return (F.least(n, F.lit(t)) * 2 * den) >= (n + t) * num


def _shared(grams: Column, template: Counter[str]) -> Column:
    """Size of the intersection of the two multisets."""
    held = F.filter(grams, lambda g: g.isin(*template))
    once = F.size(F.array_intersect(held, F.array(*[F.lit(g) for g in template])))
    def times(gram: str) -> Column:
        return F.size(F.filter(held, lambda x: x == gram))

    # What stands several times in the template can be shared as often.
    more = [F.greatest(F.least(times(g), F.lit(k)) - 1, F.lit(0)) for g, k in template.items() if k > 1]
    return reduce(lambda a, b: a + b, more, once)


def scan(docs: DataFrame) -> DataFrame:
    """The columns of docs, and n_compared (unit-template pairs within the size bounds), license (name of the best template or null) and dice (its coefficient or null).

    The best is that of the highest coefficient of at least LEAST, of equal ones
    the first by name. Null texts and units of fewer than two words are not
    compared; equal units of a text are compared once. Columns of docs by these
    names are replaced; rows stay as they are.
    """
    keep = [c for c in docs.columns if c not in ("n_compared", "license", "dice")]
    plain = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z0-9\n]+", " ")
    # A value that is bound to a lambda's variable is worked out once, however often it's used.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    units = once(plain, lambda p: F.concat(F.split(p, "\n"), F.when(F.contains(p, F.lit("\n")), F.concat(F.split(p, "\n *\n"), F.array(p))).otherwise(F.array().cast("array<string>"))))
    tidy = F.array_distinct(F.transform(units, lambda u: F.trim(F.when(F.contains(u, F.lit("\n")), F.regexp_replace(u, "[ \n]+", " ")).otherwise(u))))
    # A unit's number of bigrams is that of its spaces.
    sized = F.transform(tidy, lambda u: F.struct(u.alias("u"), (F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))).alias("n")))
    bounds = sorted({sum(g.values()) for g in GRAMS.values()})
    candidates = F.filter(sized, lambda s: reduce(lambda a, b: a | b, (_fits(s["n"], t) for t in bounds)))

    def pairs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))

    def best(grams: Column) -> Column:
        n = F.size(grams)
        each = []
        for i, template in enumerate(GRAMS.values()):
            t = sum(template.values())
            each.append(F.when(_fits(n, t), F.struct((_shared(grams, template) * 2.0 / (n + t)).alias("dice"), F.lit(-i).alias("rank"))))
        return F.array_max(F.array(*each))

    def outcome(found: Column) -> Column:
        compared = F.aggregate(found, F.lit(0).cast("long"), lambda n, s: n + reduce(lambda a, b: a + b, (_fits(s["n"], sum(g.values())).cast("long") for g in GRAMS.values())))
        top = F.array_max(F.transform(found, lambda s: once(once(F.split(s["u"], " "), pairs), best)))
        return F.struct(compared.alias("n"), top.alias("top"))

    names = F.array(*[F.lit(name) for name in GRAMS])
    result = once(candidates, outcome)

    def said(r: Column) -> Column:
        sure = r["top"]["dice"] * LEAST[1] >= LEAST[0]
        return F.struct(r["n"].alias("n_compared"), F.when(sure, F.get(names, -r["top"]["rank"])).alias("license"), F.when(sure, r["top"]["dice"]).alias("dice"))

    return docs.select(*keep, F.inline(F.transform(F.array(result), said)))


def op5_license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_compared, license, dice: a row for each document."""
    return scan(docs.select("doc_id", "text")).drop("text")


def oracle() -> str:
    """The same in SQL."""
    rows = ", ".join(f"({i}, '{name}', '{gram}', {k}, {sum(g.values())})" for i, (name, g) in enumerate(GRAMS.items()) for gram, k in g.items())
    num, den = LEAST
    return f"""
WITH t(rank, name, gram, k, t) AS (VALUES {rows}),
ts AS (SELECT DISTINCT rank, name, t FROM t),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS p FROM documents),
raw AS (
  SELECT rn, unnest(list_concat(string_split(p, chr(10)), regexp_split_to_array(p, '\n *\n'), [p])) AS u FROM d
),
u AS (SELECT row_number() OVER () AS un, rn, string_split(u, ' ') AS w FROM (SELECT DISTINCT rn, trim(regexp_replace(u, '[ \n]+', ' ', 'g')) AS u FROM raw)),
c AS (SELECT un, rn, w, rank, name, t, len(w) - 1 AS a FROM u, ts WHERE least(len(w) - 1, t) * 2 * {den} >= (len(w) - 1 + t) * {num}),
g AS (SELECT un, gram, count(*) AS n FROM (SELECT un, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT un, w, unnest(range(1, len(w))) AS i FROM (SELECT DISTINCT un, w FROM c))) GROUP BY un, gram),
s AS (SELECT un, rank, sum(least(n, k)) AS shared FROM g JOIN t USING (gram) GROUP BY un, rank),
r AS (SELECT c.rn, c.rank, c.name, coalesce(shared, 0) * 2.0 / (a + t) AS dice FROM c LEFT JOIN s USING (un, rank)),
b AS (SELECT rn, name, CAST(dice AS DOUBLE) AS dice FROM r WHERE dice * {den} >= {num} QUALIFY row_number() OVER (PARTITION BY rn ORDER BY dice DESC, rank) = 1),
n AS (SELECT rn, count(*) AS n FROM c GROUP BY rn)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_compared, name AS license, dice FROM d LEFT JOIN b USING (rn) LEFT JOIN n USING (rn)
"""
