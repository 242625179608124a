"""Licence scans: every line of a document, the whole of it, and its runs of words, against licence templates.

A unit (a line, the document, or any run of its consecutive words) and a template are compared by the Dice coefficient
``2 |A & B| / (|A| + |B|)`` over their sets of word bigrams. A coefficient of at least ``t`` needs
``|B| t / (2 - t) <= |A| <= |B| (2 - t) / t``; these bounds prune the templates that a unit is
compared with before any set is intersected. It also needs more than ``|B| t / (2 - t)`` bigrams of the
template in the unit, so of any larger number of the template's bigrams than the rest one is there: a few
words and bigrams are chosen that so many of each template's bigrams contain, and texts and lines
without any of these are passed over unsplit. Runs find the licence that is wrapped over lines of a longer
document, or stands within a longer line; they are walked for the few templates of which the document has so
many bigrams. Templates are a short fixed list in this
module, so they are joined by broadcast; documents are neither sorted nor shuffled, only the few
matches are.
"""

from __future__ import annotations

import math
import re
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: (licence, text): full texts, file headers and one-line notices.
TEMPLATES = [
    ("MIT", _MIT), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("GPL-3.0", _GPL), ("Apache-2.0", _APACHE), ("ISC", _ISC), ("MPL-2.0", _MPL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

_OTHER = r"[^\p{L}\p{N}\n]+"


def normal(text: str) -> str:
    """What both sides of a comparison see: lower case, words apart by one space, "licence" as "license"."""
    return " ".join(re.sub(r"[^\w]+|_", " ", text.lower()).replace("licence", "license").split())


def _bigrams(text: str) -> list[str]:
    w = normal(text).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def anchors(threshold: float) -> list[str]:
    """Words and bigrams of which every text that matches any template has at least one.

    Words and bigrams of more than six characters are taken while they suffice, then any bigram.
    """
    todo = []
    for _, text in TEMPLATES:
        b = _bigrams(text)
        todo.append((b, len(b) - math.ceil(len(b) * threshold / (2 - threshold) - 1e-9) + 1))
    chosen: list[str] = []

    def has(bigram: str, anchor: str) -> bool:
        return f" {anchor} " in f" {bigram} "

    longer = 6
    while True:
        gain: dict[str, int] = {}
        uncovered = False
        for b, need in todo:
            left = [x for x in b if not any(has(x, a) for a in chosen)]
            missing = need - (len(b) - len(left))
            if missing > 0:
                uncovered = True
                # Short words are in other texts too; they count with a neighbour only.
                for c in {w for x in left for w in ([x, *x.split()] if longer else [x]) if len(w) > longer}:
                    gain[c] = gain.get(c, 0) + min(missing, sum(has(x, c) for x in left))
        if not gain:
            if not uncovered:
                return chosen
            if not longer:
                raise ValueError("no anchors cover all templates")
            longer = 0
            continue
        chosen.append(max(gain, key=lambda c: (gain[c], len(c), c)))


def _any_of(text: Column, phrases: list[str]) -> Column:
    """Whether ``text`` contains one of ``phrases``. The lambda keeps ``text`` from being computed for each of them."""

    def found(t: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in phrases])

    return F.exists(F.array(text), found)


def _unit_bigrams(unit: Column) -> Column:
    w = F.filter(F.split(unit, " "), lambda x: x != "")
    return F.when(F.size(w) > 1, F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))


def templates(spark: SparkSession, threshold: float) -> DataFrame:
    """One row per template: its bigrams and the sizes of the sets that can match it."""
    # Bounds that are whole numbers may come out a little beyond them.
    rows = [(name, (b := _bigrams(text)), len(b) * threshold / (2 - threshold) - 1e-9, len(b) * (2 - threshold) / threshold + 1e-9) for name, text in TEMPLATES]
    return spark.createDataFrame(rows, "license string, _t array<string>, _lo double, _hi double")


@cache
def _indexed(threshold: float) -> list[tuple[str, frozenset[str], float]]:
    return [(name, frozenset(b := _bigrams(text)), len(b) * threshold / (2 - threshold) - 1e-9) for name, text in TEMPLATES]


def runs(text: str, threshold: float) -> list[tuple[str, float]]:
    """(licence, score) of each run of consecutive words that matches; ``text`` is words apart by one space.

    Of runs of one licence that overlap, the best counts. A run also gives way to a better one of another
    licence if more than half of the bigrams that it shares with its template are shared there as well.
    """
    w = text.split()
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    present = set(grams)
    found = []
    for name, b, least in _indexed(threshold):
        if len(b & present) < least:
            continue
        most = len(b) * (2 - threshold) / threshold + 1e-9
        # The best run begins and ends with bigrams of the template, and has the first of them once: a shorter one is as good.
        # So a bigram is visited from the last places of at most ``most`` others: linear in the text.
        for i, first in enumerate(grams):
            if first not in b:
                continue
            seen: set[str] = set()
            hits, best, end = 0, 0.0, i
            for k in range(i, len(grams)):
                g = grams[k]
                if g in seen:
                    if g == first:
                        break
                    continue
                seen.add(g)
                if len(seen) > most:
                    break
                if g in b:
                    hits += 1
                    score = 2.0 * hits / (len(seen) + len(b))
                    if score > best:
                        best, end = score, k
                    if hits == len(b):
                        break
            if best >= threshold:
                found.append((best, i, end, name, b))
    found.sort(key=lambda x: (-x[0], x[1] - x[2], x[1], x[3]))
    taken: dict[str, list[int]] = {}
    better: dict[str, list[float]] = {}
    out = []
    for score, i, end, name, b in found:
        at = range(i, end + 1)
        own = taken.setdefault(name, [0] * len(grams))
        if any(own[k] for k in at):
            continue
        shared = [k for k in at if grams[k] in b]
        if any(2 * sum(x[k] > score for k in shared) > len(shared) for n, x in better.items() if n != name):
            continue
        claim = better.setdefault(name, [0.0] * len(grams))
        for k in at:
            own[k] = 1
        for k in shared:
            claim[k] = score
        out.append((name, score))
    return out


def _runs(text: Column, threshold: float) -> Column:
    def found(x: pa.Array) -> pa.Array:
        rows = [None if t is None else [{"license": n, "score": s} for n, s in runs(t, threshold)] for t in x.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64())])))

    return F.arrow_udf(found, "array<struct<license: string, score: double>>")(text)


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, score, units): a licence that a document carries, the best Dice
    coefficient, and in how many units it was found, the whole document being one of them.

    Units are lines and the whole; where none of these matches a licence, they are the runs of words
    that do (see ``runs``).

    Defined cases: null, empty and one-word texts carry no licence; matches of rows that share a
    ``doc_id``, null among them, are reported together; a unit that matches two templates of one
    licence counts once; an empty table gives an empty one; further columns are not read.
    """
    spark = docs.sparkSession
    needed = anchors(threshold)

    def clean(other: str) -> Column:
        return F.replace(F.regexp_replace(F.lower("text"), other, " "), F.lit("licence"), F.lit("license"))

    # Anchors may be broken by the end of a line, so they are looked for in the words of all lines.
    whole = clean(r"[^\p{L}\p{N}]+")
    lines = docs.where(_any_of(whole, needed)).select("doc_id", F.split(clean(_OTHER), "\n").alias("_lines"), whole.alias("_whole"))
    lines = lines.withColumn("_runs", _runs(F.col("_whole"), threshold))
    # A text of a single line is one unit, not two.
    kept = F.transform(F.when(F.size("_lines") > 1, F.concat(F.col("_lines"), F.array("_whole"))).otherwise(F.col("_lines")), lambda x, i: F.struct(i.alias("_no"), x.alias("_unit"), F.lit(None).cast("struct<license: string, score: double>").alias("_run")))
    within = F.transform("_runs", lambda x: F.struct(F.lit(None).cast("int").alias("_no"), F.lit(None).cast("string").alias("_unit"), x.alias("_run")))
    units = lines.select("doc_id", F.explode(F.concat(F.filter(kept, lambda x: _any_of(x["_unit"], needed)), within)).alias("_u")).select("doc_id", "_u.*")
    small = templates(spark, threshold)
    units = units.select("doc_id", "_no", "_run", _unit_bigrams(F.col("_unit")).alias("_a"))
    # Runs have no bigrams here, so they meet no template and pass.
    met = units.join(F.broadcast(small), F.col("_run").isNull() & (F.size("_a") >= F.col("_lo")) & (F.size("_a") <= F.col("_hi")), "left")
    met = met.withColumn("_score", F.lit(2.0) * F.size(F.array_intersect("_a", "_t")) / (F.size("_a") + F.size("_t")))
    met = met.where((F.col("_score") >= threshold) | F.col("_run").isNotNull())
    found = met.groupBy("doc_id", F.coalesce("_run.license", "license").alias("license")).agg(
        F.max(F.when(F.col("_run").isNull(), F.col("_score"))).alias("_score"), F.countDistinct("_no").alias("_units"),
        F.max("_run.score").alias("_run_score"), F.count("_run").alias("_run_units"),
    )
    return found.select(
        "doc_id", "license", F.coalesce("_score", "_run_score").alias("score"), F.when(F.col("_score").isNull(), F.col("_run_units")).otherwise(F.col("_units")).alias("units"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB's SQL, without pruning."""
    values = ", ".join(f"('{name}', {_bigrams(text)!r})" for name, text in TEMPLATES)
    return f"""
with t as (select * from (values {values}) v(license, tb)),
 l as (select doc_id, string_split(replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), 'licence', 'license'), chr(10)) ls from documents),
 u as (select doc_id, unnest(us) unit, unnest(range(0, len(us))) nr from (select doc_id, case when len(ls) > 1 then list_append(ls, array_to_string(ls, ' ')) else ls end us from l)),
 w as (select doc_id, nr, list_filter(string_split(unit, ' '), lambda x: x <> '') ws from u),
 b as (select doc_id, nr, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) a from w where len(ws) > 1),
 s as (select doc_id, nr, license, 2.0::double * len(list_intersect(a, tb)) / (len(a) + len(tb)) score from b, t)
select doc_id, license, max(score) score, count(distinct nr) units from s where score >= {threshold} group by 1, 2"""
