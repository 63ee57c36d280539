"""Licence texts by a positional rare-token index (DataFrame functions only).

The index holds, for each word of a template's mandatory phrase, its postings: the
templates and the places in their phrases.  Document frequencies over the whole table
weigh those words.  A file's licence words name the templates whose phrases it can
hold, and the file is looked up by its highest-weighted words alone, two for each
such template.  Every place of one, shifted by the word's place in a template's
phrase, is a candidate start; the postings of the two are intersected, so a start
stands only where both words have the right distance.  What stands is verified word
by word, and compared with the whole template around it.  Every place of a phrase
holds its rarest words, so none is lost, whatever the frequencies.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import free, spread, whole

#: A word once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same characters one by one: Java looks them up in a table, and tries ranges one after another.
_FAST_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not (48 <= c < 58 or 97 <= c < 123)) + "]++"


@dataclass(frozen=True)
class Template:
    """A licence text or notice: its label, its words, and its mandatory phrase at word ``lead``."""

    label: str
    words: tuple[str, ...]
    phrase: tuple[str, ...]
    base: bool

    @property
    def lead(self) -> int:
        n = len(self.phrase)
        return next(k for k in range(len(self.words)) if self.words[k : k + n] == self.phrase)


def template(label: str, phrase: str, text: str, base: bool = False) -> Template:
    words = lambda x: tuple(re.findall("[0-9a-z]+", x.lower()))
    return Template(label, words(text), words(phrase), base)


# Public licence texts and the notices that name longer ones.
_MIT = """
    MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
    "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
    sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
    FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
    LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
    IN THE SOFTWARE."""
_BSD = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.
    3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
    without specific prior written permission.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
    LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
    LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
    DAMAGE."""
_ISC = """
    Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
    copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
    TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
    OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """
    This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
    the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
    redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
    wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
    required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
    not be removed or altered from any source distribution."""
_BOOST = """
    Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
    accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
    prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"""
_UNLICENSE = """
    This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
    this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
    that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
    make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
    act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_APACHE = """
    Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
    of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the
    License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
    language governing permissions and limitations under the License."""
_GNU = """
    This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software
    Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more
    details. You should have received a copy of the GNU {0} License along with this program. If not, see https://www.gnu.org/licenses/."""
_MPL = """
    This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
    obtain one at http://mozilla.org/MPL/2.0/."""
_CC = """
    This work is licensed under CC {0} 4.0. To view a copy of this license, visit https://creativecommons.org/licenses/{0}/4.0/"""

TEMPLATES: list[Template] = [
    template("gpl", "gnu general public license", _GNU.format("General Public", "3"), base=True),
    template("apache", "apache license", _APACHE, base=True),
    template("cc-by", "cc by", _CC.format("BY"), base=True),
    template("mit", "mit license", _MIT, base=True),
    template("agpl", "gnu affero general public license", _GNU.format("Affero General Public", "3")),
    template("apache-2.0", "apache license version 2 0", _APACHE),
    template("boost", "boost software license", _BOOST),
    template("bsd", "redistribution and use in source and binary forms", _BSD),
    template("cc-by-nc", "cc by nc", _CC.format("BY-NC")),
    template("cc-by-sa", "cc by sa", _CC.format("BY-SA")),
    template("gpl-3", "gnu general public license version 3", "GNU General Public License Version 3, 29 June 2007"),
    template("isc", "permission to use copy modify and or distribute this software", _ISC),
    template("lgpl", "gnu lesser general public license", _GNU.format("Lesser General Public", "3")),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated", _MIT),
    template("mpl", "mozilla public license", _MPL),
    template("unlicense", "free and unencumbered software released into the public domain", _UNLICENSE),
    template("zlib", "the origin of this software must not be misrepresented", _ZLIB),
]


def _vocabulary() -> list[str]:
    """Words of mandatory phrases."""
    return sorted({w for t in TEMPLATES for w in t.phrase})


def _words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_FAST_WORD), F.lit(0))


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """ln((1 + N) / (1 + df)) of each word of a mandatory phrase, over all of ``docs``; at most one row for each such word reaches the driver."""
    found = F.array_intersect(_words(whole()), F.array(*map(F.lit, _vocabulary())))
    # The total rides along as the empty word, so that one scan counts both.
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word")).groupBy("word").count().collect()
    count = {r["word"]: r["count"] for r in rows}
    return {w: math.log((1 + count.get("", 0)) / (1 + count.get(w, 0))) for w in _vocabulary()}


def _literal(words: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _index(idf: dict[str, float]) -> str:
    """The templates as SQL structs, each with its number and the two words of highest weight of its phrase and their places."""
    out = []
    for k, t in enumerate(TEMPLATES):
        one, two = sorted(set(t.phrase), key=lambda w: (-idf[w], w))[:2]
        out.append(
            f"named_struct('k', {k}L, 'label', '{t.label}', 'base', {str(t.base).lower()}, 'lead', {t.lead}, 'phrase', {_literal(t.phrase)}, 'words', {_literal(t.words)},"
            f" 'one', '{one}', 'at_one', {t.phrase.index(one)}, 'two', '{two}', 'at_two', {t.phrase.index(two)})")
    return "array(" + ", ".join(out) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words and places (label, base, start, share) of every verified phrase; columns of these names are replaced.

    ``share``: the share of the template's words that stand at their places around it.
    """
    index = _index(inverse_frequencies(docs))
    vocabulary = _literal(tuple(_vocabulary()))
    text, words, present, able, hits = (free(name, docs) for name in ("_text", "_words", "_present", "_able", "_hits"))
    # Templates of which the file has every word of the mandatory phrase.
    complete = f"filter({index}, t -> size(array_except(t.phrase, {present})) = 0)"
    # Places of the words that those templates are looked up by.
    rare = f"flatten(transform({able}, t -> array(t.one, t.two)))"
    places = f"filter(transform({words}, (w, i) -> struct(i as at, w as word)), p -> array_contains({rare}, p.word))"
    # Postings of the two words, shifted to starts of the phrase; both must give a start.
    starts = lambda word, at: f"transform(filter({hits}, p -> p.word = t.{word} AND p.at >= t.{at}), p -> p.at - t.{at})"
    kind = "array<struct<label:string,base:boolean,start:bigint,share:double>>"
    verified = f"""
      flatten(transform({able}, t -> transform(
        filter(array_intersect({starts("one", "at_one")}, {starts("two", "at_two")}), s -> slice({words}, s + 1, size(t.phrase)) = t.phrase),
        s -> struct(t.label as label, t.base as base, cast(s as bigint) as start,
          cast(size(filter(transform(t.words, (w, j) -> coalesce(s - t.lead + j >= 0 AND get({words}, s - t.lead + j) = w, false)), x -> x)) as double) / size(t.words) as share))))
    """
    return (
        docs.withColumn(text, whole())
        .withColumn(words, _words(F.col(text)))
        .withColumn(present, F.expr(f"array_intersect({words}, {vocabulary})"))
        .withColumn(able, F.expr(complete))
        .withColumn(hits, F.expr(f"CASE WHEN size({able}) > 0 THEN {places} ELSE array() END"))
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumn("places", F.expr(f"cast(CASE WHEN size({able}) > 0 THEN {verified} ELSE array() END as {kind})"))
        .drop(text, words, present, able, hits)
    )


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of ``docs``.

    score: 0 without a phrase, else a half and half the largest share of a template
    found around one.  Null and empty texts have no words, no places, empty labels and
    score 0.  Rows are independent: repeated ones and null ids are kept.  Other
    columns are not read.  Neither a shuffle nor a join is needed, but that a small table
    of few files is dealt over the cores.
    """
    base = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return scan(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(0.5 + 0.5 * F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    return ",\n    ".join(f"('{t.label}', {str(t.base).lower()}, {t.lead}, {quoted(t.phrase)}, {quoted(t.words)})" for t in TEMPLATES)


def _firsts() -> str:
    return ", ".join(sorted({f"'{t.phrase[0]}'" for t in TEMPLATES}))


#: DuckDB: every template tried at every place of its phrase's first word.
ORACLE = f"""
WITH templates(label, base, lead, phrase, words) AS (VALUES
    {_values()}
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(list_filter(list_transform(w, lambda x, k: CASE WHEN x IN ({_firsts()}) THEN k END), lambda k: k IS NOT NULL)) AS i FROM docs
), places AS (
  SELECT doc_id, i - 1 AS start, label, base,
    len(list_filter(range(1, len(words) + 1), lambda j: i - lead + j - 1 >= 1 AND w[i - lead + j - 1] = words[j]))::DOUBLE / len(words) AS share
  FROM starts JOIN templates ON w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase
), found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, 0.5 + 0.5 * max(share) AS score
  FROM places GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (doc_id)
"""
