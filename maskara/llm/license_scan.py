"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is cut into segments at line feeds and after sentence ends; a candidate is a run of consecutive segments, so a notice
is found on a line of its own, wrapped over lines, and inside a paragraph or a file. Words are runs of a-z and 0-9 in ASCII
lower case, whatever stands between them. The score of a candidate with the set of word bigrams A against a template with the
set B is 2 |A and B| / (|A| + |B|).

Size bounds prune: a score of t or more takes t / (2 - t) <= |A| / |B| <= (2 - t) / t, so a candidate is compared only with
templates for which its bigrams, repeats included, are within these bounds. It also takes |A and B| >= t / (2 - t) |B|, so a
document whose bigrams do not cover so much of a template has no candidate for it. That is told for a slice of documents
at a time from hashes of words, as arrays; what is left is scored exactly, on the words themselves.

Templates are a fixed list, or a table given as a parameter; they are sent to the tasks ``CHUNK`` at a time, one pass over
the documents for each chunk. The scan is a map over documents: nothing is shuffled.

Nulls and odd rows: null, empty and one-word texts match nothing; a document without a match has a null licence and
score 0. Ties go to the smallest licence name. Rows are scored one by one, so rows that share a doc_id or have none are no
matter, and further columns pass through. An empty table gives an empty result, and no template matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import bounded_batches, free
from .units import _LETTER, _PLACE, MOST_HASHED, by_bytes, tidy

MIN_DICE = 0.8
#: Templates sent to the tasks at a time.
CHUNK = 5_000
#: Bytes of text looked at at a time.
SLICE_BYTES = 1_500_000
#: Notices by which texts state their licence, and short licences in full.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a text is cut into segments.
SEGMENT = re.compile(r"[.!?][ \t\r]|\n")
WORD = re.compile("[a-z0-9]+")
_FOLD = str.maketrans(UPPER, LOWER)
#: For each byte its word letter, and 0 for what stands between words.
_BARE = np.zeros(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _BARE[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _BARE[_c] = _c + 32
_WEIGHT = np.where(np.arange(256) > 0, _LETTER[0], np.uint64(0))
FOUND = "struct<license: string, dice: double, starts: array<int>>"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_FOLD))


def pairs_of(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


class Scanner:
    """Templates as [(licence, set of bigrams)] and the tables by which documents are told that cannot match."""

    def __init__(self, templates: list[tuple[str, str]], min_dice: float):
        self.min_dice, self.low, self.high = min_dice, min_dice / (2 - min_dice), (2 - min_dice) / min_dice
        sets = sorted({(name, frozenset(pairs_of(words_of(text or "")))) for name, text in templates}, key=lambda x: (x[0] or "", sorted(x[1])))
        self.templates = [(name, b) for name, b in sets if b]
        vocabulary = sorted({w for _, b in self.templates for p in b for w in p})
        number = {w: i for i, w in enumerate(vocabulary)}
        known = np.array([self._hash(w) for w in vocabulary], dtype=np.uint64)
        self.order = np.argsort(known)
        self.known = known[self.order]
        bigrams = sorted({(number[a], number[b]) for _, s in self.templates for a, b in s})
        self.bigrams = np.array([a * len(vocabulary) + b for a, b in bigrams], dtype=np.int64)
        place = {p: i for i, p in enumerate(bigrams)}
        owners: list[list[int]] = [[] for _ in bigrams]
        for t, (_, s) in enumerate(self.templates):
            for a, b in s:
                owners[place[number[a], number[b]]].append(t)
        self.n_owners = np.array([len(o) for o in owners], dtype=np.int64)
        self.owners = np.array([t for o in owners for t in o], dtype=np.int64)
        self.need = np.array([self.low * len(s) for _, s in self.templates])

    @staticmethod
    def _hash(word: str) -> int:
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        return int((_WEIGHT[raw] * _PLACE[0][: len(raw)][: MOST_HASHED]).sum(dtype=np.uint64)) if len(raw) <= MOST_HASHED else 0

    def candidates(self, texts: pa.Array) -> dict[int, list[int]]:
        """By text, the templates of whose bigrams it holds enough."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, at, values = texts.buffers()
        offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        if offsets[-1] == offsets[0] or not self.templates:
            return {}
        data = _BARE[np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        inside = data > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        first[edge] |= inside[edge]
        starts = np.flatnonzero(first)
        if len(starts) < 2:
            return {}
        owner = np.searchsorted(offsets, starts, side="right") - 1
        place = np.arange(int(starts[0]), len(data), dtype=np.int64)
        place -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        np.minimum(place, MOST_HASHED, out=place)
        tail = data[int(starts[0]) :]
        h = np.add.reduceat(_WEIGHT[tail] * _PLACE[0][place], starts - starts[0])
        near = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        word = np.where(self.known[near] == h, self.order[near], -1)
        pair = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0) & (owner[:-1] == owner[1:]))
        key = word[pair] * len(self.known) + word[pair + 1]
        near = np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)
        hit = self.bigrams[near] == key
        found = np.unique(owner[pair[hit]] * len(self.bigrams) + near[hit])
        text, bigram = found // len(self.bigrams), found % len(self.bigrams)
        n = self.n_owners[bigram]
        ends = np.cumsum(n)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(self.n_owners) - self.n_owners)[bigram] - (ends - n), n)
        both, count = np.unique(np.repeat(text, n) * len(self.templates) + self.owners[where], return_counts=True)
        out: dict[int, list[int]] = {}
        for x in both[count >= self.need[both % len(self.templates)] - 1e-9].tolist():
            out.setdefault(x // len(self.templates), []).append(x % len(self.templates))
        return out

    def scored(self, text: str, templates: list[int]) -> tuple[str | None, float, list[int]]:
        """(licence, score, the segments at which matches start) of the best run of segments, segments without a word not counted."""
        segments = [w for x in SEGMENT.split(text) if (w := words_of(x))]
        words = [w for s in segments for w in s]
        ends = np.cumsum([len(s) for s in segments]).tolist()
        begins = [0, *ends[:-1]]
        pairs = pairs_of(words)
        best, starts = (0.0, None), set()
        for t in templates:
            name, b = self.templates[t]
            hits = np.append(0, np.cumsum([p in b for p in pairs])).tolist()
            most = self.high * len(b) + 1e-9
            least = self.low * len(b) - 1e-9
            for i, begin in enumerate(begins):
                limit = min(int(begin + most), len(pairs))
                if hits[limit] - hits[min(begin, limit)] < least:
                    continue
                own: set = set()
                common, at = 0, begin
                for end in ends[i:]:
                    if end - begin - 1 > most:
                        break
                    for p in pairs[at : end - 1]:
                        if p not in own:
                            own.add(p)
                            common += p in b
                    at = max(at, end - 1)
                    if end - begin - 1 >= least and own:
                        dice = 2.0 * common / (len(own) + len(b))
                        if dice >= self.min_dice:
                            starts.add(i)
                            if best[1] is None or (-dice, name) < (-best[0], best[1]):
                                best = dice, name
        return best[1], best[0], sorted(starts)


def with_found(docs: DataFrame, templates: DataFrame | None = None, min_dice: float = MIN_DICE, at: str = "_license") -> DataFrame:
    """docs with a struct ``at``: license, dice and starts (the segments at which matches start) of each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chunks = [list(TEMPLATES)]
    if templates is not None:
        given = templates.select("license", "text").filter(F.col("license").isNotNull()).distinct()
        n = max(1, -(-given.count() // CHUNK))
        chunks = [[tuple(r) for r in given.filter(F.pmod(F.xxhash64("license", "text"), F.lit(n)) == k).collect()] for k in range(n)]  # about CHUNK rows each

    def column(chunk):
        shared = spark.sparkContext.broadcast(chunk)

        @F.arrow_udf(FOUND)
        @tidy
        def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scanner = Scanner(shared.value, min_dice)
            for texts in batches:
                out: list = [(None, 0.0, [])] * len(texts)
                done = 0
                for part in by_bytes(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE_BYTES):
                    own = part.column(0)
                    for i, found in scanner.candidates(own).items():
                        out[done + i] = scanner.scored(own[i].as_py(), found)
                    done += part.num_rows
                names, dices, starts = zip(*out) if out else ((), (), ())
                yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(dices, pa.float64()), pa.array(starts, pa.list_(pa.int32()))], ["license", "dice", "starts"])

        return scan(F.col("text"))

    out = docs.withColumn(at, column(chunks[0]))
    for chunk in chunks[1:]:
        new = free(out, "_more")
        out = out.withColumn(new, column(chunk))
        a, b = F.col(at), F.col(new)
        better = (b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["license"] < a["license"]))
        best = lambda c: F.when(F.coalesce(better, F.lit(False)), b[c]).otherwise(a[c]).alias(c)  # noqa: B023, E731
        out = out.withColumn(at, F.struct(best("license"), best("dice"), F.array_union(a["starts"], b["starts"]).alias("starts"))).drop(new)
    return out


def with_license(docs: DataFrame, **how) -> DataFrame:
    """doc_id, license, dice, n_matches (segments at which a match starts) for every row of docs."""
    at = free(docs, "_license")
    return with_found(docs, at=at, **how).select("doc_id", F.col(f"{at}.license").alias("license"), F.col(f"{at}.dice").alias("dice"), F.size(f"{at}.starts").cast("long").alias("n_matches"))


def op8(spark, sf_dir: str) -> DataFrame:
    return with_license(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[a-z0-9]+')"
_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"

ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS template, license, {_PAIRS.format("w")} AS b FROM (SELECT license, {_WORDS.format("text")} AS w FROM (VALUES {", ".join(f"({_sql(a)}, {_sql(b)})" for a, b in TEMPLATES)}) v(license, text))
), tb AS (
  SELECT template, len(b) AS size, unnest(b) AS p FROM t
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), w AS (
  SELECT rid, {_WORDS.format("text")} AS w FROM d WHERE text IS NOT NULL
), h AS (
  SELECT rid, template FROM (SELECT rid, unnest({_PAIRS.format("w")}) AS p FROM w) x JOIN tb ON x.p = tb.p GROUP BY rid, template, size HAVING 3 * count(*) >= 2 * size
), g AS (
  SELECT rid, i, len({_WORDS.format("x[i]")}) AS n FROM (SELECT rid, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT rid, string_split_regex(text, '[.!?][ \t\r]|\n') AS x FROM d WHERE rid IN (SELECT rid FROM h)))
), s AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS pos, (sum(n) OVER (PARTITION BY rid ORDER BY i) - n)::BIGINT AS first, (sum(n) OVER (PARTITION BY rid ORDER BY i))::BIGINT AS last FROM g WHERE n > 0
), r AS (
  SELECT a.rid, a.pos, t.license, t.b, {_PAIRS.format("w.w[a.first + 1 : e.last]")} AS a
  FROM h JOIN t ON h.template = t.template JOIN w ON w.rid = h.rid JOIN s a ON a.rid = h.rid JOIN s e ON e.rid = h.rid AND e.pos >= a.pos
  WHERE 3 * (e.last - a.first - 1) >= 2 * len(t.b) AND 2 * (e.last - a.first - 1) <= 3 * len(t.b)
), f AS (
  SELECT rid, pos, license, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM r
), m AS (
  SELECT rid, count(DISTINCT pos)::BIGINT AS n, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM f WHERE dice >= 0.8 GROUP BY rid
)
SELECT d.doc_id, m.license, coalesce(m.dice, 0.0)::DOUBLE AS dice, coalesce(m.n, 0)::BIGINT AS n_matches FROM d LEFT JOIN m ON d.rid = m.rid
"""
