"""License scan by diagonal voting.

All rolling word 4-gram hashes of all texts are joined in Spark to the positions of the license templates. A hit votes
for its diagonal (word position in the text less position in the template). Diagonals that neighbour each other (insertions
and deletions shift them) are merged into a span. A span is verified by the share of the template's positions it holds and, since
licenses quote each other, by those grams that no template of another label has: it must hold half of them. Spans of
different labels that overlap then compete on the words of the text that both reach over: the one that holds more of these words wins, then the more
complete template, then the one with more words of the text, then the longer template.

Templates are short notices and whole licenses (files in ``texts``, named label.license.txt). ``labels`` has the labels of the phrases and those of the method, which
``method_labels`` has alone: a notice of the LGPL holds the phrase "general public license", and only its method label tells it apart.

Defined results: a null text is empty; repeated rows stay, each with the same result; an empty table gives an empty result. A text must fit a task's memory.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, bound_batches, gram_hashes, text_chunks, word_hashes

GRAM = 4
#: Template positions are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
SEPARATOR = np.array([not (0x30 <= FOLD[b] <= 0x39 or 0x61 <= FOLD[b] <= 0x7A or b >= 0x80) for b in range(256)])
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed texts: notices by which licenses are commonly granted, and whole licenses.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "Distributed under the terms of the GNU General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution"),
    ("reserved", "Copyright. All rights reserved."),
    # whole texts, and notices of several sentences
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def whole_licenses() -> list[tuple[str, str]]:
    """(label, text) of the whole licenses beside this module."""
    return [(f.name.split(".")[0], f.read_text()) for f in sorted(Path(__file__).with_name("texts").glob("*.txt"))]


def template_grams(templates) -> list[tuple[int, int, int, int, str, bool, int]]:
    """(gram, template, position, grams of the template, label, whether no other label has the gram, how many such grams the template has)."""
    made = []
    for label, text in templates:
        data = np.frombuffer(text.encode(), np.uint8)
        made.append((label, gram_hashes(word_hashes(data, np.array([0, len(data)]), SEPARATOR)[0], GRAM).view(np.int64).tolist()))
    labels: dict[int, set[str]] = {}
    for label, grams in made:
        for g in grams:
            labels.setdefault(g, set()).add(label)
    out = []
    for i, (label, grams) in enumerate(made):
        own = [len(labels[g]) == 1 for g in grams]
        out += [(g, i, p, len(grams), label, o, sum(own)) for p, (g, o) in enumerate(zip(grams, own))]
    return out


def phrase_hashes(phrases=PHRASES) -> list[np.ndarray]:
    data = [np.frombuffer(p.encode(), np.uint8) for p, _ in phrases]
    return [word_hashes(d, np.array([0, len(d)]), SEPARATOR)[0] for d in data]


def grams(batches):
    """doc_id, text hash, gram hashes in word order."""
    for batch in batches:
        for i, offsets, data in text_chunks(batch.column(2)):
            words, first = word_hashes(data, offsets, SEPARATOR)
            all_grams, rows = gram_hashes(words, GRAM), len(offsets) - 1
            counts = np.maximum(0, np.diff(first) - GRAM + 1)
            keep = np.ones(len(all_grams), bool)
            for b in range(1, GRAM):  # grams that would run over a row's end
                at = first[1:] - b
                keep[at[(at >= 0) & (at < len(keep))]] = False
            short = np.repeat(np.diff(first) < GRAM, np.diff(first))[: len(keep)]
            keep[: len(short)] &= ~short
            values = pa.array(all_grams[keep].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), lists], names=["doc_id", "th", "grams"])


def base(phrases):
    """What the phrases give: doc_id, text hash, n_words, n_base, first_word, last_word, base labels."""
    hashes = phrase_hashes(phrases)

    def run(batches):
        for batch in batches:
            for i, offsets, data in text_chunks(batch.column(2)):
                words, first = word_hashes(data, offsets, SEPARATOR)
                rows = len(offsets) - 1
                n, lo, hi = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                labels: list[set[str]] = [set() for _ in range(rows)]
                for h, (_, label) in zip(hashes, phrases):
                    k = len(h)
                    at = np.flatnonzero(np.logical_and.reduce([words[j : len(words) - k + 1 + j] == h[j] for j in range(k)])) if len(words) >= k else np.zeros(0, np.int64)
                    row = np.searchsorted(first, at, "right") - 1
                    ok = at + k <= first[row + 1]
                    at, row = at[ok], row[ok]
                    np.add.at(n, row, 1)
                    np.minimum.at(lo, row, at - first[row])
                    np.maximum.at(hi, row, at - first[row])
                    for r in np.unique(row):
                        labels[r].add(label)
                none = n == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), pa.array(np.diff(first).astype(np.int64)), pa.array(n), pa.array(lo, mask=none), pa.array(hi, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))], names=["doc_id", "th", "n_words", "n_base", "first_word", "last_word", "found"])

    return run


def license_spans(docs: DataFrame, templates, share: float = 0.6, near: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: doc_id, th (hash of the text), template, label, t_grams, share, words (the places in the text whose words the span holds, ascending)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    known = template_grams(templates)
    positions = spark.createDataFrame(known, "gram long, template int, t_pos int, t_grams int, label string, own boolean, t_own int")
    positions = F.broadcast(positions) if len(known) <= BROADCAST_ROWS else positions
    hits = texts.mapInArrow(grams, "doc_id long, th long, grams array<long>").select("doc_id", "th", F.posexplode("grams").alias("d_pos", "gram")).join(positions, "gram")
    key = ["doc_id", "th", "template"]
    fixed = ["t_grams", "label", "t_own"]
    votes = hits.groupBy(*key, *fixed, (F.col("d_pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("held"), F.collect_set(F.when(F.col("own"), F.col("t_pos"))).alias("own"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int")
    together = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    places = F.flatten(F.transform("held", lambda p: F.sequence(p + F.col("diagonal"), p + F.col("diagonal") + GRAM - 1)))
    spans = votes.withColumn("span", F.sum(F.coalesce(far, F.lit(0))).over(order)).withColumn("places", places).groupBy(*key, *fixed, "span").agg(together("held").alias("held"), together("own").alias("own"), F.array_sort(together("places")).alias("words"))
    found = spans.withColumn("share", F.size("held") / F.col("t_grams")).filter((F.col("share") >= share) & (2 * F.size("own") >= F.col("t_own")))
    return found.select(*key, "label", "t_grams", "share", "words")


def beats(a: dict, b: dict) -> bool:
    """Whether span ``a`` wins where it overlaps ``b``."""
    lo, hi = max(a["words"][0], b["words"][0]), min(a["words"][-1], b["words"][-1])
    strength = lambda s: (sum(lo <= w <= hi for w in s["words"]), s["share"], len(s["words"]), s["t_grams"], -s["template"])
    return lo <= hi and strength(a) > strength(b)


def winners(spans: list[dict]) -> list[dict]:
    """The spans of a text that no overlapping span of another label beats."""
    spans = sorted(spans, key=lambda s: (s["words"][0], s["words"][-1], s["template"]))
    lost, open_ = set(), []
    for i, s in enumerate(spans):
        open_ = [j for j in open_ if spans[j]["words"][-1] >= s["words"][0]]
        for j in open_:
            if spans[j]["label"] != s["label"]:
                lost.add(i if beats(spans[j], s) else j)
        open_.append(i)
    return [s for i, s in enumerate(spans) if i not in lost]


def decided(batches):
    """doc_id, text hash, labels, best share and number of the spans that win."""
    for batch in batches:
        rows = []
        for doc_id, th, spans in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            left = winners(spans)
            rows.append((doc_id, th, sorted({s["label"] for s in left}), max((s["share"] for s in left), default=0.0), len(left)))
        types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows)) or [()] * 5, types)], names=["doc_id", "th", "more", "score", "n_spans"])


def scan_licenses(docs: DataFrame, templates=None, phrases=PHRASES, share: float = 0.6, near: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, method_labels, score, n_spans. A template of g grams is found where a span holds ``share`` of them."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    facts = texts.mapInArrow(base(phrases), "doc_id long, th long, n_words long, n_base long, first_word long, last_word long, found array<string>")
    templates = [*TEMPLATES, *whole_licenses()] if templates is None else templates
    spans = license_spans(docs, templates, share, near, id_col=id_col, text_col=text_col)
    by_text = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("template", "label", "t_grams", "share", "words")).alias("spans")).mapInArrow(decided, "doc_id long, th long, more array<string>, score double, n_spans long")
    same = facts["doc_id"].eqNullSafe(by_text["doc_id"]) & facts["th"].eqNullSafe(by_text["th"])
    more = F.coalesce("more", F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union("found", more))
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return facts.join(by_text, same, "left").select(facts["doc_id"], "n_words", "n_base", "first_word", "last_word", F.array_join("found", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.array_join(more, ",").alias("method_labels"), score.alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
