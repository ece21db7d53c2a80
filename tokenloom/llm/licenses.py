"""License scans in DataFrame operations only: phrase places, and an exact containment join of text blocks with templates.

A template of up to S words is held against blocks of 2 S words that start at every S-th word, across lines: any S words
in a row lie whole in one of them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Least containment of a licence's text; a notice of a few words has to stand in a block whole.
THRESHOLD = 0.8

#: Blocks have twice as many words; a template goes to the smallest that has its words, a longer one to the next power of two.
STEPS = (8, 32, 128, 256)

#: Other words that may stand between two words of a notice.
GAP = 3

#: Share of the score that a licence's text can reach: that its words are in a block says nothing of their order.
SET_SCORE = 0.99

# Phrases and their labels, as the contract of op3 lists them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices (label, words in order, words that make it another licence's where they stand between) and licence texts as their licences
# word them (label, text, words that must be there, words that must not).
NOTICES = [
    ("notice-mit", "under the MIT License", ""),
    ("notice-apache-2.0", "Apache License Version 2.0", ""),
    ("notice-apache-2.0", "Apache 2.0 License", ""),
    ("notice-gpl-2.0", "GNU General Public License version 2", "lesser affero library 3"),
    ("notice-gpl-2.0", "GPL version 2", "lesser affero lgpl agpl 3"),
    ("notice-gpl-3.0", "GNU General Public License version 3", "lesser affero library"),
    ("notice-gpl-3.0", "GPL version 3", "lesser affero lgpl agpl"),
    ("notice-lgpl", "GNU Lesser General Public License", ""),
    ("notice-agpl-3.0", "GNU Affero General Public License", ""),
    ("notice-mpl-2.0", "Mozilla Public License 2.0", ""),
    ("notice-cc0-1.0", "CC0 1.0 Universal", ""),
    ("notice-cc-by-4.0", "CC BY 4.0", "sa nc nd"),
    ("notice-cc-by-sa-4.0", "CC BY-SA 4.0", "nc nd"),
    ("notice-cc-by-nc-4.0", "CC BY-NC 4.0", "sa nd"),
    ("notice-cc-by-nd-4.0", "CC BY-ND 4.0", "sa nc"),
    ("notice-cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0", "nd"),
    ("notice-cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0", "sa"),
    ("notice-cc-by-4.0", "Creative Commons Attribution 4.0 International", "sharealike noncommercial noderivatives"),
    ("notice-cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "noncommercial noderivatives"),
    ("notice-cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "sharealike noderivatives"),
    ("notice-cc-by-nd-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International", "sharealike noncommercial"),
    ("notice-cc-by-nc-sa-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "noderivatives"),
    ("notice-cc-by-nc-nd-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "sharealike"),
]
TEXTS = [
    ("text-mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "sublicense noninfringement", ""),
    ("text-isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "fee", ""),
    ("text-bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES, HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT,
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "redistributions", "endorse"),
    ("text-bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""", "redistributions endorse", ""),
    ("text-apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""", "apache", ""),
    ("text-gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""", "gnu general 2", "lesser affero library 3"),
    ("text-gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""", "gnu general 3", "lesser affero library"),
    ("text-lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version of the License, or (at your option) any later version. This library is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Lesser General Public License for more details.""", "gnu lesser", ""),
    ("text-agpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Affero General Public License for more details.""", "gnu affero", ""),
    ("text-mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mozilla", ""),
    ("text-unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""", "unencumbered", ""),
    ("text-zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software.""", "misrepresented", ""),
]


@dataclass(frozen=True)
class Template:
    """A label, the words of a text (each once), how many of them a block must have, and words that it must or must not have.

    A notice has order, its words one after the other, and between, the words that must not stand among them.
    """

    label: str
    words: tuple[str, ...]
    least: int
    step: int
    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    between: tuple[str, ...] = ()


def _split(text: str) -> list[str]:
    own = re.findall(WORD, text.lower())
    if not own:
        raise ValueError("a template without words")
    return own


def _step(n: int) -> int:
    return next((s for s in STEPS if n <= s), 1 << (n - 1).bit_length())


def template(label: str, text: str, threshold: float, must: str = "", must_not: str = "") -> Template:
    """A licence's text, of any length."""
    own = _split(text)
    words = tuple(sorted(set(own)))
    return Template(label, words, math.ceil(threshold * len(words) - 1e-9), _step(len(own)), tuple(must.split()), tuple(must_not.split()))


def notice(label: str, text: str, between: str = "") -> Template:
    """A short notice, whose words have to stand in order."""
    own = _split(text)
    words = tuple(sorted(set(own)))
    return Template(label, words, len(words), _step(len(own)), order=tuple(own), between=tuple(between.split()))


def templates(threshold: float = THRESHOLD) -> list[Template]:
    """The known notices and texts; threshold is for the texts."""
    return [notice(label, text, bars) for label, text, bars in NOTICES] + [template(label, text, threshold, must, bars) for label, text, must, bars in TEXTS]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(lowered: Column) -> Column:
    """The words in order; splitting at what lies between is several times as fast as extracting them."""
    return F.array_remove(F.split(lowered, BETWEEN), "")


def phrase_places(words: Column, phrase: str) -> Column:
    """The places in words where the phrase's words stand one after the other."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    # most texts lack the phrase's last word: those are not walked through
    there = F.array_contains(words, parts[-1]) & (last >= 0)
    places = F.filter(F.sequence(F.lit(0), last), lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(parts)]))
    return F.when(there, places).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    made = conditions[0]
    for c in conditions[1:]:
        made = made & c
    return made


def _words(words) -> Column:
    """An array of words, also where there are none."""
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")


def may_hold(own: Column, known: list[Template]) -> Column:
    """Whether a text with these of the templates' words has enough of any template's: what a block lacks, the text may have."""
    made = F.lit(False)
    for t in known:
        made = made | (F.size(F.array_intersect(own, _words(t.words))) >= t.least)
    return made


def in_order(words: Column, order: Column, between: Column, gap: int = GAP) -> Column:
    """Whether words has those of order one after the other, with up to gap others between two and none of between among these.

    All places that the words so far can end at are carried along, so a wrong start hides no right one.
    """
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == F.get(order, F.lit(0)))

    def follow(places: Column, w: Column) -> Column:
        def after(i: Column) -> Column:
            ends = F.filter(F.sequence(i + 1, i + 1 + gap), lambda j: F.get(words, j) == w)
            return F.filter(ends, lambda j: ~F.arrays_overlap(F.slice(words, i + 2, j - i - 1), between))

        return F.array_distinct(F.flatten(F.transform(places, after)))

    ends = F.aggregate(F.slice(order, F.lit(2), F.size(order)), starts, follow)
    return (F.size(words) > 0) & (F.size(ends) > 0)


def containment(texts: DataFrame, counts: DataFrame, known: list[Template]) -> DataFrame:
    """(id, digest, label, score): texts (id, digest, words; stored) with a block that holds enough of a template's words.

    A notice's words must stand in order as well, which is looked up in the texts that have them all in a block; then its
    score is 1. A licence's text is a set of words, and scores its containment times SET_SCORE.

    Exact set-similarity join on distinct words. Words of the templates are ordered by the number of texts they are in
    (counts), rarest first; they number as many as the templates have, whatever the input. A block can reach a
    template's overlap only if it has one of the template's first words (prefix filter), has words enough (length
    filter), and enough can still follow in both (positional filter).
    """
    spark = texts.sparkSession
    vocabulary = sorted({w for t in known for w in (*t.words, *t.must, *t.must_not)})
    count = {r["word"]: r["count"] for r in counts.collect()}
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, tables = [], []
    for n, t in enumerate(known):
        own = sorted(t.words, key=rank.__getitem__)
        tables.append((n, t.label, own, t.least, list(t.must), list(t.must_not)))
        index += [(w, t.step, n, i, len(own), t.least) for i, w in enumerate(own[: len(own) - t.least + 1])]
    # both grow with the templates only
    index_df = F.broadcast(spark.createDataFrame(index, "word string, step int, template int, i int, size int, need int"))
    table_df = F.broadcast(spark.createDataFrame(tables, "template int, label string, ranked array<string>, least int, must array<string>, must_not array<string>"))
    steps = F.array(*(F.lit(s) for s in sorted({t.step for t in known})))
    last = F.greatest(F.ceil(F.size("words") / F.col("step")) - 2, F.lit(0)).cast("int")
    blocks = (
        texts.select("id", "digest", "words", F.explode(steps).alias("step"))
        .select("id", "digest", "words", "step", F.explode(F.sequence(F.lit(0), last)).alias("block"))
        # in the words' order: the literal's
        .select("id", "digest", "step", "block", F.array_intersect(_words(order), F.slice("words", F.col("block") * F.col("step") + 1, F.col("step") * 2)).alias("own"))
    )
    candidates = (
        blocks.select("id", "digest", "step", "block", "own", F.posexplode("own").alias("j", "word"))
        .join(index_df, ["word", "step"])
        .filter((F.size("own") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("own") - F.col("j")) >= F.col("need")))
    )
    overlap = F.size(F.array_intersect("own", "ranked"))
    none = F.size(F.array_intersect("own", "must_not")) == 0
    held = (
        candidates.select("id", "digest", "own", "template")
        .join(table_df, "template")
        .filter((overlap >= F.col("least")) & (F.size(F.array_except("must", "own")) == 0) & none)
        .groupBy("id", "digest", "template")
        .agg(F.max(overlap / F.size("ranked")).alias("score"))
    )
    ordered = [(n, t.label, list(t.order), list(t.between)) for n, t in enumerate(known)]
    held = held.join(F.broadcast(spark.createDataFrame(ordered, "template int, label string, order array<string>, between array<string>")), "template")
    # texts that have a notice's words, each once: repeated rows have the same words
    once = texts.select("id", "digest", "words").join(held.filter(F.size("order") > 0).select("id", "digest").distinct(), ["id", "digest"]).dropDuplicates(["id", "digest"])
    sure = once.join(held.filter(F.size("order") > 0), ["id", "digest"]).filter(in_order(F.col("words"), F.col("order"), F.col("between"))).select("id", "digest", "label", F.lit(1.0).alias("score"))
    both = sure.unionByName(held.filter(F.size("order") == 0).select("id", "digest", "label", (F.col("score") * SET_SCORE).alias("score")))
    return both.groupBy("id", "digest", "label").agg(F.max("score").alias("score"))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, known: list[Template] | None = None) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of df.

    score is 1 where a base phrase or a notice stands, SET_SCORE times the greatest containment of a licence's text that a
    block meets, else 0. Texts of
    any length are scanned whole, once: what later steps need of a text goes to the shared folder. Null and empty texts
    have no words. Repeated rows give repeated rows; ids may be null or shared. Ties of templates all count. Other
    columns of df are not looked at; an id_col named like a result is an error. An empty table gives an empty one.
    """
    common.free_names([id_col], ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    known = templates(threshold) if known is None else known
    vocabulary = sorted({w for t in known for w in (*t.words, *t.must, *t.must_not)})
    key, digest = common.key_columns(id_col, text_col)
    texts = df.select(F.col(id_col).alias("own_id"), key.alias("id"), digest.alias("digest"), words_of(lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("words"))
    places = {label: phrase_places(F.col("words"), phrase) for phrase, label in PHRASES.items()}
    made = texts.select("own_id", "id", "digest", "words", F.array_intersect("words", _words(vocabulary)).alias("own"), *(p.alias(label) for label, p in places.items()))
    every = F.concat(*(F.col(label) for label in places))
    base_labels = F.array_sort(F.array_compact(F.array(*(F.when(F.size(label) > 0, F.lit(label)) for label in places))))
    seen = common.stored(made.select(
        "own_id", "id", "digest", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), base_labels.alias("base"), "own", F.when(may_hold(F.col("own"), known), F.col("words")).alias("words"),
    ))
    counts = seen.select(F.explode("own").alias("word")).groupBy("word").count()
    more = common.stored(containment(seen.filter("words is not null").select("id", "digest", "words"), counts, known))
    more = more.groupBy("id", "digest").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    joined = seen.drop("own", "words").join(more, ["id", "digest"], "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        F.col("own_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
