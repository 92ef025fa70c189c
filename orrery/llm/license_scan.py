"""License scans: an exact set-similarity join of text blocks with licence templates.

A text and a template are compared by their tokens: pairs of neighbouring words,
so that order counts.  A block is as many consecutive words as a template's size
class has (the least power of two, 64 at least, that is twice the template's
length), every half block anew, so that any span as long as the template lies
whole in one.  A block meets a template if it holds at least ``CONTAINMENT`` of
the template's distinct tokens.

Tokens are ordered by how many documents hold them, rarest first.  Prefix
filter: with n tokens of which m are needed, a block that meets the template
holds one of its first n - m + 1 tokens; documents without any of those go no
further, and blocks are joined with templates on those alone.  Length filter:
the block has m distinct tokens at least.  Positional filter: from the first
shared token at place p, at most n - p tokens can be shared.  What remains is
verified on the full sets.  All of it is DataFrame functions; the words of a
text are taken once, and only the places of template tokens are written.

Fixed phrases are found besides, at every place where their words stand
consecutively.

Defined results: a null or empty text has 0 words and no labels, score 0; null
ids and repeated rows are kept, each row answered for itself; a very long text
is cut into words whole, in one row; an empty table gives an empty result.  Only
the two named columns are read, so others may have any names.  Templates and
phrases have two words at least.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public licence notices and texts, and the labels that a match adds.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Released under the MIT License", "mit-notice"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache-2.0-notice",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program.""",
        "gpl-notice",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
        "isc-text",
    ),
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit-text",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd-2-clause",
    ),
)
CONTAINMENT = 0.8
LEAST_BLOCK = 64
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, NOT_WORD), lambda x: x != "")


def pairs(text: str) -> list[str]:
    """Pairs of neighbouring words of a template or phrase, in order."""
    w = [x for x in re.split(NOT_WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if x]
    if len(w) < 2:
        raise ValueError(f"fewer than two words: {text!r}")
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def block_of(template: str) -> int:
    """Words of a block for the template: a power of two, twice the template's words at least."""
    n = len(pairs(template)) + 1
    return max(LEAST_BLOCK, 1 << (2 * n - 1).bit_length())


def needed(template: str, containment: float) -> int:
    return math.ceil(containment * len(set(pairs(template))) - 1e-9)


def license_scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """(a row per document, a row per matching block: __row, label, start word, containment)."""
    sets = {label: set(pairs(t)) for t, label in templates}
    block, need = ({label: f(t) for t, label in templates} for f in (block_of, lambda t: needed(t, containment)))
    vocabulary = sorted({p for s in sets.values() for p in s} | {p for x, _ in phrases for p in pairs(x)})

    # The places of tokens of any template or phrase, in order.
    seen = docs.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("__w")).withColumn("n_words", F.size("__w").cast("long"))
    every = F.transform(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 1, F.lit(0))), lambda w, i: F.struct(i.alias("i"), F.concat(w, F.lit(" "), F.get("__w", i + 1)).alias("p")))
    seen = seen.withColumn("__at", F.filter(every, lambda x: x["p"].isin(vocabulary)))

    def starts(phrase: str) -> Column:
        parts = pairs(phrase)

        def here(x, j):
            found = x["p"] == parts[0]
            for k, p in enumerate(parts[1:], 1):
                then = F.get("__at", j + k)
                found = found & F.coalesce((then["p"] == p) & (then["i"] == x["i"] + k), F.lit(False))
            return found

        return F.transform(F.filter("__at", here), lambda x: x["i"])

    places = F.array(*[starts(p) for p, _ in phrases])
    seen = staged(seen.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "n_words", "__at", F.when(F.size("__at") > 0, places).alias("__places")), "license")

    # Global order of the tokens: by documents that hold them, rarest first.
    held_by = seen.select(F.explode(F.array_distinct("__at.p")).alias("p")).groupBy("p").agg(F.count("*").alias("docs"))
    held_by = dict(held_by.collect())  # at most one row for each token of the templates and phrases
    rank = {p: k for k, p in enumerate(sorted(vocabulary, key=lambda p: (held_by.get(p, 0), p)))}
    ordered = {label: sorted(s, key=rank.get) for label, s in sets.items()}
    prefixes = [(p, block[label], label, k, len(s)) for label, s in ordered.items() for k, p in enumerate(s[: len(s) - need[label] + 1])]
    spark = docs.sparkSession
    # The templates are fixed values, and so are these tables made of them.
    prefix = F.broadcast(spark.createDataFrame(prefixes, "p string, block int, label string, place int, size int"))
    token = F.broadcast(spark.createDataFrame(sorted({(p, block[label]) for label, s in sets.items() for p in s}), "p string, block int"))
    template = F.broadcast(spark.createDataFrame([(label, s, need[label]) for label, s in ordered.items()], "label string, tokens array<string>, need int"))

    may = sorted({x[0] for x in prefixes})
    at = seen.where(F.exists("__at", lambda x: x["p"].isin(may))).select("__row", F.inline("__at")).join(token, "p")
    half = (F.col("block") / 2).cast("int")
    number = F.floor(F.col("i") / half).cast("int")
    at = at.select("__row", "p", "block", "i", F.explode(F.array(number, number - 1)).alias("k")).where((F.col("k") >= 0) & (F.col("i") + 1 < F.col("k") * half + F.col("block")))
    blocks = at.groupBy("__row", "block", "k").agg(F.collect_set("p").alias("set"))
    shared = blocks.select("__row", "block", "k", "set", F.explode("set").alias("p")).join(prefix, ["p", "block"])
    first = shared.groupBy("__row", "block", "k", "label", "size").agg(F.min("place").alias("place"), F.first("set").alias("set"))
    near = first.join(template, "label").where((F.size("set") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need")))
    near = near.withColumn("shared", F.size(F.array_intersect("set", "tokens"))).where("shared >= need")
    matches = near.select("__row", "label", (F.col("k") * half).alias("start"), (F.col("shared") / F.col("size")).alias("containment"))
    return seen, matches


def summary(seen: DataFrame, matches: DataFrame, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    best = matches.groupBy("__row").agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__best"))
    out = seen.drop("__at").join(best, "__row", "left")
    none = F.array().cast("array<string>")
    base = F.filter(F.array(*[F.when(F.size(F.get("__places", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())
    every = F.flatten("__places")
    return out.select(
        "doc_id", "n_words", F.coalesce(F.when(F.col("__places").isNotNull(), F.size(every)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("__labels", none))), ",").alias("labels"),
        F.greatest(F.coalesce("__best", F.lit(0.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same by brute force in DuckDB SQL: every block against every template of its size."""
    phrase = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    template = ", ".join(f"({sorted(set(pairs(t)))!r}, '{label}', {needed(t, CONTAINMENT)}, {block_of(t)})" for t, label in TEMPLATES)
    return f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    p(ws, label) as (values {phrase}), t(ps, label, need, size) as (values {template}), sizes as (select distinct size from t),
    hits as (select doc_id, i - 1 as place, label from d, p, unnest(range(1, len(w) - len(ws) + 2)) as u(i) where w[i:i + len(ws) - 1] = ws),
    base as (select doc_id, count(*) as n, min(place) as lo, max(place) as hi, list(distinct label) as ls from hits group by doc_id),
    q as (select doc_id, len(w) as n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as ps from d),
    b as (select doc_id, size, list_distinct(ps[i * size // 2 + 1:i * size // 2 + size - 1]) as s from q, sizes, unnest(range(0, n // (size // 2) + 1)) as u(i)),
    m as (select doc_id, label, len(list_intersect(s, ps)) / len(ps) as c from b join t using (size) where len(list_intersect(s, ps)) >= need),
    best as (select doc_id, list(distinct label) as ls, max(c) as c from m group by doc_id)
    select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, lo::bigint as first_word, hi::bigint as last_word,
      array_to_string(list_sort(coalesce(base.ls, [])), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(best.ls, [])))), ',') as labels,
      greatest(coalesce(c, 0), case when n > 0 then 1 else 0 end)::double as score
    from d left join base using (doc_id) left join best using (doc_id)"""
