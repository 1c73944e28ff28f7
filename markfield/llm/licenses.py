"""Operator 7: license scans by an exact set-similarity join (DataFrame functions only).

Base phrases are found where their words stand consecutively.  The method adds labels: a text block is a paragraph (what
stands between blank lines, whatever its line breaks); its tokens are the triples of words that follow each other in it; a
block that holds at least THRESHOLD of a template's triples gets the template's label.  The join is exact:
  * triples have a global order, rarest first: by how many blocks of the whole corpus hold the rarest of their words, which
    bounds how many hold the triple;
  * prefix filter: a block that reaches the threshold holds one of the template's first |T| - need + 1 triples, so only
    blocks with the rarest word of such a triple are taken apart into triples, and only those that meet the inverted index
    of the prefixes are candidates;
  * length filter: a candidate has at least `need` triples;
  * positional filter: if the first shared triple of the template stands at place p (from 0), at most |T| - p can be
    shared, which must be `need` or more;
  * what is left is verified by counting all shared triples.
The score is the greatest share of a template that a block holds (1 where a base phrase stands).  The inverted index is made
of this module's templates alone (its size does not grow with the corpus) and is the only thing that is broadcast.

Defined cases: null text is empty (no words, no labels, null places, score 0); paragraphs of under three words match
nothing; repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.llm.shared import cut, let, table, text_or_empty

#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Wordings of public license notices and their labels.
TEMPLATES = (
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without'
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions:",
        "mit",
    ),
    (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND'
        " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
        " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
        " http://www.apache.org/licenses/LICENSE-2.0",
        "apache-2",
    ),
    (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either'
        " express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2",
    ),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of"
        " the License, or (at your option) any later version.",
        "gpl-3",
    ),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details.",
        "gpl",
    ),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND'
        " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "bsd",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
        " https://mozilla.org/MPL/2.0/.",
        "mpl-2",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
        " appear in all copies.",
        "isc",
    ),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("All rights reserved.", "all-rights-reserved"),
)
THRESHOLD, GRAM = 0.8, 3
#: A word of lower-cased text for the SQL oracle, and what separates words (a positive class: Java's negated ones are slow).
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates paragraphs: a line without more than white space.
BLANK = r"\n[ \t\r]*\n"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_in(c: Column) -> Column:
    """Words of a text whose ASCII letters are lower-cased."""
    return F.array_remove(F.split(c, F.lit(GAP)), "")


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(text: str) -> list[str]:
    """Distinct triples of a template, in order."""
    w = words_of(text)
    return list(dict.fromkeys(" ".join(w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)))


def lowered() -> Column:
    return F.translate(text_or_empty(), UPPER, UPPER.lower())


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Blocks of the whole corpus that hold a word of the vocabulary; len(vocabulary) rows reach the driver."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    held = F.flatten(F.transform(F.split(lowered(), F.lit(BLANK)), lambda b: F.array_intersect(F.split(b, F.lit(GAP)), known)))
    each = docs.select(F.explode(held).alias("word"))
    return {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}


def prefix_index(counts: dict[str, int], threshold: float) -> tuple[list[dict], list[str]]:
    """Rows (gram, template, place, size, need) of the inverted index, and the rarest word of every prefix triple."""
    rank = lambda g: (min(counts.get(w, 0) for w in g.split()), g)
    rows, rare = [], set()
    for t, (text, _) in enumerate(TEMPLATES):
        grams = sorted(grams_of(text), key=rank)
        need = math.ceil(threshold * len(grams) - 1e-9)
        rows += [{"gram": g, "template": t, "place": p, "size": len(grams), "need": need} for p, g in enumerate(grams)]
        rare |= {min(g.split(), key=lambda w: (counts.get(w, 0), w)) for g in grams[: len(grams) - need + 1]}
    return rows, sorted(rare)


def blocks_of(docs: DataFrame, rare: list[str]) -> DataFrame:
    """row long, doc_id, n_words, low (lower-cased text where all words of a base phrase occur, else null) and blocks: the
    words of every paragraph that holds a rare word of a prefix."""
    wanted = F.array(*[F.lit(w) for w in rare])

    def holds(blocks: Column, word: str) -> Column:
        return F.exists(blocks, lambda w: F.array_contains(w, word))

    def told(blocks: Column) -> Column:
        possible = F.lit(False)
        for phrase, _ in PHRASES:
            every = F.lit(True)
            for word in phrase.split():
                every = every & holds(blocks, word)
            possible = possible | every
        return F.struct(
            F.aggregate(blocks, F.lit(0).cast("long"), lambda n, w: n + F.size(w)).alias("n_words"),
            possible.alias("possible"),
            F.filter(blocks, lambda w: F.arrays_overlap(w, wanted)).alias("blocks"),
        )

    def read(low: Column) -> Column:
        return let(F.transform(F.split(low, F.lit(BLANK)), words_in), told)

    each = docs.select(F.col("doc_id").alias("doc_id"), let(lowered(), lambda low: F.struct(low.alias("low"), read(low).alias("r"))).alias("z"))
    return each.select(F.monotonically_increasing_id().alias("row"), "doc_id", "z.r.n_words", F.when(F.col("z.r.possible"), F.col("z.low")).alias("low"), "z.r.blocks")


def joined(blocks: DataFrame, rows: list[dict]) -> DataFrame:
    """row, block, template, share of every block (row, blocks) and template that join."""
    spark = blocks.sparkSession
    made = spark.sql("select inline(from_json(:rows, 'array<struct<gram string, template int, place int, size int, need int>>'))", {"rows": json.dumps(rows)})
    index = F.broadcast(made)
    each = blocks.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "w")).where(F.size("w") >= GRAM)

    def triples(w: Column) -> Column:
        n = F.greatest(F.size(w) - (GRAM - 1), F.lit(0))
        parts = [F.slice(w, F.lit(k + 1), n) for k in range(GRAM)]
        return F.array_distinct(F.zip_with(F.zip_with(parts[0], parts[1], lambda a, b: F.concat(a, F.lit(" "), b)), parts[2], lambda a, b: F.concat(a, F.lit(" "), b)))

    grams = each.select("row", "block", let(F.col("w"), triples).alias("grams"))
    hits = cut(grams.select("row", "block", F.size("grams").alias("held"), F.explode("grams").alias("gram")).join(index, "gram"))
    prefix = hits.where("place <= size - need").groupBy("row", "block", "template").agg(F.min("place").alias("p"), F.max("held").alias("held"), F.max("size").alias("size"), F.max("need").alias("need"))
    candidates = prefix.where("held >= need and size - p >= need").select("row", "block", "template")
    shared = hits.join(candidates, ["row", "block", "template"]).groupBy("row", "block", "template").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("need").alias("need"))
    return shared.where("n >= need").selectExpr("row", "block", "template", "cast(n as double) / size as share")


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks (blocks and templates that join)
    of every row."""
    vocabulary = sorted({w for text, _ in TEMPLATES for w in words_of(text)})
    rows, rare = prefix_index(word_counts(docs, vocabulary), threshold)
    read = cut(blocks_of(docs, rare))
    names = F.array(*[F.lit(label) for _, label in TEMPLATES])
    found = joined(read, rows).groupBy("row").agg(F.collect_set(F.get(names, F.col("template"))).alias("more"), F.max("share").alias("share"), F.count("*").alias("n_blocks"))

    def places(w: Column) -> Column:
        def at(i: Column) -> Column:
            hits = []
            for k, (phrase, _) in enumerate(PHRASES):
                same = F.lit(True)
                for j, part in reversed(list(enumerate(phrase.split()))):
                    same = F.when(F.get(w, i + j) == part, same).otherwise(F.lit(False))
                hits.append(F.when(same, F.struct(i.alias("at"), F.lit(k).alias("k"))))
            return F.array_compact(F.array(*hits))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), at))

    none = F.array().cast("array<struct<at:int,k:int>>")
    told = read.select("row", "doc_id", "n_words", F.when(F.col("low").isNotNull(), let(words_in(F.col("low")), places)).otherwise(none).alias("base")).join(found, "row", "left")
    label_of = F.array(*[F.lit(label) for _, label in PHRASES])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: F.get(label_of, x["k"]))))
    spots = F.transform("base", lambda x: x["at"].cast("long"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return told.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(spots).alias("first_word"),
        F.array_max(spots).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = []
    for i, (text, label) in enumerate(TEMPLATES):
        grams = grams_of(text)
        rows.append(f"({i}, '{label}', {grams!r}, {len(grams)}, {math.ceil(THRESHOLD * len(grams) - 1e-9)})")
    phrases = ", ".join(f"({k}, {p.split()!r}, '{label}')" for k, (p, label) in enumerate(PHRASES))
    low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    return rf"""
with told as materialized (select row_number() over () as r, doc_id, {low} as low from documents),
tok as materialized (select r, doc_id, regexp_extract_all(low, '{WORD}') as w from told),
p(k, parts, label) as (values {phrases}),
base as (select r, i - 1 as place, label from (select r, w, unnest(range(1, len(w) + 1)) as i from tok), p where w[i:i + len(parts) - 1] = parts),
b as (select r, count(*) as n, min(place) as lo, max(place) as hi, string_agg(distinct label, ',' order by label) as labels, list(distinct label) as ls from base group by r),
t(i, label, grams, n, need) as (values {", ".join(rows)}),
tg as materialized (select i, label, n, need, unnest(grams) as g from t),
block as materialized (select r, k, regexp_extract_all(s, '{WORD}') as w from (select r, unnest(string_split_regex(low, '{BLANK}')) as s, unnest(range(len(string_split_regex(low, '{BLANK}')))) as k from told)),
bg as materialized (select distinct r, k, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] as g from (select r, k, w, unnest(range(1, len(w) - 1)) as j from block)),
j as (select r, k, i, label, n, need, count(*) as shared from bg join tg using (g) group by all),
m as (select r, count(*) as n_blocks, max(cast(shared as double) / n) as share, list(distinct label) as ls from j where shared >= need group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(b.n, 0) as n_base, b.lo as first_word, b.hi as last_word, coalesce(b.labels, '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(m.ls, [])))), ',') as labels,
  case when b.n > 0 then 1.0 else coalesce(share, 0) end as score, coalesce(n_blocks, 0) as n_blocks
from tok left join b using (r) left join m using (r)
"""


OP7_SQL = _oracle()
