"""License scans, in DataFrame functions only.

Base: places where a license phrase's words stand consecutively. The method: an exact
set-similarity join of text blocks with license templates. A block of a template is any run of
twice its words in the normalised text, wherever lines end. Blocks are seen through the templates'
vocabulary: one pass over the texts stores, for each, the places of these words (and the base).
The vocabulary is ordered by document frequency in the whole corpus, rarest first, and so are
the words of templates and blocks. A block that holds at least c of a template's t words holds one
of its t - ceil(c t) + 1 rarest, so the equi-join is on the places of those (prefix filter);
surroundings with fewer than ceil(c t) words of the vocabulary go (length filter), and so do those
in which the words behind the matched one, in the template's order or in the block's, are too few
(positional filter). In what is left, all blocks around the place are counted exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Not in a word (of lower-cased text).
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and labels of the base.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Templates of the method, and their labels: the sentences by which works name their license, and paragraphs of the public license texts. Fixed values.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        "isc",
    ),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
        "mit",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
        "mpl",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
)
#: Places of the vocabulary that are looked at together.
CHUNK = 1_024


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def least_overlap(text: str, threshold: float) -> int:
    return math.ceil(round(threshold * len(set(template_words(text))), 9))


def spaced(text: Column) -> Column:
    """Lower-cased words with one space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP, " "))


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words start."""
    first, *rest = phrase.split(" ")

    def stands(i: Column) -> Column:
        on = F.get(words, i) == first
        for j, w in enumerate(rest, 1):
            on = on & (F.get(words, i + j) == w)
        return F.coalesce(on, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)


def _template_table(spark, frequency: dict[str, int], templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """A row for each prefix token of each template: token, its place, tokens (in order), least overlap, words of a block, label, and what is rarer in the vocabulary."""
    rank = lambda t: (frequency.get(t, 0), t)
    vocabulary = sorted({t for text, _ in templates for t in template_words(text)}, key=rank)
    rows = []
    for text, label in templates:
        tokens, least = sorted(set(template_words(text)), key=rank), least_overlap(text, threshold)
        rows += [(t, i, tokens, least, 2 * len(template_words(text)), label, vocabulary[: vocabulary.index(t)]) for i, t in enumerate(tokens[: len(tokens) - least + 1])]
    return spark.createDataFrame(rows, "token string, place int, tokens array<string>, least int, width int, label string, rarer array<string>")


def _scanned(docs: DataFrame, id_col: str, text_col: str, phrases: Sequence[tuple[str, str]], vocabulary: Sequence[str]) -> DataFrame:
    """One pass over the texts: row number, id, n_words, places and labels of the phrases, and spots: the places of the vocabulary's words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # as generated rows, the normalised text and its words are computed once, however many expressions use them
    norms = rows.select("id", F.explode(F.array(spaced(F.col("text")))).alias("norm"))
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    holds = F.explode(F.array(F.array(*[F.contains(F.col("norm"), F.lit(p)) & F.contains(padded, F.lit(f" {p} ")) for p, _ in phrases]))).alias("holds")
    words = F.explode(F.array(F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " ")))).alias("words")
    held = norms.select("id", "norm", holds).select("id", "holds", words)
    has = [F.col("holds")[i] for i in range(len(phrases))]
    places = [F.when(h, _places(F.col("words"), p)).otherwise(F.array().cast("array<int>")) for h, (p, _) in zip(has, phrases, strict=True)]
    labels = F.filter(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(has, phrases, strict=True)]), lambda x: x.isNotNull())
    spot = lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("pos"), w.alias("token")))
    return held.select(
        F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), F.flatten(F.array(*places)).alias("places"), F.array_sort(F.array_distinct(labels)).alias("base_list"),
        F.filter(F.transform("words", spot), lambda s: s.isNotNull()).alias("spots"),
    )


def _matches(scanned: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """(row, label, containment) of the templates that some block of a text meets. most: words of the largest block."""
    listed = [r["token"] for r in table.select("token").distinct().orderBy("token").collect()]  # of the templates alone
    some = scanned.filter(F.exists("spots", lambda s: s["token"].isin(listed))).select("row", "spots")
    # long texts go on in chunks, which overlap by the largest block on both sides
    first = lambda c: F.greatest(c - most, F.lit(0))
    chunk = lambda c: F.struct((c - first(c)).alias("at"), F.slice("spots", first(c) + 1, c - first(c) + CHUNK + most).alias("spots"))
    chunks = some.select("row", F.explode(F.transform(F.sequence(F.lit(0), F.size("spots") - 1, F.lit(CHUNK)), chunk)).alias("c")).select("row", "c.*")
    mine = F.filter(F.sequence(F.col("at"), F.least(F.col("at") + CHUNK, F.size("spots")) - 1), lambda i: F.get("spots", i)["token"].isin(listed))
    around = lambda i: F.struct(F.get("spots", i).alias("spot"), F.slice("spots", F.greatest(i - most, F.lit(0)) + 1, F.least(i, F.lit(most)) + most).alias("near"))
    near = chunks.select("row", F.explode(F.transform(mine, around)).alias("x")).select("row", "x.spot.token", "x.spot.pos", "x.near")
    met = near.join(F.broadcast(table), "token")  # a row for each prefix word of the given templates
    met = met.withColumn("near", F.explode(F.array(F.filter("near", lambda s: F.abs(s["pos"] - F.col("pos")) < F.col("width")))))
    met = met.withColumn("block", F.explode(F.array(F.array_distinct(F.transform("near", lambda s: s["token"])))))
    behind = F.size("block") - F.size(F.array_intersect("block", "rarer"))  # the matched word, and those after it in the block's order
    met = met.filter((F.size("block") >= F.col("least")) & (F.least(F.size("tokens") - F.col("place"), behind) >= F.col("least")))
    met = met.filter(F.size(F.array_intersect("block", "tokens")) >= F.col("least"))
    # all blocks that start at a template's word and hold the place
    met = met.withColumn("near", F.explode(F.array(F.filter("near", lambda s: F.array_contains("tokens", s["token"])))))
    starts = F.filter("near", lambda s: s["pos"] <= F.col("pos"))
    inside = lambda b: F.filter("near", lambda s: (s["pos"] >= b["pos"]) & (s["pos"] < b["pos"] + F.col("width")))
    shared = F.array_max(F.transform(starts, lambda b: F.size(F.array_distinct(F.transform(inside(b), lambda s: s["token"])))))
    return met.withColumn("shared", shared).filter("shared >= least").select("row", "label", (F.col("shared") / F.size("tokens")).alias("containment"))


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9
) -> DataFrame:
    """License phrases of whole texts, and labels of template matches in runs of their words.

    Returns one row per row of `docs`: the id, n_words, n_base (all places of all phrases),
    first_word and last_word (smallest and largest start; null without places), base_labels, labels
    (base and template labels, distinct, sorted, comma-joined), score (1 if a phrase is there, else
    the largest containment of a template, 0 if none reaches the threshold). Defined cases: null
    and empty texts have no words, no places and empty labels; texts of any length are used
    whole; line ends are gaps like others; overlapping places all count; rows with a null or a
    repeated id are judged each; an empty table gives an empty result; other columns are ignored.
    """
    vocabulary = sorted({t for text, _ in templates for t in template_words(text)})
    scanned = cut(_scanned(docs, id_col, text_col, phrases, vocabulary), "scanned")
    # document frequency over the whole corpus: a row for each word of the templates at most
    found = scanned.select(F.explode(F.array_distinct(F.transform("spots", lambda s: s["token"]))).alias("token")).groupBy("token").count()
    frequency = {r["token"]: r["count"] for r in found.collect()}
    table = _template_table(docs.sparkSession, frequency, templates, threshold)
    matches = _matches(scanned, table, 2 * max(len(template_words(text)) for text, _ in templates))
    found = matches.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    joined = scanned.drop("spots").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base_list", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_list", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
phrases(phrase, label, size) AS (VALUES {", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in PHRASES)}),
spot AS (SELECT doc_id, label, i FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d), phrases WHERE array_to_string(ws[i + 1:i + size], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM spot GROUP BY 1),
templates(no, token, size, least, width, label) AS (VALUES {", ".join(f"({n}, '{t}', {len(set(template_words(text)))}, {least_overlap(text, 0.9)}, {2 * len(template_words(text))}, '{x}')" for n, (text, x) in enumerate(TEMPLATES) for t in sorted(set(template_words(text))))}),
hits AS (SELECT doc_id, no, i, token, size, least, width, label FROM (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS i FROM d) JOIN templates USING (token)),
likely AS (SELECT doc_id, no FROM hits GROUP BY doc_id, no, least HAVING count(DISTINCT token) >= least),
h AS (SELECT hits.* FROM hits JOIN likely USING (doc_id, no)),
found AS (SELECT a.doc_id, a.label, count(DISTINCT b.token) / a.size AS containment FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.no = a.no AND b.i >= a.i AND b.i < a.i + a.width
  GROUP BY a.doc_id, a.no, a.i, a.label, a.size, a.least HAVING count(DISTINCT b.token) >= a.least),
best AS (SELECT doc_id, max(containment) AS containment FROM found GROUP BY 1),
b AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spot GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM spot UNION SELECT doc_id, label FROM found) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 CASE WHEN n_base > 0 THEN 1 ELSE coalesce(containment, 0) END::DOUBLE AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id
"""
