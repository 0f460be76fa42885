"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license notices.

A text is cut into overlapping blocks of words, so that every passage as long as a notice lies whole in a
block. A block meets a notice if it contains PERCENT of the notice's distinct words or more. The join finds
all such pairs: words of notices are ordered by how many documents of the corpus hold them, rarest
first, and only a notice's first words, of which a meeting block must hold one, are joined with the blocks'
words. Block and notice must be long enough, and the words behind the shared one must still suffice, before
the sets are intersected. All of it is DataFrame expressions and equi-joins; the notices' words are the only table
that is broadcast, and it does not grow with the corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Characters that part words, once A-Z are in lower case.
APART = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Phrases whose words stand one behind the other, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Public license notices, with their labels.
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "licensed under the terms of the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org/MPL/2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
)
#: Containment that a block must reach, and the most words of a notice: blocks hold twice as many and begin every so many.
PERCENT, SPANS = 90, (16, 64)


def notice_words(text: str) -> list[str]:
    return re.findall(f"[^{APART}]+", text.lower())


def notices(given: tuple[tuple[str, str], ...] = NOTICES) -> list[dict]:
    """Label, distinct words, needed words and span of each notice."""
    out = []
    for number, (label, text) in enumerate(given):
        words = notice_words(text)
        if not words or len(words) > SPANS[-1]:
            raise ValueError(f"a notice has 1 to {SPANS[-1]} words: {text}")
        distinct = list(dict.fromkeys(words))
        out.append({"notice": number, "label": label, "words": distinct, "needed": -(-PERCENT * len(distinct) // 100), "span": next(s for s in SPANS if len(words) <= s)})
    return out


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for a null or blank one.

    Lower case of other letters changes no result, since only words of ASCII letters and digits are looked for; the one
    other letter that it would make an ASCII letter of, the Kelvin sign, is made another one before.
    """
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")))
    apart = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
    bare = F.btrim(lower, F.lit(apart))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{APART}]+"))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table of literals; lists are lists of strings."""
    made = lambda v: _strings(v) if isinstance(v, list) else F.lit(v)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[made(v).alias(c) for c, v in row.items()]) for row in rows])))


def phrase_columns(names: tuple[tuple[str, str], ...] = PHRASES) -> dict[str, Column]:
    """Places of the phrases in an array ``words``: n_base, first_word, last_word, base_labels.

    Every word stands between two spaces of its own, so a phrase is found as a plain string, places never share a
    character, and half the spaces before a place are its number.
    """
    joined, number = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")), lambda c: F.floor(F.regexp_count(c, F.lit(" ")) / 2)
    n, first, last, labels = [], [], [], []
    for phrase, label in names:
        mark = f" {phrase.replace(' ', '  ')} "
        found = F.contains(joined, F.lit(mark))
        n.append(F.when(found, ((F.length(joined) - F.length(F.replace(joined, F.lit(mark), F.lit("")))) / len(mark)).cast("long")).otherwise(F.lit(0).cast("long")))
        first.append(F.when(found, number(F.substring_index(joined, mark, 1))))
        last.append(F.when(found, F.size("words") - number(F.substring_index(joined, mark, -1)) - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    return {"n_base": sum(n[1:], n[0]), "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"), "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))}


def frequency_order(docs: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by how many rows of ``docs`` hold a word, rarest first, ties by the word. One row a word reaches the
    driver."""
    held = docs.select(F.explode(F.array_intersect(words(F.col(text)), _strings(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = {r["word"]: r["n"] for r in held.collect()}
    return sorted(vocabulary, key=lambda w: (often.get(w, 0), w))


def license_blocks(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), given: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Every block that meets a notice: the columns ``carry``, start (its first word, from 0), size (most words it has),
    notice (its place in ``given``), label, containment.

    Blocks of 2 * span words begin every span words for each span of SPANS, and meet the notices of that span. Null and
    blank texts have no blocks.
    """
    spark, known = docs.sparkSession, notices(given)
    order = frequency_order(docs, text, sorted({w for n in known for w in n["words"]}))
    rank = {w: i for i, w in enumerate(order)}
    sets, postings = [], []
    for n in known:
        own = sorted(n["words"], key=rank.__getitem__)
        sets.append({"notice": n["notice"], "label": n["label"], "set": own})
        postings += [{"span": n["span"], "word": w, "i": i, "notice": n["notice"], "length": len(own), "needed": n["needed"]} for i, w in enumerate(own[: len(own) - n["needed"] + 1])]
    at = lambda span: F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - span - 1), F.lit(span))

    def cut(span: int) -> Column:
        """Blocks of one span that hold a first word of a notice."""
        first = _strings(sorted({p["word"] for p in postings if p["span"] == span}))
        made = F.transform(at(span), lambda i: F.struct(F.lit(span).alias("span"), i.alias("start"), F.slice("words", i + 1, F.lit(2 * span)).alias("own")))
        return F.when(F.arrays_overlap("words", first), F.filter(made, lambda b: F.arrays_overlap(b["own"], first)))

    empty = F.array().cast("array<struct<span:int,start:int,own:array<string>>>")
    every = F.concat(*[F.coalesce(cut(s), empty) for s in SPANS])
    rows = docs.select(*carry, words(F.col(text)).alias("words")).select(*carry, F.explode(every).alias("block"))
    # The words of a block that notices have, in the order of their frequency: that of the first array.
    rows = rows.select(*carry, "block.span", "block.start", F.array_intersect(_strings(order), F.col("block.own")).alias("own"))
    probed = rows.select("*", F.posexplode("own").alias("j", "word"))
    pairs = probed.join(F.broadcast(_table(spark, postings)), ["span", "word"])  # a row a notice and first word
    pairs = pairs.where((F.size("own") >= F.col("needed")) & (F.least(F.size("own") - F.col("j"), F.col("length") - F.col("i")) >= F.col("needed")))
    met = pairs.join(F.broadcast(_table(spark, sets)), "notice").withColumn("overlap", F.size(F.array_intersect("set", "own"))).where("overlap >= needed")
    found = met.select(*carry, "start", (F.col("span") * 2).alias("size"), "notice", "label", (F.col("overlap") / F.col("length")).alias("containment"))
    return found.distinct()


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels, n_blocks, score.

    ``n_base`` are the places of the PHRASES, first_word and last_word the smallest and largest word at which one starts
    (null without any); ``labels`` adds those of the notices that a block meets, n_blocks of them; both are distinct, sorted and
    joined with commas. ``score`` is 1 with a phrase, else the largest containment of a notice that is met, else 0. Null and
    empty texts have no words and no labels. Texts are read whole, whatever their length. Repeated rows come back repeated, a null key
    is a key, an empty table gives an empty result; other columns are not read, whatever their names.
    """
    own = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_hash"))
    base = own.withColumn("words", words(F.col("_text"))).select("_key", "_hash", F.size("words").cast("long").alias("n_words"), *[c.alias(n) for n, c in phrase_columns().items()])
    blocks = license_blocks(own, "_text", ("_key", "_hash"))  # equal rows have equal blocks, which are one here
    met = blocks.groupBy("_key", "_hash").agg(F.collect_set("label").alias("more"), F.count("*").alias("n_blocks"), F.max("containment").alias("containment"))
    met = met.withColumnsRenamed({"_key": "_k", "_hash": "_h"})
    rows = base.join(met, base["_key"].eqNullSafe(met["_k"]) & (base["_hash"] == met["_h"]), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return rows.select(F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), score.alias("score"))


def _sql() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    places = [f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {quoted(p.split())}), lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in PHRASES]
    values = ", ".join(f"('{n['label']}', {n['span']}, {quoted(n['words'])}, {n['notice']})" for n in notices())
    return f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^{APART}]+') AS w FROM documents),
p AS (SELECT row, doc_id, w, list_concat({", ".join(places)}) AS places FROM t),
n(label, span, words, notice) AS (VALUES {values}),
s AS (SELECT row, w, span, unnest(range(0, greatest(len(w) - span, 1), span)) AS start FROM t, (SELECT DISTINCT span FROM n)),
b AS (SELECT row, span, start, w[start + 1:start + 2 * span] AS own FROM s WHERE len(w) > 0),
m AS (SELECT row, label, len(list_intersect(words, own)) AS overlap, len(words) AS size FROM b JOIN n USING (span)),
g AS (SELECT row, list(DISTINCT label) AS labels, count(*) AS n_blocks, max(overlap / size) AS containment FROM m WHERE 100 * overlap >= {PERCENT} * size GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(list_transform(places, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(places, lambda x: x.at))::BIGINT AS last_word,
array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.label), coalesce(labels, [])))), ',') AS labels, coalesce(n_blocks, 0)::BIGINT AS n_blocks,
CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score FROM p LEFT JOIN g USING (row)"""


OP13_SQL = _sql()


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
