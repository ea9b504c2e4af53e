"""License scans by diagonal voting: rolling word k-gram hashes joined to template positions.

One scan hashes every k-gram of every whole text. A join with the templates' grams (a few thousand rows, broadcast; the
size is checked) gives hits; each votes for a template's diagonal, the document position less the template position.
Votes are summed by document, template and diagonal before any shuffle, diagonals that differ by a few words are merged
into one span (inserted or missing words shift the diagonal), whatever single hits lie between them in the text, and a span counts when enough different template
positions agree, in order and with a second, independent hash of the gram.

Fixed phrases are templates whose every gram must stand on one diagonal: that is a place of the phrase.

Defined cases: null text has no words; repeated rows are scanned on their own; texts without hits get n_base 0, null
positions, empty labels and score 0. A long text is hashed whole; its votes are grouped, never collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RowNumbers, map_texts, text_bytes

K = 2
SLACK = 6  # diagonals between neighbours of one span
LONG = 20  # grams from which a template's single hits hold no span together; they count in a span beside them
MOST_GRAMS = 50_000
#: Word characters are all but these; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))

PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: (label, least share of the template's grams, text). Fixed wording of the public notices.
TEMPLATES = [
    ("mit", 0.8, "released under the MIT License"),
    ("mit", 0.5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", 0.8, "licensed under the Apache License, Version 2.0"),
    ("apache", 0.5, "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", 0.8, "licensed under the GNU General Public License, version 3"),
    ("gpl", 0.5, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", 0.5, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by", 0.9, "licensed under CC BY 4.0"),
    ("cc-by", 0.9, "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", 0.9, "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", 0.9, "licensed under CC BY-SA 4.0"),
    ("all-rights-reserved", 1.0, "all rights reserved"),
]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def gram_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each K words in a row: the one to join on, the one to verify."""
    import zlib

    import xxhash

    n = len(words) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    one = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    two = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(K):
            a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
            b = b * np.uint32(0x85EBCA6B) + two[k : k + n]
    return a.view(np.int64), b.view(np.int32)


END = -1  # hash that keeps every document in the join


def template_grams(spark: SparkSession, templates: list[tuple[str, float, str]], phrases: list[tuple[str, str]]) -> DataFrame:
    """template, base, label, least, grams, gram, check, at: one row per gram of a template."""
    rows: list[tuple] = [(-1, False, "", 1.0, 1, END, 0, 0)]
    for t, (label, least, text) in enumerate([(label, 2.0, text) for label, text in phrases] + templates):
        grams, checks = gram_hashes(words_of(text.encode()))
        rows += [(t, least > 1, label, min(least, 1.0), len(grams), int(g), int(c), at) for at, (g, c) in enumerate(zip(grams, checks))]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"templates have {len(rows)} grams; the broadcast is meant for {MOST_GRAMS} at most")
    return spark.createDataFrame(rows, "template int, base boolean, label string, least double, grams int, gram long, check int, at int")


def scan(docs: DataFrame, templates: list[tuple[str, float, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """Per row of docs: row, doc_id, n_words, spans (label, base, first, last word, coverage: share of the template's grams)."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        rows = RowNumbers()
        for part in parts:
            hashed = [words_of(t) if t else [] for t in text_bytes(part["text"])]
            counts = [len(w) for w in hashed]
            grams, checks = zip(*map(gram_hashes, hashed)) if hashed else ((), ())
            ends = np.cumsum([0, *(len(g) + 1 for g in grams)])
            flat = np.concatenate([x for g in grams for x in (g, [END])] or [np.zeros(0, np.int64)]).astype(np.int64)
            flat_checks = np.concatenate([x for c in checks for x in (c, [0])] or [np.zeros(0, np.int32)]).astype(np.int32)
            as_lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
            yield {"row": rows.take(len(counts)), "doc_id": part["doc_id"], "n_words": counts, "grams": as_lists(flat), "checks": as_lists(flat_checks)}

    hashed = map_texts(docs, ["doc_id", "text"], work, "row long, doc_id long, n_words long, grams array<long>, checks array<int>")
    table = F.broadcast(template_grams(docs.sparkSession, templates, phrases))
    votes = hashed.selectExpr("row", "doc_id", "n_words", "checks", "posexplode(grams) as (pos, gram)").join(table, "gram")
    votes = votes.where("template = -1 or check = get(checks, pos)")
    keys = ["row", "doc_id", "n_words", "template"]
    diagonals = votes.groupBy(*keys, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.first("base").alias("base"), F.first("label").alias("label"), F.first("least").alias("least"), F.first("grams").alias("grams"),
        F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    # neighbouring diagonals of a template belong to one span; its places are as close as the template is long
    order = Window.partitionBy(*keys).orderBy("diagonal")
    strong = F.when(F.col("base") | (F.size("ats") > 1) | (F.col("grams") < LONG), F.col("diagonal"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    spans = diagonals.withColumn("strong", strong).withColumns({
        "behind": F.coalesce(F.col("diagonal") - F.max("strong").over(before) <= SLACK, F.lit(False)) & ~F.col("base"),
        "ahead": F.coalesce(F.min("strong").over(after) - F.col("diagonal") <= SLACK, F.lit(False))})
    spans = spans.withColumn("upto", F.sum(F.expr("if(strong is not null and not behind, 1, 0)")).over(order))
    spans = spans.withColumn("alone", F.row_number().over(order))
    spans = spans.withColumn("span", F.expr("case when strong is not null or behind then upto when ahead then upto + 1 else -alone end"))
    spans = spans.groupBy(*keys, "span", "base", "label", "least", "grams").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), 
        F.expr("coalesce(min(first) filter (where strong is not null), min(first)) as first"), F.expr("coalesce(max(last) filter (where strong is not null), max(last)) as last"))
    spans = spans.withColumn("coverage", F.size("ats") / F.col("grams"))  # share of the template's grams that agree
    good = spans.where("template = -1 or coverage >= least")
    span = F.struct("label", "base", F.col("first").cast("long").alias("first"), (F.col("last") + K - 1).cast("long").alias("last"), "coverage")
    kept = F.collect_list(F.when(F.col("template") >= 0, span))
    return good.groupBy("row", "doc_id", "n_words").agg(kept.alias("spans"))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (a base phrase alone counts one half)."""
    joined = lambda what: F.array_join(F.array_sort(F.array_distinct(F.expr(what))), ",")
    out = scanned.withColumn("base", F.expr("filter(spans, s -> s.base)"))
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"), joined("base.label").alias("base_labels"), joined("spans.label").alias("labels"),
        F.expr("coalesce(array_max(transform(spans, s -> if(s.base, 0.5D, s.coverage))), 0D)").alias("score"))
