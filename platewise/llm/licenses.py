"""License scans: phrases by place, and notices by an exact set-similarity join.

A text block is a window of ``2 c`` words that starts at a multiple of ``c`` words, for ``c`` = 8, 16, 32...; a template of ``n`` words looks for itself in the
blocks of the smallest ``c >= n``, so any ``n`` words in a row lie in one block whole, however lines are broken. A block meets a template if it holds at least
``need = ceil(0.9 n)`` of the template's ``n`` distinct words.

The join: words are ordered by their frequency in the whole corpus, rare ones first. A block that holds ``need`` of the template's words holds one of the first
``n - need + 1`` of them (prefix filter); it has ``need`` words of the templates' vocabulary at least (length filter); and after a shared word at places ``i`` and ``j`` of
the two ordered sets enough words must be left in both (positional filter). Distinct word sets of blocks are joined with the templates' prefixes on the word, and whole
sets verify what is left. Words of no template can't count, so they leave the blocks at once, and a block without a prefix word is never listed. A set that many documents share
is joined once.

Of two templates met in the same block, one with all its words in the other, the one with the larger share stays, and the longer one if the shares are equal (CC BY-NC,
not CC BY, where both are whole; GPL, not AGPL, where one word of AGPL's is missing).

Defined results: null and empty texts have no words; repeated rows give equal rows; ties have no order to break, as labels are sorted; one text may be of any length (it is worked on
alone); an empty table, or no templates, gives base columns only; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .words import byte_kinds, in_byte_slices, split

#: Share of a template's words, in percent, that a block must hold.
CONTAINED = 90
#: Smallest ``c`` of the blocks.
CLASS = 8
_KINDS = byte_kinds(bytes(x for x in range(128) if not chr(x).isalnum()))

# Phrases that the base looks for, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label and words of well-known license notices.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "licensed under the GNU General Public License, version 2"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD 3 Clause License"),
    ("bsd", "licensed under the BSD 2 Clause License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
]


def words_of(text: str) -> list[str]:
    w = split(pa.array([text], pa.string()), _KINDS)
    return w.distinct.take(pa.array(w.code)).to_pylist()


def class_of(n: int) -> int:
    """The ``c`` of a template of ``n`` words."""
    return max(CLASS, 1 << max(0, n - 1).bit_length())


def need_of(n: int, contained: int = CONTAINED) -> int:
    return -(-contained * n // 100)


def vocabulary(docs: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words by their number in all documents, rare ones first (ties: by the word)."""
    known = sorted({w for _, t in templates for w in words_of(t)})
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(known, pa.string()))

    def run(batches):
        import pyarrow.compute as pc

        total = np.zeros(len(shared.value), dtype=np.int64)
        for b in in_byte_slices(batches, 0):
            w = split(b.column(0), _KINDS)
            n = np.bincount(w.code, minlength=len(w.distinct))
            at = pc.index_in(shared.value, w.distinct).fill_null(-1).to_numpy()
            total += np.where(at >= 0, n[at], 0) if len(n) else 0
        yield pa.RecordBatch.from_arrays([shared.value, pa.array(total)], ["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # a row a word of the templates
    return sorted(known, key=lambda w: (found.get(w, 0), w))


def template_sets(templates: list[tuple[str, str]], order: list[str], contained: int = CONTAINED) -> list[tuple]:
    """``(template, label, c, need, ranks)`` of each template, ranks ascending."""
    rank = {w: k for k, w in enumerate(order)}
    sets = []
    for k, (label, text) in enumerate(templates):
        words = words_of(text)
        if words:
            ranks = sorted({rank[w] for w in words})
            sets.append((k, label, class_of(len(words)), need_of(len(ranks), contained), ranks))
    return sets


def scan(docs: DataFrame, order: list[str], sets: list[tuple]) -> DataFrame:
    """Per document the base columns, and ``blocks``: the distinct (c, ranks) of blocks that hold a prefix word and enough words of the templates."""
    spark = docs.sparkSession
    phrases = [(tuple(p.split()), label) for p, label in PHRASES.items()]
    rank = {w: k for k, w in enumerate(order)}
    classes = {}
    for _, _, c, need, ranks in sets:
        least, first = classes.get(c, (need, set()))
        classes[c] = min(least, need), first | set(ranks[: len(ranks) - need + 1])
    shared = spark.sparkContext.broadcast((rank, classes))

    def base(codes, at, ends, number):
        """Places of each phrase: first words and text numbers."""
        found = []
        for words, label in phrases:
            c = [number.get(w, -1) for w in words]
            n = len(codes) - len(c) + 1
            if min(c) < 0 or n <= 0:
                continue
            hit = np.flatnonzero(codes[:n] == c[0])
            for k in range(1, len(c)):
                hit = hit[(codes[hit + k] == c[k]) & (at[hit + k] == at[hit])]
            found.append((hit, label))
        return found

    def run(batches):
        ranks_of, by_class = shared.value
        for b in in_byte_slices(batches, 1):
            w = split(b.column(1), _KINDS)
            rows = b.num_rows
            sizes = np.bincount(w.text, minlength=rows)
            start = np.concatenate([[0], np.cumsum(sizes)])
            names = w.distinct.to_pylist()
            n, first, last, labels = np.zeros(rows, np.int64), np.full(rows, -1, np.int64), np.full(rows, -1, np.int64), [set() for _ in range(rows)]
            number = {x: k for k, x in enumerate(names) if x in wanted}
            for hit, label in base(w.code, w.text, start, number):
                for h in hit.tolist():
                    t = int(w.text[h])
                    place = h - int(start[t])
                    n[t] += 1
                    first[t] = place if first[t] < 0 else min(first[t], place)
                    last[t] = max(last[t], place)
                    labels[t].add(label)
            own = np.array([ranks_of.get(x, -1) for x in names], dtype=np.int32)
            code = own[w.code] if len(w.code) else np.zeros(0, np.int32)
            blocks = [set() for _ in range(rows)]
            held = np.flatnonzero(code >= 0)
            place = held - start[w.text[held]]
            for c, (least, prefix) in by_class.items():
                marked = held[np.isin(code[held], list(prefix))]
                where = (marked - start[w.text[marked]]) // c
                found = {(t, x) for t, x in zip(w.text[marked].tolist(), where.tolist())} | {(t, x - 1) for t, x in zip(w.text[marked].tolist(), where.tolist()) if x}
                for t, x in found:
                    lo = np.searchsorted(held, start[t] + x * c)
                    hi = np.searchsorted(held, min(start[t] + (x + 2) * c, start[t + 1]))
                    ranks = np.unique(code[held[lo:hi]])
                    if len(ranks) >= least:
                        blocks[t].add((c, tuple(ranks.tolist())))
            cols = [
                b.column(0),
                pa.array(sizes.astype(np.int64)),
                pa.array(n),
                pa.array(first, mask=first < 0),
                pa.array(last, mask=last < 0),
                pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                pa.array([[{"c": c, "ranks": list(r)} for c, r in sorted(x)] for x in blocks], pa.list_(pa.struct([("c", pa.int32()), ("ranks", pa.list_(pa.int32()))]))),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    wanted = {w for p, _ in phrases for w in p}
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<c: int, ranks: array<int>>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def matches(blocks: DataFrame, sets: list[tuple]) -> DataFrame:
    """``block, labels, score`` of the distinct ``block`` (c, ranks) that meet a template."""
    spark = blocks.sparkSession
    parts = spark.createDataFrame(sets, "template int, label string, c int, need int, words array<int>")
    prefix = F.slice("words", F.lit(1), F.size("words") - F.col("need") + 1)
    postings = parts.select("template", "c", "need", F.size("words").alias("n"), F.posexplode(prefix).alias("i", "word"))
    words = blocks.select("block", F.col("block.c").alias("c"), F.size("block.ranks").alias("m"), F.posexplode("block.ranks").alias("j", "word"))
    left = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    candidates = words.join(postings, ["c", "word"]).filter((F.col("m") >= F.col("need")) & (left >= F.col("need"))).select("block", "template").distinct()
    whole = candidates.join(parts.select("template", "label", "need", "words"), "template")
    held = F.size(F.array_intersect("words", F.col("block.ranks")))
    met = whole.withColumn("held", held).filter("held >= need")
    met = met.groupBy("block").agg(F.collect_list(F.struct("label", "words", (F.col("held") / F.size("words")).alias("share"))).alias("met"))  # templates at most
    within = lambda x, y: (F.size(F.array_except(x["words"], y["words"])) == 0) & (F.size(y["words"]) > F.size(x["words"]))
    closer = lambda x, y: (within(x, y) & (y["share"] >= x["share"])) | (within(y, x) & (y["share"] > x["share"]))
    kept = met.select("block", F.filter("met", lambda x: ~F.exists("met", lambda y: closer(x, y))).alias("met"))
    return kept.select("block", F.array_distinct(F.col("met.label")).alias("labels"), F.array_max(F.col("met.share")).alias("score"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, contained: int = CONTAINED) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; score: 1 where a phrase stands, else the largest share of a template met."""
    made: list[str] = []
    order = vocabulary(docs, templates)
    sets = template_sets(templates, order, contained)
    rows = materialise(scan(docs, order, sets).withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = rows.filter(F.size("blocks") > 0).select("row", F.explode("blocks").alias("block"))
    met = materialise(matches(each.select("block").distinct(), sets), "notices", made)
    found = each.join(met, "block").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("more"), F.max("score").alias("most"))
    found = materialise(found, "notices-of-rows")
    discard(docs.sparkSession, made)
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
