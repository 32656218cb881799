"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A template's tokens are its distinct words. A block is a window of 2 * L words, begun every L words, L being the least power of two
that a template's words fit in: so each place of such a template lies whole in a block, and blocks are as long as what is sought in
them. A block holds a template if it has at least THRESHOLD of its tokens, `least` of them. All tokens have one order: by how often they
occur in all documents, the rarest first. Three filters leave few pairs to verify, and lose none:

- prefix: of n tokens, `least` of which must be shared, one of the rarest n - least + 1 must be; those alone are looked up in texts;
- length: the block must have at least `least` tokens that occur in templates at all;
- position: after the first shared token, enough tokens must be left in either order.

Templates are taken in parts of at most BLOCK_BYTES, each of which is broadcast. Documents are not shuffled: a scan counts
the templates' words, another finds base phrases and blocks.

Defined results: a null text is empty; a text without words has no places, null first_word and last_word, and no labels. Templates
without words or without a label match nothing. Documents that repeat are reported each, null ids too. score is the largest
share of a template's tokens that a reported block holds, 1 where a base phrase stands, else 0. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, texts

#: Base phrases, and the labels they give.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Statements and notices of widely used licenses, with the label that each gives.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
THRESHOLD, BLOCK_BYTES = 0.9, 8 << 20

#: Bytes: A-Z become a-z; what can't be in a word becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
HIT = "struct<label:string,begin:long,end:long,shared:int,tokens:int>"
KIND = f"doc_id long, n_words long, places array<struct<label:string,at:long>>, blocks array<{HIT}>"


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def phrase_places(own: list[bytes]) -> list[tuple[str, int]]:
    """(label, number of its first word) of every base phrase."""
    joined, out = b" %s " % b" ".join(own), []
    for phrase, label in PHRASES.items():
        seek, seen, before = b" %s " % phrase.encode(), 0, 0
        at = joined.find(seek)
        while at >= 0:
            before += joined.count(b" ", seen, at)  # every word before has one space in front of it
            out.append((label, before))
            seen, at = at, joined.find(seek, at + 1)
    return out


class Index:
    """Templates by the rarest of their tokens. frequency: of words, in all documents."""

    def __init__(self, templates: list[tuple[str, bytes]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        kept = [(label, w) for label, text in templates if (w := words(text))]
        self.rank = {w: k for k, w in enumerate(sorted({w for _, own in kept for w in own}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.rare = [], {}
        for k, (label, own) in enumerate(kept):
            tokens = sorted({self.rank[w] for w in own})
            least = max(1, ceil(len(tokens) * threshold - 1e-9))
            self.templates.append((label, tokens, frozenset(tokens), least, 1 << (len(own) - 1).bit_length()))
            for at in range(len(tokens) - least + 1):
                self.rare.setdefault(tokens[at], []).append((k, at))
        self.rare_words = {w: self.rare[r] for w, r in self.rank.items() if r in self.rare}

    def holds(self, block: list[int], k: int) -> int:
        """How many tokens of template k the block (ranks in order) has, or 0 if too few."""
        _, tokens, own, least, _ = self.templates[k]
        if len(block) < least:
            return 0
        first = next(j for j, r in enumerate(block) if r in own)
        if 1 + min(len(block) - first, len(tokens) - tokens.index(block[first])) - 1 < least:
            return 0
        shared = sum(r in own for r in block)
        return shared if shared >= least else 0

    def blocks(self, own: list[bytes]) -> list[tuple]:
        """(label, begin, end, tokens shared, tokens of the template) of every block that holds a template."""
        asked: dict[tuple[int, int], set] = {}
        for i, w in enumerate(own):
            for k, _ in self.rare_words.get(w, ()):
                step = self.templates[k][4]
                for b in (i // step - 1, i // step):
                    if b >= 0 and (b * step + step < len(own) or b == 0):  # a block that adds no word to the one before isn't begun
                        asked.setdefault((step, b), set()).add(k)
        out = []
        for (step, b), ks in asked.items():
            begin, end = b * step, min(len(own), (b + 2) * step)
            block = sorted({r for w in own[begin:end] if (r := self.rank.get(w)) is not None})
            out += [(self.templates[k][0], begin, end, n, len(self.templates[k][1])) for k in ks if (n := self.holds(block, k))]
        return sorted(out, key=lambda x: (x[1], x[2], x[0], -x[3], x[4]))


def frequencies(docs: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """How often each of the asked words occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                n.update(w for w in words(t) if w in shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = texts(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def scan(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """templates: label, text. A row for each document and part of the templates: doc_id, n_words, places of base phrases (with the
    first part), and blocks that hold a template."""
    small_batches(docs.sparkSession)
    given = templates.select(F.col("label").cast("string").alias("label"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("label IS NOT NULL").distinct()
    parts = max(1, -(-(given.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0) // BLOCK_BYTES))
    given = given.withColumn("part", F.pmod(F.xxhash64("label", "text"), F.lit(parts)))
    out = None
    for part in range(parts):
        own = [(r["label"], r["text"].encode()) for r in given.where(F.col("part") == part).orderBy("label", "text").collect()]
        index = Index(own, frequencies(docs, {w for _, t in own for w in words(t)}), threshold)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared, first=part == 0):
            for b in batches:
                rows = [words(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), pa.array([len(x) for x in rows], pa.int64()),
                        pa.array([[{"label": a, "at": n} for a, n in (phrase_places(x) if first else ())] for x in rows], pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64())]))),
                        pa.array([[dict(zip(("label", "begin", "end", "shared", "tokens"), y)) for y in shared.value.blocks(x)] for x in rows],
                                 pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("shared", pa.int32()), ("tokens", pa.int32())]))),
                    ],
                    ["doc_id", "n_words", "places", "blocks"],
                )

        more = texts(docs).mapInArrow(run, KIND)
        out = more if out is None else out.unionByName(more)
    return out


def known_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "label string, text string")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEMPLATES are one part, so a document has one row."""
    found = scan(read(spark, sf_dir, "documents"), known_templates(spark))
    at, joined = F.transform("places", lambda x: x["at"]), lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.transform("places", lambda x: x["label"])
    n_base = F.size("places").cast("long")
    share = F.array_max(F.transform("blocks", lambda x: x["shared"].cast("double") / x["tokens"]))
    return found.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("blocks", lambda x: x["label"]))).alias("labels"), F.when(n_base > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )
