"""Benchmark decontamination by pigeonhole edit matching, on words.

A test item of n words is allowed k = floor(n * RATE) word edits and cut into k + 1 pieces. A passage within k edits holds
at least one piece unchanged, so an automaton of all pieces finds every place to look at, and Myers' bit-parallel
distance decides there. Items are taken in blocks of about BLOCK bytes, each of which is broadcast and held against all
documents; hits of an item on nearly one diagonal are verified together, so no place is looked at twice.

Words are runs of letters, digits and underscores, lower-cased, so case and punctuation don't count as edits.

Defined results: an item without words matches nothing, and a document without words holds nothing; null texts are
empty. Items that repeat (id and text) count once; documents that repeat are reported each. Null ids are carried as they
are. Empty tables give no rows. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, texts, with_ids, written

RATE, BLOCK = 0.2, 8 << 20
WORD = re.compile(r"\w+")
KIND = "doc_id long, item_id long, item_words long, budget long, distance long, begin_word long, end_word long"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def cut(n: int, rate: float = RATE) -> list[tuple[int, int]]:
    """Begin and end of each of the k + 1 pieces of an item of n words."""
    k = int(n * rate)
    at = [n * i // (k + 1) for i in range(k + 2)]
    return list(zip(at, at[1:]))


class Pattern:
    """An item's words, for Myers' algorithm: the best place of the item in a text, by edits."""

    def __init__(self, item: list[str]):
        self.n, self.bits, self.back = len(item), {}, {}
        for i, w in enumerate(item):
            self.bits[w] = self.bits.get(w, 0) | 1 << i
            self.back[w] = self.back.get(w, 0) | 1 << (self.n - 1 - i)

    def ends(self, text: list[str], bits: dict, free: bool):
        """After each word of text, the least edits of the item against what ends there; free: it may begin anywhere."""
        n, all_bits = self.n, (1 << self.n) - 1
        top, up, down, score = 1 << (n - 1), (1 << n) - 1, 0, n
        for w in text:
            same = bits.get(w, 0)
            v = same | down
            h = (((same & up) + up) ^ up) | same
            rise, fall = down | ~(h | up), up & h
            score += bool(rise & top) - bool(fall & top)
            rise, fall = (rise << 1) | (not free), fall << 1
            up, down = (fall | ~(v | rise)) & all_bits, rise & v & all_bits
            yield score

    def best(self, text: list[str]) -> tuple[int, int, int]:
        """Edits, begin and end in text of the first best match."""
        edits, end = self.n, 0
        for j, s in enumerate(self.ends(text, self.bits, True), 1):
            if s < edits:
                edits, end = s, j
        for j, s in enumerate(self.ends(text[end - 1 :: -1] if end else [], self.back, False), 1):
            if s == edits:
                return edits, end - j, end
        return edits, end, end


class Block:
    """Items and the automaton of their pieces."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        import ahocorasick

        self.items, self.rate, self.patterns = [(i, w) for i, t in items if (w := words(t))], rate, {}
        self.automaton, places = ahocorasick.Automaton(), {}
        for k, (_, item) in enumerate(self.items):
            for a, b in cut(len(item), rate):
                places.setdefault(f" {' '.join(item[a:b])} ", []).append((k, a, b - a))
        for piece, at in places.items():
            self.automaton.add_word(piece, at)
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str):
        """(item, its words, budget, edits, begin, end) of every item that the text holds, at its best place."""
        w = words(text)
        if not w or not self.items:
            return
        joined = f" {' '.join(w)} "
        # A piece ends with a space, so the place of its end tells how many words come before.
        hits = [(end, k, a, many) for end, places in self.automaton.iter(joined) for k, a, many in places]
        if not hits:
            return
        spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32)
        after = np.searchsorted(spaces, [h[0] for h in hits]).tolist()
        diagonals: dict[int, set] = {}
        for (_, k, a, many), end in zip(hits, after):
            diagonals.setdefault(k, set()).add(end - many - a)
        for k, found in diagonals.items():
            item_id, item = self.items[k]
            n, budget = len(item), int(len(item) * self.rate)
            pattern = self.patterns.get(k) or self.patterns.setdefault(k, Pattern(item))
            best, windows = None, []
            for d in sorted(found):
                a, b = max(0, d - budget), min(len(w), d + n + budget)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                edits, begin, end = pattern.best(w[a:b])
                if edits <= budget and (best is None or edits < best[0]):
                    best = (edits, a + begin, a + end)
            if best:
                yield item_id, n, budget, *best


@lru_cache(2)
def _block(broadcast_id: int, items: tuple, rate: float) -> Block:
    """One for each Python worker and block."""
    return Block(list(items), rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each document and item that it holds: edits, and where (in words)."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    parts = []
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(tuple(sorted(((r[0], r[1]) for r in items.where(F.col("block") == k).select("item_id", "text").collect()), key=repr)))

        def run(batches, shared=shared, k=k):
            block = _block(id(shared.value), shared.value, rate)
            for b in batches:
                rows = [(i, *m) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for m in block.matches(t)]
                cols = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in KIND.split(", ")])

        parts.append(texts(docs).mapInArrow(run, KIND))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item."""
    found = contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return with_ids(docs, written(found, "contaminated"), keep=False)
