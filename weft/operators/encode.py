"""Encoding of words and texts. A word's tokens are the same wherever it stands, so they are found once and remembered.

encode_column does so within each task, and shuffles nothing. encode_words with encode_texts does so once for all tasks, at the
price of a shuffle of every word's places: for words so long or rules so many that encoding costs more than that.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.words import CLOSE, UNKNOWN, WORD_END, characters, known_only, merged_all, segmented, unsegmented, words
from ..ship import ship
from ..store import written

#: Words that a task remembers, of at most LONG characters; words of at most SHORT symbols are merged without a heap.
REMEMBERED, LONG, SHORT = 400_000, 64, 24


#: What an Arrow batch holds at most, unless a single row is larger: words and tokens of a batch are Python objects, many times its size.
BATCH_BYTES = 1 << 20


def prepared(spark) -> None:
    """Before Python runs: the package, and small batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Model:
    """A tokenizer: rules in order, tokens, the word end and the unknown token. Of rules given twice the later rank holds."""

    def __init__(self, rules: list[tuple[str, str]], tokens: list[str], word_end: str = WORD_END, unknown: str = UNKNOWN):
        self.rules, self.tokens, self.word_end, self.unknown = [tuple(r) for r in rules], sorted(set(tokens)), word_end, unknown
        self.ranks = {r: k for k, r in enumerate(self.rules)}
        self.known, self.memory, self.own = set(self.tokens), {}, {t: t for t in self.tokens}

    @classmethod
    def learned(cls, rules: list[tuple[str, str]], alphabet: list[str], word_end: str = WORD_END, unknown: str = UNKNOWN) -> Model:
        """Tokens: the alphabet, the word end, and all that rules make."""
        return cls(rules, [*alphabet, word_end, *(a + b for a, b in rules)], word_end, unknown)

    def encode_word(self, word: str, drop: bool = False) -> list[str]:
        """The pair of the lowest rank is merged, leftmost first, until none is left; new pairs count at once."""
        s = [c if c in self.known else self.unknown for c in word if c in self.known or not drop] + [self.word_end]
        return self._merged_short(s) if len(s) <= SHORT else self._merged(s)

    def _merged_short(self, s: list[str]) -> list[str]:
        """By looking at all pairs for each merge, which few symbols make cheap."""
        never = len(self.rules)
        while len(s) > 1:
            rank, i = min((self.ranks.get(p, never), i) for i, p in enumerate(zip(s, s[1:])))
            if rank == never:
                break
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def _merged(self, s: list[str]) -> list[str]:
        """By a heap of (rank, place) over linked places: n log n. An entry is stale if its place no longer begins that pair."""
        n, ranks = len(s), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(s, s[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if s[i] is None or j >= n or ranks.get((s[i], s[j])) != rank:
                continue
            s[i], s[j], after[i] = s[i] + s[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := ranks.get((s[a], s[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in s if x is not None]

    def remembered(self, word: str, drop: bool = False) -> list[str]:
        """encode_word, remembered within bounds. The list must not be changed."""
        if len(word) > LONG:
            return self.encode_word(word, drop)
        found = self.memory.get((word, drop))
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            # Remembered lists share one string for each token.
            found = self.memory[(word, drop)] = [self.own.get(t, t) for t in self.encode_word(word, drop)]
        return found


@lru_cache(8)
def _model(rules: tuple, tokens: tuple, word_end: str, unknown: str) -> Model:
    return Model(list(rules), list(tokens), word_end, unknown)


def encode_words(distinct: DataFrame, model: Model, drop: bool = False) -> DataFrame:
    """distinct: word. word, tokens, by rank: right for any rules."""
    spark = distinct.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast((tuple(model.rules), tuple(model.tokens), model.word_end, model.unknown))

    def run(batches):
        m = _model(*shared.value)
        for b in batches:
            tokens = [None if w is None else m.encode_word(w, drop) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(tokens, pa.list_(pa.string()))], ["word", "tokens"])

    return distinct.select("word").mapInArrow(run, "word string, tokens array<string>")


def sweep_words(distinct: DataFrame, model: Model, drop: bool = False) -> DataFrame:
    """The same by one sweep over the rules, in SQL functions alone: for rules in the order they were learned."""
    known = F.array(*[F.lit(t) for t in model.tokens if len(t) == 1] or [F.lit("")])
    s = known_only(characters(F.col("word")), known, None if drop else model.unknown)
    s = F.concat(s, F.array(F.lit(model.word_end)))
    return distinct.select("word", unsegmented(merged_all(segmented(s), model.rules)).alias("tokens"))


#: A word is hot if it has so many places and more than one in HOT_WORDS of all, which fewer than HOT_WORDS words have.
HOT_PLACES, HOT_WORDS = 10_000, 1_000


#: Words of the texts that share a list of their words, unless one text has more; texts that are looked at together before it is full.
CHUNK_WORDS, CHUNK_ROWS = 250_000, 64


def in_chunks(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, at, vocabulary, n of every text, written: texts that lie together share a list of distinct words and how often each stands
    there, which is in the chunk's first row; at: each word's place in it. So a word is met once a chunk, not at each of its places."""
    spark = texts.sparkSession
    prepared(spark)

    def rows(keys, lists, chunk):
        keys, lists = pa.concat_arrays(keys), pa.concat_arrays(lists)
        own = lists.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        times = np.bincount(own.indices.to_numpy(), minlength=len(own.dictionary)).astype(np.int64)
        first = pa.array([0, len(own.dictionary)] + [len(own.dictionary)] * (len(keys) - 1), pa.int32())
        found = [keys, pa.array(np.full(len(keys), chunk)), pa.ListArray.from_arrays(ends, own.indices), pa.ListArray.from_arrays(first, own.dictionary), pa.ListArray.from_arrays(first, pa.array(times))]
        return pa.RecordBatch.from_arrays(found, ["__key", "chunk", "at", "vocabulary", "n"])

    def run(batches):
        keys, lists, n, chunk = [], [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for k in range(0, b.num_rows, CHUNK_ROWS):
                part = b.slice(k, CHUNK_ROWS)
                keys.append(part.column(0))
                lists.append(part.column(1))
                n += len(part.column(1).flatten())
                if n >= CHUNK_WORDS:
                    yield rows(keys, lists, chunk)
                    keys, lists, n, chunk = [], [], 0, chunk + 1
        if keys:
            yield rows(keys, lists, chunk)

    kind = dict(texts.select(key).dtypes)[key]
    split = texts.select(key, words(F.col(text)).alias("words"))
    return written(split.mapInArrow(run, f"__key {kind}, chunk long, at array<int>, vocabulary array<string>, n array<long>"), "chunks")


def encode_texts(texts: DataFrame, encoded: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens of every text in order, none for a text without words; encoded: word, tokens. Keys must be distinct."""
    return encode_chunks(in_chunks(texts, key, text), encoded, key)


def encode_chunks(chunks: DataFrame, encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same of texts in chunks.

    The words of each chunk are joined with their tokens, which then meet the chunk's texts. A word of all chunks still meets itself in
    one task, so hot words are counted first: their encodings, if of usual length, go to all tasks, and the rest are joined by sort and merge.
    """
    own = chunks.where(F.size("vocabulary") > 0).select("chunk", F.posexplode(F.arrays_zip("vocabulary", "n")).alias("no", "w")).select("chunk", "no", F.col("w.vocabulary").alias("word"), "w.n")
    usual = F.length("word") <= LONG
    sums = own.where(usual).groupBy("word").agg(F.sum("n").alias("count"))
    total = chunks.agg(F.sum(F.size("at"))).head()[0] or 0
    hot = [r["word"] for r in sums.where(F.col("count") >= max(HOT_PLACES, total // HOT_WORDS)).select("word").collect()] if total >= HOT_PLACES else []
    own = own.drop("n")
    # One string of a word's tokens, each closed by a mark, is far smaller than a list of them.
    encoded = encoded.select("word", F.array_join(F.transform("tokens", lambda t: F.concat(t, F.lit(CLOSE))), "").alias("marked"))
    if hot:
        is_hot = F.col("word").isin(hot)
        cold = own.where(~is_hot).join(encoded.where(~is_hot).hint("merge"), "word")
        met = cold.unionByName(own.where(is_hot).join(F.broadcast(encoded.where(is_hot)), "word"))
    else:
        met = own.join(encoded, "word")

    def run(texts: pa.Table, met: pa.Table) -> pa.Table:
        no, marked = met.column("no").to_numpy(), met.column("marked").to_pylist()
        at = texts.column("at").combine_chunks()
        places, ends = at.flatten().to_numpy(), np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))
        tokens = pa.array("".join(marked).split(CLOSE)[:-1], pa.string())
        sizes = np.array([x.count(CLOSE) for x in marked], np.int64)
        size, begin = np.zeros((2, max(places.max(initial=-1), no.max(initial=-1)) + 1), np.int64)
        size[no], begin[no] = sizes, np.cumsum(sizes) - sizes
        each = size[places]
        so_far = np.concatenate([[0], np.cumsum(each)])
        taken = np.repeat(begin[places] - so_far[:-1], each) + np.arange(so_far[-1])
        lists = pa.ListArray.from_arrays(np.append(0, so_far[ends]).astype(np.int32), tokens.take(pa.array(taken)))
        return pa.Table.from_arrays([texts.column("__key"), lists], ["__key", "tokens"])

    kind = dict(chunks.dtypes)["__key"]
    found = chunks.select("__key", "chunk", "at").groupBy("chunk").cogroup(met.select(F.col("chunk").alias("of"), "no", "marked").groupBy("of"))
    return found.applyInArrow(run, f"__key {kind}, tokens array<string>").withColumnRenamed("__key", key)


def encode_column(texts: DataFrame, model: Model, text: str = "text", to: str = "tokens", drop: bool = False) -> DataFrame:
    """Adds tokens of every text, without a shuffle: each task remembers the words that it has encoded. Also for streams."""
    spark = texts.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast((tuple(model.rules), tuple(model.tokens), model.word_end, model.unknown))

    def run(batches):
        m = _model(*shared.value)
        for b in batches:
            tokens, ends = [], [0]
            for ws in b.column(b.num_columns - 1).to_pylist():
                for w in ws:
                    tokens += m.remembered(w, drop)
                ends.append(len(tokens))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], to])

    schema = T.StructType([*texts.schema.fields, T.StructField(to, T.ArrayType(T.StringType()))])
    return texts.withColumn("__words", words(F.col(text))).mapInArrow(run, schema)


def encode_batch(texts: DataFrame, model: Model, key: str = "doc_id", text: str = "text", workers: int = 0, drop: bool = False) -> DataFrame:
    """key, tokens of all texts; workers: tasks among which the texts are dealt (0: as they come)."""
    dealt = texts.repartition(workers) if workers > 0 else texts
    return encode_column(dealt.select(key, text), model, text, drop=drop).select(key, "tokens")


def uncached(distinct: DataFrame, cache: DataFrame) -> DataFrame:
    """Words that a table of encodings lacks."""
    return distinct.join(cache.select("word"), "word", "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """A table of encodings with new ones, which take precedence."""
    return cache.join(new.select("word"), "word", "left_anti").unionByName(new)
