"""Words, alphabets and pair statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import WORD_END, adjacent, characters, symbols, words


def word_counts(texts: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """by, word, freq. Partial sums are made before the shuffle."""
    return texts.select(*by, F.explode(words(F.col(text))).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("freq"))


def distinct_words(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(F.explode(words(F.col(text))).alias("word")).distinct()


def alphabet(counted: DataFrame, *by: str) -> DataFrame:
    """Distinct characters of counted words."""
    return counted.select(*by, F.explode(characters(F.col("word"))).alias("symbol")).distinct()


def with_symbols(counted: DataFrame, end: str = WORD_END) -> DataFrame:
    return counted.withColumn("symbols", symbols(F.col("word"), end))


def pair_counts(split: DataFrame, *by: str) -> DataFrame:
    """split: symbols, freq. l, r, n: every adjacent place adds its word's frequency."""
    pairs = split.select(*by, "freq", F.explode(adjacent(F.col("symbols"))).alias("p"))
    return pairs.groupBy(*by, F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("freq").alias("n"))


def pair_counts_by_window(split: DataFrame) -> DataFrame:
    """The same by a window over each word's places; pair_counts needs no shuffle of those."""
    places = split.select("word", "freq", F.posexplode("symbols").alias("at", "l"))
    paired = places.withColumn("r", F.lead("l").over(Window.partitionBy("word").orderBy("at"))).where(F.col("r").isNotNull())
    return paired.groupBy("l", "r").agg(F.sum("freq").alias("n"))


def top_pairs(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The most frequent pairs; of equals, those first in byte order."""
    return pairs.orderBy(F.desc("n"), "l", "r").limit(k)


def pair_postings(split: DataFrame) -> DataFrame:
    """l, r, n_words, and the set of words that hold the pair, in order."""
    pairs = split.select("word", F.explode(F.array_distinct(adjacent(F.col("symbols")))).alias("p"))
    return pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.count(F.lit(1)).alias("n_words"), F.array_sort(F.collect_set("word")).alias("words"))


def words_with(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """postings: of pair_postings; pairs: distinct l, r. l, r, word: the words that hold each pair, looked up by pair."""
    return postings.join(pairs.select("l", "r"), ["l", "r"], "left_semi").select("l", "r", F.explode("words").alias("word"))
