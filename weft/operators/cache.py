"""Encodings of words, kept from run to run: a bucketed table for each model, of which a run encodes only the words that it lacks."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bucketed import Bucketed
from ..store import scratch, written
from .encode import Model, encode_chunks, encode_words, in_chunks

#: A task holds a bucket's words while it sorts them; a table with twice as many is dealt into more buckets before it grows.
BUCKET_WORDS, LEAST_BUCKETS, MOST_BUCKETS, FILES = 100_000, 8, 100_000, 8


def model_digest(model: Model, drop: bool) -> str:
    """Two models of one digest encode every word alike."""
    return hashlib.sha256(json.dumps([model.rules, model.tokens, model.word_end, model.unknown, drop]).encode()).hexdigest()


class EncodingCache:
    """drop: whether characters outside the alphabet are dropped. buckets: how many, if given.

    A word's tokens depend on the model alone, so filling it again after a failure, or twice, gives the same rows. Null words are
    not kept.
    """

    def __init__(self, spark: SparkSession, path: str, model: Model, drop: bool = False, buckets: int | None = None):
        self.spark, self.model, self.drop, self.given = spark, model, drop, buckets
        self.table = Bucketed(spark, f"{path}/{model_digest(model, drop)}", "word", "word STRING, tokens ARRAY<STRING>")

    def _buckets_for(self, words: int) -> int:
        return self.given or min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-words // BUCKET_WORDS)))

    def rows(self) -> DataFrame:
        """word, tokens, batch (of fill, that encoded the word; null once the table was written anew)."""
        meta = self.table.meta()
        names = self.spark.createDataFrame([(r["attempt"], r["batch"]) for r in meta if r["folder"] == meta[-1]["folder"]], "attempt string, batch string")
        return self.table.rows().join(F.broadcast(names), "attempt").select("word", "tokens", "batch")

    def fill(self, words: DataFrame, batch: str | None = None) -> int:
        """words: word. Encodes those that the table lacks, and returns how many. The table is read in place, without a shuffle."""
        meta, attempt = self.table.meta(), uuid.uuid4().hex
        asked = written(words.select("word").where("word IS NOT NULL").distinct(), "asked")
        n = asked.count()
        if meta and self._buckets_for(n + self.table.rows().count()) > 2 * meta[-1]["buckets"]:
            self.table.spread(self._buckets_for(n + self.table.rows().count()))
            meta = self.table.meta()
        folder, buckets = (meta[-1]["folder"], meta[-1]["buckets"]) if meta else (f"table-{attempt}", self._buckets_for(n))
        with self.table.tables() as known:
            held = known(f"{self.table.path}/{folder}", buckets)
            had = self.table.held(self.spark.table(held), meta).select("word")
            # In buckets as the table is, so a task of the join has one bucket of each; a shuffle would deal them out anew, by its own sizes.
            own = known(scratch(self.spark, "asked"), buckets, "word STRING")
            self.table.write(asked.repartition(buckets, "word"), own, buckets)
            new = written(self.spark.table(own).hint("merge").join(had, "word", "left_anti"), "unseen")
            n = new.count()
            if n:
                encoded = encode_words(new, self.model, self.drop).withColumn("attempt", F.lit(attempt))
                self.table.write(encoded.repartition(buckets, "word"), held, buckets)
                self.table.publish(meta, folder, buckets, attempt, batch)
        if n and self.table.files(self.table.meta()) > FILES * buckets:
            self.compact()
        return n

    def compact(self) -> None:
        self.table.write_anew(lambda rows: rows.groupBy("word").agg(F.first("tokens").alias("tokens")), self._buckets_for)

    def encode(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, tokens of every text, by a join with the table, after it was filled with the texts' words."""
        chunks = in_chunks(texts, key, text)
        self.fill(chunks.select(F.explode("vocabulary").alias("word")))
        return encode_chunks(chunks, self.table.rows().select("word", "tokens"), key)
