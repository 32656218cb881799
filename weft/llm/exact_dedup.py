"""Exact dedup against a persistent digest index [native].

The index is a table bucketed and sorted by digest. A batch is digested, grouped, and looked up by a sort-merge join that reads the
index in place (no shuffle of it); the digests that it lacks are appended.

An index has a bucket for about BUCKET_ROWS digests (LEAST_BUCKETS at least). Every append adds a file to each bucket; above
FILES files a bucket, or when it has outgrown its buckets, the index is written anew in a folder of its own, one sorted file a
bucket, which is then read without a sort.

A batch's result is written first, then its digests, each with the name of the attempt, and last a row of `meta` that says which
folder and which attempts hold: one file, which appears whole or not at all. Digests of attempts that aren't in `meta` count for
nothing. So a driver may be lost at any point: the batch run again finds the index as it was before, and a batch of a name that `meta`
has returns the result that was written then. A batch without a name is always a new one. One batch runs at a time.

Defined results: a null text is the empty text; all rows without words but for white space of any length >= 1 are
equal to each other, and not to the empty text. Of equal texts the row with the smallest doc_id stays; null ids come
last. Rows that repeat doc_id and text count in group_size, and one of them is kept. An empty batch gives no rows and
leaves the index as it was. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bucketed import Bucketed
from .common import WHITE, lookup, read, scratch, texts, with_ids, written

DIGESTS = "digest BINARY, keep_id BIGINT, n BIGINT"
RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS, FILES = 2_000_000, 24, 100_000, 8


def normalised(text):
    return F.regexp_replace(text, WHITE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the SHA-256 of every whole normalised text."""
    return texts(docs).select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


class DigestIndex:
    """A growing set of digests with the doc_id that stands for each, bucketed and sorted by digest. buckets: how many, if given."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.given, self.table = spark, buckets, Bucketed(spark, path, "digest", DIGESTS)

    def _buckets_for(self, rows: int) -> int:
        return self.given or min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))

    def rows(self) -> DataFrame:
        """digest, keep_id, n."""
        return self.table.rows().select("digest", "keep_id", "n")

    def compact(self) -> None:
        """Write the index anew, one file a bucket."""
        self.table.write_anew(lambda rows: rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")), self._buckets_for)

    def dedup(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Add docs to the index. Per row: doc_id, keep_id, group_size, kept, text_sha256. batch: a name; see above."""
        meta = self.table.meta()
        attempt = next((r["attempt"] for r in meta if batch is not None and r["batch"] == batch), None)
        if not attempt:
            attempt = uuid.uuid4().hex
            self._add(docs, meta, attempt, batch)
        return self.spark.read.schema(RESULT).parquet(f"{self.table.path}/results/{attempt}")

    def _add(self, docs: DataFrame, meta: list, attempt: str, batch: str | None) -> None:
        own = written(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
        total = own.count()
        folder, buckets = (meta[-1]["folder"], meta[-1]["buckets"]) if meta else (f"table-{attempt}", self._buckets_for(total))
        # The first row of each digest: by doc_id, null last; of rows that repeat an id, as they were read.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
        groups = own.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))
        groups = groups.select("digest", F.col("first.doc_id").alias("own_id"), F.col("first.row").alias("own_row"), "n")
        with self.table.tables() as known:
            index = known(f"{self.table.path}/{folder}", buckets)
            stage = known(scratch(self.spark, "groups"), buckets, "digest BINARY, own_id BIGINT, own_row BIGINT, n BIGINT")
            self.table.write(groups.repartition(buckets, "digest"), stage, buckets)

            # One read of the index tells which digests it has and who stands for them. What is found lies in the same buckets.
            had = self.table.held(self.spark.table(index), meta).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("had"))
            old = F.coalesce("had", F.lit(False))
            met = self.spark.table(stage).hint("merge").join(had, "digest", "left").select("digest", F.when(old, F.col("old_id")).otherwise(F.col("own_id")).alias("keep_id"), "own_row", "n", old.alias("old"))
            found = known(scratch(self.spark, "found"), buckets, "digest BINARY, keep_id BIGINT, own_row BIGINT, n BIGINT, old BOOLEAN")
            self.table.write(met, found, buckets)
            found = self.spark.table(found)

            both = lookup(own, found.withColumn("group_size", F.col("n")), "digest", total)
            kept = ~F.col("old") & (F.col("row") == F.col("own_row"))
            result = both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
            result.write.parquet(f"{self.table.path}/results/{attempt}")
            self.table.write(found.where("NOT old").select("digest", "keep_id", "n", F.lit(attempt).alias("attempt")), index, buckets)
        self.table.publish(meta, folder, buckets, attempt, batch)
        files = self.table.files(self.table.meta())
        if files > FILES * buckets or not self.given and files > buckets and self._buckets_for(self.rows().count()) > 2 * buckets:
            self.compact()


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DigestIndex(spark, scratch(spark, "index")).dedup(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, one of each group of equal texts."""
    found = DigestIndex(spark, scratch(spark, "index")).dedup(docs)
    dropped, kept = found.where("NOT kept"), found.where("kept")
    # An id that repeats can be among both.
    if dropped.where("doc_id IS NULL").isEmpty() and with_ids(kept, dropped, keep=True).isEmpty():
        return with_ids(docs, dropped, keep=False)
    own = docs.withColumn("__d", F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))), 256))
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__h"))
    return own.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__h")), "left_semi").dropDuplicates(["doc_id", "__d"]).drop("__d")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""
