"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..store import scratch, written

#: ASCII white space, as the contracts define it.
WHITE = r"[\x20\x09-\x0D]+"

#: A side is broadcast only when it was counted and has at most so many rows of fixed width.
BROADCAST_ROWS = 100_000


#: What one Arrow batch holds at most, unless a single row is larger. One value for all operators, so no call changes another's batches.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Before Python runs: bound the bytes of Arrow batches, for texts may be long, and bring the package along."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def column(docs: DataFrame, name: str, kind: str):
    """A column by its name (no matter which others there are), nulls kept, cast to kind."""
    return F.col(f"`{name}`").cast(kind)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a null text read as empty; all other columns go."""
    return docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))


def with_ids(docs: DataFrame, ids: DataFrame, keep: bool) -> DataFrame:
    """The rows of docs whose doc_id is (keep) or is not among ids; ids are broadcast only if counted to be few."""
    ids = ids.select(F.col("doc_id").alias("__id"))
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) if not keep else F.col("doc_id") == F.col("__id"), "left_semi" if keep else "left_anti")


#: A group may be hot if it has so many rows and more than one in HOT_GROUPS of all: fewer than HOT_GROUPS groups do.
HOT_ROWS, HOT_GROUPS = 10_000, 1_000


def lookup(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined by key with groups, which has one row for each key and, as n, the number of rows with it; total: of rows.

    The rows of a group would meet in one task of a join by key. The few groups that hold many of the rows are broadcast
    instead, which moves none of their rows; the join by key has the rest.
    """
    groups = groups.withColumnRenamed(key, "__key")
    if total < HOT_ROWS:
        return rows.join(groups, F.col(key) == F.col("__key")).drop("__key", "n")
    hot = F.broadcast(groups.where(F.col("n") >= max(HOT_ROWS, total // HOT_GROUPS)))
    cold = rows.join(hot.select("__key"), F.col(key) == F.col("__key"), "left_anti").join(groups.hint("merge"), F.col(key) == F.col("__key"))
    return cold.unionByName(rows.join(hot, F.col(key) == F.col("__key"))).drop("__key", "n")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["BROADCAST_ROWS", "WHITE", "column", "lookup", "read", "scratch", "small_batches", "texts", "with_ids", "written"]
