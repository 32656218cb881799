"""Cleaning, sampling, splitting and batching of pairs. Chance is always the order of a seeded hash, so it repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.pairs import line_limit, with_ordinals
from ..store import written

PAD, SOS, EOS, UNKNOWN_ID = 0, 1, 2, 3


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def first_per_key(table: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. Found by a minimum, so a frequent key's rows are reduced before they are shuffled."""
    first = table.groupBy(key).agg(F.min_by(F.struct(*table.columns), F.col(order)).alias("x"))
    return first.select("x.*")


#: Rows that may be sorted to one task, and hexadecimal digits told apart in one count.
EDGE, DIGITS = 10_000, 4


def first_by_hash(table: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first n rows by hash, then key. Counts by the hash's beginning tell where the cut is; only rows about it are sorted."""
    hashed = table.withColumn("__h", hash_order(F.col(key), seed))
    cut, left = "", n
    while len(cut) < 32:
        here = hashed.where(F.col("__h").startswith(cut)).groupBy(F.substring("__h", len(cut) + 1, DIGITS).alias("d")).count().collect()
        if left >= sum(x["count"] for x in here):
            return table if not cut else hashed.where(F.substring("__h", 1, len(cut)) <= cut).drop("__h")
        for x in sorted(here, key=lambda x: x["d"]):
            if x["count"] > left:
                break
            left -= x["count"]
        cut += x["d"]
        if x["count"] <= EDGE:
            break
    edge = hashed.where(F.col("__h").startswith(cut)).orderBy("__h", key).limit(left)
    return hashed.where(F.substring("__h", 1, len(cut)) < cut).unionByName(edge).drop("__h")


def sample_fraction(table: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Exactly round(share * rows) rows."""
    return first_by_hash(table, key, round(share * table.count()), seed)


def sample_columns(pairs: DataFrame, k: int | float, seed: int = 0) -> DataFrame:
    """k sources and k targets, drawn apart from each other: pos, src, tgt. They are no translations of each other."""
    if isinstance(k, float):
        if not 0 < k < 1:
            raise ValueError("a share is above 0 and below 1")
        k = int(pairs.count() * k)
    k = line_limit(0, k)

    def drawn(column: str, own: int) -> DataFrame:
        few = first_by_hash(pairs.select(column, "pair_id"), "pair_id", k, own).withColumn("__h", hash_order(F.col("pair_id"), own))
        return with_ordinals(few, "pos", "__h", "pair_id").select("pos", column)

    return drawn("src", seed).join(drawn("tgt", seed + 1), "pos")


def split(table: DataFrame, key: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds part: "val" for the first floor(share * rows) by hash, else "train"."""
    n = int(share * table.count())
    val = first_by_hash(table.select(key), key, n, seed).select(F.col(key).alias("__val"))
    marked = table.join(val, F.col(key) == F.col("__val"), "left")
    return marked.withColumn("part", F.when(F.col("__val").isNull(), "train").otherwise("val")).drop("__val")


def bootstrap(table: DataFrame, key: str, share: float = 0.7, epoch: int = 0, seed: int = 0) -> DataFrame:
    """draw, key: floor(share * rows) draws with replacement, others in each epoch."""
    rows = with_ordinals(table.select(key), "__n", key).withColumn("__n", F.col("__n") - 1)
    n = table.count()
    drawn = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{epoch}-{seed}"))), 1, 8), 16, 10).cast("bigint") % max(n, 1)
    draws = table.sparkSession.range(int(share * n)).select(F.col("id").alias("draw"), drawn.alias("__n"))
    return draws.join(rows, "__n").select("draw", key)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """token, id: after the four reserved ids, by byte order of the tokens."""
    return with_ordinals(tokens.select("token").distinct(), "id", "token").select("token", (F.col("id") + UNKNOWN_ID).cast("int").alias("id"))


def add_tokens(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """vocab and ids after its last for tokens that it lacks; tokens that it has keep theirs."""
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(UNKNOWN_ID)).alias("m")).head()["m"]
    new = tokens.select("token").distinct().join(vocab.select("token"), "token", "left_anti")
    return vocab.unionByName(with_ordinals(new, "id", "token").select("token", (F.col("id") + last).cast("int").alias("id")))


#: Tokens of a vocabulary that every task may hold.
VOCABULARY = 1_000_000


def ids(encoded: DataFrame, vocab: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """encoded: key, tokens. key, ids in order. A token without id is UNKNOWN_ID, or an error if strict.

    A vocabulary of at most VOCABULARY tokens goes to every task, and nothing is shuffled; a larger one is joined.
    """
    if vocab.limit(VOCABULARY + 1).count() > VOCABULARY:
        return ids_by_join(encoded, vocab, key, strict)
    spark = encoded.sparkSession
    table = vocab.select("token", F.col("id").cast("int").alias("id")).toArrow()
    shared = spark.sparkContext.broadcast((table.column("token").combine_chunks().cast(pa.string()), table.column("id").combine_chunks()))

    def run(batches):
        known, numbers = shared.value
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().cast(pa.string())
            found = numbers.take(pc.index_in(flat, value_set=known))
            if strict and found.null_count:
                raise ValueError(f"no id for token {flat.filter(found.is_null())[0].as_py()}")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.fill_null(UNKNOWN_ID))], [key, "ids"])

    schema = T.StructType([encoded.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return encoded.select(key, "tokens").mapInArrow(run, schema)


def ids_by_join(encoded: DataFrame, vocab: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """The same for any vocabulary; keys must be distinct."""
    encoded = written(encoded.select(key, "tokens"), "tokens")
    places = encoded.select(key, F.posexplode("tokens").alias("at", "token")).join(vocab, "token", "left")
    missing = F.raise_error(F.concat(F.lit("no id for token "), F.col("token"))) if strict else F.lit(UNKNOWN_ID)
    listed = places.select(key, F.struct("at", F.coalesce(F.col("id"), missing).alias("id")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    listed = listed.select(F.col(key).alias("__key"), F.transform("x", lambda x: x["id"]).alias("ids"))
    return encoded.select(key).join(listed, F.col(key) == F.col("__key"), "left").select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def source_example(ids_: Column) -> Column:
    return F.concat(ids_, F.array(F.lit(EOS)))


def target_example(ids_: Column) -> Column:
    return F.concat(F.array(F.lit(SOS)), ids_, F.array(F.lit(EOS)))


def decoder_input(target: Column) -> Column:
    return F.slice(target, F.lit(1), F.greatest(F.size(target) - 1, F.lit(0)))


def decoder_label(target: Column) -> Column:
    return F.slice(target, F.lit(2), F.greatest(F.size(target) - 1, F.lit(0)))


def batched(examples: DataFrame, key: str, size: int) -> DataFrame:
    """Adds batch_id and pos_in_batch, from 0: consecutive by key; the last batch may be smaller."""
    n = F.col("__n") - 1
    return with_ordinals(examples, "__n", key).withColumn("batch_id", F.floor(n / size)).withColumn("pos_in_batch", n % size).drop("__n")


def padded(batches: DataFrame, *columns: str) -> DataFrame:
    """Each column padded to its batch's longest, by itself."""
    widths = batches.groupBy("batch_id").agg(*[F.max(F.size(c)).alias(f"__{c}") for c in columns])
    fill = {c: F.concat(F.col(c), F.array_repeat(F.lit(PAD), F.col(f"__{c}") - F.size(c))) for c in columns}
    return batches.join(widths, "batch_id").withColumns(fill).drop(*[f"__{c}" for c in columns])


def chunks(items: DataFrame, n: int, *order: str) -> DataFrame:
    """Adds chunk, from 1: n runs at most, none empty, the first ones an item longer if they can't be even."""
    numbered = with_ordinals(items, "__n", *order)
    total = items.count()
    size, longer = divmod(total, n)
    at = F.col("__n") - 1
    chunk = F.when(at < longer * (size + 1), F.floor(at / (size + 1))).otherwise(longer + F.floor((at - longer * (size + 1)) / max(size, 1)))
    return numbered.withColumn("chunk", (chunk + 1).cast("int")).drop("__n")


def masked_loss(logits: DataFrame) -> DataFrame:
    """logits: batch_id, target, logits (array). batch_id, loss: mean cross-entropy over what isn't padding; null if all is."""
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    each = F.log(total) + top - F.element_at("logits", F.col("target") + 1)
    return logits.select("batch_id", F.when(F.col("target") != PAD, each).alias("loss")).groupBy("batch_id").agg(F.avg("loss").alias("loss"))


def epoch_loss(batch_losses: DataFrame) -> DataFrame:
    """The plain mean of batches' losses; null without any."""
    return batch_losses.agg(F.avg("loss").alias("loss"))
