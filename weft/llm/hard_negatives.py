"""Hard-negative mining by an orthogonal PCA rotation.

Anchors are the stated queries, held against all rows in blocks of at most BLOCK_BYTES, each of which is broadcast. Rows and anchors
are rotated onto the principal axes of all rows' second moments, so the leading components carry most of a product. The products
of the components up to STAGES of the energy are summed; what the rest can add is at most the product of the two residual norms (Cauchy
and Schwarz), plus a slack for rounding and for what the rotation lacks of being orthogonal. A pair whose score can't lie where it is
sought is discarded there. The scores of the survivors are products of the whole numbers, so results don't depend on the rotation.

Positives are sought first, among rows of the anchor's label; then, for each positive, negatives between 0.8 of its score and its
score. Either search runs on a share of the rows first (one in SAMPLE by hash): the fifth best there is a floor for the fifth
best of all, so tasks discard from the beginning, and all tasks together keep about 5 * SAMPLE rows an anchor, however many tasks there are.

Defined results: rows with a null label or a vector that isn't whole take no part. Vectors of unequal length are compared as
if the shorter ended in zeros. Whole components and scores beyond a long are the nearest long. Rows that repeat a vec_id
are candidates each, but none of them is a positive or negative of the anchor with that vec_id, which is the first of them by
label, then components. A null vec_id is never an anchor and comes last of equal scores. An anchor without positives, or a
positive without negatives, gives no rows; nor does an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, scratch, small_batches, written
from .vectors import inner, matrix, whole, width

ANCHORS, FLIPPED, POSITIVES, NEGATIVES = 100, 7, 5, 5
#: Of a block of anchors that is broadcast, as doubles; shares of the energy after which pairs are discarded; one row in SAMPLE is searched first.
BLOCK_BYTES, STAGES, SAMPLE = 8 << 20, (0.75, 0.9), 32
#: Anchors and rows that are multiplied at a time, pairs whose components are gathered at a time, and components that are rotated at most.
TILE, PAIRS, ROTATED = 1024, 1 << 15, 1024
FOUND = "anchor_id long, slot int, score long, id long"
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def moments(rows: DataFrame, wide: int) -> np.ndarray:
    """The sum over all rows of the products of their components, two by two: a partial sum from each task, added up by line."""

    all_wide = width(rows)

    def partial(batches):
        total = np.zeros((wide, wide))
        for b in batches:
            q = matrix(b.column("q"), all_wide)[:, :wide].astype(np.float64)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide)), pa.array(list(total), pa.list_(pa.float64()))], ["line", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = np.sum(table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, wide), 0)
        return pa.table({"line": table.column("line")[:1], "sums": pa.array([sums], pa.list_(pa.float64()))})

    lines = rows.select("q").mapInArrow(partial, "line long, sums array<double>").groupBy("line").applyInArrow(added, "line long, sums array<double>")
    out = np.zeros((wide, wide))
    for r in lines.toLocalIterator():
        out[r["line"]] = r["sums"]
    return out


class Rotation:
    """Onto the principal axes of rows, the strongest first; components beyond ROTATED keep their axes."""

    def __init__(self, rows: DataFrame):
        self.wide = width(rows)
        n = min(self.wide, ROTATED)
        strength, axes = np.linalg.eigh(moments(rows, n)) if n else (np.empty(0), np.empty((0, 0)))
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        share = np.cumsum(np.maximum(strength[::-1], 0))
        share = share / share[-1] if n and share[-1] > 0 else np.ones(n)
        self.stages = sorted({min(int(np.searchsorted(share, s)) + 1, n) for s in STAGES}) if n else [0]
        eps = np.finfo(float).eps
        self.slack = (np.abs(self.axes.T @ self.axes - np.eye(n)).sum() if n else 0) + 16 * (self.wide + 8) * eps

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated rows, and their norms: after each stage of what remains, and last of all."""
        q = q.astype(np.float64)
        n = len(self.axes)
        y = np.hstack([q[:, :n] @ self.axes, q[:, n:]])
        norms = [np.sqrt(np.square(y[:, k:]).sum(1)) for k in self.stages] + [np.sqrt(np.square(y).sum(1))]
        return y, np.stack(norms, 1)


class Block:
    """Anchors with the scores that are sought: from low to high, for each slot. same: among rows of the anchor's label, else of others."""

    def __init__(self, rotation: Rotation, ids, labels, q: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray):
        self.rotation, self.ids, self.labels, self.q, self.same, self.low, self.high = rotation, ids, labels, q, same, low, high
        self.y, self.norms = rotation.of(q)

    def may(self, a: np.ndarray, wanted: np.ndarray, y: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Pairs (of anchors a and rows) that are wanted and whose score may lie from low to high."""
        slack, stages = self.rotation.slack, self.rotation.stages
        k = stages[0]
        part = self.y[a, :k] @ y[:, :k].T
        room = np.outer(self.norms[a, 0], norms[:, 0]) + slack * np.outer(self.norms[a, -1], norms[:, -1])
        i, j = np.nonzero(wanted & self.meets(part, room, low[:, None], high[:, None]))
        part = part[i, j]
        for at, (k, to) in enumerate(zip(stages, stages[1:]), 1):
            for s in range(0, len(i), PAIRS):
                x = slice(s, s + PAIRS)
                part[x] += np.einsum("ij,ij->i", self.y[a[i[x]], k:to], y[j[x], k:to])
            room = self.norms[a[i], at] * norms[j, at] + slack * self.norms[a[i], -1] * norms[j, -1]
            on = self.meets(part, room, low[i], high[i])
            i, j, part = i[on], j[on], part[on]
        return a[i], j

    @staticmethod
    def meets(part: np.ndarray, room: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a score within room of part may lie from low to high; a score beyond a long counts as the nearest long."""
        return (np.maximum(part + room, -(2.0**63)) >= low) & (np.minimum(part - room, 2.0**63) <= high)

    def search(self, batches, keep: int):
        """The first `keep` of each anchor and slot, of all batches."""
        floor, new = self.low.copy(), [np.empty((0, 5), np.int64)]

        def merged() -> None:
            new[:] = [held := first(np.concatenate(new), keep)]
            full = np.flatnonzero((held[keep - 1 :, :2] == held[: len(held) - keep + 1, :2]).all(1)) + keep - 1
            floor[held[full, 0], held[full, 1]] = held[full, 2]

        for b in batches:
            labels, ids = b.column("label").to_numpy(), b.column("vec_id")
            none = ids.is_null().to_numpy(zero_copy_only=False)
            ids, q = ids.fill_null(0).to_numpy(), matrix(b.column("q"), self.rotation.wide)
            y, norms = self.rotation.of(q)
            for rows in self.tiles(labels):
                anchors = np.flatnonzero(self.labels == labels[rows[0]]) if self.same else np.arange(len(self.ids))
                for s in range(0, len(anchors), TILE):
                    a = anchors[s : s + TILE]
                    wanted = (self.ids[a, None] != ids[None, rows]) | none[None, rows]
                    if not self.same:
                        wanted &= self.labels[a, None] != labels[None, rows]
                    a, j = self.may(a, wanted, y[rows], norms[rows], floor[a].min(1).astype(float), self.high[a].max(1).astype(float))
                    j = rows[j]
                    score = np.concatenate([np.empty(0, np.int64), *(inner(self.q[a[x : x + PAIRS]], q[j[x : x + PAIRS]]) for x in range(0, len(a), PAIRS))])
                    for slot in range(self.low.shape[1]):
                        on = (score >= floor[a, slot]) & (score <= self.high[a, slot])
                        new.append(np.stack([a[on], np.full(on.sum(), slot), score[on], none[j[on]], ids[j[on]]], 1))
                    if sum(map(len, new[1:])) > max(PAIRS, len(new[0])):
                        merged()
        merged()
        held = new[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.ids[held[:, 0]]), pa.array(held[:, 1].astype(np.int32)), pa.array(held[:, 2]), pa.array(held[:, 4], mask=held[:, 3].astype(bool))], ["anchor_id", "slot", "score", "id"]
        )

    def tiles(self, labels: np.ndarray):
        """Places of at most TILE rows; where anchors seek their own label, of one label that an anchor has."""
        for label in np.intersect1d(labels, self.labels) if self.same else [None]:
            at = np.flatnonzero(labels == label) if self.same else np.arange(len(labels))
            for s in range(0, len(at), TILE):
                yield at[s : s + TILE]


def first(rows: np.ndarray, keep: int) -> np.ndarray:
    """rows: anchor, slot, score, whether the id is null, id. The first `keep` of each anchor and slot, in order."""
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    begins = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])) if len(rows) else np.empty(0, int)
    rank = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    return rows[rank < keep]


def found(rows: DataFrame, block: Block, keep: int) -> DataFrame:
    """anchor_id, slot, score, id, rank: the first `keep` of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    own = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = rows.mapInArrow(lambda batches: shared.value.search(batches, keep), FOUND)
    return out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= keep)


def mined(rotation: Rotation, rows: DataFrame, some: DataFrame, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, positives: int, negatives: int) -> DataFrame:
    """The negatives of one block of anchors."""
    place = {int(x): k for k, x in enumerate(ids)}

    def floors(low: np.ndarray, high: np.ndarray, same: bool, keep: int) -> Block:
        """The block whose low is what the sample has as the last of the first `keep`."""
        low, block = low.copy(), Block(rotation, ids, labels, q, same, low, high)
        for r in found(some, block, keep).where(F.col("rank") == keep).select("anchor_id", "slot", "score").collect():
            low[place[r["anchor_id"]], r["slot"]] = r["score"]
        return Block(rotation, ids, labels, q, same, low, high)

    every = np.full((len(ids), 1), LOWEST), np.full((len(ids), 1), HIGHEST)
    near = written(found(rows, floors(*every, True, positives), positives), "positives")
    # A negative is sought from 4/5 of the positive's score to that score: nowhere, if there is no such positive.
    low, high = np.full((len(ids), positives), HIGHEST), np.full((len(ids), positives), LOWEST)
    for r in near.select("anchor_id", "rank", "score").collect():
        at = place[r["anchor_id"]], r["rank"] - 1
        low[at], high[at] = r["score"] - r["score"] // 5, r["score"]
    far = found(rows, floors(low, high, False, negatives), negatives)
    near = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    far = far.select("anchor_id", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, asked: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows: vec_id, label, q (whole numbers); asked: those that are anchors, with distinct ids. The hard negatives of each anchor and positive."""
    spark = rows.sparkSession
    small_batches(spark)
    rotation = Rotation(rows)
    some = written(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(SAMPLE)) == 0), "sample")
    blocks = max(1, -(-asked.count() * 8 * max(1, rotation.wide) * 5 // (4 * BLOCK_BYTES)))  # hashed blocks differ in size: four fifths on average
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")), "anchors")
    path = scratch(spark, "mined")
    for k in range(blocks):
        own = asked.where(F.col("block") == k).select("vec_id", "label", "q").toArrow()
        ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
        q = matrix(own.column("q").combine_chunks(), rotation.wide)
        mined(rotation, rows, some, ids, labels, q, positives, negatives).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % FLIPPED == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = written(whole(read(spark, sf_dir, "embeddings")).where("label IS NOT NULL").withColumn("label", label), "vectors")
    asked = rows.where(F.col("vec_id") % ANCHORS == 0).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x"))
    return hard_negatives(rows, asked.select("vec_id", "x.label", "x.q"))


ORACLE = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id IS DISTINCT FROM r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
