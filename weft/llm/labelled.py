"""What the two classifiers share: the fold of each document, and the bounded sample of labelled rows they learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

FOLDS = 5


def held_out():
    """True for the documents whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def folded(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("held_out", held_out())


#: Bytes of all texts of a sample together.
SAMPLE_BYTES = 32 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, size: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """Documents with a label (0 or 1) from the learning folds, whole, by hash of doc_id: at most size ids, and in that order
    those whose texts still fit into most bytes. Two labels of one id: the smaller."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size), "known")
    sizes = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"), F.first(F.xxhash64("doc_id")).alias("h")).collect()
    taken, left = [], most
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= left:
            taken.append((r["doc_id"],))
            left -= r["size"]
    known = known.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id")
    return docs.join(F.broadcast(known), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(p) for k, p in params.items()}
        self.v = {k: np.zeros_like(p) for k, p in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def cut_point(score: np.ndarray, label: np.ndarray) -> float:
    """The threshold of the best F1 for label 1, halfway to the next score below; of equals, the middle one."""
    if not len(score) or not label.any():
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    best = np.flatnonzero(f1 == f1.max())
    k = int(best[len(best) // 2])
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)
