"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of PASSAGE words. A passage is described by its bytes' shares and the shape and
repetition of its words, and encoded by a learned layer. Gated attention (a tanh and a sigmoid branch, multiplied)
weighs the passages; the weighted sum is scored. All is learned from documents' labels alone, by gradient descent in
numpy, on every passage of at most SAMPLE labelled documents of at most SAMPLE_BYTES together (the sample's bounds). Scoring
reads every passage of every document.

Defined results: a null or empty text is one passage without words. Rows that repeat are scored each. Without labels of
both kinds in the learning folds every score is the share of label 1 in them, or 0.5. An empty table gives no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, with_ids, written
from .labelled import Adam, folded, sample, sigmoid

PASSAGE, SAMPLE = 64, 6000
WIDTH, GATE, EPOCHS, STEPS, MINIBATCH, RATE, DECAY = 32, 16, 30, 1500, 64, 0.01, 1e-4
THRESHOLD = 0.3
#: Which of the byte classes each byte is in: every ASCII mark alone, digits, capitals, small letters, controls, the rest.
CLASS = np.zeros(256, np.int64)
_marks = [c for c in range(33, 127) if not chr(c).isalnum()]
CLASS[:33], CLASS[127] = 0, 0
CLASS[128:] = 1
for _c in range(33, 127):
    CLASS[_c] = 2 if chr(_c).isdigit() else 3 if chr(_c).isupper() else 4 if chr(_c).islower() else 5 + _marks.index(_c)
CLASSES = 5 + len(_marks)
FEATURES = CLASSES + 10


def passages(text: bytes) -> np.ndarray:
    """A row of features for each passage."""
    w = text.split()
    out = np.zeros((max(1, -(-len(w) // PASSAGE)), FEATURES), np.float32)
    total = len(set(w)) / max(1, len(w))
    for k, row in enumerate(out):
        p = w[k * PASSAGE : (k + 1) * PASSAGE]
        if not p:
            continue
        joined = b" ".join(p)
        c = np.bincount(CLASS[np.frombuffer(joined, np.uint8)], minlength=CLASSES).astype(np.float32)
        row[:CLASSES] = np.sqrt(c / c.sum())
        m, kinds = len(p), set(p)
        row[CLASSES:] = (
            len(kinds) / m, max(map(p.count, kinds)) / m if len(kinds) < 0.75 * m else 0.1, sum(a == b for a, b in zip(p, p[1:])) / m, len(joined) / m / 10,
            sum(x[:1].isupper() for x in p) / m, sum(x.isupper() for x in p) / m, sum(len(x) <= 3 for x in p) / m, m / PASSAGE, np.log1p(len(w)) / 8, total,
        )
    return out


class Attention:
    """z = sum of a_k h_k; h = tanh(W x + b); a = softmax of w (tanh(V h) * sigmoid(U h)); the score is sigmoid(u z + c)."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        of = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": of(FEATURES, WIDTH), "b": np.zeros(WIDTH), "V": of(WIDTH, GATE), "U": of(WIDTH, GATE), "w": of(GATE), "u": of(WIDTH), "c": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict:
        """x: passages of the documents that begin at rows begin."""
        p = self.p
        x = (x - self.mean) / self.scale
        many = np.diff(np.append(begin, len(x)))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), many))
        a = e / np.repeat(np.add.reduceat(e, begin), many)
        z = np.add.reduceat(a[:, None] * h, begin)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "many": many, "y": sigmoid(z @ p["u"] + p["c"])}

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.forward(x, begin)["y"] if self.constant is None else np.full(len(begin), self.constant)

    def grads(self, f: dict, begin: np.ndarray, d: np.ndarray) -> dict:
        """d: of the loss by each document's score before the sigmoid."""
        p, out = self.p, {}
        out["u"], out["c"] = f["z"].T @ d, d.sum(keepdims=True)
        dz = np.repeat(d, f["many"])[:, None] * p["u"]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begin), f["many"]))
        out["w"] = (f["t"] * f["g"]).T @ de
        dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        out["W"], out["b"] = f["x"].T @ dh, dh.sum(0)
        return out

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> None:
        if not len(bags) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(bags) else 0.5
            return
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.05
        rng, adam = np.random.default_rng(2), Adam(self.p, RATE)
        epochs = max(EPOCHS, min(300, STEPS * MINIBATCH // len(bags)))
        for epoch in range(epochs):
            adam.rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(bags))
            for i in range(0, len(order), MINIBATCH):
                own = order[i : i + MINIBATCH]
                part = [bags[k] for k in own]
                begin = np.cumsum([0, *map(len, part[:-1])])
                f = self.forward(np.concatenate(part), begin)
                g = self.grads(f, begin, (f["y"] - labels[own]) / len(own))
                adam.step({k: v + DECAY * self.p[k] for k, v in g.items()})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Attention:
    """docs: doc_id, text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = [passages(t).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    rows = sample(docs, labels, label, SAMPLE).select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    model = Attention()
    model.fit([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows], float))
    return model


def score(docs: DataFrame, model: Attention, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text, held_out. doc_id, held_out, score, predicted, n_passages, attention (the largest weight)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            bags = [passages(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            many = [len(x) for x in bags]
            begin, every = np.cumsum([0, *many[:-1]]), np.concatenate(bags)
            f = m.forward(every, begin)
            y = m.score(every, begin)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(y), pa.array((y >= threshold).astype(np.int32)), pa.array(many, pa.int64()), pa.array(np.maximum.reduceat(f["a"], begin))],
                ["doc_id", "held_out", "score", "predicted", "n_passages", "attention"],
            )

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, attention double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = folded(read(spark, sf_dir, "documents"))
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    own = folded(docs)
    found = written(score(own, train(own, read(spark, sf_dir, "labels"))), "quality")
    dropped = found.groupBy("doc_id").agg(F.max("predicted").alias("stays")).where("stays = 0")
    return with_ids(docs, dropped, keep=False)
