"""Toxicity: a convolutional text classifier with hashed word embeddings, filters of several widths and max pooling.

Words (runs of letters and digits, lower-cased) are hashed to BUCKETS embeddings: a word's is the sum of three, of the
whole word and of its first four and six characters, so that unseen words of a known stem are told. FILTERS filters of each width in
WIDTHS slide over the whole text, each gives its largest response, and those are weighed into a score. Everything is
learned in numpy by gradient descent (a filter learns from the place of its largest response) on at most SAMPLE labelled
documents of at most SAMPLE_BYTES together, in whole length (the sample's bounds); an embedding starts at its bucket's
smoothed log-odds in that sample. A fold of the sample sets the score's scale, so that 0.5 is the best threshold over all languages, and a
threshold for each language with enough labels there. The language chooses a threshold, never a score.

Scoring uses that a filter's response is a sum over its places: responses of every bucket at every place are tabled once,
and a text's responses are sums of rows, RUN words at a time.

Defined results: a null or empty text has only padding. Rows that repeat are scored each. Without labels of both kinds in
the learning folds every score is the share of label 1 in them, or 0.5. An unknown or null language has the threshold 0.5.
An empty table gives no rows. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read, small_batches
from .labelled import Adam, cut_point, held_out, sample, sigmoid

BUCKETS, WIDTH, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 6
SAMPLE, RUN = 6000, 1 << 16
EPOCHS, STEPS, MINIBATCH, RATE, DECAY = 6, 800, 32, 0.01, 1e-4
THRESHOLD, LEAST = 0.5, 40
PAD, PARTS = BUCKETS, 3
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
REMEMBERED, LONGEST = 250_000, 64


class Places(dict):
    """Word to its row in a table of buckets: of the word, and of its first 4 and 6 characters. Both stay within bounds."""

    def __init__(self):
        self.table, self.n = np.empty((1024, PARTS), np.uint16), 0

    def __missing__(self, word: bytes) -> int:
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        text = word.decode("utf-8", "replace")
        self.table[self.n] = [zlib.crc32(x) % BUCKETS for x in (word, b"4" + text[:4].encode(), b"6" + text[:6].encode())]
        if len(word) <= LONGEST:
            self[word] = self.n
        self.n += 1
        return self.n - 1


_places = Places()


def hashed(text: bytes) -> np.ndarray:
    """Buckets of a text's words, a row each, with padding so that filters of every width have a place."""
    global _places
    w = WORD.findall(text.lower())
    if _places.n > REMEMBERED:
        _places = Places()
    rows = np.fromiter(map(_places.__getitem__, w), np.int64, len(w))
    out = np.full((len(w) + max(WIDTHS), PARTS), PAD, np.uint16)
    out[: len(w)] = _places.table[rows]
    return out


class Convolution:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (BUCKETS + 1, WIDTH))
        self.e[PAD] = 0
        self.p = {f"f{w}": rng.normal(0, 0.3, (w * WIDTH, FILTERS)) for w in WIDTHS} | {"u": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "c": np.zeros(1)}
        self.constant, self.scale, self.shift, self.thresholds, self.tables = None, 1.0, 0.0, {}, None

    def prepare(self) -> None:
        """Table every bucket's part of every filter's response."""
        parts, self.columns, at = [], {}, 0
        for w in WIDTHS:
            self.columns[w] = [slice(at + j * FILTERS, at + (j + 1) * FILTERS) for j in range(w)]
            parts += [self.e @ f for f in self.p[f"f{w}"].reshape(w, WIDTH, FILTERS)]
            at += w * FILTERS
        self.tables = np.concatenate(parts, 1).astype(np.float32)

    def responses(self, texts: list[np.ndarray]) -> np.ndarray:
        """The largest response of each filter in each text. Long texts go in pieces that overlap by all but one of a filter's words."""
        out, pieces, of, have = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32), [], [], 0
        for k, t in enumerate(texts):
            for i in range(0, len(t), RUN):
                pieces.append(t[i : i + RUN + max(WIDTHS) - 1])
                of.append(k)
                have += len(pieces[-1])
                if have >= RUN:
                    np.maximum.at(out, of, self._responses(pieces))
                    pieces, of, have = [], [], 0
        if pieces:
            np.maximum.at(out, of, self._responses(pieces))
        return out

    def _responses(self, texts: list[np.ndarray]) -> np.ndarray:
        ids, many = np.concatenate(texts), np.array([len(t) for t in texts])
        begin, out = np.cumsum(many) - many, []
        rows = np.concatenate([ids, np.full((max(WIDTHS), PARTS), PAD, ids.dtype)])
        table, n = self.tables[rows[:, 0]], len(ids)
        for k in range(1, PARTS):
            table += self.tables[rows[:, k]]
        for w, own in self.columns.items():
            r = table[:n, own[0]].copy()
            for j in range(1, w):
                r += table[j : j + n, own[j]]
            for j in range(1, w):
                r[np.maximum(begin, begin + many - j)] = 0  # these places reach into the next text
            out.append(np.maximum(np.maximum.reduceat(r, begin), 0))
        return np.concatenate(out, 1)

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.responses(texts) @ self.p["u"] + self.p["c"]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.scale * self.raw(texts) + self.shift)

    def start(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Each embedding's first number: the smoothed log-odds of its bucket."""
        seen = np.zeros((2, BUCKETS + 1))
        for t, k in zip(texts, y):
            seen[int(k), np.unique(t)] += 1  # once for each text
        odds = np.log((seen[1] + 0.5) / (seen[0] + 0.5) * ((1 - y).sum() + 1) / (y.sum() + 1))
        odds *= np.minimum(1, seen.sum(0) / 10)
        self.e[:, 0] = odds / 4
        self.e[PAD] = 0

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        """Of words, each the sum of its buckets' embeddings."""
        return sum(self.e[rows[:, k]] for k in range(PARTS))

    def maxima(self, rows: np.ndarray, begin: np.ndarray, many: np.ndarray) -> dict:
        """For each width, the largest response of each text and filter, and the first place that has it; RUN places at a time."""
        n, out = int(many.sum()), {w: (np.full((len(many), FILTERS), -np.inf), np.zeros((len(many), FILTERS), int)) for w in WIDTHS}
        for s in range(0, n, RUN):
            e = min(n, s + RUN)
            first, last = (int(np.searchsorted(begin, x, "right")) - 1 for x in (s, e - 1))
            of_piece, words = slice(first, last + 1), self.embedded(rows[s : e + max(WIDTHS) - 1])
            cut = np.maximum(begin[of_piece], s) - s
            of = np.repeat(np.arange(last + 1 - first), np.diff(np.append(cut, e - s)))
            for w, (top, at) in out.items():
                r = np.concatenate([words[j : j + e - s] for j in range(w)], 1) @ self.p[f"f{w}"]
                for j in range(1, w):  # these places reach into the next text
                    over = np.maximum(begin[of_piece], (begin + many)[of_piece] - j)
                    r[over[(over >= s) & (over < e)] - s] = 0
                largest, where = np.maximum.reduceat(r, cut), np.empty((len(cut), FILTERS), int)
                for f in range(FILTERS):
                    i = np.flatnonzero(r[:, f] == largest[of, f])
                    where[of[i[::-1]], f] = i[::-1] + s
                more = largest > top[of_piece]
                top[of_piece], at[of_piece] = np.where(more, largest, top[of_piece]), np.where(more, where, at[of_piece])
        return out

    def step(self, texts: list[np.ndarray], y: np.ndarray, adam: Adam, grown: np.ndarray) -> None:
        ids, many = np.concatenate(texts), np.array([len(t) for t in texts])
        rows = np.concatenate([ids, np.full((max(WIDTHS), PARTS), PAD, ids.dtype)])
        places = self.maxima(rows, np.cumsum(many) - many, many)
        best = [np.maximum(top, 0) for top, _ in places.values()]
        x = np.concatenate(best, 1)
        d = (sigmoid(x @ self.p["u"] + self.p["c"]) - y) / len(y)
        g = {"u": x.T @ d + DECAY * self.p["u"], "c": d.sum(keepdims=True)}
        touched, change = [], []
        for i, w in enumerate(WIDTHS):
            top, at = places[w]
            dr = d[:, None] * self.p["u"][i * FILTERS : (i + 1) * FILTERS] * (top > 0)
            windows = [np.concatenate([self.embedded(rows[at[:, f] + j]) for j in range(w)], 1) for f in range(FILTERS)]
            g[f"f{w}"] = np.stack([windows[f].T @ dr[:, f] for f in range(FILTERS)], 1) + DECAY * self.p[f"f{w}"]
            for f in range(FILTERS):
                part = dr[:, f, None] * self.p[f"f{w}"][:, f]
                for j in range(w):
                    for k in range(PARTS):
                        touched.append(rows[at[:, f] + j, k])
                        change.append(part[:, j * WIDTH : (j + 1) * WIDTH])
        adam.step(g)
        which, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(which), WIDTH))
        np.add.at(total, inverse, np.concatenate(change))
        total[which == PAD] = 0
        grown[which] += total**2
        self.e[which] -= 0.05 * total / np.sqrt(grown[which])

    def fit(self, texts: list[np.ndarray], y: np.ndarray, lang: list[str]) -> None:
        if not len(texts) or y.min() == y.max():
            self.constant = float(y.mean()) if len(texts) else 0.5
            return
        rng = np.random.default_rng(3)
        fold = rng.random(len(texts)) < 0.2
        if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
            fold[:] = False
        own = np.flatnonzero(~fold)
        self.start([texts[k] for k in own], y[own])
        adam, grown = Adam(self.p, RATE), np.full(self.e.shape, 1e-4)
        epochs = max(EPOCHS, min(40, STEPS * MINIBATCH // len(own)))
        for epoch in range(epochs):
            adam.rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(own)
            for i in range(0, len(order), MINIBATCH):
                part = order[i : i + MINIBATCH]
                self.step([texts[k] for k in part], y[part], adam, grown)
        self.prepare()
        check = np.flatnonzero(fold) if fold.any() else own
        raw, labels = self.raw([texts[k] for k in check]), y[check]
        # A score of 0.5 is the best cut, if there are labels enough to tell; the scale is that of the best fit there.
        cut = cut_point(sigmoid(raw), labels) if labels.sum() >= LEAST / 2 else 0.5
        cut = float(np.log(cut / (1 - cut))) if 0 < cut < 1 else 0.0
        scales = [0.25, 0.5, 1.0, 2.0]
        loss = [-np.mean(np.log(np.where(labels > 0, s, 1 - s) + 1e-9)) for k in scales if (s := sigmoid(k * (raw - cut))) is not None]
        self.scale = scales[int(np.argmin(loss))]
        self.shift = -self.scale * cut
        score, of = sigmoid(self.scale * raw + self.shift), np.array([lang[k] for k in check])
        for name in sorted(set(of)):
            here = of == name
            if labels[here].sum() >= LEAST / 4 and here.sum() >= LEAST:
                self.thresholds[name] = cut_point(score[here], labels[here])


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), lang, held_out."""
    text = F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text")
    return docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), text, column(docs, "lang", "string").alias("lang")).withColumn("held_out", held_out())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Convolution:
    """docs: doc_id, text, lang."""
    small_batches(docs.sparkSession)
    docs = prepared(docs)

    def run(batches):
        for b in batches:
            x = [hashed(t).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("label"), pa.array(x, pa.binary())], ["doc_id", "lang", "label", "x"])

    rows = sample(docs.drop("held_out"), labels, label, SAMPLE).select("doc_id", "lang", "label", "text")
    rows = rows.mapInArrow(run, "doc_id long, lang string, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    model = Convolution()
    model.fit([np.frombuffer(r["x"], np.uint16).reshape(-1, PARTS) for r in rows], np.array([r["label"] for r in rows], float), [r["lang"] or "" for r in rows])
    return model


def score(docs: DataFrame, model: Convolution) -> DataFrame:
    """docs: doc_id, text, lang. doc_id, held_out, score, predicted, threshold (its language's), flagged (by that)."""
    spark = docs.sparkSession
    small_batches(spark)
    model.prepare()
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            y = m.score([hashed(t) for t in b.column("text").cast(pa.binary()).to_pylist()])
            t = np.array([m.thresholds.get(x or "", THRESHOLD) for x in b.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(y), pa.array((y >= THRESHOLD).astype(np.int32)), pa.array(t), pa.array(y >= t)],
                ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
            )

    return prepared(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
