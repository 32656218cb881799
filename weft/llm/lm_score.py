"""LM scoring: a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Words are counted over all training documents. The model predicts a symbol from the CONTEXT symbols before. The most frequent
words have a symbol each, the square root of the number of distinct training words of them (LEAST at least), so more text has
a larger model; every other word has the symbol of its ending's class. Symbols are dealt by frequency into about as many
groups as a group has symbols, and the model predicts the group, then the symbol in it. Scoring multiplies batches of
context vectors with all groups' vectors and with those of the own group, so each symbol's probability is normalised exactly;
a word without a symbol of its own then has its share (c + 1) / sum(c + 1) of its class, with one more place in each class for
words never seen. So the probabilities over all words sum to one.

The noise of a prediction is the frequency of groups, or of the symbols in the group. Both are short lists, so the expected
loss over NOISE draws is taken, which needs no draws.

Training is data-parallel. One task fits a start by START_PASSES over the first START_TOKENS tokens of about START_DOCS
documents, which a cut of their ids' hashes chooses; then every partition runs over all its training documents from the same
start, and the parameters are averaged by tokens (in rounds of AVERAGED at a time). Partitions follow the files, so other files
of the same rows give slightly other parameters; counts and base scores don't depend on them.

Counts of at most KNOWN words, the most frequent (no longer than LONGEST bytes), are broadcast, at most 16 MB; so are those of
longer words that are more than one in HOT_WORDS of all tokens, by their digests; the counts of all others are joined by a shuffle,
of words already counted within their document.

Defined results: a null or empty text is one end token. A null doc_id counts as the empty id. Rows that repeat are
scored each. With no training documents all counts are 0 and the model is uniform but for its start. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, texts, written

KNOWN, LONGEST, HOT_WORDS = 200_000, 64, 1000
LEAST, CLASSES = 256, 128
CONTEXT, WIDTH = 3, 24
NOISE, BATCH, SCORED, RATE = 64, 8192, 16384, 0.5
START_DOCS, START_TOKENS, START_PASSES, AVERAGED = 1000, 1 << 20, 6, 16
END = b""
FLUSH = 300_000
LN10 = float(np.log(10))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and ASCII white space only


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def count_words(batches):
    """(word, class, n) of the texts, counted as far as memory allows before the shuffle."""

    def out():
        words = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([ending(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "class", "n"])

    seen: Counter = Counter()
    for b in batches:
        for t in b.column("text").cast(pa.binary()).to_pylist():
            seen.update(tokens(t))
            seen[END] += 1
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


class Known(dict):
    """Word to its place among the known; a word not among them gives -1 minus its class."""

    def __missing__(self, word):
        return -1 - ending(word)


def digest(word: bytes) -> bytes:
    return hashlib.md5(word).digest()


def by_group(then: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and of each group that occurs where it begins and ends in that."""
    group = then // size
    order = np.argsort(group.astype(np.uint16 if group.max(initial=0) < 1 << 16 else np.uint32), kind="stable")
    group = group[order]
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return order, [(int(group[i]), i, j) for i, j in zip(cuts, cuts[1:]) if i < j]


class Model:
    """Symbol s is place s % SIZE of group s // SIZE; parameters are one float32 vector: input vectors, output vectors and biases
    of symbols and of groups, and a diagonal matrix for each context place."""

    def __init__(self, noise: np.ndarray, flat: np.ndarray | None = None):
        """noise: the share of each symbol."""
        n = len(noise)
        self.groups = isqrt(max(n - 1, 0)) + 1
        self.size = -(-n // self.groups)
        self.groups = -(-n // self.size)
        places = self.groups * self.size
        share = np.zeros(places)
        share[:n] = noise
        share = share.reshape(self.groups, self.size)
        of_group = share.sum(1)
        self.p1, self.p2 = of_group.astype(np.float32), (share / of_group[:, None]).astype(np.float32)
        cut = np.cumsum([places * WIDTH, places * WIDTH, places, self.groups * WIDTH, self.groups])
        if flat is None:
            flat = np.random.default_rng(1).normal(0, 0.1, int(cut[-1]) + CONTEXT * WIDTH).astype(np.float32)
            parts = np.split(flat, cut)
            parts[2][:] = np.log(np.maximum(self.p2, 1e-30)).ravel()
            parts[4][:] = np.log(self.p1)
            parts[5][:] = 1.0 / CONTEXT
        self.flat, parts = flat, np.split(flat, cut)
        self.r, self.top, self.c = (parts[k].reshape(-1, WIDTH) for k in (0, 3, 5))
        self.q, self.b, self.top_b = parts[1].reshape(self.groups, self.size, WIDTH), parts[2].reshape(self.groups, self.size), parts[4]
        self.none = self.p2 == 0  # places without a symbol
        # Of the noise: its weight, and the weight's logarithm.
        self.k1, self.k2 = NOISE * self.p1, NOISE * self.p2
        self.log_k1, self.log_k2 = np.log(np.maximum(self.k1, 1e-30)), np.log(np.maximum(self.k2, 1e-30))

    def context(self, before: np.ndarray) -> np.ndarray:
        h = self.r[before[0]] * self.c[0]
        for j in range(1, CONTEXT):
            h += self.r[before[j]] * self.c[j]
        return h

    def log10(self, before: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of symbols after their contexts."""
        out, b = np.empty(len(then)), np.where(self.none, np.float32(-1e30), self.b)
        longest, largest = np.sqrt((self.q**2).sum(2).max(1)), np.abs(np.where(self.none, 0, self.b)).max(1)
        longest_1, largest_1 = np.sqrt((self.top**2).sum(1).max()), np.abs(self.top_b).max()
        for i in range(0, len(then), SCORED):
            order, groups = by_group(then[i : i + SCORED], self.size)
            order += i
            h, of = self.context(before[:, order]), then[order]
            far, place = np.sqrt((h * h).sum(1).max()), of % self.size
            lp = self._own(h @ self.top.T + self.top_b, of // self.size, far * longest_1 + largest_1 < 80)
            for g, x, y in groups:
                lp[x:y] += self._own(h[x:y] @ self.q[g].T + b[g], place[x:y], far * longest[g] + largest[g] < 80)
            out[order] = lp
        return out / LN10

    @staticmethod
    def _own(s: np.ndarray, which: np.ndarray, small: bool) -> np.ndarray:
        """small: no power is too large."""
        if not small:
            s -= s.max(1, keepdims=True)
        own = s[np.arange(len(s)), which]
        return own - np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32))

    @staticmethod
    def _slope(s: np.ndarray, which: np.ndarray, weight: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
        """Of the loss by s, which is overwritten: of the true one against NOISE draws of noise, in expectation."""
        np.subtract(log_weight, s, out=s)
        with np.errstate(over="ignore"):  # then the slope is nothing
            np.exp(s, out=s)
        s += 1
        np.reciprocal(s, out=s)
        rows = np.arange(len(s))
        own = s[rows, which] - 1
        s *= weight
        s[rows, which] += own
        return s

    def fit(self, chunks) -> int:
        """AdaGrad steps on the expected NCE loss of groups and of symbols in them; the number of symbols seen."""
        n, grown = 0, np.full(len(self.flat), 1e-2, np.float32)
        short = np.uint16 if len(self.r) <= 1 << 16 else np.uint32  # short numbers are sorted fast
        for before, then in chunks:
            n += len(then)
            order, groups = by_group(then, self.size)
            before, then = before[:, order], then[order]
            h, place = self.context(before), then % self.size
            d = self._slope(h @ self.top.T + self.top_b, then // self.size, self.k1, self.log_k1)
            dtop, dtop_b, dh = d.T @ h, d.sum(0), d @ self.top
            dq, db = np.zeros_like(self.q), np.zeros_like(self.b)
            for g, x, y in groups:
                d = self._slope(h[x:y] @ self.q[g].T + self.b[g], place[x:y], self.k2[g], self.log_k2[g])
                dq[g], db[g] = d.T @ h[x:y], np.ones(y - x, np.float32) @ d
                dh[x:y] += d @ self.q[g]
            dr, dc = np.zeros_like(self.r), np.empty((CONTEXT, WIDTH), np.float32)
            for j in range(CONTEXT):
                order = np.argsort(before[j].astype(short), kind="stable")
                at = before[j][order]
                begin = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                dr[at[begin]] += np.add.reduceat(dh[order], begin) * self.c[j]
                dc[j] = np.einsum("nw,nw->w", dh, self.r[before[j]])
            d = np.concatenate([dr.ravel(), dq.ravel(), db.ravel(), dtop.ravel(), dtop_b, dc.ravel()])
            d /= np.float32(len(then))
            grown += d * d
            self.flat -= np.float32(RATE) * d / np.sqrt(grown)
        return n


def symbols(known: Known, symbol: np.ndarray, other: int, batches, chunk: int):
    """Contexts and next symbols of the texts, in batches of about chunk; other: the symbol of the first class."""
    before, then, have = [], [], 0
    for b in batches:
        for t in b.column("text").cast(pa.binary()).to_pylist():
            w = tokens(t)
            ids = np.fromiter(map(known.__getitem__, w), np.int32, len(w))
            s = np.zeros(len(w) + CONTEXT + 1, np.int32)  # the end token is known word 0 and symbol 0
            s[CONTEXT:-1] = np.where(ids < 0, other - 1 - ids, symbol[np.maximum(ids, 0)])
            for i in range(0, len(w) + 1, chunk):
                k = min(chunk, len(w) + 1 - i)
                before.append(np.stack([s[i + CONTEXT - 1 - j : i + CONTEXT - 1 - j + k] for j in range(CONTEXT)]))
                then.append(s[i + CONTEXT : i + CONTEXT + k])
                have += k
                if have >= chunk:
                    yield np.concatenate(before, 1), np.concatenate(then)
                    before, then, have = [], [], 0
    if have:
        yield np.concatenate(before, 1), np.concatenate(then)


def first_of(chunks, most: int):
    """Chunks until they have most tokens."""
    for before, then in chunks:
        yield before, then
        most -= len(then)
        if most <= 0:
            return


def average(df: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The mean of the parameters (part, n, flat), by n; the driver gets AVERAGED rows at most."""

    def add(pdf):
        total = np.zeros(size)
        for n, f in zip(pdf["n"], pdf["flat"]):
            total += n * np.frombuffer(f, np.float32).astype(np.float64)
        n = int(pdf["n"].sum())
        return pdf.iloc[:1].assign(n=n, flat=[(total / n).astype(np.float32).tobytes()])

    df = written(df, "fits")
    while df.count() > AVERAGED:
        df = written(df.withColumn("part", F.floor(F.col("part") / AVERAGED)).groupBy("part").applyInPandas(add, df.schema), "fits")
    rows = df.collect()
    n = sum(r["n"] for r in rows)
    return sum((r["n"] * np.frombuffer(r["flat"], np.float32).astype(np.float64) for r in rows), np.zeros(size)) / max(n, 1), n


def known_above(counts: DataFrame) -> int:
    """The least count that at most KNOWN words are above. Different counts are few: their sum is at most the tokens."""
    table = counts.where(F.length("word") <= LONGEST).groupBy("n").count().toArrow()
    words = 0
    for n, many in sorted(zip(table.column("n").to_pylist(), table.column("count").to_pylist()), reverse=True):
        words += many
        if words > KNOWN:
            return n
    return 0


class LanguageModel:
    """Counts, and the neural model's parameters."""

    def __init__(self, counts: DataFrame, known: DataFrame):
        self.counts = counts
        table = known.toArrow()
        rows = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist()), key=lambda r: (r[0] != END, -r[1], r[0]))
        if not rows or rows[0][0] != END:
            rows.insert(0, (END, 0))
        total = counts.groupBy("class").agg(F.sum(F.col("n") + 1).alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
        self.n, self.v = sum(r["n"] for r in total), sum(r["v"] for r in total)
        self.own = min(max(LEAST, isqrt(self.v)), KNOWN)
        long = counts.where((F.length("word") > LONGEST) & (F.col("n") > self.n // HOT_WORDS)).select(F.unhex(F.md5("word")).alias("d"), "n").collect()
        self.long = {bytes(r["d"]): r["n"] for r in long}
        self.known = Known((w, i) for i, (w, _) in enumerate(rows))
        n = np.array([k for _, k in rows], np.float64)
        ends = np.array([ending(w) for w in self.known])
        self.symbol = np.where(np.arange(len(n)) < self.own, np.arange(len(n)), self.own + ends).astype(np.int32)
        share, mass = np.ones(CLASSES), np.zeros(self.own + CLASSES)
        for r in total:
            share[r["class"]] += r["s"]
            mass[self.own + r["class"]] += r["n"]
        top = n[: self.own]
        in_table = top > 0
        np.subtract.at(share, ends[: self.own][in_table], top[in_table] + 1)
        np.subtract.at(mass, self.own + ends[: self.own], top)
        mass[: len(top)] += top
        self.noise = (mass + 1) / (mass + 1).sum()
        self.log_n, self.log_share = np.log10(n + 1), np.log10(share)
        self.flat = Model(self.noise).flat

    @classmethod
    def train(cls, docs: DataFrame) -> LanguageModel:
        """docs: doc_id, text (not null)."""
        spark = docs.sparkSession
        small_batches(spark)
        only = docs.select("text")
        counts = written(only.mapInArrow(count_words, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n")), "words")
        known = counts.where((F.length("word") <= LONGEST) & ((F.col("n") > known_above(counts)) | (F.col("word") == F.lit(END)))).select("word", "n")
        model = cls(counts, known)
        shared = spark.sparkContext.broadcast((model.known, model.symbol, model.own, model.noise))

        def fit(start, passes):
            def run(batches):
                known, symbol, own, noise = shared.value
                m, part = Model(noise, start.copy()), TaskContext.get().partitionId()
                chunks = symbols(known, symbol, own, batches, BATCH)
                if passes > 1:
                    chunks = [*first_of(chunks, START_TOKENS)] * passes
                n = m.fit(chunks)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([m.flat.tobytes()], pa.binary())], ["part", "n", "flat"])

            return run

        # Hashes choose the start's documents, once each, and order them, so they are the same ones in the same order in every run.
        share = START_DOCS / max(docs.count(), START_DOCS)
        chosen = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.pmod(F.col("h"), F.lit(1 << 40)) < int(share * (1 << 40)))
        first = chosen.groupBy("h").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions("h").select("text")
        for data, passes in ((first, START_PASSES), (only, 1)):
            flat, n = average(data.mapInArrow(fit(model.flat, passes), "part long, n long, flat binary"), len(model.flat))
            model.flat = flat.astype(np.float32) if n else model.flat
        return model

    def score(self, docs: DataFrame) -> DataFrame:
        """docs: doc_id, text (not null), held_out. The contract's columns for every row."""
        spark = docs.sparkSession
        small_batches(spark)
        shared = spark.sparkContext.broadcast((self.known, self.symbol, self.own, self.log_n, self.log_share, self.noise, self.flat, self.long))

        def run(batches):
            known, symbol, own, log_n, log_share, noise, flat, long = shared.value
            m, row = Model(noise, flat), TaskContext.get().partitionId() << 40
            for b in batches:
                lists, ends, rare, often = [], [], [], []
                for t in b.column("text").cast(pa.binary()).to_pylist():
                    w = tokens(t)
                    w.append(END)
                    ids = np.fromiter(map(known.__getitem__, w), np.int32, len(w))
                    lists.append(ids)
                    ends.append(len(w))
                    seldom = Counter(w[i] for i in np.flatnonzero(ids < 0).tolist())
                    hot = {x: long[d] for x in seldom if len(x) > LONGEST and (d := digest(x)) in long} if long else {}
                    often.append((sum(seldom[x] for x in hot), sum(seldom.pop(x) * np.log10(n + 1) for x, n in hot.items())))
                    rare.append(seldom)
                if not lists:
                    continue
                of = np.repeat(np.arange(len(lists)), ends)
                ids, at = np.concatenate(lists), np.cumsum(ends)
                s = np.where(ids < 0, own - 1 - ids, symbol[np.maximum(ids, 0)])
                place = np.arange(len(s)) - np.repeat(at - ends, ends)
                before = np.stack([np.where(place > j, np.roll(s, j + 1), 0) for j in range(CONTEXT)])
                lp = m.log10(before, s)
                base = np.where(ids < 0, 0, log_n[np.maximum(ids, 0)])
                lp += np.where(s >= own, base - log_share[np.maximum(s - own, 0)], 0)
                sums = lambda x: np.bincount(of, x, len(lists))
                times, add = np.array(often, np.float64).T
                flat_words = [w for c in rare for w in c]
                off = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in rare])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(lists)), pa.int64()), b.column("doc_id"), b.column("held_out"), pa.array(ends, pa.int64()),
                        pa.array((sums(base > 0) + times).astype(np.int64)), pa.array(sums(base) + add), pa.array(sums(lp) + add),
                        pa.ListArray.from_arrays(off, pa.array(flat_words, pa.binary())), pa.ListArray.from_arrays(off, pa.array([n for c in rare for n in c.values()], pa.int64())),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "words", "times"],
                )
                row += len(lists)

        kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double, words array<binary>, times array<long>"
        done = written(docs.select("doc_id", "text", "held_out").mapInArrow(run, kind), "scored")
        rare = done.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
        more = rare.join(self.counts.select("word", "n"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1))).alias("add"), F.sum("times").alias("more"))
        none = F.lit(float(self.n + self.v + 1))
        return done.drop("words", "times").join(more, "row", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(self.n).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.log10(none)).alias("base_score"),
            (F.col("lm") + F.coalesce("add", F.lit(0.0))).alias("score"),
        )


def split(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    return texts(docs).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == held)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = split(read(spark, sf_dir, "documents"))
    return LanguageModel.train(docs.where("NOT held_out")).score(docs)
