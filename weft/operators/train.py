"""Learning byte-pair merge rules: the most frequent adjacent pair is merged again and again.

Of pairs with equal counts the first in byte order is taken. Training stops quietly when no pair is left.

Words lie in shards that keep their symbols from job to job (`shards`). The driver keeps a table of the counts of frequent pairs,
which signed deltas keep exact. A job gets the rules since the shards were last written and up to GUESSED pairs, the most
frequent in order, which may or may not be what comes next; it returns what merging each of them, one after the other, changes. The
driver goes along: as long as the next guess is the most frequent pair of the table as changed so far, it is the
next rule and its deltas are taken; at the first that isn't, the rest is dropped. So every rule is the one that training one by one
takes, the first guess always holds, and some twenty rules share a job.

The table has no more pairs than the rules still to be learned need. Tasks know which these are (`shards.useful`), so changes of
others stay with them, and new pairs come to the driver only if they are frequent enough for the table.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import WORD_END
from ..ship import ship
from ..store import discard, scratch, written
from . import shards
from .counts import alphabet

RULES = "rank int, l string, r string, n long"
#: Pairs that a job tries (twice as many as held the last time and LEAST more, GUESSED at most), rules after which the shards are written
#: anew, and pairs whose counts the driver holds.
GUESSED, LEAST, REWRITE, HELD = 64, 8, 128, 200_000
#: Pairs that the table keeps, however few rules are left.
NEEDED = 1_000
#: Symbols of distinct words that one task may hold.
KERNEL_PLACES = 8_000_000


class Trainer:
    def __init__(self, counted: DataFrame, end: str = WORD_END, held: int = HELD, shard: int = shards.SHARD):
        self.spark, self.held, self.jobs = counted.sparkSession, held, 0
        self.names = sorted({r["symbol"] for r in alphabet(counted).collect()} | {end})
        self.number = {x: k for k, x in enumerate(self.names)}
        self.exist = set(self.number.values())
        self.rules: list[tuple[str, str, int]] = []
        self.pending: list[tuple[int, int, int]] = []
        self.path, self.guessed, self.shared = None, LEAST, None
        self._write(shards.made(counted, self.number, end, shard))
        self.many = self.state.count() > shards.FEW  # of shards; files get fewer when shards are written anew
        self._recount()

    def _write(self, state: DataFrame) -> None:
        before, self.path = self.path, scratch(self.spark, "shards")
        state.write.parquet(self.path)
        self.state, self.pending = self.spark.read.schema(shards.STATE).parquet(self.path), []
        self.jobs += 1
        if before:
            discard(self.spark, before)

    def _put(self, pair: tuple[int, int], n: int) -> None:
        self.count[pair] = n
        heapq.heappush(self.heap, (-n, self.names[pair[0]], self.names[pair[1]]))

    def _recount(self) -> None:
        """The table of the most frequent pairs, from all shards. All pairs of at least `floor` are in it."""
        found = shards.pair_sums(self.state, self.pending).orderBy(F.desc("n")).limit(self.held + 1).toArrow()
        n = found.column("n").to_pylist()
        self.floor = n[-1] + 1 if len(n) > self.held else 1
        self.count: dict[tuple[int, int], int] = {}
        self.heap: list[tuple[int, str, str]] = []
        for a, b, x in zip(found.column("l").to_pylist(), found.column("r").to_pylist(), n):
            if x >= self.floor:
                self._put((a, b), x)
        self.jobs += 1
        if not self.count and n:  # more pairs of one count than are held: hold more
            self.held *= 2
            self._recount()

    def _prune(self, most: int) -> None:
        """The floor rises to where twice as many pairs are left as rules can still come; if they don't do, all pairs are counted again."""
        keep = max(NEEDED, 2 * most)
        if len(self.count) > 3 * keep // 2:
            self.floor = max(self.floor, heapq.nlargest(keep, self.count.values())[-1])
            self.count = {p: n for p, n in self.count.items() if n >= self.floor}

    def _share(self) -> None:
        """Tells the tasks of the next job what the table has; needless if it has all pairs."""
        before, self.shared = self.shared, None
        if self.floor > 1:
            codes = np.sort(np.fromiter((a << 32 | b for a, b in self.count), np.int64, len(self.count)))
            self.shared = self.spark.sparkContext.broadcast((codes, np.array([k in self.exist for k in range(len(self.names))], bool)))
        if before:
            before.destroy()

    def _best(self) -> tuple[int, int] | None:
        """The most frequent pair, if the table tells."""
        while self.heap:
            less, left, right = self.heap[0]
            pair = self.number[left], self.number[right]
            n = self.count.get(pair, 0)
            if n == -less:
                return pair if n >= self.floor else None
            heapq.heappop(self.heap)  # an old count: the present one goes in
            if n >= self.floor:
                heapq.heappush(self.heap, (-n, left, right))
        return None

    def _guesses(self, most: int) -> list[tuple[int, int]]:
        out, taken = [], []
        while len(out) < most and (pair := self._best()):
            if not out or pair != out[-1]:
                out.append(pair)
            taken.append(heapq.heappop(self.heap))
        for x in taken:
            heapq.heappush(self.heap, x)
        return out

    def _change(self, changes: list[tuple], again: bool) -> list[tuple[int, int]]:
        """The table after the deltas of a rule. Returns the pairs that it can't tell: whose new symbol existed, and which it hadn't."""
        unknown = []
        for l, r, n in changes:
            pair = (l, r)
            if pair in self.count:
                if n > 0:
                    self._put(pair, self.count[pair] + n)
                else:
                    self.count[pair] += n  # its entry in the heap is old now
                    if not self.count[pair]:
                        del self.count[pair]
            elif n > 0:
                if again and self.floor > 1:
                    unknown.append(pair)
                elif n >= self.floor:
                    self._put(pair, n)
        return unknown

    def step(self, most: int) -> bool:
        """One job, and one rule at least; false if no pair is left."""
        if self._best() is None and self.floor > 1:
            self._recount()
        if self._best() is None:
            return False
        if len(self.pending) >= REWRITE:
            self._write(shards.applied(self.state, self.pending))
        self._prune(most)
        steps, again, made = [], [], set()
        for a, b in self._guesses(min(most, self.guessed)):
            name = self.names[a] + self.names[b]
            if name not in self.number:
                self.number[name] = len(self.names)
                self.names.append(name)
            if self.number[name] in self.exist or self.number[name] in made:
                again.append(len(steps))
            made.add(self.number[name])
            steps.append((a, b, self.number[name]))
        self._share()
        changes = shards.deltas(self.state, self.pending, steps, self.many, again, self.floor, self.shared)
        self.jobs += 1
        before = len(self.rules)
        for rule, change in zip(steps, changes):
            if self._best() != rule[:2]:
                break
            self.rules.append((self.names[rule[0]], self.names[rule[1]], self.count[rule[:2]]))
            self.pending.append(rule)
            unknown = self._change(change, rule[2] in self.exist)
            self.exist.add(rule[2])
            if unknown:
                for r in shards.pair_sums(self.state, self.pending, unknown).where(F.col("n") >= self.floor).collect():
                    self._put((r["l"], r["r"]), r["n"])
                self.jobs += 1
                break
        self.guessed = min(GUESSED, 2 * (len(self.rules) - before) + LEAST)
        return True


def train_sharded(counted: DataFrame, n_merges: int) -> list[tuple[str, str, int]]:
    """counted: word, freq. Rules (l, r, n), learned from shards of all words."""
    trainer = Trainer(written(counted.select("word", "freq"), "counted"))
    while len(trainer.rules) < n_merges and trainer.step(n_merges - len(trainer.rules)):
        pass
    discard(trainer.spark, trainer.path)
    return trainer.rules


def learn(words: list[str], freqs: list[int], n_merges: int, end: str = "</w>") -> list[tuple[str, str, int]]:
    """The same in one process: symbols in linked places, and for each pair its count and the places where it was seen."""
    names: list[str] = []
    number: dict[str, int] = {}

    def of(s: str) -> int:
        if s not in number:
            number[s] = len(names)
            names.append(s)
        return number[s]

    at, after, before, weight = array("i"), array("i"), array("i"), array("q")
    for word, freq in zip(words, freqs):
        start = len(at)
        at.extend([*map(of, word), of(end)])
        k = len(at)
        after.extend([*range(start + 1, k), -1])
        before.extend([-1, *range(start, k - 1)])
        weight.extend([freq] * (k - start))
    count: dict[tuple[int, int], int] = {}
    seen: dict[tuple[int, int], array] = {}

    def add(i: int, j: int) -> tuple[int, int]:
        pair = (at[i], at[j])
        count[pair] = count.get(pair, 0) + weight[i]
        if pair not in seen:
            seen[pair] = array("i")
        seen[pair].append(i)
        return pair

    for i, j in enumerate(after):
        if j >= 0:
            add(i, j)
    heap = [(-n, names[a], names[b]) for (a, b), n in count.items()]
    heapq.heapify(heap)
    rules = []
    while heap and len(rules) < n_merges:
        less, left, right = heapq.heappop(heap)
        pair = (number[left], number[right])
        n = count.get(pair, 0)
        if n != -less:  # an old count: it goes back with the present one
            if n:
                heapq.heappush(heap, (-n, left, right))
            continue
        rules.append((left, right, n))
        new, made = of(left + right), set()
        for i in sorted(set(seen.pop(pair))):
            j = after[i] if at[i] == pair[0] else -1
            if j < 0 or at[j] != pair[1]:
                continue
            h, k = before[i], after[j]
            for x, y in ((h, i), (j, k)):
                if x >= 0 and y >= 0:
                    count[(at[x], at[y])] -= weight[i]
            at[i], at[j], after[i] = new, -1, k
            if k >= 0:
                before[k] = i
            for x, y in ((h, i), (i, k)):
                if x >= 0 and y >= 0:
                    made.add(add(x, y))
        del count[pair]
        for a, b in made:
            if count.get((a, b), 0):
                heapq.heappush(heap, (-count[(a, b)], names[a], names[b]))
    return rules


def places():
    """Symbols of distinct words, ends included."""
    return F.sum(F.length("word") + F.lit(1))


def train_by(counted: DataFrame, by: str, n_merges: int) -> DataFrame:
    """counted: by, word, freq. by and its rules: groups are learned side by side, each in one task.

    Groups with more symbols in distinct words than a task may hold are learned from shards, one after the other.
    """
    spark = counted.sparkSession
    ship(spark)
    counted = written(counted.select(by, "word", "freq"), "counted")
    large = [x[by] for x in counted.groupBy(by).agg(places().alias("n")).where(F.col("n") > KERNEL_PLACES).collect()]
    kind = dict(counted.dtypes)[by]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")
        rules = learn(pdf["word"].tolist(), pdf["freq"].tolist(), n_merges)
        out = pd.DataFrame(rules, columns=["l", "r", "n"]).assign(rank=range(len(rules)))
        out[by] = pdf[by].iloc[0]
        return out[[by, "rank", "l", "r", "n"]]

    small = counted
    for value in large:
        small = small.where(~F.col(by).eqNullSafe(F.lit(value)))
    out = small.groupBy(by).applyInPandas(kernel, f"`{by}` {kind}, {RULES}")
    for value in large:
        rules = train_sharded(counted.where(F.col(by).eqNullSafe(F.lit(value))), n_merges)
        rows = [(value, k, a, b, n) for k, (a, b, n) in enumerate(rules)]
        out = out.unionByName(spark.createDataFrame(rows, f"`{by}` {kind}, {RULES}"))
    return out


def train(counted: DataFrame, n_merges: int = 4500) -> DataFrame:
    """counted: word, freq. Rules (rank, l, r, n), learned from shards of all words."""
    rules = train_sharded(counted, n_merges)
    return counted.sparkSession.createDataFrame([(k, a, b, n) for k, (a, b, n) in enumerate(rules)], RULES)


def train_in_one_task(counted: DataFrame, n_merges: int = 4500) -> DataFrame:
    """The same by one task, if it may hold all words."""
    return train_by(counted.withColumn("all", F.lit(0)), "all", n_merges).drop("all")
