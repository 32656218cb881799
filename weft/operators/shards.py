"""Words in shards, and what merging does to the counts of adjacent pairs.

A shard has the symbols of some SHARD places of distinct words, as numbers, with NONE after each word, and each word's frequency.
Merging works on whole shards at a time; the deltas of a merge come from the places that it touches alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: Places of a shard, unless one word is longer. A place takes 12 bytes, and a few times that while it is worked on. Sums of more than
#: FEW shards are added up by Spark before the driver gets them.
SHARD, NONE = 100_000, -1
FEW = 64
STATE, DELTAS, PAIRS = "symbols binary, freqs binary", "step int, l int, r int, n long", "l int, r int, n long"


def summed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, and the sums of their n."""
    code = left.astype(np.int64) << 32 | right
    order = np.argsort(code, kind="stable")
    code = code[order]
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, int)
    code = code[begins]
    return (code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32), np.add.reduceat(n[order], begins) if len(begins) else n[:0]


class Shard:
    def __init__(self, symbols: bytes, freqs: bytes):
        self.s = np.frombuffer(symbols, np.int32)
        ends = np.flatnonzero(self.s == NONE)
        self.n = np.repeat(np.frombuffer(freqs, np.int64), np.diff(ends, prepend=-1))

    def row(self) -> tuple[bytes, bytes]:
        return self.s.tobytes(), self.n[self.s == NONE].tobytes()

    def pairs(self, at: np.ndarray | None = None) -> tuple:
        """Sums of the pairs that begin at the places given, or at all."""
        if at is None:
            at = np.arange(len(self.s) - 1)
        else:
            at = np.unique(at)
            at = at[(at >= 0) & (at < len(self.s) - 1)]
        at = at[(self.s[at] != NONE) & (self.s[at + 1] != NONE)]
        return summed(self.s[at], self.s[at + 1], self.n[at])

    def merge(self, left: int, right: int, made: int, deltas: bool = False) -> list[tuple]:
        """From the left, none used twice. deltas: the pairs that went, with negative sums, and those that came."""
        at = np.flatnonzero((self.s[:-1] == left) & (self.s[1:] == right))
        if left == right and len(at):  # of a run of places that each begin a pair, every other one is merged
            k = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, k, 0))
            at = at[(k - begin) % 2 == 0]
        if not len(at):
            return []
        out = []
        if deltas:
            l, r, n = self.pairs(np.concatenate([at - 1, at, at + 1]))
            out.append((l, r, -n))
        keep = np.ones(len(self.s), bool)
        keep[at + 1] = False
        s = self.s.copy()
        s[at] = made
        self.s, self.n = s[keep], self.n[keep]
        at = at - np.arange(len(at))
        if deltas:
            out.append(self.pairs(np.concatenate([at - 1, at])))
        return out


def made(counted: DataFrame, number: dict[str, int], end: str, size: int) -> DataFrame:
    """counted: word, freq, distinct words. Shards of `size` places or so; number: of each character and of the end."""
    spark = counted.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(number)
    places = counted.agg(F.sum(F.length("word") + F.lit(2))).head()[0] or 0

    def run(batches):
        number, s, freqs = shared.value, [], []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([np.array(s, np.int32).tobytes()]), pa.array([np.array(freqs, np.int64).tobytes()])], ["symbols", "freqs"])
        for b in batches:
            for word, freq in zip(b.column("word").to_pylist(), b.column("freq").to_pylist()):
                s += [number[c] for c in word]
                s += [number[end], NONE]
                freqs.append(freq)
                if len(s) >= size:
                    yield row()
                    s, freqs = [], []
        if s:
            yield row()

    return counted.where("word IS NOT NULL").select("word", "freq").repartition(max(1, -(-places // size)), "word").mapInArrow(run, STATE)


def _merged(b: pa.RecordBatch, rules: list[tuple[int, int, int]]):
    for symbols, freqs in zip(b.column("symbols").to_pylist(), b.column("freqs").to_pylist()):
        shard = Shard(symbols, freqs)
        for rule in rules:
            shard.merge(*rule)
        yield shard


def applied(state: DataFrame, rules: list[tuple[int, int, int]]) -> DataFrame:
    """The shards after the rules (left, right, made)."""

    def run(batches):
        for b in batches:
            rows = list(zip(*(x.row() for x in _merged(b, rules)))) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in rows], ["symbols", "freqs"])

    return state.mapInArrow(run, STATE)


def pair_sums(state: DataFrame, rules: list[tuple[int, int, int]], asked: list[tuple[int, int]] | None = None) -> DataFrame:
    """l, r, n of all pairs, or of those asked, after the rules. Each shard adds its own up first."""
    codes = None if asked is None else np.array([a << 32 | b for a, b in asked], np.int64)

    def run(batches):
        for b in batches:
            for shard in _merged(b, rules):
                l, r, n = shard.pairs()
                if codes is not None:
                    on = np.isin(l.astype(np.int64) << 32 | r, codes)
                    l, r, n = l[on], r[on], n[on]
                yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(r), pa.array(n)], ["l", "r", "n"])

    return state.mapInArrow(run, PAIRS).groupBy("l", "r").agg(F.sum("n").alias("n"))


def useful(step: np.ndarray, l: np.ndarray, r: np.ndarray, again: list[int], held: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which changes a table of some pairs has a use for. held: the codes of its pairs in order, and which symbols there were at that time.

    A pair of such symbols that the table lacks can only lose, unless the step makes a symbol again.
    """
    codes, were = held
    old = (l < len(were)) & (r < len(were))
    old[old] = were[l[old]] & were[r[old]]
    code = l[old].astype(np.int64) << 32 | r[old]
    at = np.searchsorted(codes, code)
    out = ~old
    out[old] = np.append(codes, -1)[at] == code
    return out | np.isin(step, again)


def deltas(state: DataFrame, rules: list[tuple[int, int, int]], steps: list[tuple[int, int, int]], many: bool, again: list[int] = [], floor: int = 1, held=None) -> list[list[tuple[int, int, int]]]:  # noqa: B006
    """What each of the steps, one after the other, changes in the counts of pairs (l, r, n), once the rules were applied.

    held: a broadcast for `useful`, which then says what is left out, as are sums of new pairs below the floor; but for the steps in
    again, of which all is returned. So what the driver gets follows its table, not all pairs that there are.
    """

    def run(batches):
        for b in batches:
            for shard in _merged(b, rules):
                found = [(k, *x) for k, step in enumerate(steps) for x in shard.merge(*step, deltas=True)]
                if found:
                    step = np.repeat(np.array([x[0] for x in found], np.int32), [len(x[1]) for x in found])
                    rows = [step, *(np.concatenate([x[i] for x in found]) for i in (1, 2, 3))]
                    if held is not None:
                        on = useful(*rows[:3], again, held.value)
                        rows = [x[on] for x in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["step", "l", "r", "n"])

    found = state.mapInArrow(run, DELTAS)
    if many:
        n = F.col("n")
        found = found.groupBy("step", "l", "r").agg(F.sum("n").alias("n")).where((n < 0) | (n >= floor) | (n > 0) & F.col("step").isin(again))
    step, l, r, n = (x.to_numpy() for x in found.toArrow().columns)
    out: list[list[tuple[int, int, int]]] = []
    for k in range(len(steps)):
        sums = summed(l[step == k], r[step == k], n[step == k])
        out.append([x for x in zip(*(y.tolist() for y in sums)) if x[2]])
    return out
