"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits, and it is mapped to its segments' bit counts, 32 numbers
from 0 to 2. The Manhattan distance of two such points is at most the Hamming distance of the fingerprints. The grid:
the segments are dealt into GROUPS groups, and two points within distance MOST differ in at most MOST groups, so they
lie in the same unit cell of at least one of the subspaces that leave MOST groups out. Every point is put into its cell
in each subspace; within a cell, the Manhattan distance excludes most pairs, and the Hamming distance decides.

Only distinct fingerprints are compared. A cell gives a forest of its links, not all pairs: a point already linked to
another isn't compared again. A cell of more than CELL points is split into blocks, and each two blocks are compared by a
task of their own, so a task holds 2 * CELL points at most.

Defined results: a null text is empty; a text without words has fingerprint zero. Rows that repeat are linked like
others. Null doc_ids are never a component_id unless a component has no other. An empty table gives no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lookup, read, small_batches, texts, written
from .components import components

WORDS, SEED, MOST = 4, 42, 4
CELL = 4096
SEGMENTS = 32
#: So many points of a cell are compared in all pairs; larger ones by walking along links.
FEW = 8
ODD = np.uint64(0x5555555555555555)
#: Shingles whose bits are counted at a time.
RUN = 1 << 16


def bits_set(h: np.ndarray) -> np.ndarray:
    """How many of h have each of the 64 bits set."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    whole = len(bits) // 255 * 255  # sums of 255 fit a byte
    return bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    w = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    whole = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k, xxh = min(words, len(w)), xxhash.xxh64_intdigest
    begins, ends, counts = begins[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), np.zeros(64, np.int64)
    for i in range(0, len(begins), RUN):
        h = np.array([xxh(whole[a:b], SEED) for a, b in zip(begins[i : i + RUN], ends[i : i + RUN])], "<u8")
        counts += bits_set(h)
    return int(np.packbits(2 * counts > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


#: What a row of a cell costs to make and shuffle, and a comparison within a cell, in nanoseconds; only their ratio matters.
ROW, PAIR = 2000, 1


def cost(groups: int, n: int, most: int = MOST) -> float:
    """Of a fingerprint among n: its rows, once for each block of its cell, and the others it meets by chance, since two segments' counts
    agree by 3/8."""
    sizes = [sum(s * groups // SEGMENTS == g for s in range(SEGMENTS)) for g in range(groups)]
    met = [n * (3 / 8) ** sum(kept) for kept in combinations(sizes, groups - most)]
    return sum(ROW * max(1, m / CELL) + PAIR * m / 2 for m in met)


def groups_for(n: int, most: int = MOST) -> int:
    """The number of groups that costs least. Rows a fingerprint: 17 up to 0.1 billion, 35 at 0.2 billion, 36 at one, 130 at 50."""
    return min(range(most + 2, SEGMENTS + 1), key=lambda g: cost(g, n, most))


def subspaces(groups: int, most: int = MOST) -> list[int]:
    """Of each subspace, a mask of the bits of its segments (as a signed long)."""
    own = [sum(3 << 2 * s for s in range(SEGMENTS) if s * groups // SEGMENTS == g) for g in range(groups)]
    masks = [sum(own[g] for g in kept) for kept in combinations(range(groups), groups - most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def embedded(fp):
    """The segments' bit counts, each 0, 1 or 2 written as 00, 01 or 11: so the bits in which two differ are their Manhattan distance."""
    next_bit = F.shiftrightunsigned(fp, 1)
    odd = F.lit(int(ODD))
    return fp.bitwiseOR(next_bit).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(odd), 1))


def _embedded(fp: np.ndarray) -> np.ndarray:
    near = fp >> np.uint64(1)
    return ((fp | near) & ODD) | ((fp & near & ODD) << np.uint64(1))


def forest(fp: np.ndarray, most: int = MOST, more: np.ndarray | None = None, both: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect what is within most bits of each other: each place but a tree's first, with the one that found it.

    more: second fingerprints; then the bits of both that differ must be at most both.
    """
    left, right = [], []
    point, rest = _embedded(fp), np.arange(len(fp))
    while len(rest):
        rest, edge = rest[1:], [rest[0]]
        while edge and len(rest):
            x = edge.pop()
            near = np.flatnonzero(np.bitwise_count(point[rest] ^ point[x]) <= most)
            apart = np.bitwise_count(fp[rest[near]] ^ fp[x])
            near, apart = near[apart <= most], apart[apart <= most]
            if more is not None:
                near = near[apart + np.bitwise_count(more[rest[near]] ^ more[x]) <= both]
            found = rest[near]
            edge += found.tolist()
            left.append(np.full(len(found), x))
            right.append(found)
            rest = np.delete(rest, near)
    return (np.concatenate(left), np.concatenate(right)) if left else (rest[:0], rest[:0])


def cell_links(batches, most: int = MOST, both: int = 0):
    """Links within each run of equal (space, cell, a, b); rows come sorted by those, then have fp.

    A link is two fingerprints. both: rows also have a second fingerprint and a name; the bits of both fingerprints that
    differ must be at most both, and a link is two names.
    """

    def found(keys, fp, more, name):
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        begin = np.concatenate([[0], change])
        many = np.diff(np.concatenate([begin, [len(fp)]]))
        left, right = [], []
        small = np.repeat(many <= FEW, many)
        run = np.repeat(np.arange(len(begin)), many)
        point = _embedded(fp)
        for d in range(1, FEW):
            i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
            i = i[np.bitwise_count(point[i] ^ point[i + d]) <= most]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
            if both:
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) + np.bitwise_count(more[i] ^ more[i + d]) <= both]
            left.append(i)
            right.append(i + d)
        for k in np.flatnonzero(many > FEW):
            run_of = slice(begin[k], begin[k] + many[k])
            a, b = forest(fp[run_of], most, more[run_of] if both else None, both)
            left.append(a + begin[k])
            right.append(b + begin[k])
        u, v = name[np.concatenate(left)], name[np.concatenate(right)]
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    held = [np.empty((0, 4), np.int64), *[np.empty(0, np.uint64)] * 3]
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy().view(np.uint64) for i in ((4, 5, 6) if both else (4, 4, 4))]
        new = [np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], 1), *columns]
        held = [np.concatenate(x) for x in zip(held, new)]
        if len(held[1]) < RUN:
            continue
        whole = np.flatnonzero((held[0] != held[0][-1]).any(1))
        cut = int(whole[-1]) + 1 if len(whole) else 0  # the last run may go on
        if cut:
            yield found(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if len(held[1]):
        yield found(*held)


def blocked(cells: DataFrame, *columns: str) -> DataFrame:
    """cells: space, cell, and columns, the last of which tells points apart. Rows with the same (space, cell, a, b) together.

    A cell of more than CELL points is dealt into blocks, and every two of them make a run of their own.
    """
    large = written(cells.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL), "cells")
    n_large = large.count()
    if n_large:
        # One more pass over the cells; of each row, its block with every block of its cell, or the only one.
        cells = cells.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large.hint("merge"), ["space", "cell"], "left")
        cells = cells.withColumn("blocks", F.coalesce(F.ceil(F.col("n") / CELL).cast("int"), F.lit(1)))
        cells = cells.withColumn("own", F.pmod(F.xxhash64(columns[-1]), F.col("blocks")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("space", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), *columns)
    else:
        cells = cells.select("space", "cell", F.lit(0).alias("a"), F.lit(0).alias("b"), *columns)
    key = ["space", "cell", "a", "b"]
    return cells.repartition(*key).sortWithinPartitions(*key)


def links(points: DataFrame, most: int = MOST) -> DataFrame:
    """points: distinct fp. Links (u, v) that connect all fingerprints within most bits of each other."""
    masks = subspaces(groups_for(points.count(), most), most)
    of = F.array([F.lit(m).cast("bigint") for m in masks])
    cells = points.select("fp", embedded(F.col("fp")).alias("p"), F.posexplode(of).alias("space", "mask"))
    cells = blocked(cells.select("space", F.col("p").bitwiseAND(F.col("mask")).alias("cell"), "fp"), "fp")
    return written(cells.mapInArrow(lambda batches: cell_links(batches, most), "u long, v long"), "near")


def near_dedup(docs: DataFrame, words: int = WORDS, most: int = MOST) -> DataFrame:
    """Per row: doc_id, fingerprint (hexadecimal), component_id (the smallest doc_id that links reach)."""
    own = written(fingerprints(docs, words), "fingerprints")
    points = written(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "points")
    root = written(components(links(points.select("fp"), most)), "roots")
    rooted = points.join(root, F.col("fp") == F.col("u"), "left").select("fp", "doc_id", "n", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    per_root = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    of_point = lookup(rooted.select("fp", "root", F.col("n").alias("rows")), per_root, "root", points.count())
    of_point = written(of_point.select("fp", F.col("rows").alias("n"), "component_id"), "of-points")
    return lookup(own, of_point, "fp", own.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))
