"""Near copies by similarity of word shingles: SimHash candidates, then an exact join for the rest.

The contract of op4 links fingerprints; the corpus pipeline asks for similarity (Jaccard) of the sets of five-word shingles. At
0.8 two 64-bit fingerprints differ in about nine bits, too many for cells that must miss none. So a text gets COPIES fingerprints
(the same shingle hashes, mixed anew), and each is put, as in simhash, into the cells of disjoint subspaces of its two-bit segments,
as wide as keeps about MET points in a cell. Points of one cell are candidates within Manhattan, then Hamming distance NEAR, and
BOTH together with the next copy's fingerprint, so that chance candidates are a handful however large the table is. Sketches, counts
of the shingles by their lowest bits, exclude pairs that can't be similar enough; the shingle sets of every other candidate pair decide.

That joins large groups with few comparisons, but it may miss pairs. So an exact join follows, by prefixes: all
shingles have one order, and two texts that are similar enough share one of the first of each (of n, all but similarity * n, and one
more). Texts that share such a shingle, and have enough left from there on, are compared as sets, unless they are in one large
group already or were compared before. A text that shares one with members of a large group is not paired with each of them: it is noted
once beside the group, and its sketch is held against those of all members within tasks. It is compared with the likeliest member of
each block of them, and only if that doesn't link it, with every other that is plausible.
Every pair of the similarity is found, in whatever order the shingles are; the order only
saves work: shingles that are frequent in one of SAMPLE texts come last, so a passage that many texts share is seldom among the
first. Every link of either part is one that the shingle sets have.

Texts that are equal but for ASCII case and white space are one class, compared once. Within a cell of more than a few points, each
point is linked to the one that found it, so a group of copies makes few links, not all pairs; large cells are split into blocks.

Defined results: a null text is empty, and texts without words are one class. Rows that repeat are of one class. Null doc_ids
are never the smallest unless a class has no other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import lookup, small_batches, texts, with_ids, written
from .components import components
from .simhash import RUN, SEGMENTS, bits_set, blocked, cell_links, embedded

WORDS, SIMILARITY = 5, 0.8
COPIES, MET, NEAR, BOTH = 4, 64, 12, 24
#: Only work depends on these: frequent shingles are those met OFTEN times in one of SAMPLE texts, FREQUENT of them at most; a group of
#: LARGE texts or more isn't compared within itself again, if the members of all such are MEMBERS at most (else of larger ones only).
SAMPLE, OFTEN, FREQUENT, LARGE, MEMBERS = 8, 3, 500_000, 8, 1_000_000
#: Of the sketches that meet in one task a side has about SIDE, unless that makes more than SIDES blocks, and SIDE_MOST then.
SIDE, SIDES, SIDE_MOST = 256, 64, 4096
LITTLE = 1e-6
#: Counts of a sketch.
SKETCH = 256
#: Of a bitmap that is broadcast: 16 MB.
BITS = 1 << 27


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(text: bytes, words: int = WORDS, asked: np.ndarray | None = None) -> tuple[int, np.ndarray | None]:
    """A hash of the lower-cased words, and those of all shingles (fewer words: of the whole; none: none), made of their words' hashes.

    asked: a bitmap of the classes whose shingles are wanted; for others None instead.
    """
    w = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    own = xxhash.xxh64_intdigest(b" ".join(w), 1)
    if asked is not None and not asked[(own >> 3) & (len(asked) - 1)] >> (own & 7) & 1:
        return own, None
    n, k = len(w), min(words, len(w))
    if not n:
        return own, np.empty(0, np.uint64)
    x = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, n)
    h = x[: n - k + 1].copy()
    for j in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += x[j : n - k + 1 + j]
    return own, mixed(h)


def sketch(h: np.ndarray) -> bytes:
    """How many of the distinct shingle hashes have each of the SKETCH lowest values; 255 is so many or more."""
    return np.minimum(np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def signature(h: np.ndarray) -> np.ndarray:
    """COPIES fingerprints of distinct shingle hashes; the bits of each copy are the hashes', mixed with its number."""
    out = np.zeros(COPIES, np.uint64)
    if not len(h):
        return out
    for copy in range(COPIES):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), RUN):
            x = h[i : i + RUN] ^ np.uint64(0x9E3779B97F4A7C15 * copy % 2**64)
            counts += bits_set(mixed(x))
        out[copy] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, c (of the class), fps, size (of the shingle set), sketch."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            both = [hashes(t, words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            c, sets = np.array([x for x, _ in both], np.uint64).view(np.int64), [np.unique(h) for _, h in both]
            flat = np.concatenate([signature(h) for h in sets]) if both else np.empty(0, np.uint64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(both) + 1) * COPIES, pa.int32()), pa.array(flat.view(np.int64)))
            own = [pa.array([len(h) for h in sets], pa.int64()), pa.array([sketch(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(c), fps, *own], ["doc_id", "c", "fps", "size", "sketch"])

    return texts(docs).mapInArrow(run, "doc_id long, c long, fps array<long>, size long, sketch binary")


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) that can be of the similarity: sets share at most the smaller count of each value. Loses none that are."""
    side = lambda k, n, f: sketches.select(F.col("c").alias(k), F.col("size").alias(n), F.col("sketch").alias(f)).hint("merge")
    both = pairs.join(side("u", "m", "x"), "u").join(side("v", "n", "y"), "v")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("x", "y"))
            small = np.minimum(x, y)
            most = np.where((small == 255).any(1), np.inf, small.sum(1, dtype=np.int64))
            of_both = b.column("m").to_numpy() + b.column("n").to_numpy()
            yield b.select(["u", "v"]).filter(pa.array(most * (1 + similarity) >= similarity * of_both * (1 - LITTLE)))

    return both.select("u", "v", "m", "n", "x", "y").mapInArrow(run, "u long, v long")


def bitmap(pairs: DataFrame) -> np.ndarray:
    """Bytes of which the bits tell the classes that are in a pair; others may seem to be. At most BITS bits, however many pairs."""
    bits = min(BITS, 1 << max(10, (16 * pairs.count()).bit_length()))
    both = pairs.select(F.col("u").alias("c")).unionByName(pairs.select(F.col("v").alias("c")))
    place, one = F.shiftright("c", 3).bitwiseAND(F.lit(bits // 8 - 1)), F.expr("shiftleft(1, CAST(c & 7 AS INT))")
    table = both.select(place.alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return out


def shingles(docs: DataFrame, pairs: DataFrame, words: int = WORDS) -> DataFrame:
    """c, s: the classes that are in a pair (and a few others), each with its set of shingle hashes. Texts stay where they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(pairs))

    def run(batches):
        for b in batches:
            both = [hashes(t, words, shared.value) for t in b.column("text").cast(pa.binary()).to_pylist()]
            both = [(c, np.unique(h)) for c, h in both if h is not None]
            if both:
                off = np.cumsum([0, *(len(s) for _, s in both)]).astype(np.int32)
                flat = np.concatenate([s for _, s in both]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([c for c, _ in both], np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["c", "s"])

    return texts(docs).select("text").mapInArrow(run, "c long, s array<long>")


def least_of(sizes: DataFrame, most: int, least: int) -> int:
    """sizes: n, times. The smallest n, at least `least`, so that at most `most` are of that n or more."""
    total = 0
    for n, many in sorted(((r["n"], r["times"]) for r in sizes.where(F.col("n") >= least).collect()), reverse=True):
        total += many
        if total > most:
            return n + 1
    return least


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles, and how often each was met in the sample."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        for b in batches:
            sets = [np.unique(hashes(t, words)[1]) for t in b.column("text").cast(pa.binary()).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["s"])

    some = texts(docs).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    met = written(some.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN), "frequent")
    table = met.where(F.col("n") >= least_of(met.groupBy("n").agg(F.count(F.lit(1)).alias("times")), FREQUENT, OFTEN)).toArrow()
    s, n = table.column("s").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefix(h: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of distinct sorted hashes, the first in the common order that a similar set must share one of."""
    long = len(h) - int(np.ceil(similarity * len(h) - LITTLE)) + 1
    s, n = frequent
    if not len(h) or not len(s):
        return h[:long]
    at = np.minimum(np.searchsorted(s, h), len(s) - 1)
    met = np.where(s[at] == h, n[at], 0)
    return h[np.argsort(met, kind="stable")[:long]]


def prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """cell (a shingle), c, size (of its set), left (so many of them from this shingle on)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                c, h = hashes(t, words)
                h = np.unique(h)
                first = prefix(h, similarity, shared.value)
                k = len(first)
                rows.append((first, np.full(k, c, np.uint64), np.full(k, len(h), np.int32), len(h) - np.arange(k, dtype=np.int32)))
            if rows:
                cell, c, size, left = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(c.view(np.int64)), pa.array(size), pa.array(left)], ["cell", "c", "size", "left"])

    return texts(docs).select("text").mapInArrow(run, "cell long, c long, size int, left int")


def enough(size, left, i, j, similarity: float):
    """Whether i and j can still share as many as the similarity needs, if theirs is the first shingle they share."""
    return np.minimum(left[i], left[j]) * (1 + similarity) >= similarity * (size[i].astype(np.int64) + size[j]) - LITTLE


def pairs_of(run: np.ndarray, c: np.ndarray, size: np.ndarray, left: np.ndarray, group: np.ndarray, similarity: float):
    """Places (i, j) of texts to compare within each run of equal numbers."""
    begin = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
    many = np.diff(np.concatenate([begin, [len(run)]]))
    ok = lambda i, j: (c[i] != c[j]) & (group[i] != group[j]) & enough(size, left, i, j, similarity)
    few = np.flatnonzero(np.repeat((many > 1) & (many <= simhash.FEW), many))
    for d in range(1, simhash.FEW):
        i = few[few + d < len(run)]
        i = i[run[i] == run[i + d]]
        i = i[ok(i, i + d)]
        yield i, i + d
    for k in np.flatnonzero(many > simhash.FEW):
        at = np.arange(begin[k], begin[k] + many[k])
        at = at[np.argsort(group[at], kind="stable")]
        ends = np.concatenate([np.flatnonzero(np.diff(group[at])) + 1, [len(at)]])
        # Each text against all that come after its own group.
        for x, after in zip(at[: ends[-2]] if len(ends) > 1 else [], np.repeat(ends, np.diff(np.concatenate([[0], ends])))):
            j = at[after:]
            j = j[ok(np.full(len(j), x), j)]
            yield np.full(len(j), x), j


def cell_pairs(cells: DataFrame, keys: list[str], similarity: float, groups) -> DataFrame:
    """u, v to compare, of rows sorted by keys; where one is in a large group, the other as u and the group's root instead, v null.
    The rows of a run of more than CELL come back instead, with v and root null, if keys are cells."""
    most, kind = simhash.CELL, "u long, v long, cell long, size int, left int, root long"
    names = ["u", "v", "cell", "size", "left", "root"]

    def found(key, cell, c, size, left):
        change = (key[1:] != key[:-1]).any(1)
        run = np.concatenate([[0], np.cumsum(change)])
        many = np.bincount(run)
        if len(keys) == 1:
            own = (many > most)[run]
            if own.any():
                none = pa.nulls(int(own.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c[own]), none, pa.array(cell[own]), pa.array(size[own]), pa.array(left[own]), none], names)
        keep = np.flatnonzero((many > 1)[run] & ((many <= most)[run] | (len(keys) > 1)))
        run, c, size, left = run[keep], c[keep], size[keep], left[keep]
        if not len(c):
            return
        members, roots = groups.value
        group, large = c.copy(), np.zeros(len(c), bool)
        if len(members):
            at = np.minimum(np.searchsorted(members, c), len(members) - 1)
            large = members[at] == c
            group = np.where(large, roots[at], c)
        ready, near, have = [], [], 0
        for i, j in pairs_of(run, c, size, left, group, similarity):
            i, j = np.where(large[i] & ~large[j], (j, i), (i, j))
            into = large[j]
            ready.append((np.minimum(c[i], c[j])[~into], np.maximum(c[i], c[j])[~into]))
            near.append((c[i][into], group[j][into]))
            have += len(i)
            if have > RUN:
                yield from linked(ready, near)
                ready, near, have = [], [], 0
        if have:
            yield from linked(ready, near)

    def linked(ready, near):
        for found, of_root in ((ready, False), (near, True)):
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], 1), axis=0)
            if len(both):
                none = [pa.nulls(len(both), t) for t in (pa.int64(), pa.int32(), pa.int32())]
                u, v = (pa.array(both[:, k].copy()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([u, none[0], *none, v] if of_root else [u, v, *none, none[0]], names)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in keys], 1)
            held.append((key, *(b.column(k).to_numpy() for k in ("cell", "c", "size", "left"))))
            n += b.num_rows
            if n < RUN or (held[0][0][0] == key[-1]).all():
                continue
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero((whole[0] != whole[0][-1]).any(1))[-1]) + 1  # the last run may go on
            yield from found(*[x[:cut] for x in whole])
            held, n = [tuple(x[cut:] for x in whole)], len(whole[1]) - cut
        if held:
            yield from found(*[np.concatenate(x) for x in zip(*held)])

    return cells.mapInArrow(run, kind)


def exact_candidates(docs: DataFrame, rooted: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rooted: c, root. Distinct pairs (u, v) that hold, with what is near large groups, all of the similarity but those within a large group.

    Also the members (root, c) of large groups, and texts near such a group: distinct (u, root). Which member u may be similar to is open.
    """
    spark = docs.sparkSession
    per_root = written(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LARGE), "groups")
    least = least_of(per_root.groupBy("n").agg(F.sum("n").alias("times")), MEMBERS, LARGE)
    members = written(rooted.join(per_root.where(F.col("n") >= least).select("root"), "root").select("root", "c"), "members")
    table = members.toArrow()
    c, root = (table.column(k).to_numpy() for k in ("c", "root"))
    order = np.argsort(c)
    groups = spark.sparkContext.broadcast((c[order], root[order]))
    cells = prefixes(docs, words, similarity).repartition("cell").sortWithinPartitions("cell")
    first = written(cell_pairs(cells, ["cell"], similarity, groups), "prefix-pairs")
    found = first.select("u", "v", "root")
    large = first.where("v IS NULL AND root IS NULL").select(F.lit(0).alias("space"), "cell", "size", "left", F.col("u").alias("c"))
    if large.limit(1).count():
        dealt = blocked(large.distinct(), "size", "left", "c")
        found = found.unionByName(written(cell_pairs(dealt, ["space", "cell", "a", "b"], similarity, groups), "prefix-pairs").select("u", "v", "root"))
    return found.where("v IS NOT NULL").select("u", "v").distinct(), members, written(found.where("root IS NOT NULL").select("u", "root").distinct(), "near-groups")


def in_groups(near: DataFrame, members: DataFrame, sketches: DataFrame, similarity: float, best: bool = False) -> DataFrame:
    """near: u, root. Pairs (u, v) of u with those members of the group that it can be similar to, by sketches; best: with one a block.

    Both sides are dealt into blocks, and every two blocks of a group meet in one task; pairs that sketches exclude make no rows.
    """
    blocks = lambda n: F.greatest(F.least(F.ceil(n / SIDE), F.lit(SIDES)), F.ceil(n / SIDE_MOST)).cast("int")
    asked = near.groupBy("root").agg(blocks(F.count(F.lit(1))).alias("of_u"))
    shape = written(members.groupBy("root").agg(blocks(F.count(F.lit(1))).alias("of_v")).join(asked, "root"), "shape")
    both = near.select("root", F.col("u").alias("c"), F.lit(True).alias("asks")).unionByName(members.select("root", "c", F.lit(False).alias("asks")))
    both = both.join(F.broadcast(shape), "root").join(sketches, "c")
    own = lambda of: F.array(F.pmod(F.xxhash64("c"), F.col(of)).cast("int"))
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    both = both.withColumn("a", F.explode(F.when(F.col("asks"), own("of_u")).otherwise(every("of_u"))))
    both = both.withColumn("b", F.explode(F.when(F.col("asks"), every("of_v")).otherwise(own("of_v"))))

    def run(table: pa.Table) -> pa.Table:
        c, size = table.column("c").to_numpy(), table.column("size").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        counts = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        v, n, y = c[~asks], size[~asks], counts[~asks]
        found = [(v[:0], v[:0])]
        for u, m, x in zip(c[asks], size[asks], counts[asks]):
            may = np.flatnonzero((np.minimum(m, n) * (1 + similarity) >= similarity * (m + n) * (1 - LITTLE)) & (v != u))
            small = np.minimum(y[may], x)
            most = np.where((small == 255).any(1), np.inf, small.sum(1, dtype=np.int64))
            ok = most * (1 + similarity) >= similarity * (m + n[may]) * (1 - LITTLE)
            may, most = may[ok], most[ok]
            if best and len(may):
                may = may[[np.argmax(most / (m + n[may]))]]
            found.append((np.minimum(u, v[may]), np.maximum(u, v[may])))
        u, v = (np.concatenate(x) for x in zip(*found))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return both.select("root", "a", "b", "c", "asks", "size", "sketch").groupBy("root", "a", "b").applyInArrow(run, "u long, v long").distinct()


def similar(docs: DataFrame, pairs: DataFrame, sketches: DataFrame | None, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets of shingles are of the similarity. Sketches, if given, exclude most of the others before sets are moved."""
    pairs = written(plausible(pairs, sketches, similarity), "plausible") if sketches else pairs
    sets = written(shingles(docs, pairs, words).dropDuplicates(["c"]), "shingles")
    side = lambda k, f: sets.select(F.col("c").alias(k), F.col("s").alias(f))
    both = pairs.join(side("u", "x").hint("merge"), "u").join(side("v", "y").hint("merge"), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("u", "v")


def span_for(n: int) -> int:
    """The fewest segments with which a random fingerprint meets at most MET of n others: two segments' counts agree by 3/8."""
    return next(k for k in range(4, SEGMENTS + 1) if n * (3 / 8) ** k <= MET or k == SEGMENTS)


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, component_id (the smallest doc_id that links of that similarity reach)."""
    spark = docs.sparkSession
    own = written(signatures(docs, words), "signatures")
    classes = written(own.groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.max(F.struct("fps", "size", "sketch")).alias("x")), "classes")
    sketches = classes.select("c", "x.size", "x.sketch")
    classes = classes.select("c", "doc_id", "n", "x.fps")  # the same for all texts of a class

    span = span_for(classes.count())
    masks = [sum(3 << 2 * k for k in range(j, j + span)) for j in range(0, SEGMENTS - span + 1, span)]
    of = F.array([F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks])
    cells = classes.select("c", F.posexplode("fps").alias("copy", "fp"), "fps")
    cells = cells.select("c", "copy", "fp", F.element_at("fps", F.pmod(F.col("copy") + 1, F.lit(COPIES)).cast("int") + 1).alias("more"), embedded(F.col("fp")).alias("p"), F.posexplode(of).alias("j", "mask"))
    cells = cells.select((F.col("copy") * len(masks) + F.col("j")).alias("space"), F.col("p").bitwiseAND(F.col("mask")).alias("cell"), "fp", "more", "c")
    cells = blocked(cells, "fp", "more", "c")
    pairs = cells.mapInArrow(lambda batches: cell_links(batches, NEAR, BOTH), "u long, v long")
    pairs = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "candidates")
    close = similar(docs, pairs, sketches, words, similarity)
    of_root = lambda root: written(classes.select("c", "doc_id", "n").join(root, F.col("c") == F.col("u"), "left").select("c", "doc_id", "n", F.coalesce("root", "c").alias("root")), "rooted")
    root = written(components(close), "roots")

    missed, members, near = exact_candidates(docs, of_root(root), words, similarity)
    missed = written(missed.join(pairs, ["u", "v"], "left_anti"), "missed")
    likely = written(plausible(missed, sketches, similarity).unionByName(in_groups(near, members, sketches, similarity, best=True).join(pairs, ["u", "v"], "left_anti")).distinct(), "plausible")
    more = written(similar(docs, likely, None, words, similarity), "more")
    root = written(components(root.select("u", F.col("root").alias("v")).unionByName(more)), "roots")
    # What is still apart from a group that it is near.
    now = of_root(root).select(F.col("c").alias("__c"), F.col("root").alias("now"))
    of_group = near.select("root").distinct().join(now, F.col("root") == F.col("__c")).select("root", F.col("now").alias("of_group"))
    apart = near.join(F.broadcast(of_group), "root").join(now, F.col("u") == F.col("__c")).where("now <> of_group").select("u", "root")
    apart = written(apart, "apart")
    if apart.limit(1).count():
        rest = in_groups(apart, members, sketches, similarity).join(pairs, ["u", "v"], "left_anti").join(likely, ["u", "v"], "left_anti")
        last = similar(docs, written(rest, "plausible"), None, words, similarity)
        root = written(components(root.select("u", F.col("root").alias("v")).unionByName(last)), "roots")
    rooted = of_root(root)
    per_root = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    of_class = lookup(rooted.select("c", "root", F.col("n").alias("rows")), per_root, "root", classes.count())
    of_class = written(of_class.select("c", F.col("rows").alias("n"), "component_id"), "of-classes")
    return lookup(own.select("doc_id", "c"), of_class, "c", own.count()).select("doc_id", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that with the smallest doc_id."""
    found = near_copies(docs).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")))
    dropped = written(found.groupBy("doc_id").agg(F.max("stays").alias("stays")).where("NOT stays"), "dropped")
    return with_ids(docs, dropped, keep=False)
