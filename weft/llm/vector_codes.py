"""Vector code compression: product codes by Hamerly's form of Lloyd's algorithm, on whole numbers.

Vectors are cut into PARTS parts, each with a codebook of its own. The state of a row is written after every round: its code, and for each
part an upper bound of the distance to its entry and one lower bound of the distance to any other entry. When entries have
moved, the bounds move by as much. A part stays where it is if its upper bound is strictly below the lower bound, or below half
the way to the entry's nearest neighbour; if not, the exact distance becomes the upper bound; and if that fails too, all entries are
scanned in whole numbers, the lower index of equals. Bounds are rounded outwards, so rounding can cause a scan but never a wrong code.

The codebooks and the sums of a round are all that the driver gets: PARTS times ENTRIES rows of sums.

Defined results: rows whose vector is null or holds a null or a component that isn't finite go. Vectors of unequal length, or
of a length that PARTS doesn't divide, are filled with zeros to the least such length of the longest. With fewer kept rows than ENTRIES,
each is an entry. Rows that repeat a vec_id are rows of their own; of those the entries are taken by label, then components, nulls
last. Of equal entries the lower index is used. Whole components and errors beyond a long are the nearest long. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, read, small_batches, written
from .vectors import EXACT, LONG, long, matrix, most, whole, width

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose distances to all entries are made at a time.
RUN = 4096
#: By what a bound is moved outwards, as a part of it.
LITTLE = 1e-6
STATE = "vec_id long, label long, q array<long>, code array<smallint>, upper array<float>, lower array<float>, scans int"
SUMS = "part int, entry int, at int, total decimal(38,0), n long"


def outward(x: np.ndarray, way: float) -> np.ndarray:
    """As floats of 32 bits, not nearer than x."""
    return np.nextafter((x * (1 + way * LITTLE)).astype(np.float32), np.float32(way * np.inf))


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to each entry, exact: as doubles where those are, else as whole numbers of any size."""
    kind = np.float64 if 4 * x.shape[1] * max(most(x), most(book)) ** 2 < EXACT / 4 else object
    x, book = x.astype(kind), book.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def own_square(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to the same row of entry."""
    kind = np.int64 if 4 * x.shape[1] * max(most(x), most(entry)) ** 2 < LONG else object
    d = x.astype(kind) - entry.astype(kind)
    return (d * d).sum(1)


class Books:
    """The codebook of every part, how far its entries moved last, and half the way from each to its nearest neighbour."""

    def __init__(self, books: list[np.ndarray], before: list[np.ndarray] | None = None):
        self.books = books
        self.moved = before and [np.sqrt(own_square(b, a).astype(np.float64)) * (1 + LITTLE) for b, a in zip(books, before)]
        self.half = []
        for b in books:
            d = squares(b, b).astype(np.float64)
            np.fill_diagonal(d, np.inf)
            self.half.append(np.sqrt(d.min(1)) / 2 * (1 - LITTLE))

    def scan(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lower of equals; distances to it and to the second nearest."""
        code, near, next_ = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
        for s in range(0, len(x), RUN):
            d = squares(x[s : s + RUN], self.books[part])
            at = code[s : s + RUN] = d.argmin(1)
            near[s : s + RUN] = np.sqrt(d[np.arange(len(d)), at].astype(np.float64))
            if d.shape[1] > 1:
                next_[s : s + RUN] = np.sqrt(np.partition(d.astype(np.float64), 1, 1)[:, 1])
        return code, near, next_

    def again(self, x: np.ndarray, part: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple:
        """Code and bounds after the entries moved, and which rows had to be scanned."""
        moved, book = self.moved[part], self.books[part]
        upper = upper + moved[code]
        rank = np.argsort(-moved)
        others = np.where(code == rank[0], moved[rank[1]] if len(rank) > 1 else 0, moved[rank[0]])
        lower = lower - others
        sure = np.maximum(lower * (1 - LITTLE), self.half[part][code])
        bad = np.flatnonzero(~(upper * (1 + LITTLE) < sure))
        upper[bad] = np.sqrt(own_square(x[bad], book[code[bad]]).astype(np.float64))
        bad = bad[~(upper[bad] * (1 + LITTLE) < sure[bad])]
        code, scanned = code.copy(), np.zeros(len(x), np.int64)
        code[bad], upper[bad], lower[bad] = self.scan(x[bad], part)
        scanned[bad] = 1
        return code, upper, lower, scanned

    def assign(self, batches, wide: int):
        """Rows with state; those without (code null) are scanned in all parts."""
        w = wide // PARTS
        for b in batches:
            q, n = matrix(b.column("q"), wide), b.num_rows
            code, upper, lower = np.empty((n, PARTS), np.int64), np.empty((n, PARTS)), np.empty((n, PARTS))
            scans = b.column("scans").to_numpy(zero_copy_only=False).astype(np.int64)
            before = self.moved and [b.column(c).flatten().to_numpy().reshape(n, PARTS) for c in ("code", "upper", "lower")]
            for p in range(PARTS):
                x = q[:, p * w : (p + 1) * w]
                if before:
                    code[:, p], upper[:, p], lower[:, p], more = self.again(x, p, before[0][:, p].astype(np.int64), before[1][:, p].astype(float), before[2][:, p].astype(float))
                    scans += more
                else:
                    code[:, p], upper[:, p], lower[:, p] = self.scan(x, p)
                    scans += 1
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), PARTS).cast(pa.list_(k)) for x, k in ((code.astype(np.int16), pa.int16()), (outward(upper, 1), pa.float32()), (outward(lower, -1), pa.float32()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("vec_id", "label", "q")], *lists, pa.array(scans.astype(np.int32))], [x.split()[0] for x in STATE.split(", ")])

    def sums(self, batches, wide: int):
        """Of all batches, for each part, entry and component within it: the sum, and how many rows."""
        w, k = wide // PARTS, max(map(len, self.books))
        total, n, large = np.zeros((PARTS, k, w), object), np.zeros((PARTS, k), np.int64), False
        small = np.zeros((PARTS, k, w))
        for b in batches:
            q, code = matrix(b.column("q"), wide), b.column("code").flatten().to_numpy().reshape(-1, PARTS)
            large = len(q) * most(q) >= EXACT  # a batch's sums wouldn't be exact as doubles
            for p in range(PARTS):
                n[p] += np.bincount(code[:, p], minlength=k)
                for c in range(w):
                    x = q[:, p * w + c]
                    if large:
                        np.add.at(total[p, :, c], code[:, p], x.astype(object))
                    else:
                        small[p, :, c] = np.bincount(code[:, p], x.astype(np.float64), k)
            if not large:
                total += small.astype(np.int64).astype(object)
        part, entry, at = np.indices((PARTS, k, w)).reshape(3, -1)
        used = np.flatnonzero(n[part, entry])
        names = [x.split()[0] for x in SUMS.split(", ")]
        yield pa.RecordBatch.from_arrays([*[pa.array(x[used].astype(np.int32)) for x in (part, entry, at)], pa.array([int(x) for x in total.ravel()[used]], pa.decimal128(38, 0)), pa.array(n[part, entry][used])], names)

    def updated(self, state: DataFrame, wide: int) -> Books:
        """Every entry becomes its parts' mean, rounded down; unused ones stay."""
        shared = state.sparkSession.sparkContext.broadcast(self)
        sums = state.select("q", "code").mapInArrow(lambda batches: shared.value.sums(batches, wide), SUMS)
        new = [b.copy() for b in self.books]
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toLocalIterator():
            new[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
        return Books(new, self.books)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def assigned(state: DataFrame, books: Books, wide: int, name: str) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(books)
    return written(state.mapInArrow(lambda batches: shared.value.assign(batches, wide), STATE), name)


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """rows: vec_id, label, q. The last state, and the codebooks it is of."""
    small_batches(rows.sparkSession)
    wide = -(-width(rows) // PARTS) * PARTS
    start = rows.orderBy(F.asc_nulls_last("vec_id"), F.asc_nulls_last("label"), "q").limit(ENTRIES).select("q").toArrow()
    start = matrix(start.column("q").combine_chunks(), wide)
    books = Books([np.ascontiguousarray(x) for x in np.split(start, PARTS, 1)])
    none = [F.lit(None).cast(f"array<{k}>").alias(c) for c, k in (("code", "smallint"), ("upper", "float"), ("lower", "float"))]
    state = assigned(rows.select("vec_id", "label", "q", *none, F.lit(0).alias("scans")), books, wide, "state")
    for _ in range(rounds):
        books = books.updated(state, wide)
        state = assigned(state, books, wide, "state")
    return state, books


def encoded(state: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code (hexadecimal digits), error, scans (parts that were compared with all entries, of all rounds)."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            wide = sum(x.shape[1] for x in shared.value.books)
            q, code, w = matrix(b.column("q"), wide), b.column("code").flatten().to_numpy().reshape(-1, PARTS), wide // PARTS
            error = sum((own_square(q[:, p * w : (p + 1) * w], shared.value.books[p][code[:, p]]) for p in range(PARTS)), np.zeros(len(q), np.int64))
            digits = pa.array([x.tobytes().hex() for x in code.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), digits, pa.array(long(error)), b.column("scans")], ["vec_id", "label", "code", "error", "scans"])

    return state.mapInArrow(run, "vec_id long, label long, code string, error long, scans int")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(whole(read(spark, sf_dir, "embeddings")), "vectors")
    if rows.isEmpty():
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    state, books = fit(rows)
    out = written(encoded(state, books), "codes").withColumn("own", F.coalesce(F.col("label").cast("string"), F.lit("none")))
    summed = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by_label = out.groupBy("own").agg(summed.alias("label_error"), F.count(F.lit(1)).alias("n"))
    return lookup(out, by_label, "own", out.count()).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Every round as a table of its own."""
    q = """WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, q[part * len(q) // 16 + 1 : (part + 1) * len(q) // 16] AS x FROM v, range(16) r(part)),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 64)"""
    for k in range(ROUNDS + 1):
        q += f""",
a{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.x) AS x, min(struct_pack(d := list_inner_product(c, c) - 2 * list_inner_product(p.x, c) + list_inner_product(p.x, p.x), e := e)) AS best
  FROM p JOIN c{k} USING (part) GROUP BY p.vec_id, p.part)"""
        if k < ROUNDS:
            q += f""",
u{k} AS MATERIALIZED (
  SELECT part, e, list(m ORDER BY i) AS m FROM (
    SELECT part, best.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM a{k}, range(1, 1000) r(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY part, e),
c{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(u.m, c.c) AS c FROM c{k} c LEFT JOIN u{k} u USING (part, e))"""
    return f"""{q},
t AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN t USING (vec_id), h"""


ORACLE = _sql()
