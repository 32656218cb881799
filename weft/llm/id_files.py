"""Token-id output: Simple-8b files of all documents' ids in ascending doc_id order, and reading them back.

Documents are encoded where they are, and their ids are dealt by ranges of doc_id, so the files in the order of their names hold
ascending ids. A task writes as it goes. A file appears under its name only when whole, so a lost task is simply done again.

Defined results: a null or empty text is the end id alone. A null doc_id comes first. Rows that repeat a doc_id are
written each, in the order of a hash of their texts (so that many such rows spread over files). A special token's string in a
text becomes that token's id, as the library does by itself, unless special_as_text. An empty table gives no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, scratch, small_batches, texts, written
from .simple8b import Reader, Writer
from .tokens import encoder, path_of

END_ID = 0
#: A file ends with the batch that brings it to so many ids or documents; a reader decodes about so many ids, or returns so many rows, at a time.
FILE_IDS, FILE_DOCS, READ_IDS, READ_DOCS = 1 << 26, 1 << 22, 1 << 20, 1 << 16


#: Ranges of documents for each partition of a shuffle: ranges are dealt by hash, so more of them spread more evenly.
RANGES = 8
ROW = "doc_id long, hash long, row long"


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), row (where it was read), text. The first three are the order of the files; so no key holds many rows."""
    return texts(docs).select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")


def ranges(rows: DataFrame) -> list[tuple]:
    """The first place (whether there is an id, doc_id, hash, row) of each range of documents, of which there are a few for each partition."""
    many = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("hash").alias("c"), F.col("row").alias("d"))
    spread = rows.select(place.alias("place")).repartitionByRange(many, "place")
    return sorted(tuple(r["m"]) for r in spread.groupBy(F.spark_partition_id()).agg(F.min("place").alias("m")).collect())


def encoded(rows: DataFrame, bounds: list[tuple], path: str, end_id: int, special_as_text: bool) -> DataFrame:
    """range, doc_id, hash, row, n, ids (with the end id, as bytes: two an id if all are small enough, else four). Texts stay where they are."""

    def run(batches):
        e = encoder(path, False, special_as_text)
        for b in batches:
            ids, many = e.encode(b.column("text"))
            ids, many = np.insert(ids, np.cumsum(many), end_id), many + 1
            ends = np.cumsum(many)
            large = np.logical_or.reduceat(ids >> 16 > 0, ends - many) if len(ends) else []
            packed = [ids[e - n : e].astype("<u4" if x else "<u2").tobytes() for e, n, x in zip(ends.tolist(), many.tolist(), large)]
            own = [b.column(c) for c in ("doc_id", "hash", "row")]
            place = [bisect_right(bounds, (i is not None, i or 0, h, r)) for i, h, r in zip(*(c.to_pylist() for c in own))]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *own, pa.array(many, pa.int64()), pa.array(packed, pa.binary())], ["range", "doc_id", "hash", "row", "n", "ids"])

    return rows.mapInArrow(run, f"range int, {ROW}, n long, ids binary")


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """Write the files. Per file: part (the range) and nth (in order), file, n_docs, n_ids."""
    spark = docs.sparkSession
    small_batches(spark)
    where, inside = fs.FileSystem.from_uri(folder)
    where.create_dir(inside)

    def run(batches):
        store, inside = fs.FileSystem.from_uri(folder)
        task, part, nth, out, made = TaskContext.get(), None, 0, None, []

        def close():
            out.close()
            store.move(hidden, f"{inside}/{name}")
            made.append((part, nth, f"{folder}/{name}", out.docs, out.ids))

        for whole in batches:
            own = whole.column("range").to_numpy()
            for begin, end in zip(cuts := [0, *(np.flatnonzero(np.diff(own)) + 1).tolist()], [*cuts[1:], len(own)]):
                if begin == end:
                    continue
                b = whole.slice(begin, end - begin)
                if own[begin] != part:
                    if out is not None:
                        close()
                    part, nth, out = int(own[begin]), 0, None
                many, doc_ids = b.column("n").to_numpy(), b.column("doc_id")
                ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.uint32) for x, n in zip(b.column("ids").to_pylist(), many.tolist())]
                if out is None:
                    name = f"ids-{part:06d}-{nth:04d}.s8b"
                    hidden = f"{inside}/_{name}.{task.taskAttemptId()}"
                    out = Writer(store.open_output_stream(hidden))
                out.add(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), many, np.concatenate(ids))
                if out.ids + out.n_held >= FILE_IDS or out.docs >= FILE_DOCS:
                    close()
                    out, nth = None, nth + 1
        if out is not None:
            close()
        cols = list(zip(*made)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["part", "nth", "file", "n_docs", "n_ids"])

    # Ids are shuffled, not texts. Ranges are found first, by the columns of the order alone, so that no text is encoded twice.
    rows = rows_of(docs)
    dealt = encoded(rows, ranges(rows), path, end_id, special_as_text)
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "hash", "row")
    return written(dealt.select("range", "doc_id", "n", "ids").mapInArrow(run, "part long, nth long, file string, n_docs long, n_ids long"), "files")


def read_back(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                store, inside = fs.FileSystem.from_uri(x["file"])
                with store.open_input_file(inside) as f:
                    r = Reader(f)
                    ends, at = np.cumsum(r.many), 0
                    while at < len(ends):
                        begin = int(ends[at - 1]) if at else 0
                        # Documents of READ_IDS ids together, or one that has more.
                        to = min(max(at + 1, int(np.searchsorted(ends, begin + READ_IDS, "right"))), at + READ_DOCS)
                        many = r.many[at:to]
                        stops = ends[at:to] - begin
                        ids = r.ids(begin, int(ends[to - 1])).astype("<u4")
                        crc = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(many.tolist(), stops.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.doc_ids[at:to], mask=r.null[at:to]), pa.array(x["before"] + begin + stops - many), pa.array(many), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                        )
                        at = to

    # One row a file: numbers of files are small.
    order = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    before = files.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    return before.repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write(read(spark, sf_dir, "documents"), scratch(spark, "ids"), path_of("byte_bpe_50k.json")))
