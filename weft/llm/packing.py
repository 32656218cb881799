"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut at every LENGTH ids as they are made, so a piece is either a whole sequence or the document's
end. The ends are dealt into random groups of about GROUP pieces, which are packed independently: the largest first, each
into the first bin with room, found by descending a tree whose nodes hold the largest capacity below.

Defined results: a null or empty text is the end id alone. Rows that repeat are packed each. Equal lengths go by doc_id
(null first), then start. A special token's string in a text becomes that token's id, as the library does by itself, unless
special_as_text. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, texts, written
from .tokens import encoder, path_of

LENGTH, END_ID, GROUP = 4096, 2, 4096
#: Pieces that bring their ids along: at most 16 MB a group.
GROUP_WITH_IDS = 1024


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, for sizes in descending order."""
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree, out = [capacity] * (2 * leaves), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        out[k] = at - leaves
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return out


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, row (a number of its own); with_ids: and the ids."""
    small_batches(docs.sparkSession)

    def run(batches):
        e, row = encoder(path, True, special_as_text), TaskContext.get().partitionId() << 40
        for b in batches:
            ids, many = e.encode(b.column("text"))
            ids, many = np.insert(ids, np.cumsum(many), end_id).astype("<u4"), many + 1
            if not len(many):
                continue
            n = -(-many // length)  # pieces of each document
            of, nth = np.repeat(np.arange(len(many)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = nth * length
            size, begin = np.minimum(many[of] - start, length), (np.cumsum(many) - many)[of] + start
            data = [memoryview(ids[i : i + k]).cast("B") for i, k in zip(begin.tolist(), size.tolist())]
            columns = [b.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(many[of]), pa.array(row + np.arange(len(of)))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"]
            row += len(of)
            if with_ids:
                names, columns = [*names, "ids"], [*columns, pa.array([bytes(x) for x in data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: where it comes from and its place in a sequence; with_ids: and its ids, little-endian unsigned 32-bit."""
    cut = written(pieces(docs, path, length, end_id, with_ids), "pieces")
    n = cut.count()
    tasks, groups = max(1, -(-n // GROUP)), max(1, -(-n // (GROUP_WITH_IDS if with_ids else GROUP)))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True], na_position="first", ignore_index=True)
        pdf["bin"] = first_fit_decreasing(pdf["length"].to_numpy(), length)
        pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = pdf["group"] * (1 << 32) + pdf["bin"]
        return pdf[columns]

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt.repartition(tasks, "group").groupBy("group").applyInPandas(run, kind)


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """packed: with ids. sequence_id, ids (padded to length unless they are a power of two many)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(pdf.sort_values("offset")["ids"]), "<u4").astype(np.int32)
        short = 0 if len(ids) & (len(ids) - 1) == 0 else length - len(ids)
        return pd.DataFrame({"sequence_id": pdf["sequence_id"][:1], "ids": [np.pad(ids, (0, short), constant_values=pad)]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<int>")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), path_of("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces, with their ids, from which `sequences` makes rows to train on."""
    return pack(docs, path_of("word_bpe_49k.json"), with_ids=True)
