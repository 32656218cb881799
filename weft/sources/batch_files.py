"""Padded batches as tensors in files, with an index by which any batch is read alone.

A row has a whole batch: for each column the ids as little-endian integers of 32 bits, row after row, and the width. Files are sorted by
batch_id, each with a range of its own; the index says which file has a batch, so a reader opens that file alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Bytes of a group of rows that a reader has to take whole.
GROUP_BYTES = 1 << 20


def write_batches(batches: DataFrame, path: str, key: str, *columns: str) -> None:
    """batches: batch_id, pos_in_batch, key, and columns of ids padded by batch. Batches without rows don't exist."""
    spark = batches.sparkSession
    ship(spark)
    kind = f"batch_id long, keys array<long>, {', '.join(f'{c} binary, {c}_width int' for c in columns)}"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos_in_batch")
        out = {"batch_id": table.column("batch_id").slice(0, 1).to_pylist(), "keys": [table.column(key).to_pylist()]}
        for c in columns:
            ids = table.column(c).combine_chunks()
            out |= {c: [ids.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()], f"{c}_width": [len(ids[0])]}
        return pa.table(out, schema=schema)

    fields = [("batch_id", pa.int64()), ("keys", pa.list_(pa.int64()))]
    for c in columns:
        fields += [(c, pa.binary()), (f"{c}_width", pa.int32())]
    schema = pa.schema(fields)
    packed = batches.select("batch_id", "pos_in_batch", F.col(key).cast("long").alias(key), *columns).groupBy("batch_id").applyInArrow(pack, kind)
    packed.repartitionByRange("batch_id").sortWithinPartitions("batch_id").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/tensors")
    found = spark.read.parquet(f"{path}/tensors").select("batch_id", F.size("keys").alias("n"), *[f"{c}_width" for c in columns], F.input_file_name().alias("file"))
    found.write.parquet(f"{path}/index")


def read_batch(spark: SparkSession, path: str, batch_id: int) -> dict[str, np.ndarray] | None:
    """keys, and each column as a matrix; None if there is no such batch."""
    at = spark.read.parquet(f"{path}/index").where(F.col("batch_id") == batch_id).head()
    if at is None:
        return None
    row = spark.read.parquet(at["file"]).where(F.col("batch_id") == batch_id).head().asDict()
    columns = [c.removesuffix("_width") for c in row if c.endswith("_width")]
    return {"keys": np.array(row["keys"])} | {c: np.frombuffer(row[c], "<i4").reshape(-1, row[f"{c}_width"]) for c in columns}


def read_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All batches as rows again: batch_id, pos_in_batch, key, and the columns of ids."""
    packed = spark.read.parquet(f"{path}/tensors")
    columns = [c.removesuffix("_width") for c in packed.columns if c.endswith("_width")]
    ship(spark)

    def unpack(batches):
        for b in batches:
            for row in b.to_pylist():
                n = len(row["keys"])
                out = [pa.array([row["batch_id"]] * n, pa.int64()), pa.array(np.arange(n)), pa.array(row["keys"], pa.int64())]
                for c in columns:
                    w = row[f"{c}_width"]
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(np.frombuffer(row[c], "<i4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["batch_id", "pos_in_batch", key, *columns])

    return packed.mapInArrow(unpack, f"batch_id long, pos_in_batch long, `{key}` long, {', '.join(f'{c} array<int>' for c in columns)}")
