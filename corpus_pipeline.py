"""A corpus pipeline of five training-data operators over the table documents.

Each stage gets what the one before kept, as a Parquet table, and all but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, exact_dedup, near_copies, packing, quality
from weft.llm.common import read, written

STAGES = [
    ("quality classifier", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("SimHash near-dedup", near_copies.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the classifier nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
