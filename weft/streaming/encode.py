"""Encoding of a stream of texts: rows are encoded as they come, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import Model, encode_column


def encode_stream(texts: DataFrame, model: Model, path: str, checkpoint: str) -> StreamingQuery:
    """texts: a streaming table with text. Appends rows with their tokens to Parquet files; each row once."""
    return encode_column(texts, model).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
