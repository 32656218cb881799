"""Tokenizers and weights as files."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import Model

#: The keys of a tokenizer's file.
SCHEMA = "word_break string, ukn_token string, rules array<array<string>>, tokens array<string>"


def save_json(spark: SparkSession, model: Model, path: str) -> None:
    """One JSON object of four keys, in a file or in a folder's one part by Spark's writer (path ends in /)."""
    data = {"word_break": model.word_end, "ukn_token": model.unknown, "rules": [list(r) for r in model.rules], "tokens": model.tokens}
    if path.endswith("/"):
        row = spark.createDataFrame([(json.dumps(data, ensure_ascii=False),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(path)
        return
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)


def load_json(spark: SparkSession, path: str) -> Model:
    """All four keys must be there."""
    row = spark.read.schema(SCHEMA).json(path, multiLine=True).head()
    if row is None or any(row[k] is None for k in ("word_break", "ukn_token", "rules", "tokens")):
        raise ValueError(f"{path}: a tokenizer has word_break, ukn_token, rules and tokens")
    return Model([tuple(r) for r in row["rules"]], row["tokens"], row["word_break"], row["ukn_token"])


def load_json_legacy(spark: SparkSession, path: str, unknown: str = "<ukn>") -> Model:
    """Rules and tokens must not be empty; the file's unknown token wins unless empty; its word end is ignored."""
    row = spark.read.schema(SCHEMA).json(path, multiLine=True).head()
    if row is None or not row["rules"] or not row["tokens"]:
        raise ValueError(f"{path}: rules and tokens must not be empty")
    return Model([tuple(r) for r in row["rules"]], row["tokens"], unknown=row["ukn_token"] or unknown)


def rules_table(spark: SparkSession, model: Model) -> DataFrame:
    """rank, l, r. Of rules given twice the later rank holds."""
    rows = [(k, a, b) for k, (a, b) in enumerate(model.rules)]
    return spark.createDataFrame(rows, "rank int, l string, r string").groupBy("l", "r").agg(F.max("rank").alias("rank")).select("rank", "l", "r")


def save_tables(spark: SparkSession, model: Model, folder: str) -> None:
    """Rules and tokens as two Parquet tables."""
    rows = [(k, a, b) for k, (a, b) in enumerate(model.rules)]
    spark.createDataFrame(rows, "rank int, l string, r string").write.mode("overwrite").parquet(f"{folder}/rules")
    spark.createDataFrame([(t,) for t in model.tokens], "token string").write.mode("overwrite").parquet(f"{folder}/tokens")


def load_tables(spark: SparkSession, folder: str) -> Model:
    rules = sorted((x["rank"], x["l"], x["r"]) for x in spark.read.parquet(f"{folder}/rules").collect())
    return Model([(a, b) for _, a, b in rules], [x["token"] for x in spark.read.parquet(f"{folder}/tokens").collect()])


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """A row for each parameter: its name, shape and numbers."""
    rows = [(k, [int(n) for n in v.shape], np.asarray(v, np.float32).ravel().tolist()) for k, v in sorted(weights.items())]
    spark.createDataFrame(rows, "param string, shape array<int>, data array<float>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {x["param"]: np.array(x["data"], np.float32).reshape(x["shape"]) for x in spark.read.parquet(path).collect()}
