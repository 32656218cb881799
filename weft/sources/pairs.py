"""Reading and writing parallel corpora. Rows get an explicit pair_id, since tables have no order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that a CSV reader of the customary kind takes for null. Matching is exact.
NULL_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quotes may be doubled and fields may hold line feeds."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def with_nulls(table: DataFrame, markers: list[str] = NULL_MARKERS) -> DataFrame:
    return table.select(*[F.when(~F.col(f"`{c}`").isin(markers), F.col(f"`{c}`")).alias(c) for c in table.columns])


def pair_csv(spark: SparkSession, path: str, src: str = "en", tgt: str = "fr") -> DataFrame:
    """src, tgt of the rows without a null in any column."""
    full = with_nulls(raw_csv(spark, path)).na.drop("any")
    return full.select(F.col(f"`{src}`").cast("string").alias("src"), F.col(f"`{tgt}`").cast("string").alias("tgt"))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def line_limit(n: int, limit: int | float) -> int:
    """How many of n lines: a number of them, or a share in (0, 1], rounded down."""
    if isinstance(limit, bool) or not isinstance(limit, (int, float)):
        raise ValueError("the limit is a whole number or a share")
    if isinstance(limit, float):
        if not 0 < limit <= 1:
            raise ValueError("a share is above 0 and at most 1")
        return int(n * limit)
    if limit < 0:
        raise ValueError("a number of lines is 0 or more")
    return limit


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no from 0, value: a file's lines in order, without blank ones at either end.

    Places are numbered by partition first, so no task sorts all lines: line_no is the partition's offset and the place in it.
    """
    lines = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).alias("part")
    sizes = lines.groupBy(part).agg(F.count(F.lit(1)).alias("size"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = F.broadcast(sizes.select(F.col("part").alias("__part"), F.coalesce(F.sum("size").over(order), F.lit(0)).alias("__offset")))
    at = lines.join(offsets, F.shiftright("__at", 33) == F.col("__part")).select((F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("line_no"), "value")
    full = at.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b")).head()
    if full["a"] is None:
        return at.where(F.lit(False))
    return at.where(F.col("line_no").between(full["a"], full["b"])).withColumn("line_no", F.col("line_no") - full["a"])


def pair_tsv(spark: SparkSession, path: str, limit: int | float = 10_000) -> DataFrame:
    """pair_id (the line's number), src, tgt: of the first lines, those with two fields or more. Bad lines count to the limit."""
    lines = numbered_lines(spark, path)
    n = line_limit(lines.count() if isinstance(limit, float) else 0, limit)
    fields = lines.where(F.col("line_no") < n).select("line_no", F.split("value", "\t").alias("f"))
    return fields.where(F.size("f") >= 2).select(F.col("line_no").alias("pair_id"), F.col("f")[0].alias("src"), F.col("f")[1].alias("tgt"))


def pairs_from_turns(conversations: DataFrame) -> DataFrame:
    """pair_id, src, tgt: each user turn with the assistant turn right after it."""
    a, b = conversations.alias("a"), conversations.alias("b")
    met = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    met = met.where((F.col("a.role") == "user") & (F.col("b.role") == "assistant"))
    met = met.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("a.text").alias("src"), F.col("b.text").alias("tgt"))
    return with_ordinals(met, "pair_id", "conv_id", "turn").select("pair_id", "src", "tgt")


def with_ordinals(table: DataFrame, name: str, *order: str) -> DataFrame:
    """Numbers from 1 in the given order, which must be total: sorted by ranges, numbered in each as they are written, and shifted by
    what comes before. One shuffle."""
    from ..store import written

    spread = table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    spread, part = written(spread, "ranges"), F.shiftright("__at", 33)
    sizes = spread.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = F.broadcast(sizes.select(F.col("part").alias("__part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__offset")))
    nth = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(1)
    return spread.join(offsets, part == F.col("__part")).withColumn(name, nth + F.col("__offset")).drop("__at", "__part", "__offset")
