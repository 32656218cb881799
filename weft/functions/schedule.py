"""Scalars of a training run: schedule, early stopping, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def teacher_forcing(epoch: Column, start: float, end: float, begins: int, done: int) -> Column:
    """start up to epoch begins, end from epoch done, a line between."""
    line = F.lit(start) - (start - end) * (epoch - begins) / max(1, done - begins)
    return F.when(epoch <= begins, F.lit(float(start))).when(epoch >= done, F.lit(float(end))).otherwise(line)


def minutes(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds - 60 * F.floor(seconds / 60)).cast("string"), F.lit("s"))


def early_stopping(losses: DataFrame, min_delta: float, patience: int, start: int) -> DataFrame:
    """losses: run, epoch (from 0), loss. Per run: stop_epoch (null: it ran to its end), best_epoch, best_loss, kept_epoch.

    An epoch improves if its loss is below the best less min_delta. Before epoch start the counter stays 0. After patience
    epochs without improvement the run stops and the best weights are kept; without a stop, the last are.
    """
    state = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(None).cast("int").alias("best_epoch"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"), F.lit(None).cast("int").alias("last"),
    )

    def step(s: Column, x: Column) -> Column:
        better = x["loss"] < s["best"] - min_delta
        bad = F.when(better | (x["epoch"] < start), F.lit(0)).otherwise(s["bad"] + 1)
        on = F.struct(
            F.when(better, x["loss"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"), bad.alias("bad"),
            F.when(bad >= patience, x["epoch"]).alias("stop"), x["epoch"].alias("last"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(on)

    rows = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("loss").cast("double").alias("loss"))))
    s = losses.groupBy("run").agg(F.aggregate(rows, state, step).alias("s"))
    return s.select("run", F.col("s.stop").alias("stop_epoch"), F.col("s.best_epoch").alias("best_epoch"), F.col("s.best").alias("best_loss"), F.when(F.col("s.stop").isNotNull(), F.col("s.best_epoch")).otherwise(F.col("s.last")).alias("kept_epoch"))
