"""Connected components of links, by large-star and small-star steps; every step is a few shuffles of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written


def _mins(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "mins")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of longs as (u, root), for every u that isn't its component's smallest."""
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        far = lookup(both.where("v > u"), _mins(both), "u", 2 * now[0])
        edges = written(far.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        mins = _mins(edges)
        near = lookup(edges, mins, "u", now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(near.unionByName(mins.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edges.withColumnRenamed("v", "root")
