"""Tables that later steps read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder made for a local session that has none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """All that this session writes there."""
    return f"{shared_dir(spark)}/weft-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path there that no other call gets."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table there that is read no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this session wrote there. Tables that results still read are among it, so the caller says when."""
    discard(spark, own_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table there: its lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
