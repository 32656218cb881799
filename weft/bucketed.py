"""A growing table, bucketed and sorted by a key, in a shared folder: what later runs read in place.

Rows are appended by attempts. An attempt counts once a row of `meta` names it, and that row is one file, which appears whole or not
at all; rows of attempts that were never named count for nothing. So a driver may be lost at any point, and what it did is done
again as if for the first time. Appending adds a file to each bucket; the table can be written anew, one file a bucket, in a
folder of its own, and is read from there once `meta` says so. One driver writes at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "seq int, folder string, buckets int, attempt string, batch string"
#: A scan of a bucketed table then says that it is sorted, where every bucket is one file.
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Bucketed:
    def __init__(self, spark: SparkSession, path: str, key: str, columns: str):
        """columns: names and types, the key's among them."""
        self.spark, self.path, self.key, self.columns = spark, path.rstrip("/"), key, f"{columns}, attempt STRING"
        self.names = [x.split()[0] for x in columns.split(", ")]

    def meta(self) -> list:
        """What was published, in order: a row for each attempt, and each time that the table was written anew."""
        try:
            return self.spark.read.schema(META).parquet(f"{self.path}/meta").orderBy("seq").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def publish(self, meta: list, folder: str, buckets: int, attempt: str, batch: str | None) -> None:
        row = (meta[-1]["seq"] + 1 if meta else 0, folder, buckets, attempt, batch)
        self.spark.createDataFrame([row], META).coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    @staticmethod
    def holding(meta: list) -> list[str]:
        """The attempts whose rows count: those published since the folder that holds was begun."""
        return [r["attempt"] for r in meta if r["folder"] == meta[-1]["folder"]]

    def held(self, rows: DataFrame, meta: list) -> DataFrame:
        return rows.where(F.col("attempt").isin(self.holding(meta) if meta else []))

    def rows(self) -> DataFrame:
        """All rows that count, by a plain scan, with the attempt that appended each."""
        meta = self.meta()
        if not meta:
            return self.spark.createDataFrame([], self.columns)
        return self.held(self.spark.read.schema(self.columns).parquet(f"{self.path}/{meta[-1]['folder']}"), meta)

    def files(self, meta: list) -> int:
        return len(self.spark.read.schema(self.columns).parquet(f"{self.path}/{meta[-1]['folder']}").inputFiles())

    @contextmanager
    def tables(self):
        """Gives a function that makes a bucketed table known to the catalog; afterwards it isn't, and its files stay."""
        before, names = self.spark.conf.get(SORTED, None), []

        def known(path: str, buckets: int, columns: str | None = None) -> str:
            names.append(f"weft_{uuid.uuid4().hex}")
            self.spark.sql(f"CREATE TABLE {names[-1]} ({columns or self.columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {buckets} BUCKETS LOCATION '{path}'")
            return names[-1]

        self.spark.conf.set(SORTED, "true")
        try:
            yield known
        finally:
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.spark.conf.unset(SORTED) if before is None else self.spark.conf.set(SORTED, before)

    def write(self, df: DataFrame, table: str, buckets: int) -> None:
        df.write.mode("append").format("parquet").bucketBy(buckets, self.key).sortBy(self.key).saveAsTable(table)

    def spread(self, buckets: int) -> None:
        """All rows that count, with their attempts, in so many buckets: in a folder of its own, which one file of `meta` makes the table."""
        meta, folder = self.meta(), f"table-{uuid.uuid4().hex}"
        with self.tables() as known:
            self.write(self.rows().repartition(buckets, self.key), known(f"{self.path}/{folder}", buckets), buckets)
        own = [r for r in meta if r["folder"] == meta[-1]["folder"]]
        rows = [(meta[-1]["seq"] + 1 + k, folder, buckets, r["attempt"], r["batch"]) for k, r in enumerate(own)]
        self.spark.createDataFrame(rows, META).coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def write_anew(self, merged: Callable[[DataFrame], DataFrame], buckets_for: Callable[[int], int]) -> None:
        """One file a bucket. merged: makes one row of each key's, grouping by it. The files of before stay until they are deleted by hand."""
        meta, attempt = self.meta(), uuid.uuid4().hex
        if not meta:
            return
        old, folder = meta[-1], f"table-{attempt}"
        with self.tables() as known:
            rows = self.held(self.spark.table(known(f"{self.path}/{old['folder']}", old["buckets"])), meta)
            buckets = max(old["buckets"], buckets_for(rows.count()))
            if buckets != old["buckets"]:
                rows = rows.repartition(buckets, self.key)
            # Grouping keeps a task to a bucket, without a shuffle if their number is as before.
            self.write(merged(rows).select(*self.names, F.lit(attempt).alias("attempt")), known(f"{self.path}/{folder}", buckets), buckets)
        self.publish(meta, folder, buckets, attempt, None)
