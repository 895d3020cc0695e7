"""The stored tables: Parquet folders, laid out by day.

Nothing but `spark.read` and `df.write`. Day partitions make the three writes of the jobs
safe to repeat: append, replace whole days, clear whole days.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLUSTERING, PARTITIONS, TABLES


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._staged: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        """The table, empty if it was never written."""
        schema = TABLES[table]
        try:
            return self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def all(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in TABLES}

    def _laid_out(self, df: DataFrame, table: str) -> DataFrame:
        """Columns of the table, one or few sorted files per day.

        REBALANCE is done by AQE: it merges small pieces and splits a day that is too big,
        where a plain repartition by day would put a hot day into one task.
        """
        names = [f.name for f in TABLES[table].fields]
        by = PARTITIONS.get(table, [])
        df = df.select(*names)
        if by:
            df = df.hint("rebalance", *by)
        order = [*by, *CLUSTERING.get(table, [])]
        return df.sortWithinPartitions(*order) if order else df

    def append(self, df: DataFrame, table: str) -> None:
        self._writer(df, table).mode("append").parquet(self.path(table))

    def replace_days(self, df: DataFrame, table: str) -> None:
        """Overwrite exactly the partitions that occur in `df`."""
        writer = self._writer(df, table).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path(table))

    def _writer(self, df: DataFrame, table: str):
        return self._laid_out(df, table).write.partitionBy(*PARTITIONS.get(table, []))

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def clear_days(self, table: str, days: Iterable[str]) -> None:
        """Drop whole days: a dynamic overwrite leaves days alone that have no new rows.

        One file-system call per calendar day, no Spark job; repeating it is harmless.
        """
        self.clear(table, [f"local_date={day}" for day in days])

    def clear(self, table: str, folders: Iterable[str]) -> None:
        """Drop whole partitions by the names of their folders."""
        for folder in folders:
            self._delete(f"{self.path(table)}/{folder}")

    @contextmanager
    def staging(self) -> Iterator[None]:
        """Drop the copies made by `staged` inside this block once it is left."""
        outer, self._staged = self._staged, []
        try:
            yield
        finally:
            for path in self._staged:
                self._delete(path)
            self._staged = outer

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame to the shared folder and read it back: cuts the lineage in a way that
        survives lost executors, and lets a table be overwritten from its own content."""
        base = self.spark.conf.get("spark.checkpoint.dir", None) or f"{self.root}/_staging"
        path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._staged.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only_days(self, table: str, days: list[str]) -> DataFrame:
        """Pruned read of some days."""
        return self.only_where(table, F.col("local_date").isin(days))

    def only_where(self, table: str, wanted: Column) -> DataFrame:
        """Pruned read by a test on partition columns."""
        return self.read(table).filter(wanted)
