"""Helpers the operators share: table access, shared folders, row ids, tokens."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in every operator.
SPACE = b" \t\n\x0b\x0c\r"
_OWN_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder. Python workers get this package's place on their path; on a cluster ship it with --py-files."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, as in tests, a folder of this process; a cluster must set it."""
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "own" not in _OWN_FOLDERS:
        holder = tempfile.TemporaryDirectory(prefix="sightline-llm-")
        atexit.register(holder.cleanup)
        _OWN_FOLDERS["own"] = Path(holder.name).as_uri()
    return _OWN_FOLDERS["own"]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this package made with new_folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def crc32_of(column: str) -> Column:
    """crc32 of a column's text; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc32_value(value: object) -> int:
    return zlib.crc32(str(value).encode())


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A row id from partition and place in it. It repeats when a task is run again as long as `df` is read from files."""
    return df.withColumn(name, F.monotonically_increasing_id())


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
