"""Raw alarm sources (S1), batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import RAW_ALARMS


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed bodies with receipt time and sender: Parquet, ORC, JSON lines or CSV."""
    return spark.read.schema(RAW_ALARMS).format(fmt).load(path)


def stream_raw(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """The same landing folder as a stream of new files."""
    reader = spark.readStream.schema(RAW_ALARMS).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
