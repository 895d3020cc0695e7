"""Results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, out: str = "body") -> DataFrame:
    """One JSON object per row, as text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
