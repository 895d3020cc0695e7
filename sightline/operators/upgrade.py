"""Bringing tables of an older layout to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TABLES


def upgrade_table(old: DataFrame, table: str) -> DataFrame:
    """Add the nullable columns an old table lacks and backfill the two special ones."""
    schema = TABLES[table]
    missing = {
        f.name: F.lit(None).cast(f.dataType)
        for f in schema.fields
        if f.nullable and f.name not in old.columns
    }
    df = old.withColumns(missing) if missing else old
    if table == "webhook_notifications":
        df = df.withColumn("delivery_key", F.coalesce("delivery_key", "id"))
    if table == "presence_sessions":
        fixed = F.when(F.col("is_open").isin(0, 1), F.col("is_open")).otherwise(0)
        df = df.withColumn("is_open", fixed.cast("int"))
    return df.select(*[f.name for f in schema.fields if f.name in df.columns])
