"""Daily operational counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The counter fields.
COUNTER_FIELDS = [
    "rejected_auth",
    "rejected_json",
    "rejected_body",
    "ingested_webhooks",
    "events_attempted",
    "events_inserted",
    "duplicates",
    "vehicles_attempted",
    "vehicles_inserted",
    "vehicle_duplicates",
    "zero_face_webhooks",
    "d1_failures",
]


def add_counters(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Add increments to the stored values, by day and field."""
    columns = ["local_date", "field", "value"]
    return (
        stored.select(*columns)
        .unionByName(added.select(*columns))
        .groupBy("local_date", "field")
        .agg(F.sum("value").alias("value"))
    )


def daily_counters(counters: DataFrame, date: str | None = None) -> DataFrame:
    """One row per day with all twelve fields; missing ones are 0, unknown ones ignored."""
    if date:
        counters = counters.filter(F.col("local_date") == date)
    sums = [
        F.coalesce(F.sum(F.when(F.col("field") == f, F.col("value"))), F.lit(0))
        .cast("long")
        .alias(f)
        for f in COUNTER_FIELDS
    ]
    return counters.groupBy("local_date").agg(*sums)


def decode_counters(df: DataFrame, column: str) -> DataFrame:
    """Counters kept as JSON text; bad or partial text gives zeros for what is missing."""
    schema = T.StructType([T.StructField(f, T.LongType()) for f in COUNTER_FIELDS])
    parsed = df.withColumn("_c", F.from_json(column, schema))
    values = [F.coalesce(f"_c.{f}", F.lit(0).cast("long")).alias(f) for f in COUNTER_FIELDS]
    return parsed.select(*df.columns, *values)
