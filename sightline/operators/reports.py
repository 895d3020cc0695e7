"""Daily person reports (A21, J6, W4) and reads of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts, times


def reports_from_sessions(sessions: DataFrame, generated_at_ms: int) -> DataFrame:
    """One row per (day, person), built from the sessions alone.

    The first sighting of a day is the start of its first session and the last one the end of
    its last, so sightings are not read again. When the sessions come straight from the
    sessioniser they are already partitioned and sorted by (day, person): no further shuffle.
    """
    first = F.min_by(
        F.struct("person_name", "started_at_ms", "first_event_id", "first_camera_id"),
        F.struct("started_at_ms", "first_event_id"),
    )
    last = F.max_by(
        F.struct("ended_at_ms", "last_event_id", "last_camera_id"),
        F.struct("ended_at_ms", "started_at_ms", "last_event_id"),
    )
    days = sessions.groupBy("local_date", "person_key").agg(
        first.alias("f"),
        last.alias("l"),
        F.sum("sighting_count").alias("seen_count"),
        F.sum(times.span_ms("started_at_ms", "ended_at_ms")).alias("observed_ms"),
        F.count("*").alias("session_count"),
    )
    raw_ms = F.col("l.ended_at_ms") - F.col("f.started_at_ms")
    rounded = times.ceil_quarter_minutes(raw_ms)
    observed = times.ceil_quarter_minutes("observed_ms")
    return days.select(
        "local_date",
        "person_key",
        F.col("f.person_name").alias("person_name"),
        F.col("f.started_at_ms").alias("first_seen_ms"),
        F.col("l.ended_at_ms").alias("last_seen_ms"),
        times.seconds(raw_ms).alias("raw_span_seconds"),
        rounded.alias("rounded_span_minutes"),
        times.quarter_hours(rounded).alias("rounded_span_hours"),
        F.col("f.first_event_id").alias("first_event_id"),
        F.col("l.last_event_id").alias("last_event_id"),
        F.col("f.first_camera_id").alias("first_camera_id"),
        F.col("l.last_camera_id").alias("last_camera_id"),
        "seen_count",
        F.lit(generated_at_ms).cast("long").alias("generated_at_ms"),
        times.seconds(F.col("observed_ms")).alias("observed_span_seconds"),
        observed.alias("observed_rounded_minutes"),
        times.quarter_hours(observed).alias("observed_rounded_hours"),
        "session_count",
    )


def _for_person(df: DataFrame, person_name: str | None) -> DataFrame:
    return df.filter(texts.same_text("person_name", person_name)) if person_name else df


def reports_for_month(reports: DataFrame, month: str, person_name: str | None = None) -> DataFrame:
    """Reports of a month in date and name order."""
    found = reports.filter(F.col("local_date").startswith(month))
    return _for_person(found, person_name).orderBy("local_date", "person_name", "person_key")


def sessions_for_date(sessions: DataFrame, date: str, person_name: str | None = None) -> DataFrame:
    """Sessions of a day by start time."""
    found = sessions.filter(F.col("local_date") == date)
    return _for_person(found, person_name).orderBy("started_at_ms", "person_key")
