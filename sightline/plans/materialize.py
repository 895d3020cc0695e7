"""Derived tables by day, renewed only where their source changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import reports_for_month, reports_from_sessions
from ..operators.sessions import presence_sessions
from ..params import JobParams
from ..sources.tables import Tables
from . import facts

MATERIALIZER_VERSION = 2


def source_facts(faces: DataFrame) -> DataFrame:
    """A5 for every day: number of sightings and the newest one."""
    return faces.groupBy("local_date").agg(
        F.count("*").alias("source_event_count"),
        F.coalesce(F.max("seen_at_ms"), F.lit(0)).alias("max_seen_at_ms"),
    )


def date_facts(faces: DataFrame, date: str) -> DataFrame:
    """A5: the same for one day; a day without sightings still gives a row of zeros."""
    return faces.filter(F.col("local_date") == date).agg(
        F.count("*").alias("count"),
        F.coalesce(F.max("seen_at_ms"), F.lit(0).cast("long")).alias("max_seen_at_ms"),
    )


def freshness(
    wanted: DataFrame, faces: DataFrame | None, state: DataFrame, counted: DataFrame | None = None
) -> DataFrame:
    """Facts of the wanted days (`local_date`) and whether the stored state matches them.

    With `counted`, kept facts of the days, no sighting is read. All three sides have one row per day, so the joins are tiny whatever the number of rows.
    """
    counted = source_facts(faces) if counted is None else counted
    stored = state.select(
        "local_date",
        F.col("source_event_count").alias("_count"),
        F.col("max_seen_at_ms").alias("_max"),
        F.col("materializer_version").alias("_version"),
    )
    zero = F.lit(0).cast("long")
    return (
        wanted.select("local_date")
        .distinct()
        .join(counted, "local_date", "left")
        .join(stored, "local_date", "left")
        .select(
            "local_date",
            F.coalesce("source_event_count", zero).alias("source_event_count"),
            F.coalesce("max_seen_at_ms", zero).alias("max_seen_at_ms"),
            "_count",
            "_max",
            "_version",
        )
        .select(
            "local_date",
            "source_event_count",
            "max_seen_at_ms",
            F.coalesce(
                (F.col("_version") == MATERIALIZER_VERSION)
                & (F.col("_count") == F.col("source_event_count"))
                & (F.col("_max") == F.col("max_seen_at_ms")),
                F.lit(False),
            ).alias("is_fresh"),
        )
    )


def state_rows(source: DataFrame, generated_at_ms: int) -> DataFrame:
    """The state to store for materialised days."""
    return source.select(
        "local_date",
        "source_event_count",
        "max_seen_at_ms",
        F.lit(MATERIALIZER_VERSION).cast("long").alias("materializer_version"),
        F.lit(generated_at_ms).cast("long").alias("generated_at_ms"),
    )


def state_of(state: DataFrame, date: str) -> DataFrame:
    """Stored state of one day."""
    return state.filter(F.col("local_date") == date)


def _renew(tables: Tables, params: JobParams, due: list, now_ms: int) -> None:
    """One job over all due days. Derived rows first, state last: a run that dies in between
    leaves the state stale and is simply repeated."""
    days = [r.local_date for r in due]
    emptied = [r.local_date for r in due if r.source_event_count == 0]
    faces = tables.only_days("face_events", days)
    sessions = presence_sessions(faces, params.gaps, now_ms)
    tables.replace_days(sessions, "presence_sessions")
    tables.clear_days("presence_sessions", emptied)
    # Reports come from the sessions just written, so sightings are read once.
    written = tables.only_days("presence_sessions", days)
    tables.replace_days(reports_from_sessions(written, now_ms), "daily_person_reports")
    tables.clear_days("daily_person_reports", emptied)
    if facts.kept(tables) is not None:
        facts.recount(tables, "presence_sessions", days)
        facts.recount(tables, "daily_person_reports", days)
    spark = tables.spark
    source = spark.createDataFrame(
        due, "local_date string, source_event_count long, max_seen_at_ms long, is_fresh boolean"
    )
    tables.replace_days(state_rows(source, now_ms), "materialization_state")


def materialize(
    tables: Tables,
    params: JobParams,
    dates: DataFrame,
    now_ms: int,
    force: bool = False,
) -> dict[str, int]:
    """D12 over any number of days: renew the stale ones (all of them with `force`).

    The list of days is collected: one short row per calendar day, to prune partitions with.
    """
    wanted = [r.local_date for r in dates.select("local_date").distinct().collect()]
    if not wanted:
        return {"checked": 0, "regenerated": 0}
    listed = tables.spark.createDataFrame([(d,) for d in wanted], "local_date string")
    kept = facts.kept(tables)
    checked = freshness(
        listed,
        tables.only_days("face_events", wanted),
        tables.only_days("materialization_state", wanted),
        None if kept is None else facts.source_facts(kept),
    ).collect()
    due = [r for r in checked if force or not r.is_fresh]
    if due:
        _renew(tables, params, due, now_ms)
    return {"checked": len(checked), "regenerated": len(due)}


def materialize_date(
    tables: Tables, params: JobParams, date: str, now_ms: int, force: bool = False
) -> bool:
    """One day; true if it was renewed."""
    dates = tables.spark.createDataFrame([(date,)], "local_date string")
    return materialize(tables, params, dates, now_ms, force)["regenerated"] > 0


def read_month(
    tables: Tables, params: JobParams, month: str, now_ms: int, person_name: str | None = None
) -> DataFrame:
    """C5 as it is asked for: stale days of the month are renewed first, then its reports read."""
    materialize_month(tables, params, month, now_ms)
    return reports_for_month(tables.read("daily_person_reports"), month, person_name)


def materialize_month(tables: Tables, params: JobParams, month: str, now_ms: int) -> dict[str, int]:
    """The days of a month that have sightings, in one job."""
    kept = facts.kept(tables)
    days = tables.read("face_events") if kept is None else facts.source_facts(kept)
    return materialize(tables, params, days.filter(F.col("local_date").startswith(month)), now_ms)
