"""Kept day facts: rows and newest time per table and day.

Freshness and health ask for little more than counts per day, which would take a scan of every
sighting. Each batch adds its own counts instead; what retention or a renewal rewrites is
counted anew for the days it touched. A batch's rows are told apart by its name, so adding
them twice changes nothing. Facts are kept by the jobs: a store that is written to in other
ways has none, and readers then fall back to the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..operators.summary import side_by_side
from ..params import DAY_MS, HOUR_MS
from ..sources.tables import Tables

#: table: the column whose newest value is kept
TIMES = {
    "webhook_notifications": "received_at_ms",
    "face_events": "seen_at_ms",
    "vehicle_events": "seen_at_ms",
    "daily_person_reports": "first_seen_ms",
    "presence_sessions": "started_at_ms",
}
RECOUNTED = "recounted"


def _counted(rows: DataFrame, table: str, batch: str) -> DataFrame:
    days = rows.groupBy("local_date").agg(
        F.count("*").alias("rows"), F.coalesce(F.max(TIMES[table]), F.lit(0)).cast("long").alias("max_ms")
    )
    return days.select("rows", "max_ms", F.lit(batch).alias("batch"), F.lit(table).alias("table"), "local_date")


def add(tables: Tables, new: dict[str, DataFrame], batch: str) -> None:
    """Count the rows a batch has stored, by table. A later try of the batch recounts its days instead."""
    parts = [_counted(rows, table, batch) for table, rows in new.items()]
    tables.append(reduce(DataFrame.unionByName, parts), "day_facts")


def recount(tables: Tables, table: str, days: list[str] | None = None) -> None:
    """Count days of a table anew, all of them without a list."""
    rows = tables.read(table) if days is None else tables.only_days(table, days)
    tables.replace_days(_counted(rows, table, RECOUNTED), "day_facts")
    if days:
        known = tables.only_where("day_facts", (F.col("table") == table) & F.col("local_date").isin(days))
        left = {r.local_date for r in rows.select("local_date").distinct().collect()}
        stale = {r.local_date for r in known.select("local_date").distinct().collect()} - left
        tables.clear("day_facts", [f"table={table}/local_date={d}" for d in sorted(stale)])


def ensure(tables: Tables) -> None:
    """Count a store that has no facts yet."""
    if tables.read("day_facts").isEmpty():
        for table in TIMES:
            if not tables.read(table).isEmpty():
                recount(tables, table)


def kept(tables: Tables) -> DataFrame | None:
    """`table`, `local_date`, `rows`, `max_ms`; none if this store keeps no facts."""
    facts = tables.read("day_facts")
    if facts.isEmpty():
        return None
    once = facts.groupBy("table", "local_date", "batch").agg(F.max("rows").alias("rows"), F.max("max_ms").alias("max_ms"))
    days = once.groupBy("table", "local_date").agg(F.sum("rows").alias("rows"), F.max("max_ms").alias("max_ms"))
    return days.filter("rows > 0")


def source_facts(facts: DataFrame) -> DataFrame:
    """A5 for every day, as `materialize.source_facts` counts it."""
    faces = facts.filter(F.col("table") == "face_events")
    return faces.select("local_date", F.col("rows").alias("source_event_count"), F.col("max_ms").alias("max_seen_at_ms"))


def health_facts(tables: Tables, facts: DataFrame, now_ms: int) -> DataFrame:
    """A20 from kept facts; only the days that can hold the last 24 hours are read of the tables."""
    total = {t: F.coalesce(F.sum(F.when(F.col("table") == t, F.col("rows"))), F.lit(0)) for t in TIMES}
    newest = {t: F.max(F.when(F.col("table") == t, F.col("max_ms"))) for t in TIMES}
    sums = facts.agg(
        *[total[t].alias(f"rows_{t}") for t in TIMES],
        newest["webhook_notifications"].alias("last_webhook_at_ms"),
        newest["face_events"].alias("last_event_at_ms"),
    )
    recent = []
    for table, name in (("webhook_notifications", "webhooks"), ("face_events", "events")):
        time, day = F.col(TIMES[table]), now_ms - DAY_MS
        rows = tables.only_where(table, F.col("local_date") >= times.first_day(day)).filter(time >= day)
        hour = F.count_if(time >= now_ms - HOUR_MS).alias(f"{name}_last_hour")
        recent.append(rows.agg(hour, F.count("*").alias(f"{name}_last_day")))
    return side_by_side(sums, *recent)
