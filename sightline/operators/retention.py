"""Retention: scrub raw text after 30 days, drop rows after 365."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..params import DAY_MS
from .upserts import detach

RAW_DAYS = 30
ROW_DAYS = 365
SCRUBBED = "{}"


def cutoffs(now_ms: int) -> tuple[int, int]:
    """Moments before which raw text is scrubbed and rows are dropped."""
    return now_ms - RAW_DAYS * DAY_MS, now_ms - ROW_DAYS * DAY_MS


# table: (time column, raw text column or None)
AGED = {
    "webhook_notifications": ("received_at_ms", "payload_json"),
    "face_events": ("seen_at_ms", "raw_trigger_json"),
    "vehicle_events": ("seen_at_ms", "raw_trigger_json"),
    "daily_person_reports": ("first_seen_ms", None),
    "presence_sessions": ("started_at_ms", None),
}
# Names of the summary counts, in the order of the steps.
COUNTS = {
    ("scrub", "webhook_notifications"): "scrubbed_notifications",
    ("scrub", "face_events"): "scrubbed_face_events",
    ("scrub", "vehicle_events"): "scrubbed_vehicle_events",
    ("drop", "webhook_notifications"): "deleted_notifications",
    ("drop", "face_events"): "deleted_face_events",
    ("drop", "vehicle_events"): "deleted_vehicle_events",
    ("drop", "daily_person_reports"): "deleted_reports",
    ("drop", "presence_sessions"): "deleted_sessions",
}


def needs_scrub(table: str, now_ms: int) -> Column:
    """F7 & F8: old enough and not scrubbed yet."""
    time, raw = AGED[table]
    unclean = (F.col(raw) != SCRUBBED) | F.col("image_base64").isNotNull()
    return _before(time, cutoffs(now_ms)[0]) & unclean


def expires(table: str, now_ms: int) -> Column:
    """rows to drop. Notifications go with the raw cutoff, all others after a year."""
    time, _ = AGED[table]
    raw_cutoff, row_cutoff = cutoffs(now_ms)
    return _before(time, raw_cutoff if table == "webhook_notifications" else row_cutoff)


def _before(time: str, cutoff_ms: int) -> Column:
    """The exact test, beside the one on days that it implies."""
    return (F.col("local_date") <= times.last_day(cutoff_ms)) & (F.col(time) < cutoff_ms)


def scrubbed(df: DataFrame, table: str, now_ms: int) -> DataFrame:
    """Raw text emptied and image removed on rows past the raw cutoff."""
    _, raw = AGED[table]
    old = needs_scrub(table, now_ms)
    return df.withColumns(
        {
            raw: F.when(old, F.lit(SCRUBBED)).otherwise(F.col(raw)),
            "image_base64": F.when(~old, F.col("image_base64")),
        }
    )


def live_state(state: DataFrame, faces: DataFrame) -> DataFrame:
    """State rows of days that still have face sightings."""
    return state.join(faces.select("local_date").distinct(), "local_date", "left_semi")


def day_counts(df: DataFrame, table: str, now_ms: int) -> DataFrame:
    """Days on which the job changes rows, with how many it drops and scrubs. Later days are not read."""
    raw = AGED[table][1]
    tests = {"drop": expires(table, now_ms)}
    tests["scrub"] = needs_scrub(table, now_ms) if raw else F.lit(False)
    # Raw text ages faster than rows, so its cutoff bounds the days of both.
    newest = times.last_day(cutoffs(now_ms)[0 if raw else 1])
    old = df.filter((F.col("local_date") <= newest) & (tests["drop"] | tests["scrub"]))
    return old.groupBy("local_date").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def retention_counts(tables: dict[str, DataFrame], now_ms: int) -> DataFrame:
    """The eight row counts as (`metric`, `rows`), one pass per table.

    All predicates look at a table's state before any step; no step changes a row in a way
    that another count of the same table would notice.
    """
    parts = []
    for table, (_, raw) in AGED.items():
        tests = ["drop", "scrub"] if raw else ["drop"]
        days = day_counts(tables[table], table, now_ms)
        counted = days.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in tests])
        pairs = [
            F.struct(F.lit(COUNTS[n, table]).alias("metric"), F.col(n).alias("rows"))
            for n in tests
        ]
        parts.append(counted.select(F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, parts)


def aged_tables(tables: dict[str, DataFrame], now_ms: int) -> dict[str, DataFrame]:
    """Every table after the job."""
    notes = tables["webhook_notifications"]
    expired = notes.filter(expires("webhook_notifications", now_ms))
    out = {}
    for table, (_, raw) in AGED.items():
        kept = tables[table].filter(~expires(table, now_ms))
        if raw:
            kept = scrubbed(kept, table, now_ms)
        if table in ("face_events", "vehicle_events"):
            kept = detach(kept, expired)
        out[table] = kept
    out["materialization_state"] = live_state(
        tables["materialization_state"], out["face_events"]
    )
    return out


def retention(tables: dict[str, DataFrame], now_ms: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after retention, and the counts."""
    return aged_tables(tables, now_ms), retention_counts(tables, now_ms)
