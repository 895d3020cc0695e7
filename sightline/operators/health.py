"""Ingest health and row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..params import DAY_MS, HOUR_MS
from .counters import daily_counters
from .markers import read_markers
from .summary import side_by_side

WEBHOOK_STALE_MS = 6 * HOUR_MS
CLEANUP_STALE_MS = 36 * HOUR_MS


def is_fresh(last_ms: str, now_ms: int, limit_ms: int) -> F.Column:
    """something happened within the limit; never is not fresh."""
    return F.coalesce(F.lit(now_ms) - F.col(last_ms) <= limit_ms, F.lit(False))


def webhook_health(notifications: DataFrame, since_ms: int, now_ms: int) -> DataFrame:
    """Last receipt, receipts since a moment, and the 6-hour verdict; one pass."""
    return notifications.agg(
        F.max("received_at_ms").alias("last_received_at_ms"),
        F.count_if(F.col("received_at_ms") >= since_ms).alias("count_last_hour"),
    ).select(
        "*", is_fresh("last_received_at_ms", now_ms, WEBHOOK_STALE_MS).alias("healthy")
    )


def _traffic(df: DataFrame, time: str, now_ms: int, last: str, hour: str, day: str, total: str):
    return df.agg(
        F.max(time).alias(last),
        F.count_if(F.col(time) >= now_ms - HOUR_MS).alias(hour),
        F.count_if(F.col(time) >= now_ms - DAY_MS).alias(day),
        F.count("*").alias(total),
    )


def health_facts(
    notifications: DataFrame,
    faces: DataFrame,
    vehicles: DataFrame,
    reports: DataFrame,
    sessions: DataFrame,
    now_ms: int,
) -> DataFrame:
    """Traffic and row counts, one aggregate per table, one row."""
    return side_by_side(
        _traffic(
            notifications, "received_at_ms", now_ms, "last_webhook_at_ms",
            "webhooks_last_hour", "webhooks_last_day", "rows_webhook_notifications",
        ),
        _traffic(
            faces, "seen_at_ms", now_ms, "last_event_at_ms",
            "events_last_hour", "events_last_day", "rows_face_events",
        ),
        vehicles.agg(F.count("*").alias("rows_vehicle_events")),
        reports.agg(F.count("*").alias("rows_daily_person_reports")),
        sessions.agg(F.count("*").alias("rows_presence_sessions")),
    )


def health_snapshot(tables: dict[str, DataFrame], now_ms: int, zone: str) -> DataFrame:
    """C4: facts, today's counters and operational markers in one row."""
    today = times.local_date(F.lit(now_ms), zone)
    counters = daily_counters(tables["ops_daily_counters"].filter(F.col("local_date") == today))
    facts = health_facts(
        tables["webhook_notifications"],
        tables["face_events"],
        tables["vehicle_events"],
        tables["daily_person_reports"],
        tables["presence_sessions"],
        now_ms,
    )
    # A day without counters gives no row here; the aggregate turns that into zeros.
    names = [c for c in counters.columns if c != "local_date"]
    zeroed = counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    row = side_by_side(facts, zeroed, read_markers(tables["ops_markers"], now_ms))
    return row.select(
        F.lit(now_ms).cast("long").alias("generated_at_ms"),
        today.alias("local_date"),
        "*",
        is_fresh("last_webhook_at_ms", now_ms, WEBHOOK_STALE_MS).alias("webhook_healthy"),
        (~is_fresh("last_cleanup_at_ms", now_ms, CLEANUP_STALE_MS)).alias("cleanup_stale"),
    )
