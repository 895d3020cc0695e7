"""The live view of one local day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..params import HOUR_MS, GapRules
from .health import webhook_health
from .sessions import gap_sessions, is_recent, vehicle_sessions
from .summary import side_by_side

RECENT_SHOWN = 20


def unknown_face() -> F.Column:
    """an unrecognised face, by trigger or by name."""
    return (F.col("trigger_key") == "face_unknown") | (F.lower("person_name") == "unknown")


def _rows(sessions: DataFrame, key: str, label: str, now_ms: int, rules: GapRules) -> DataFrame:
    """One row per entity. Sessions are already partitioned by (day, key): no shuffle."""
    latest = F.max_by(
        F.struct(label, "last_camera_id", "entity_gap_ms", "end_camera_gap_ms"),
        F.struct("ended_at_ms", "started_at_ms"),
    )
    grouped = (
        sessions.groupBy("local_date", key)
        .agg(
            latest.alias("latest"),
            F.min("started_at_ms").alias("first_seen_ms"),
            F.max("ended_at_ms").alias("last_seen_ms"),
            F.sum(times.span_ms("started_at_ms", "ended_at_ms")).alias("observed_ms"),
            F.count("*").alias("session_count"),
            F.sum("sighting_count").alias("sighting_count"),
        )
        .select("*", "latest.*")
    )
    rounded = times.ceil_quarter_minutes("observed_ms")
    return grouped.select(
        key,
        label,
        F.when(is_recent("last_seen_ms", now_ms, rules), "present").otherwise("away").alias("status"),
        "first_seen_ms",
        "last_seen_ms",
        "last_camera_id",
        times.seconds("observed_ms").alias("observed_span_seconds"),
        rounded.alias("observed_rounded_minutes"),
        times.quarter_hours(rounded).alias("observed_rounded_hours"),
        "session_count",
        "sighting_count",
    )


def presence_order(key: str) -> list:
    """K7: present ones first, then the most recently seen."""
    return [F.when(F.col("status") == "present", 0).otherwise(1), F.desc("last_seen_ms"), key]


def today_people(faces: DataFrame, today: str, now_ms: int, rules: GapRules) -> DataFrame:
    """People of the day with presence status, cut live from the sightings."""
    day = faces.filter(F.col("local_date") == today)
    sessions = gap_sessions(day, rules, keep_gaps=True)
    rows = _rows(sessions, "person_key", "person_name", now_ms, rules)
    return rows.orderBy(*presence_order("person_key"))


def today_vehicles(vehicles: DataFrame, today: str, now_ms: int, rules: GapRules) -> DataFrame:
    """Vehicles of the day; visits are cut from this day's sightings only."""
    day = vehicles.filter(F.col("local_date") == today)
    sessions = vehicle_sessions(day, rules, scope=("local_date",), keep_gaps=True)
    rows = _rows(sessions, "plate_key", "plate_text", now_ms, rules)
    return rows.orderBy(*presence_order("plate_key"))


def recent_events(faces: DataFrame, today: str) -> DataFrame:
    """K5: the newest twenty sightings of the day."""
    return (
        faces.filter(F.col("local_date") == today)
        .select(
            "event_id", "seen_at_ms", "person_name", "camera_id", "trigger_key", "image_base64"
        )
        .orderBy(F.desc("seen_at_ms"), "event_id")
        .limit(RECENT_SHOWN)
    )


def today_counts(
    faces: DataFrame,
    vehicles: DataFrame,
    notifications: DataFrame,
    today: str,
    now_ms: int,
    rules: GapRules,
) -> DataFrame:
    """The scalar part of the snapshot, one row."""
    hour_ago = now_ms - HOUR_MS
    present = F.col("status") == "present"
    last_hour = F.col("seen_at_ms") >= hour_ago
    return side_by_side(
        today_people(faces, today, now_ms, rules).agg(
            F.count_if(present).alias("present_count"), F.count("*").alias("seen_today_count")
        ),
        faces.filter(F.col("local_date") == today).agg(
            F.count_if(unknown_face()).alias("unknown_face_count"),
            F.count_if(last_hour).alias("events_last_hour"),
        ),
        today_vehicles(vehicles, today, now_ms, rules).agg(
            F.count_if(present).alias("vehicles_present_count"),
            F.count("*").alias("vehicles_seen_today_count"),
        ),
        vehicles.filter(F.col("local_date") == today).agg(
            F.count_if(last_hour).alias("vehicle_events_last_hour")
        ),
        webhook_health(notifications, hour_ago, now_ms),
    ).select(
        F.lit(today).alias("local_date"), F.lit(now_ms).cast("long").alias("generated_at_ms"), "*"
    )


def today_snapshot(
    faces: DataFrame,
    vehicles: DataFrame,
    notifications: DataFrame,
    today: str,
    now_ms: int,
    rules: GapRules,
) -> dict[str, DataFrame]:
    """The parts of the snapshot. Lists stay frames, as their length is not bounded."""
    return {
        "counts": today_counts(faces, vehicles, notifications, today, now_ms, rules),
        "people": today_people(faces, today, now_ms, rules),
        "vehicles": today_vehicles(vehicles, today, now_ms, rules),
        "recent_events": recent_events(faces, today),
    }
