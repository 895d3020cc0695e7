"""Table schemas. Every epoch column is UTC milliseconds; `local_date` is `YYYY-MM-DD` text."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def _schema(ddl: str) -> T.StructType:
    """`name type` pairs; a trailing `?` on the name marks a nullable column."""
    fields = []
    for item in ddl.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name.rstrip("?"), _TYPES[kind], name.endswith("?")))
    return T.StructType(fields)


RAW_ALARMS = _schema("raw_body string, received_at_ms long, source_ip string")

NOTIFICATIONS = _schema(
    "id string, received_at_ms long, source_ip string, event_id string, alarm_name string,"
    "payload_json string, image_base64? string, delivery_key? string, local_date string"
)

FACES = _schema(
    "id string, notification_id? string, event_id string, seen_at_ms long, local_date string,"
    "person_key string, person_name string, person_id string, trigger_key string,"
    "camera_id string, alarm_name string, raw_trigger_json string, image_base64? string"
)

VEHICLES = _schema(
    "id string, notification_id? string, event_id string, seen_at_ms long, local_date string,"
    "plate_key string, plate_text string, trigger_key string, camera_id string,"
    "alarm_name string, raw_trigger_json string, image_base64? string"
)

SESSIONS = _schema(
    "id string, local_date string, person_key string, person_name string,"
    "started_at_ms long, ended_at_ms long, duration_seconds double,"
    "rounded_duration_minutes long, sighting_count long, first_event_id string,"
    "last_event_id string, first_camera_id string, last_camera_id string, is_open int,"
    "generated_at_ms long"
)

REPORTS = _schema(
    "local_date string, person_key string, person_name string, first_seen_ms long,"
    "last_seen_ms long, raw_span_seconds double, rounded_span_minutes long,"
    "rounded_span_hours double, first_event_id string, last_event_id string,"
    "first_camera_id string, last_camera_id string, seen_count long, generated_at_ms long,"
    "observed_span_seconds? double, observed_rounded_minutes? long,"
    "observed_rounded_hours? double, session_count? long"
)

STATE = _schema(
    "local_date string, source_event_count long, max_seen_at_ms long,"
    "materializer_version long, generated_at_ms long"
)

COUNTERS = _schema("local_date string, field string, value long, batch string")

MARKERS = _schema("key string, value? string, at_ms long")

REJECTS = _schema(
    "raw_body? string, received_at_ms long, source_ip string, reason string, local_date string,"
    "batch string"
)

# What each batch added, by kind of row, day of receipt and day of the row.
BATCHES = _schema(
    "fingerprint string, kind string, received_date string, local_date string, value long,"
    "batch string"
)

# Stored keys by hash, the blocks of their Bloom filters, and the names of the parts.
LEDGER = _schema(
    "digest long, check long, ref? string, at_ms long, kind string, bucket int, part string"
)
FILTERS = _schema("block long, bits long, bucket int, part string")
LEDGER_FILES = _schema("bucket int, keys long, blocks long, part string")
LEDGER_OPEN = _schema("bucket int, part string")

# Rows and newest time of each table and day, by the batch that added them.
DAY_FACTS = _schema("rows long, max_ms long, batch string, table string, local_date string")

TABLES = {
    "webhook_notifications": NOTIFICATIONS,
    "face_events": FACES,
    "vehicle_events": VEHICLES,
    "presence_sessions": SESSIONS,
    "daily_person_reports": REPORTS,
    "materialization_state": STATE,
    "ops_daily_counters": COUNTERS,
    "ops_markers": MARKERS,
    "rejected_alarms": REJECTS,
    "ingest_batches": BATCHES,
    "key_ledger": LEDGER,
    "key_filters": FILTERS,
    "ledger_files": LEDGER_FILES,
    "ledger_open": LEDGER_OPEN,
    "day_facts": DAY_FACTS,
}

# Every table but the markers is laid out by day, so day and month filters prune files.
PARTITIONS = {name: ["local_date"] for name in TABLES if name != "ops_markers"}
# What a repeated batch writes again is found by its name.
PARTITIONS["ops_daily_counters"] = PARTITIONS["rejected_alarms"] = ["local_date", "batch"]
PARTITIONS["ingest_batches"] = ["batch"]
PARTITIONS["day_facts"] = ["table", "local_date"]
PARTITIONS["key_ledger"] = PARTITIONS["key_filters"] = ["part", "bucket"]
PARTITIONS["ledger_files"] = PARTITIONS["ledger_open"] = ["part"]

# Column that rows of one day are sorted by, so that row-group statistics prune key lookups.
CLUSTERING = {
    "webhook_notifications": ["delivery_key"],
    "face_events": ["person_key", "seen_at_ms"],
    "vehicle_events": ["plate_key", "seen_at_ms"],
    "presence_sessions": ["person_key", "started_at_ms"],
    "daily_person_reports": ["person_key"],
    "key_ledger": ["digest"],
    "key_filters": ["block"],
}
