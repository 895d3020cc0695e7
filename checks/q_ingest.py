"""Sources, sinks and payload parsing: S*, P*, A27, J1, J2, W5, F9, F10."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sightline.operators import counters, markers, parse, reports, sessions, upserts
from sightline.operators.directory import FACE_COLUMNS, VEHICLE_COLUMNS, people_directory
from sightline.plans import ingest
from sightline.sources import json_out, raw
from sightline.sources.tables import Tables

from . import feed
from .base import query
from .sql import (
    FACES,
    RAW,
    REPORTS,
    SESSIONS,
    VEHICLES,
    day,
    sessions as sql_sessions,
    with_,
)

MID = 1705276800000  # 2024-01-15 00:00 UTC: earlier deliveries count as stored
W = with_(RAW)


def lines(spark, sf):
    return parse.alarm_lines(feed.raw_alarms(spark, sf), feed.PARAMS)


def staged_lines(spark, sf):
    """The lines as the ingest job uses them: parsed once and read from a staged copy."""
    return Tables(spark, feed.scratch(spark, "lines")).staged(lines(spark, sf), "lines")


def good(spark, sf):
    return lines(spark, sf).filter("reason IS NULL AND kind IS NOT NULL")


@query("S1_raw_source", W + "SELECT received_at_ms, '10.0.0.1' AS source_ip FROM sent")
def _(spark, sf):
    path = feed.scratch(spark, "raw")
    feed.raw_alarms(spark, sf).write.parquet(path)
    return raw.read_raw(spark, path).select("received_at_ms", "source_ip")


@query("S2_body_size_gate", W + "SELECT received_at_ms, reason FROM sent WHERE reason = 'rejected_body'")
def _(spark, sf):
    found = parse.check_payloads(feed.raw_alarms(spark, sf), feed.PARAMS)
    return found.filter("reason = 'rejected_body'").select("received_at_ms", "reason")


@query("S3_json_gate", W + "SELECT received_at_ms, reason FROM sent WHERE reason = 'rejected_json'")
def _(spark, sf):
    return (
        parse.rejects_of(lines(spark, sf))
        .filter("reason = 'rejected_json'")
        .select("received_at_ms", "reason")
    )


NOTES_SQL = """
SELECT delivery_key, received_at_ms, CASE WHEN no_alarm THEN 'N/A' ELSE head_event_id END AS event_id,
       CASE WHEN no_alarm THEN 'N/A' ELSE 'Alarm ' || (g % 7) END AS alarm_name,
       CASE WHEN g % 4 = 0 AND NOT no_alarm THEN 'SU1H' END AS image_base64
FROM (SELECT *, row_number() OVER (PARTITION BY delivery_key ORDER BY received_at_ms, g) AS rn
      FROM sent WHERE reason IS NULL)
"""
_NOTE_COLUMNS = ["delivery_key", "received_at_ms", "image_base64"]


@query(
    "S4_notification_sink",
    W
    + f"SELECT delivery_key, received_at_ms, image_base64 FROM ({NOTES_SQL} WHERE rn = 1) WHERE delivery_key NOT IN"
    f" (SELECT delivery_key FROM sent WHERE reason IS NULL AND received_at_ms < {MID})",
)
def _(spark, sf):
    found = parse.notifications_of(lines(spark, sf))
    stored = found.filter(F.col("received_at_ms") < MID).select("delivery_key").distinct()
    new = upserts.insert_if_absent(found, stored, "delivery_key", ingest.NOTE_ORDER)
    return new.select(*_NOTE_COLUMNS)


_FACE_OUT = "event_id, seen_at_ms, local_date, person_key, person_name, camera_id, image_base64"
_VEHICLE_OUT = "event_id, seen_at_ms, local_date, plate_key, plate_text, camera_id, image_base64"


def _first(kind: str) -> str:
    return (
        "(SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at_ms, pos) AS rn"
        f" FROM named WHERE kind = '{kind}')"
    )


def _stored(kind: str) -> str:
    return f"(SELECT event_id FROM named WHERE kind = '{kind}' AND received_at_ms < {MID})"


def _sink_sql(kind: str, out: str) -> str:
    return W + f"SELECT {out} FROM {_first(kind)} WHERE rn = 1 AND event_id NOT IN {_stored(kind)}"


def _sink(found, out):
    stored = found.filter(F.col("received_at_ms") < MID).select("event_id").distinct()
    new = upserts.insert_if_absent(found, stored, "event_id", ingest.SIGHTING_ORDER)
    return new.select(*out.split(", "))


@query("S5_face_sink", _sink_sql("face", _FACE_OUT))
def _(spark, sf):
    return _sink(parse.faces_of(lines(spark, sf)), _FACE_OUT)


@query("S6_vehicle_sink", _sink_sql("vehicle", _VEHICLE_OUT))
def _(spark, sf):
    return _sink(parse.vehicles_of(lines(spark, sf)), _VEHICLE_OUT)


S20 = sql_sessions("sess20", "faces", "person_key", "local_date", feed.GAPS_20)
CUT = "2024-01-15"
_MERGED = f"""merged AS (
  SELECT * FROM sess20 WHERE local_date < '{CUT}' AND local_date <> '2024-01-05'
  UNION ALL SELECT * FROM sess WHERE local_date >= '{CUT}')"""


def _replaced(spark, sf):
    """Store all days at one gap, then renew the later days at another and empty one day."""
    tables = Tables(spark, feed.scratch(spark, "replace"))
    faces = feed.faces(spark, sf)
    late = faces.filter(F.col("local_date") >= CUT)
    for rows in ((faces, feed.GAPS_20), (late, feed.GAPS_240)):
        found = sessions.presence_sessions(*rows, 0)
        tables.replace_days(found, "presence_sessions")
        tables.replace_days(
            reports.reports_from_sessions(found, 0), "daily_person_reports"
        )
    for name in ("presence_sessions", "daily_person_reports"):
        tables.clear_days(name, ["2024-01-05"])
    return tables


@query(
    "S7_replace_days",
    with_(FACES, SESSIONS, S20, _MERGED)
    + """SELECT local_date, person_key, CAST(sum(sighting_count) AS BIGINT) AS seen_count,
       count(*) AS session_count FROM merged GROUP BY 1, 2""",
)
def _(spark, sf):
    stored = _replaced(spark, sf).read("daily_person_reports")
    return stored.select("local_date", "person_key", "seen_count", "session_count")


_SESSION_OUT = (
    "local_date, person_key, person_name, started_at_ms, ended_at_ms, first_event_id,"
    " last_event_id, first_camera_id, last_camera_id, sighting_count"
)


@query(
    "S8_replace_sessions",
    with_(FACES, SESSIONS, S20, _MERGED) + f"SELECT {_SESSION_OUT} FROM merged",
)
def _(spark, sf):
    stored = _replaced(spark, sf).read("presence_sessions")
    return stored.select(*_SESSION_OUT.split(", "))


@query(
    "S9_upsert_reports",
    with_(FACES, SESSIONS, S20, REPORTS)
    + f"""SELECT local_date, person_key, session_count FROM reports WHERE local_date >= '{CUT}'
UNION ALL SELECT local_date, person_key, count(*) FROM sess20 WHERE local_date < '{CUT}' GROUP BY 1, 2""",
)
def _(spark, sf):
    faces = feed.faces(spark, sf)
    old = reports.reports_from_sessions(sessions.presence_sessions(faces, feed.GAPS_20, 0), 0)
    late = faces.filter(F.col("local_date") >= CUT)
    new = reports.reports_from_sessions(sessions.presence_sessions(late, feed.GAPS_240, 0), 0)
    merged = upserts.upsert(old, new, ["local_date", "person_key"])
    return merged.select("local_date", "person_key", "session_count")


def _increments(df, field):
    return df.groupBy("local_date").agg(
        F.lit(field).alias("field"), F.count("*").alias("value")
    )


@query(
    "S10_add_counters",
    with_(FACES, VEHICLES)
    + """SELECT local_date, 'events_inserted' AS field, CAST(2 * count(*) AS BIGINT) AS value FROM faces GROUP BY 1
UNION ALL SELECT local_date, 'vehicles_inserted', count(*) FROM vehicles GROUP BY 1""",
)
def _(spark, sf):
    faces = _increments(feed.faces(spark, sf), "events_inserted")
    vehicles = _increments(feed.vehicles(spark, sf), "vehicles_inserted")
    return counters.add_counters(faces, faces.unionByName(vehicles))


@query(
    "S11_marker_log",
    """SELECT key, value FROM (
  SELECT 'ops:' || event_type AS key, arg_max(CASE WHEN event_id % 7 = 0 THEN '' ELSE 'v' || event_id END,
    event_id) AS value FROM events GROUP BY 1) WHERE value <> ''""",
)
def _(spark, sf):
    events = feed.table(spark, sf, "events")
    log = events.select(
        F.concat(F.lit("ops:"), "event_type").alias("key"),
        F.when(
            F.col("event_id") % 7 != 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))
        ).alias("value"),
        F.col("event_id").alias("at_ms"),
    )
    return markers.latest_markers(log)


def _log(spark, sf):
    """A marker log with every key, written again and again through the whole event table."""
    n = F.col("event_id")
    text = n.cast("string")
    keys = [
        (markers.REPORT_AT, text),
        (markers.REPORT_DATE, F.concat(F.lit("day "), text)),
        (markers.CLEANUP_AT, text),
        (markers.CLEANUP_SUMMARY, F.concat(F.lit('{"rows":'), text, F.lit("}"))),
        (markers.FK_CHECK_AT, text),
        (markers.FK_CHECK_OK, F.lit("1")),
        (markers.STORE_ERROR_AT, F.lit(None).cast("string")),
        (
            markers.STORE_ERROR,
            F.concat(F.lit('{"code":"C'), text, F.lit('","at_ms":'), text, F.lit("}")),
        ),
        (markers.CRON_ERROR, F.concat(F.lit("plain text "), text)),
    ]
    key = F.element_at(F.array(*[F.lit(k) for k, _ in keys]), (n % 9 + 1).cast("int"))
    value = F.element_at(F.array(*[v for _, v in keys]), (n % 9 + 1).cast("int"))
    return feed.table(spark, sf, "events").select(
        key.alias("key"), value.alias("value"), n.alias("at_ms")
    )


def _last(i: int) -> str:
    return f"(SELECT max(event_id) FROM events WHERE event_id % 9 = {i})"


@query(
    "S12_marker_read",
    f"""SELECT {_last(0)} AS last_cron_report_at_ms, 'day ' || {_last(1)} AS last_cron_report_date,
  {_last(2)} AS last_cleanup_at_ms, {_last(3)} AS summary_rows, {_last(4)} AS last_fk_check_at_ms,
  true AS last_fk_check_ok, {_last(7)} AS last_d1_error_at_ms, 'C' || {_last(7)} AS d1_code,
  'unknown' AS d1_operation, 'LEGACY' AS cron_code, CAST({feed.NOW} AS BIGINT) AS cron_at_ms""",
)
def _(spark, sf):
    row = markers.read_markers(_log(spark, sf), feed.NOW)
    return row.select(
        "last_cron_report_at_ms",
        "last_cron_report_date",
        "last_cleanup_at_ms",
        F.col("last_cleanup_summary")["rows"].alias("summary_rows"),
        "last_fk_check_at_ms",
        "last_fk_check_ok",
        "last_d1_error_at_ms",
        F.col("last_d1_error.code").alias("d1_code"),
        F.col("last_d1_error.operation").alias("d1_operation"),
        F.col("last_cron_error.code").alias("cron_code"),
        F.col("last_cron_error.at_ms").alias("cron_at_ms"),
    )


@query("S13_pruned_face_scan", with_(FACES) + f"SELECT {', '.join(FACE_COLUMNS)} FROM faces")
def _(spark, sf):
    return feed.faces(spark, sf).select(*FACE_COLUMNS)


@query(
    "S14_pruned_vehicle_scan",
    with_(VEHICLES) + f"SELECT {', '.join(VEHICLE_COLUMNS)} FROM vehicles",
)
def _(spark, sf):
    return feed.vehicles(spark, sf).select(*VEHICLE_COLUMNS)


@query(
    "S15_full_scan_facts",
    "SELECT count(*) AS rows, max(event_id) AS last_id, min(event_id) AS first_id FROM events",
)
def _(spark, sf):
    return feed.table(spark, sf, "events").agg(
        F.count("*").alias("rows"),
        F.max("event_id").alias("last_id"),
        F.min("event_id").alias("first_id"),
    )


@query(
    "S16_json_results",
    with_(FACES)
    + """SELECT '{"person_key":"' || person_key || '","last_seen_ms":' || max(seen_at_ms) || ',"event_count":'
  || count(*) || '}' AS body FROM faces GROUP BY person_key""",
)
def _(spark, sf):
    people = people_directory(feed.faces(spark, sf))
    return json_out.as_json(people.select("person_key", "last_seen_ms", "event_count"))


# Parsing. A line is known by its receipt time and trigger position.
_ID = ["received_at_ms", "pos"]


@query(
    "P1_explode_triggers",
    W
    + "SELECT received_at_ms, pos, trigger_key FROM sent JOIN trig USING (g) WHERE reason IS NULL AND NOT no_alarm",
)
def _(spark, sf):
    found = lines(spark, sf).filter("reason IS NULL AND pos IS NOT NULL")
    return found.select(*_ID, "trigger_key")


@query(
    "P2_classify",
    W
    + """SELECT received_at_ms, pos, CASE WHEN trigger_key LIKE 'face%' THEN 'face' ELSE 'vehicle' END AS kind
FROM sent JOIN trig USING (g) WHERE reason IS NULL AND NOT no_alarm AND trigger_key <> 'motion'""",
)
def _(spark, sf):
    found = lines(spark, sf).filter("reason IS NULL AND pos IS NOT NULL")
    kind = parse.sighting_kind(F.col("trigger_key"), True)
    return found.select(*_ID, kind.alias("kind")).filter("kind IS NOT NULL")


def _parsed(name, columns, where="kind IS NOT NULL"):
    """A check of some columns of the accepted lines."""

    @query(name, W + f"SELECT received_at_ms, pos, {', '.join(columns)} FROM named WHERE {where}")
    def _(spark, sf):
        return good(spark, sf).filter(where).select(*_ID, *columns)


_parsed("P3_event_id_required", ["camera_id"])
_parsed("P4_test_event_id", ["event_id"])
_parsed("P5_timestamps", ["seen_at_ms"])


@query(
    "P6_all_or_nothing",
    W
    + "SELECT received_at_ms, reason IS NULL AS accepted FROM sent WHERE g % 97 <> 5 AND g % 89 <> 3"
    " AND g % 211 <> 7 AND g % 101 <> 9 AND NOT no_alarm",
)
def _(spark, sf):
    checked = parse.check_payloads(feed.raw_alarms(spark, sf), feed.PARAMS)
    readable = checked.filter("try_variant_get(payload, '$.alarm', 'variant') IS NOT NULL")
    return readable.select("received_at_ms", F.col("reason").isNull().alias("accepted"))


_parsed("P7_local_date", ["local_date"])
_parsed("P8_person_name", ["person_name"], "kind = 'face'")
_parsed("P9_person_id", ["person_id"], "kind = 'face'")
_parsed("P10_person_key", ["person_key"], "kind = 'face'")
_parsed("P11_plate_text", ["plate_text"], "kind = 'vehicle'")
_parsed("P12_plate_key", ["plate_key"], "kind = 'vehicle'")


@query(
    "P13_raw_trigger_json",
    W
    + """SELECT m.received_at_ms, m.pos, trigger_key AS key, kind = 'vehicle' OR m.n % 5 <> 0 AS has_value,
  CASE WHEN kind = 'vehicle' THEN '[redacted]' WHEN m.n % 5 <> 0 THEN label END AS value,
  CASE WHEN m.n % 10 = 0 THEN CASE WHEN kind = 'vehicle' THEN '[redacted]' ELSE label END END AS group_name,
  kind = 'face' AND m.n % 7 <= 2 AS has_image
FROM named m JOIN (SELECT n, label FROM trig) t ON m.n = t.n""",
)
def _(spark, sf):
    text = F.col("raw_trigger_json")
    found = good(spark, sf).filter("kind IS NOT NULL")
    value = F.get_json_object(text, "$.value")
    return found.select(
        *_ID,
        F.get_json_object(text, "$.key").alias("key"),
        value.isNotNull().alias("has_value"),
        value.alias("value"),
        F.get_json_object(text, "$.group.name").alias("group_name"),
        F.get_json_object(text, "$.image").isNotNull().alias("has_image"),
    )


_parsed("P14_event_image", ["image_base64"])


@query(
    "P15_image_check",
    with_(FACES)
    + "SELECT event_id, CASE WHEN image_base64 LIKE 'aW%' THEN image_base64 END AS image FROM faces",
)
def _(spark, sf):
    from sightline.functions.texts import jpeg_base64

    faces = feed.faces(spark, sf)
    prefixed = F.when(
        F.col("seen_at_ms") % 2 == 0, F.concat(F.lit("data:image/JPEG;base64,"), "image_base64")
    ).otherwise(F.col("image_base64"))
    return faces.select("event_id", jpeg_base64(prefixed).alias("image"))


@query(
    "P16_notification_fields",
    W
    + """SELECT received_at_ms, CASE WHEN no_alarm THEN 'N/A' WHEN head_event_id = '' THEN 'N/A' ELSE head_event_id
  END AS event_id, CASE WHEN no_alarm THEN 'N/A' ELSE 'Alarm ' || (g % 7) END AS alarm_name
FROM sent WHERE reason IS NULL""",
)
def _(spark, sf):
    return parse.notifications_of(lines(spark, sf)).select(
        "received_at_ms", "event_id", "alarm_name"
    )


@query("P17_delivery_key", W + "SELECT received_at_ms, delivery_key FROM sent WHERE reason IS NULL")
def _(spark, sf):
    return parse.notifications_of(lines(spark, sf)).select("received_at_ms", "delivery_key")


@query(
    "F9_camera_filter",
    W + "SELECT received_at_ms, pos FROM named WHERE camera_id IN ('Cam-1', 'Cam-3')",
)
def _(spark, sf):
    # Payloads whose only bad trigger is at another camera pass with the filter on, so the
    # filter is applied to lines accepted without it.
    watch = replace(feed.PARAMS, cameras=("cam-1", "cam-3"))
    return good(spark, sf).filter(parse.camera_wanted(F.col("camera_id"), watch)).select(*_ID)


@query(
    "F10_target_filter",
    W
    + "SELECT received_at_ms, pos FROM named WHERE kind = 'face' AND (lower(person_name) = 'user  3' OR person_id IN ('P7', 'P8'))",
)
def _(spark, sf):
    wanted = replace(feed.PARAMS, target_names=("user  3",), target_ids=("p7", "p8"))
    found = parse.alarm_lines(feed.raw_alarms(spark, sf), wanted)
    return parse.faces_of(found).select(*_ID)


# Keys and joins of the ingest.
@query(
    "J1_canonical_parent",
    W
    + """SELECT delivery_key, CAST(min(received_at_ms) AS BIGINT) AS first_received_ms
FROM sent WHERE reason IS NULL GROUP BY 1""",
)
def _(spark, sf):
    notes = parse.notifications_of(staged_lines(spark, sf))
    first = upserts.keep_first(notes, "delivery_key", ingest.NOTE_ORDER)
    stored = first.filter(F.col("received_at_ms") < MID).select("delivery_key", "id")
    ids = upserts.canonical_ids(first.select("delivery_key", "id"), stored)
    times_of = notes.select(F.col("id").alias("canonical_id"), "received_at_ms").distinct()
    return ids.join(times_of, "canonical_id").select(
        "delivery_key", F.col("received_at_ms").alias("first_received_ms")
    )


@query(
    "J2_insert_if_absent",
    W
    + f"""SELECT kind, event_id FROM (SELECT kind, event_id, min(received_at_ms) AS r FROM named GROUP BY 1, 2)
WHERE r >= {MID}""",
)
def _(spark, sf):
    # read four times below
    found = feed.staging(spark, "keys")(good(spark, sf).select("kind", "event_id", "received_at_ms"))
    parts = []
    for kind in ("face", "vehicle"):
        some = found.filter(F.col("kind") == kind)
        stored = some.filter(F.col("received_at_ms") < MID).select("event_id").distinct()
        batch = some.select("kind", "event_id").distinct()
        parts.append(upserts.absent(batch, stored, "event_id").select("kind", "event_id"))
    return parts[0].unionByName(parts[1])


@query(
    "W5_keep_first",
    W
    + "SELECT kind, event_id, CAST(min(received_at_ms) AS BIGINT) AS received_at_ms FROM named GROUP BY 1, 2",
)
def _(spark, sf):
    found = good(spark, sf).select("kind", "event_id", *ingest.SIGHTING_ORDER)
    first = upserts.keep_first(found, ["kind", "event_id"], ingest.SIGHTING_ORDER)
    return first.select("kind", "event_id", "received_at_ms")


def _kind_counts(kind, day_column="received_date"):
    return (
        f"SELECT {day_column} AS d, count(*) AS tried, 0 AS kept FROM named WHERE kind = '{kind}' GROUP BY 1"
        f" UNION ALL SELECT {day_column}, 0, count(*) FROM {_first(kind)}"
        f" WHERE rn = 1 AND event_id NOT IN {_stored(kind)} GROUP BY 1"
    )


def _planned(spark, sf):
    found = staged_lines(spark, sf)
    early = F.col("received_at_ms") < MID
    stored = {
        "webhook_notifications": upserts.keep_first(
            parse.notifications_of(found).filter(early), "delivery_key", ingest.NOTE_ORDER
        ),
        "face_events": parse.faces_of(found).filter(early).select("event_id").distinct(),
        "vehicle_events": parse.vehicles_of(found).filter(early).select("event_id").distinct(),
    }
    return found, ingest.plan_ingest(found, stored, feed.staging(spark, "chosen"))


@query(
    "A27_ingest_counts",
    W
    + f"""SELECT 'face' AS kind, CAST(sum(tried) AS BIGINT) AS attempted, CAST(sum(kept) AS BIGINT) AS inserted,
  CAST(sum(tried) - sum(kept) AS BIGINT) AS duplicates FROM ({_kind_counts("face")})
UNION ALL SELECT 'vehicle', CAST(sum(tried) AS BIGINT), CAST(sum(kept) AS BIGINT), CAST(sum(tried) - sum(kept) AS BIGINT)
FROM ({_kind_counts("vehicle")})""",
)
def _(spark, sf):
    found, planned = _planned(spark, sf)
    rows = ingest.counter_rows(found, ingest.added_rows(planned, feed.PARAMS.zone))
    wide = counters.daily_counters(rows)
    fields = {
        "face": ("events_attempted", "events_inserted", "duplicates"),
        "vehicle": ("vehicles_attempted", "vehicles_inserted", "vehicle_duplicates"),
    }
    total = wide.agg(*[F.sum(c).alias(c) for names in fields.values() for c in names])
    out = ("attempted", "inserted", "duplicates")
    entries = [
        F.struct(F.lit(kind).alias("kind"), *[F.col(c).alias(o) for c, o in zip(names, out)])
        for kind, names in fields.items()
    ]
    return total.select(F.inline(F.array(*entries)))


_COUNT_PARTS = f"""parts AS (
  SELECT {day("received_at_ms")} AS local_date, reason AS field, 1 AS value FROM sent WHERE reason IS NOT NULL
  UNION ALL SELECT {day("received_at_ms")}, 'zero_face_webhooks', 1 FROM sent s WHERE reason IS NULL
    AND NOT EXISTS (SELECT 1 FROM named m WHERE m.g = s.g)
  UNION ALL SELECT {day("received_at_ms")}, 'ingested_webhooks', 1 FROM ({NOTES_SQL} WHERE rn = 1)
  UNION ALL SELECT received_date, CASE kind WHEN 'face' THEN 'events_attempted' ELSE 'vehicles_attempted' END, 1 FROM named
  UNION ALL SELECT received_date, 'events_inserted', 1 FROM {_first("face")} WHERE rn = 1
  UNION ALL SELECT received_date, 'duplicates', 1 FROM {_first("face")} WHERE rn > 1
  UNION ALL SELECT received_date, 'vehicles_inserted', 1 FROM {_first("vehicle")} WHERE rn = 1
  UNION ALL SELECT received_date, 'vehicle_duplicates', 1 FROM {_first("vehicle")} WHERE rn > 1)"""
COUNTERS_SQL = (
    with_(RAW, _COUNT_PARTS)
    + "SELECT local_date, field, CAST(sum(value) AS BIGINT) AS value FROM parts GROUP BY 1, 2"
)
COUNTERS_WIDE_SQL = (
    with_(RAW, _COUNT_PARTS)
    + "SELECT local_date, "
    + ", ".join(
        f"CAST(coalesce(sum(value) FILTER (WHERE field = '{f}'), 0) AS BIGINT) AS {f}"
        for f in counters.COUNTER_FIELDS
    )
    + " FROM parts GROUP BY 1"
)


def _empty(spark):
    from sightline.schemas import TABLES

    return {
        t: spark.createDataFrame([], TABLES[t])
        for t in ("webhook_notifications", "face_events", "vehicle_events")
    }


@query("A25_daily_counters", COUNTERS_WIDE_SQL)
def _(spark, sf):
    found = staged_lines(spark, sf)
    planned = ingest.plan_ingest(found, _empty(spark), feed.staging(spark, "chosen"))
    rows = ingest.counter_rows(found, ingest.added_rows(planned, feed.PARAMS.zone))
    return counters.daily_counters(rows)


@query(
    "A26_legacy_counters",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS duplicates,
  CASE WHEN event_id % 3 = 1 THEN 3 ELSE 0 END AS rejected_json, CAST(0 AS BIGINT) AS d1_failures FROM events""",
)
def _(spark, sf):
    n = F.col("event_id")
    text = n.cast("string")
    stored = (
        F.when(n % 3 == 0, F.lit("not json"))
        .when(n % 3 == 1, F.concat(F.lit('{"rejected_json":3,"duplicates":'), text, F.lit("}")))
        .otherwise(F.concat(F.lit('{"other":1,"duplicates":'), text, F.lit("}")))
    )
    kept = feed.table(spark, sf, "events").select("event_id", stored.alias("stored"))
    decoded = counters.decode_counters(kept, "stored")
    return decoded.select("event_id", "duplicates", "rejected_json", "d1_failures")
