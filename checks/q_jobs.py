"""Composite results, retention, materialisation, quality and streams: C*, D*, A30, Q*, T*."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import (
    calendars,
    directory,
    health,
    profiles,
    quality,
    reports,
    retention,
    today,
    upgrade,
)
from sightline.params import GapRules
from sightline.plans import daily, materialize as mat
from sightline.plans.ingest import batch_counters, ingest
from sightline.sources import raw as raw_source
from sightline.sources.tables import Tables
from sightline.streaming import ingest as stream_ingest
from sightline.streaming import live
from sightline.streaming.camera_sessions import camera_sessions

from . import feed
from .base import query
from .feed import GAPS_240, MONTH, NOW, RAW_NOW, TODAY, YEAR_NOW
from .q_ingest import COUNTERS_SQL, W, _first, _log
from .q_reporting import (
    COUNTS,
    DAYMS,
    FACTS,
    HEAT,
    HEAT_HOURS,
    PEOPLE_SQL,
    PLATES_SQL,
    RECENT20,
    SESS_COLUMNS,
    SPAN,
    TODAY_PEOPLE,
    TODAY_VEHICLES,
    WALL,
    WF,
    WR,
    WS,
    WT,
    WV,
    WVV,
    Z,
    _all_tables,
    _cameras_sql,
    _people_sql,
    _recent_sql,
    _state,
    _today_tables,
    _typical_sql,
)
from .sql import (
    FACES,
    NOTES,
    REPORT_COLUMNS,
    REPORTS,
    SESSIONS,
    VEHICLES,
    clock,
    hours,
    label,
    quarter,
    secs,
    sessions as sql_sessions,
    with_,
)


# The parts of the today snapshot
def _snapshot(part):
    return lambda spark, sf: today.today_snapshot(*_today_tables(spark, sf), TODAY, NOW, GAPS_240)[
        part
    ]


query("C1_today_snapshot_counts", WT + COUNTS)(_snapshot("counts"))
query("C1_today_snapshot_people", WT + TODAY_PEOPLE)(_snapshot("people"))
query("C1_today_snapshot_vehicles", WT + TODAY_VEHICLES)(_snapshot("vehicles"))
query("C1_today_snapshot_recent", WT + RECENT20)(_snapshot("recent_events"))


# Profiles of all entities
def _people_profiles(spark, sf):
    found, reported = feed.reports_and_sessions(spark, sf)
    return profiles.person_profiles(
        feed.faces(spark, sf), found, reported, TODAY, Z, stage=feed.staging(spark, "recent")
    )


def _plate_profiles(spark, sf):
    return profiles.vehicle_profiles(
        feed.vehicles(spark, sf), GAPS_240, TODAY, Z, stage=feed.staging(spark, "recent")
    )


def _scalars(df):
    return df.drop("cameras", "heatmap", "recent_events")


def _profile_sql(identity, src, key):
    return f"""SELECT i.*, visit_count, {secs("span")} AS observed_span_seconds,
  {hours(quarter("span"))} AS observed_rounded_hours, arrival AS typical_arrival_minutes,
  departure AS typical_departure_minutes, {label("arrival")} AS typical_arrival_label,
  {label("departure")} AS typical_departure_label
FROM ({identity} GROUP BY 1) i
LEFT JOIN (SELECT {key}, count(*) AS visit_count, {SPAN} AS span FROM {src} GROUP BY 1) v USING ({key})
LEFT JOIN ({_typical_sql(src, key)}) t USING ({key})"""


@query("C2_person_profile", WS + _profile_sql(PEOPLE_SQL, "sess", "person_key"))
def _(spark, sf):
    return _scalars(_people_profiles(spark, sf))


@query(
    "C2_person_profile_heatmap",
    WR
    + """SELECT person_key, local_date, observed_span_seconds, observed_rounded_hours, session_count FROM reports""",
)
def _(spark, sf):
    return calendars.profile_heat(_people_profiles(spark, sf), "person_key")


@query(
    "C2_person_profile_cameras",
    WF + f"SELECT person_key, camera_id, event_count FROM ({_cameras_sql('faces', 'person_key')})",
)
def _(spark, sf):
    return _people_profiles(spark, sf).select("person_key", F.inline("cameras"))


@query(
    "C2_person_profile_recent",
    WF + f"SELECT person_key, event_id, rank FROM ({_recent_sql('faces', 'person_key', 24)})",
)
def _(spark, sf):
    events = _people_profiles(spark, sf).select("person_key", F.posexplode("recent_events"))
    return events.select("person_key", "col.event_id", (F.col("pos") + 1).alias("rank"))


@query("C3_vehicle_profile", WVV + _profile_sql(PLATES_SQL, "visits", "plate_key"))
def _(spark, sf):
    return _scalars(_plate_profiles(spark, sf))


@query("C3_vehicle_profile_heatmap", WVV + HEAT.format(key="plate_key", src="visits"))
def _(spark, sf):
    return calendars.profile_heat(_plate_profiles(spark, sf), "plate_key")


@query(
    "C3_vehicle_profile_recent",
    WV + f"SELECT plate_key, event_id, rank FROM ({_recent_sql('vehicles', 'plate_key', 24)})",
)
def _(spark, sf):
    events = _plate_profiles(spark, sf).select("plate_key", F.posexplode("recent_events"))
    return events.select("plate_key", "col.event_id", (F.col("pos") + 1).alias("rank"))


def _counter_rows(spark, sf):
    faces = feed.faces(spark, sf)
    return faces.groupBy("local_date").agg(
        F.lit("events_inserted").alias("field"), F.count("*").alias("value")
    )


@query(
    "C4_health_snapshot",
    WALL
    + f"""SELECT {FACTS}, CAST({NOW} AS BIGINT) AS generated_at_ms, '{TODAY}' AS local_date,
  (SELECT count(*) FROM faces WHERE local_date = '{TODAY}') AS events_inserted, CAST(0 AS BIGINT) AS duplicates,
  (SELECT max(event_id) FROM events WHERE event_id % 9 = 2) AS last_cleanup_at_ms,
  (SELECT {NOW} - max(received_at_ms) <= 21600000 FROM notes) AS webhook_healthy, true AS cleanup_stale,
  'LEGACY' AS cron_code""",
)
def _(spark, sf):
    tables = dict(
        _all_tables(spark, sf),
        ops_daily_counters=_counter_rows(spark, sf),
        ops_markers=_log(spark, sf),
    )
    row = health.health_snapshot(tables, NOW, Z)
    facts = [c for c in row.columns if c.startswith(("rows_", "events_last", "webhooks_last"))]
    return row.select(
        *facts, "last_webhook_at_ms", "last_event_at_ms", "generated_at_ms", "local_date",
        "events_inserted", "duplicates", "last_cleanup_at_ms", "webhook_healthy", "cleanup_stale",
        F.col("last_cron_error.code").alias("cron_code"),
    )


@query(
    "C5_reports_of_month",
    WR
    + f"SELECT {REPORT_COLUMNS}, CAST(0 AS BIGINT) AS generated_at_ms FROM reports WHERE local_date LIKE '{MONTH}%'"
    " AND lower(person_name) = 'user 3'",
)
def _(spark, sf):
    return reports.reports_for_month(feed.reports_and_sessions(spark, sf)[1], MONTH, "User 3")


@query(
    "C5_month_renewed_first",
    WR
    + f"SELECT {REPORT_COLUMNS}, CAST({NOW} AS BIGINT) AS generated_at_ms FROM reports WHERE local_date LIKE '{MONTH}%'",
)
def _(spark, sf):
    """Every day is stored as it looked before its last third came in; the month is then asked for."""
    tables = Tables(spark, feed.scratch(spark, "month"))
    faces = feed.faces(spark, sf)
    late = F.crc32("event_id") % 3 == 0
    tables.append(faces.filter(~late), "face_events")
    mat.materialize_month(tables, feed.PARAMS, MONTH, NOW - 1)
    tables.append(faces.filter(late), "face_events")
    return mat.read_month(tables, feed.PARAMS, MONTH, NOW)


_FACE_LIST = ", ".join(directory.FACE_COLUMNS)
_VEHICLE_LIST = ", ".join(directory.VEHICLE_COLUMNS)


@query(
    "C6_face_day_log",
    WF + f"SELECT {_FACE_LIST} FROM faces WHERE local_date = '{TODAY}' AND lower(person_name) LIKE 'user 1'",
)
def _(spark, sf):
    return directory.events_for_date(feed.faces(spark, sf), TODAY, "uSER 1")


@query(
    "C6_face_day_log_all", WF + f"SELECT {_FACE_LIST} FROM faces WHERE local_date = '{TODAY}'"
)
def _(spark, sf):
    return directory.events_for_date(feed.faces(spark, sf), TODAY)


@query(
    "C7_faces_since", WF + f"SELECT {_FACE_LIST} FROM faces WHERE seen_at_ms >= {NOW - 5 * DAYMS}"
)
def _(spark, sf):
    return directory.events_since(feed.faces(spark, sf), NOW - 5 * DAYMS)


@query("C8_sessions_of_date", WS + f"SELECT {SESS_COLUMNS} FROM sess WHERE local_date = '{TODAY}'")
def _(spark, sf):
    found = reports.sessions_for_date(feed.reports_and_sessions(spark, sf)[0], TODAY)
    return found.select(*SESS_COLUMNS.split(", "))


@query(
    "C9_vehicle_day_log", WV + f"SELECT {_VEHICLE_LIST} FROM vehicles WHERE local_date = '{TODAY}'"
)
def _(spark, sf):
    return directory.vehicle_events_for_date(feed.vehicles(spark, sf), TODAY)


@query(
    "C10_month_calendar",
    WR
    + f"""SELECT d AS local_date, person_key, person_name,
  strftime({clock("first_seen_ms")}, '%H:%M') AS first_time, strftime({clock("last_seen_ms")}, '%H:%M') AS last_time,
  observed_rounded_hours AS observed_hours, rounded_span_hours AS wall_hours, session_count,
  day(CAST(d AS DATE)) AS day, dayofweek(CAST(d AS DATE)) AS weekday, person_key IS NOT NULL AS is_active
FROM (SELECT strftime(unnest(generate_series(DATE '2023-12-01', DATE '2023-12-31', INTERVAL 1 DAY)), '%Y-%m-%d') AS d
      UNION ALL SELECT strftime(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)), '%Y-%m-%d'))
LEFT JOIN reports ON local_date = d""",
)
def _(spark, sf):
    found = feed.reports_and_sessions(spark, sf)[1]
    months = [calendars.month_calendar(found, m) for m in ("2023-12", MONTH)]
    return months[0].unionByName(months[1])


@query(
    "C11_heat_grid",
    WR
    + f""", h AS (SELECT person_key, local_date, {HEAT_HOURS} AS hours FROM reports),
top AS (SELECT person_key, greatest(0.25, max(hours)) AS most FROM h GROUP BY 1)
SELECT person_key, d AS local_date, coalesce(hours, 0) AS hours,
  CAST(CASE WHEN hours IS NULL THEN 0 ELSE floor(least(1, hours / most) * 10 + 0.5) END AS INT) AS level
FROM top, (SELECT strftime(unnest(generate_series(DATE '2023-03-01', DATE '2024-01-31', INTERVAL 1 DAY)), '%Y-%m-%d') AS d)
LEFT JOIN h ON h.person_key = top.person_key AND h.local_date = d""".replace("SELECT person_key, d", "SELECT top.person_key, d"),
)
def _(spark, sf):
    summary = profiles.report_summary(feed.reports_and_sessions(spark, sf)[1], Z, TODAY)
    heat = summary.select("person_key", F.inline("report_heat"))
    return calendars.heat_grid(heat, "person_key", "2024-01-31")


@query(
    "C12_person_choices",
    f"SELECT person_name, event_count, person_name || ' (' || event_count || ')' AS label,"
    f" lower(person_name) = 'user 3' AS is_selected FROM ({_people_sql('')})",
)
def _(spark, sf):
    return directory.person_choices(directory.distinct_people(feed.faces(spark, sf)), "user 3")


@query(
    "C12_plate_choices",
    WV
    + f"""SELECT plate_key, count(*) AS event_count,
  coalesce(nullif(max(plate_text), ''), replace(plate_key, 'plate:', '')) || ' (' || count(*) || ')' AS label,
  plate_key = 'plate:AB3' AS is_selected FROM vehicles WHERE local_date = '{TODAY}' OR plate_key = 'plate:none' GROUP BY 1
UNION ALL SELECT 'plate:AB3', 0, 'AB3 (0)', true WHERE NOT EXISTS
  (SELECT 1 FROM vehicles WHERE local_date = '{TODAY}' AND plate_key = 'plate:AB3')""",
)
def _(spark, sf):
    plates = directory.distinct_plates(feed.vehicles(spark, sf), TODAY)
    return directory.plate_choices(plates, "plate:AB3")


@query(
    "C13_state_of_date",
    WF
    + "SELECT local_date, count(*) AS source_event_count, max(seen_at_ms) AS max_seen_at_ms,"
    " CAST(2 AS BIGINT) AS materializer_version, CAST(0 AS BIGINT) AS generated_at_ms"
    " FROM faces WHERE local_date = '2024-01-16' GROUP BY 1",
)
def _(spark, sf):
    return mat.state_of(_state(spark, sf), "2024-01-16")


# Retention. Raw text ages against RAW_NOW, whole rows against YEAR_NOW.
RAW_CUT, YEAR_CUT = RAW_NOW - 30 * DAYMS, YEAR_NOW - 365 * DAYMS


def _aged(spark, sf, table, now_ms):
    return retention.aged_tables(_all_tables(spark, sf), now_ms)[table]


def _scrub(name, src, table, raw):
    @query(
        name,
        with_(FACES, VEHICLES, NOTES)
        + f"""SELECT id, CASE WHEN t < {RAW_CUT} THEN '{{}}' ELSE {raw} END AS {raw},
  CASE WHEN t >= {RAW_CUT} THEN image_base64 END AS image_base64
FROM (SELECT *, {retention.AGED[table][0]} AS t FROM {src})""",
    )
    def _(spark, sf):
        rows = _all_tables(spark, sf)[table]
        return retention.scrubbed(rows, table, RAW_NOW).select("id", raw, "image_base64")


_scrub("D1_scrub_notifications", "notes", "webhook_notifications", "payload_json")
_scrub("D2_scrub_faces", "faces", "face_events", "raw_trigger_json")
_scrub("D3_scrub_vehicles", "vehicles", "vehicle_events", "raw_trigger_json")


@query("D4_drop_faces", WF + f"SELECT id FROM faces WHERE seen_at_ms >= {YEAR_CUT}")
def _(spark, sf):
    return _aged(spark, sf, "face_events", YEAR_NOW).select("id")


@query("D5_drop_vehicles", WV + f"SELECT id FROM vehicles WHERE seen_at_ms >= {YEAR_CUT}")
def _(spark, sf):
    return _aged(spark, sf, "vehicle_events", YEAR_NOW).select("id")


@query(
    "D6_drop_reports",
    WR + f"SELECT local_date, person_key FROM reports WHERE first_seen_ms >= {YEAR_CUT}",
)
def _(spark, sf):
    return _aged(spark, sf, "daily_person_reports", YEAR_NOW).select("local_date", "person_key")


@query(
    "D7_drop_sessions",
    WS + f"SELECT local_date, person_key, started_at_ms FROM sess WHERE started_at_ms >= {YEAR_CUT}",
)
def _(spark, sf):
    return _aged(spark, sf, "presence_sessions", YEAR_NOW).select(
        "local_date", "person_key", "started_at_ms"
    )


@query(
    "D8_drop_state",
    WF
    + f"""SELECT DISTINCT local_date FROM faces WHERE seen_at_ms >= {YEAR_CUT}
  AND CAST(substr(local_date, 9, 2) AS INT) % 5 <> 0""",
)
def _(spark, sf):
    return _aged(spark, sf, "materialization_state", YEAR_NOW).select("local_date")


@query(
    "D9_drop_notifications",
    with_(FACES, VEHICLES, NOTES)
    + f"""SELECT c.id, CASE WHEN received_at_ms >= {RAW_CUT} THEN notification_id END AS notification_id
FROM (SELECT id, notification_id FROM faces UNION ALL SELECT id, notification_id FROM vehicles) c
JOIN notes ON notes.id = notification_id
UNION ALL SELECT id, 'kept' FROM notes WHERE received_at_ms >= {RAW_CUT}""",
)
def _(spark, sf):
    aged = retention.aged_tables(_all_tables(spark, sf), RAW_NOW)
    children = [aged[t].select("id", "notification_id") for t in ("face_events", "vehicle_events")]
    kept = aged["webhook_notifications"].select("id", F.lit("kept").alias("notification_id"))
    return children[0].unionByName(children[1]).unionByName(kept)


def _counts_sql(now):
    raw_cut, year_cut = now - 30 * DAYMS, now - 365 * DAYMS
    parts = []
    for table, src in {
        "webhook_notifications": "notes",
        "face_events": "faces",
        "vehicle_events": "vehicles",
        "daily_person_reports": "reports",
        "presence_sessions": "sess",
    }.items():
        time, raw = retention.AGED[table]
        cut = raw_cut if src == "notes" else year_cut
        name = retention.COUNTS["drop", table]
        parts.append(f"SELECT '{name}' AS metric, count(*) AS rows FROM {src} WHERE {time} < {cut}")
        if raw:
            name = retention.COUNTS["scrub", table]
            parts.append(
                f"SELECT '{name}', count(*) FROM {src} WHERE {time} < {raw_cut}"
                f" AND ({raw} <> '{{}}' OR image_base64 IS NOT NULL)"
            )
    return WALL + " UNION ALL ".join(parts)


@query("A30_retention_summary", _counts_sql(YEAR_NOW))
def _(spark, sf):
    return retention.retention_counts(_all_tables(spark, sf), YEAR_NOW)


def _stored(spark, sf, name):
    """The feed's base tables in storage."""
    tables = Tables(spark, feed.scratch(spark, name))
    tables.append(feed.notifications(spark, sf), "webhook_notifications")
    tables.append(feed.faces(spark, sf), "face_events")
    tables.append(feed.vehicles(spark, sf), "vehicle_events")
    return tables


@query(
    "D11_daily_job",
    with_(FACES, VEHICLES, NOTES)
    + f"""SELECT 'faces' AS t, count(*) AS rows, count(*) FILTER (WHERE seen_at_ms < {RAW_CUT}) AS scrubbed,
  (SELECT count(*) FROM faces f JOIN notes n ON f.notification_id = n.id WHERE received_at_ms < {RAW_CUT}) AS detached FROM faces
UNION ALL SELECT 'notifications', count(*), 0, 0 FROM notes WHERE received_at_ms >= {RAW_CUT}
UNION ALL SELECT 'markers', 7, 0, 0""",
)
def _(spark, sf):
    tables = _stored(spark, sf, "daily")
    daily.run_daily(tables, feed.PARAMS, RAW_NOW)

    def row(table, name, scrubbed=None, detached=None):
        zero = F.lit(0).cast("long")
        return tables.read(table).agg(
            F.lit(name).alias("t"),
            F.count("*").alias("rows"),
            (zero if scrubbed is None else F.count_if(scrubbed)).alias("scrubbed"),
            (zero if detached is None else F.count_if(detached)).alias("detached"),
        )

    return (
        row(
            "face_events",
            "faces",
            F.col("raw_trigger_json") == "{}",
            F.col("notification_id").isNull(),
        )
        .unionByName(row("webhook_notifications", "notifications"))
        .unionByName(row("ops_markers", "markers"))
    )


@query(
    "D12_materialize_dates",
    with_(FACES, SESSIONS, REPORTS)
    + f"SELECT {REPORT_COLUMNS} FROM reports WHERE local_date >= '2024-01-20'",
)
def _(spark, sf):
    tables = Tables(spark, feed.scratch(spark, "dates"))
    tables.append(feed.faces(spark, sf), "face_events")
    wanted = tables.read("face_events").filter("local_date >= '2024-01-20'")
    mat.materialize(tables, feed.PARAMS, wanted, NOW)
    return tables.read("daily_person_reports").select(*REPORT_COLUMNS.split(", "))


@query("D13_materialize_month", WS + f"SELECT {SESS_COLUMNS} FROM sess WHERE local_date LIKE '{MONTH}%'")
def _(spark, sf):
    tables = Tables(spark, feed.scratch(spark, "month"))
    tables.append(feed.faces(spark, sf), "face_events")
    mat.materialize_month(tables, feed.PARAMS, MONTH, NOW)
    return tables.read("presence_sessions").select(*SESS_COLUMNS.split(", "))


@query(
    "D14_schema_upgrade",
    with_(NOTES)
    + "SELECT id, CAST(NULL AS VARCHAR) AS image_base64, id AS delivery_key FROM notes",
)
def _(spark, sf):
    old = feed.notifications(spark, sf).drop("image_base64", "delivery_key")
    new = upgrade.upgrade_table(old, "webhook_notifications")
    return new.select("id", "image_base64", "delivery_key")


@query(
    "D14_session_upgrade",
    WS
    + "SELECT local_date, person_key, started_at_ms, CASE WHEN sighting_count = 1 THEN 1 ELSE 0 END AS is_open FROM sess",
)
def _(spark, sf):
    found = feed.reports_and_sessions(spark, sf)[0]
    odd = found.withColumn("is_open", F.col("sighting_count").cast("int"))
    new = upgrade.upgrade_table(odd, "presence_sessions")
    return new.select("local_date", "person_key", "started_at_ms", "is_open")


# Data quality, on sightings with planted faults
def _faulty(spark, sf):
    n = F.substring("event_id", 4, 20).cast("long")
    faces = feed.faces(spark, sf)
    return faces.withColumns(
        {
            "person_key": F.when(n % 10 == 1, "").otherwise(F.col("person_key")),
            "seen_at_ms": F.when(n % 50 == 3, -1).otherwise(F.col("seen_at_ms")),
            "local_date": F.when(n % 20 == 7, "2024-1-5").otherwise(F.col("local_date")),
            "camera_id": F.when(n % 30 != 9, F.col("camera_id")),
            "event_id": F.when(n % 4 == 2, F.concat(F.lit("ev-"), (n + 1).cast("string"))).otherwise(
                F.col("event_id")
            ),
        }
    )


FAULTY = "(SELECT n FROM ev WHERE n % 4 <> 0)"


@query(
    "Q1_check_rules",
    with_()
    + f"""SELECT rule, violations FROM (
  SELECT 'person_key not empty' AS rule, count(*) FILTER (WHERE n % 10 = 1) AS violations FROM {FAULTY}
  UNION ALL SELECT 'seen_at_ms >= 0', count(*) FILTER (WHERE n % 50 = 3) FROM {FAULTY}
  UNION ALL SELECT 'local_date shape', count(*) FILTER (WHERE n % 20 = 7) FROM {FAULTY})""",
)
def _(spark, sf):
    found = quality.check_rules(_faulty(spark, sf), "face_events")
    return found.filter("rule NOT LIKE '%not null' AND violations > 0").select("rule", "violations")


@query(
    "Q2_unique_keys",
    with_()
    + f"""SELECT 'unique event_id' AS rule, count(*) AS violations FROM (
  SELECT CASE WHEN n % 4 = 2 THEN n + 1 ELSE n END AS k FROM {FAULTY} GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique id', 0""",
)
def _(spark, sf):
    return quality.check_unique(_faulty(spark, sf), "face_events").select("rule", "violations")


@query(
    "Q3_references",
    with_(FACES, NOTES)
    + """SELECT 'face_events' AS "table", count(*) AS violations FROM faces WHERE notification_id NOT IN
  (SELECT id FROM notes WHERE alarm_name <> 'Alarm 3')""",
)
def _(spark, sf):
    parents = feed.notifications(spark, sf).filter("alarm_name <> 'Alarm 3'")
    found = quality.check_references(feed.faces(spark, sf), parents, "face_events")
    return found.select("table", "violations")


@query(
    "Q4_not_null",
    with_()
    + f"SELECT 'camera_id not null' AS rule, count(*) FILTER (WHERE n % 30 = 9) AS violations FROM {FAULTY}",
)
def _(spark, sf):
    found = quality.check_rules(_faulty(spark, sf), "face_events")
    return found.filter("rule LIKE '%not null' AND violations > 0").select("rule", "violations")


# Streams. Each runs over the whole landed feed with an `availableNow` trigger.
def _landed(spark, sf, name):
    path = feed.scratch(spark, name)
    feed.raw_alarms(spark, sf).write.parquet(path)
    return path


def _run_ingest(spark, sf, name, now_ms=None):
    stream = raw_source.stream_raw(spark, _landed(spark, sf, name))
    tables = Tables(spark, feed.scratch(spark, name))
    run = stream_ingest.ingest_stream(
        stream, tables, feed.PARAMS, feed.scratch(spark, name), now_ms=now_ms
    )
    run.awaitTermination()
    return tables


@query(
    "T1_ingest_stream",
    W
    + f"SELECT event_id, seen_at_ms, person_key, person_name, camera_id FROM {_first('face')} WHERE rn = 1",
)
def _(spark, sf):
    stored = _run_ingest(spark, sf, "t1").read("face_events")
    return stored.select("event_id", "seen_at_ms", "person_key", "person_name", "camera_id")


def _sightings_stream(spark, sf, name):
    """The face sightings landed as files and read as a stream."""
    path = feed.scratch(spark, name)
    kept = ["event_id", "seen_at_ms", "local_date", "person_key", "camera_id"]
    faces = feed.faces(spark, sf).select(*kept)
    faces.unionByName(faces.filter("seen_at_ms % 3 = 0")).write.parquet(path)
    stream = spark.readStream.schema(faces.schema).parquet(path)
    return stream.withColumn("seen_ts", F.timestamp_millis("seen_at_ms"))


def _drain(spark, df, name):
    """Run a stream over what is there and read its output folder."""
    out, state = feed.scratch(spark, name), feed.scratch(spark, name)
    run = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("T2_dedup_stream", WF + "SELECT event_id, seen_at_ms, person_key FROM faces")
def _(spark, sf):
    unique = stream_ingest.dedup_stream(_sightings_stream(spark, sf, "t2"), "31 days")
    return _drain(spark, unique.select("event_id", "seen_at_ms", "person_key"), "t2")


def _live_sql(rules, delay_ms):
    gap = " ".join(f"WHEN '{k}' THEN {v * 60000}" for k, v in rules.by_entity.items())
    gap = f"CASE person_key {gap} ELSE {rules.default_ms} END" if gap else rules.default_ms
    return (
        with_(FACES, sql_sessions("live", "faces", "person_key", "", rules))
        + f"""SELECT person_key, started_at_ms, ended_at_ms, sighting_count FROM live
WHERE ended_at_ms + {gap} <= (SELECT max(seen_at_ms) FROM faces) - {delay_ms}"""
    )


def _live(spark, sf, name, rules, delay):
    stream = _sightings_once(spark, sf, name)
    return _drain(spark, live.live_sessions(stream, "person_key", rules, delay), name)


def _sightings_once(spark, sf, name):
    path = feed.scratch(spark, name)
    faces = feed.faces(spark, sf).select("event_id", "seen_at_ms", "person_key")
    faces.write.parquet(path)
    stream = spark.readStream.schema(faces.schema).parquet(path)
    return stream.withColumn("seen_ts", F.timestamp_millis("seen_at_ms"))


PLAIN = GapRules(240)
PER_PERSON = GapRules(240, {"id:7": 60.0, "id:3": 30.0})


@query("T3_watermark", _live_sql(PLAIN, 6 * 3_600_000))
def _(spark, sf):
    return _live(spark, sf, "t3", PLAIN, "6 hours")


@query("T4_live_sessions", _live_sql(PLAIN, 0))
def _(spark, sf):
    return _live(spark, sf, "t4", PLAIN, "0 seconds")


@query("T5_live_sessions_by_person", _live_sql(PER_PERSON, 0))
def _(spark, sf):
    return _live(spark, sf, "t5", PER_PERSON, "0 seconds")


def _closed_sql(rules, columns, delay_ms):
    """W1's sessions over all days that no further sighting can join: the next one has begun, or time is up."""
    entity = " ".join(f"WHEN '{k}' THEN {v * 60000}" for k, v in rules.by_entity.items())
    camera = " ".join(f"WHEN '{k}' THEN {max(v * 60000, rules.default_ms)}" for k, v in rules.by_camera.items())
    gap = f"coalesce(CASE person_key {entity} END, CASE last_camera_id {camera} END, {rules.default_ms})"
    return (
        with_(FACES, sql_sessions("live", "faces", "person_key", "", rules))
        + f"""SELECT person_key, {columns} FROM (
  SELECT *, lead(started_at_ms) OVER (PARTITION BY person_key ORDER BY started_at_ms) AS next_ms FROM live)
WHERE least(ended_at_ms + {gap}, next_ms) <= (SELECT max(seen_at_ms) FROM faces) - {delay_ms}"""
    )


LIVE_COLUMNS = (
    "started_at_ms, first_event_id, first_camera_id, ended_at_ms, last_event_id, last_camera_id, sighting_count"
)
_DELIVERIES = 5


def _delivered(spark, sf, name):
    """Sightings in five files by time; every seventh one comes a file late."""
    path = feed.scratch(spark, name)
    kept = ["event_id", "seen_at_ms", "person_key", "camera_id"]
    rows = feed.faces(spark, sf).select(*kept)
    span = rows.agg(F.min("seen_at_ms").alias("a"), F.max("seen_at_ms").alias("b")).first()
    part = F.least(F.lit(_DELIVERIES - 1), F.floor((F.col("seen_at_ms") - span.a) * _DELIVERIES / F.lit(span.b - span.a + 1)))
    late = F.when(F.crc32("event_id") % 7 == 0, 1).otherwise(0)
    # The newest sighting is on time, so that the last watermark is known.
    late = F.when(F.col("seen_at_ms") == span.b, 0).otherwise(late)
    dealt = rows.withColumn("part", F.least(F.lit(_DELIVERIES - 1), part + late))
    # Dealt out once by all tasks; a task that writes the file of a delivery reads no other rows.
    kept = feed.scratch(spark, name)
    dealt.write.partitionBy("part").parquet(kept)
    dealt = spark.read.schema(dealt.schema).parquet(kept)

    def deliver(numbers):
        for i in numbers:
            some = dealt.filter(F.col("part") == i).select(*rows.columns)
            some.coalesce(1).write.mode("append").parquet(path)

    deliver([0])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return deliver, stream.withColumn("seen_ts", F.timestamp_millis("seen_at_ms"))


@query("T5_live_camera_gaps", _closed_sql(GAPS_240, LIVE_COLUMNS, 8 * 86_400_000))
def _(spark, sf):
    deliver, stream = _delivered(spark, sf, "t5-camera")
    out, state = feed.scratch(spark, "t5-camera"), feed.scratch(spark, "t5-camera")
    found = camera_sessions(stream, "person_key", GAPS_240, "8 days")
    for numbers in (range(1, 3), range(3, _DELIVERIES)):  # with a restart between them
        deliver(numbers)
        run = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query(
    "T6_late_data_renews_days",
    W.rstrip()
    + f""",
kept AS (SELECT * FROM {_first("face")} WHERE rn = 1),
{sql_sessions("ks", "kept", "person_key", "local_date", GAPS_240)}
SELECT {SESS_COLUMNS} FROM ks""",
)
def _(spark, sf):
    stored = _run_ingest(spark, sf, "t6", now_ms=NOW).read("presence_sessions")
    return stored.select(*SESS_COLUMNS.split(", "))


@query("T7_stream_counters", COUNTERS_SQL)
def _(spark, sf):
    stored = _run_ingest(spark, sf, "t7").read("ops_daily_counters")
    return stored.groupBy("local_date", "field").agg(F.sum("value").alias("value"))


@query("S1_S6_batch_ingest", COUNTERS_SQL)
def _(spark, sf):
    raw = raw_source.read_raw(spark, _landed(spark, sf, "batch"))
    tables = Tables(spark, feed.scratch(spark, "batch"))
    ingest(raw, tables, feed.PARAMS, "all")
    return batch_counters(tables, "all")
