"""Filters, joins, aggregates, windows, top-k, set operations and column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import texts, times
from sightline.operators import (
    calendars,
    directory,
    gaps,
    health,
    profiles,
    reports,
    retention,
    sessions,
    today,
    upserts,
)
from sightline.plans import materialize as mat

from . import feed
from .base import query
from .feed import GAPS_20, GAPS_240, MONTH, NOW, TODAY
from .sql import (
    FACES,
    NOTES,
    REPORT_COLUMNS,
    REPORTS,
    SESSIONS,
    VEHICLES,
    VISITS,
    clock,
    day,
    gap_after,
    hours,
    label,
    minute,
    quarter,
    secs,
    sessions as sql_sessions,
    with_,
)

HOUR = 3_600_000
DAYMS = 24 * HOUR
Z = feed.DEFAULT_ZONE
WF, WV = with_(FACES), with_(VEHICLES)
WS, WR = with_(FACES, SESSIONS), with_(FACES, SESSIONS, REPORTS)
WVV = with_(VEHICLES, VISITS)
SINCE90, SINCE365 = "2023-11-01", "2023-01-30"  # 90 and 365 days before TODAY


def _faces_where(name, sql, condition):
    @query(name, WF + f"SELECT event_id FROM faces WHERE {sql}")
    def _(spark, sf):
        return feed.faces(spark, sf).filter(condition()).select("event_id")


_faces_where("F1_date_equality", f"local_date = '{TODAY}'", lambda: F.col("local_date") == TODAY)
_faces_where(
    "F2_month_prefix", f"local_date LIKE '{MONTH}%'", lambda: F.col("local_date").startswith(MONTH)
)
_faces_where(
    "F3_name_any_case",
    "lower(person_name) = lower('uSeR 3')",
    lambda: texts.same_text("person_name", "uSeR 3"),
)
_faces_where("F4_since", f"seen_at_ms >= {NOW - DAYMS}", lambda: F.col("seen_at_ms") >= NOW - DAYMS)


@query("F5_key_equality", WV + "SELECT event_id FROM vehicles WHERE plate_key = 'plate:AB7'")
def _(spark, sf):
    return feed.vehicles(spark, sf).filter("plate_key = 'plate:AB7'").select("event_id")


_faces_where(
    "F6_date_lower_bound",
    "local_date >= '2024-01-20'",
    lambda: F.col("local_date") >= times.days_before(F.lit(TODAY), 10),
)


@query(
    "F7_older_than_cutoffs",
    WF
    + f"""SELECT count(*) FILTER (WHERE seen_at_ms < {feed.RAW_NOW - 30 * DAYMS}) AS past_raw,
  count(*) FILTER (WHERE seen_at_ms < {feed.YEAR_NOW - 365 * DAYMS}) AS past_year FROM faces""",
)
def _(spark, sf):
    raw_cutoff, _ = retention.cutoffs(feed.RAW_NOW)
    return feed.faces(spark, sf).agg(
        F.count_if(F.col("seen_at_ms") < raw_cutoff).alias("past_raw"),
        F.count_if(retention.expires("face_events", feed.YEAR_NOW)).alias("past_year"),
    )


@query(
    "F8_already_scrubbed",
    with_(NOTES)
    + f"""SELECT id FROM notes WHERE received_at_ms < {feed.RAW_NOW - 30 * DAYMS}
  AND (payload_json <> '{{}}' OR image_base64 IS NOT NULL)""",
)
def _(spark, sf):
    due = retention.needs_scrub("webhook_notifications", feed.RAW_NOW)
    return feed.notifications(spark, sf).filter(due).select("id")


_faces_where("F11_unknown_face", "trigger_key = 'face_unknown'", today.unknown_face)


@query(
    "F12_valid_dates",
    f"""SELECT event_id, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31
    AND try_cast('2024-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) IS NOT NULL
  THEN '2024-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') ELSE '{TODAY}' END AS date,
  CASE WHEN m BETWEEN 1 AND 12 THEN '2024-' || lpad(CAST(m AS VARCHAR), 2, '0') ELSE '{MONTH}' END AS month
FROM (SELECT event_id, event_id % 15 AS m, event_id % 34 AS d FROM events)""",
)
def _(spark, sf):
    n = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    month = F.concat(F.lit("2024-"), two(n % 15))
    date = F.concat(month, F.lit("-"), two(n % 34))
    asked = feed.table(spark, sf, "events").select(n, month.alias("m"), date.alias("d"))
    return asked.select(
        "event_id",
        F.when(times.valid_date("d"), F.col("d")).otherwise(TODAY).alias("date"),
        F.when(times.valid_month("m"), F.col("m")).otherwise(MONTH).alias("month"),
    )


@query(
    "F13_staleness",
    with_(NOTES)
    + f"""SELECT local_date, {NOW} - max(received_at_ms) <= {6 * HOUR} AS webhook_healthy,
  {NOW} - max(received_at_ms) > {36 * HOUR} AS cleanup_stale FROM notes GROUP BY 1""",
)
def _(spark, sf):
    last = feed.notifications(spark, sf).groupBy("local_date").agg(F.max("received_at_ms").alias("m"))
    return last.select(
        "local_date",
        health.is_fresh("m", NOW, health.WEBHOOK_STALE_MS).alias("webhook_healthy"),
        (~health.is_fresh("m", NOW, health.CLEANUP_STALE_MS)).alias("cleanup_stale"),
    )


# Joins
def _state(spark, sf):
    """Stored state as of an earlier load: right for most days, stale or missing for some."""
    facts = mat.source_facts(feed.faces(spark, sf))
    dom = F.substring("local_date", 9, 2).cast("int")
    return mat.state_rows(
        facts.filter(dom % 5 != 0).withColumn(
            "source_event_count",
            F.when(dom % 7 == 0, F.col("source_event_count") - 1).otherwise(
                F.col("source_event_count")
            ),
        ),
        0,
    )


@query(
    "J3_state_without_faces",
    WF + "SELECT local_date FROM faces WHERE CAST(substr(local_date, 9, 2) AS INT) % 5 <> 0 GROUP BY 1"
    " HAVING bool_or(person_key = 'id:3')",
)
def _(spark, sf):
    faces = feed.faces(spark, sf).filter("person_key = 'id:3'")
    return retention.live_state(_state(spark, sf), faces).select("local_date")


@query(
    "J4_detach_expired_parents",
    with_(FACES, NOTES)
    + f"""SELECT faces.event_id, CASE WHEN received_at_ms < {feed.RAW_NOW - 30 * DAYMS} THEN NULL ELSE notification_id END
  AS notification_id FROM faces JOIN notes ON notification_id = notes.id""",
)
def _(spark, sf):
    notes = feed.notifications(spark, sf)
    expired = notes.filter(retention.expires("webhook_notifications", feed.RAW_NOW))
    return upserts.detach(feed.faces(spark, sf), expired).select("event_id", "notification_id")


@query(
    "J5_orphans",
    with_(FACES, NOTES)
    + """SELECT notification_id, count(*) AS children FROM faces WHERE notification_id NOT IN
  (SELECT id FROM notes WHERE alarm_name <> 'Alarm 3') GROUP BY 1""",
)
def _(spark, sf):
    parents = feed.notifications(spark, sf).filter("alarm_name <> 'Alarm 3'")
    return upserts.orphans(feed.faces(spark, sf), parents)


@query(
    "J6_observed_sums",
    WR + "SELECT local_date, person_key, observed_span_seconds, session_count FROM reports",
)
def _(spark, sf):
    _, found = feed.reports_and_sessions(spark, sf)
    return found.select("local_date", "person_key", "observed_span_seconds", "session_count")


@query(
    "J7_gap_lookup",
    WF
    + f"SELECT event_id, CAST({gap_after('person_key', 'camera_id', GAPS_240)} AS DOUBLE) AS gap_ms FROM faces",
)
def _(spark, sf):
    faces = gaps.attach_gaps(feed.faces(spark, sf), "person_key", "camera_id", GAPS_240)
    gap = gaps.gap_after(F.col("camera_id"), F.col("camera_gap_ms"), GAPS_240)
    return faces.select("event_id", gap.alias("gap_ms"))


@query(
    "J8_calendar_spine",
    WR
    + """SELECT strftime(d, '%Y-%m-%d') AS local_date, count(person_key) AS people
FROM (SELECT unnest(generate_series(DATE '2024-02-01', DATE '2024-02-29', INTERVAL 1 DAY)) AS d
      UNION ALL SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)))
LEFT JOIN reports ON local_date = strftime(d, '%Y-%m-%d') GROUP BY 1""",
)
def _(spark, sf):
    _, found = feed.reports_and_sessions(spark, sf)
    grids = [calendars.month_calendar(found, m) for m in (MONTH, "2024-02")]
    both = grids[0].unionByName(grids[1])
    return both.groupBy("local_date").agg(F.count("person_key").alias("people"))


FRESH_SQL = """SELECT local_date, count(*) AS source_event_count, max(seen_at_ms) AS max_seen_at_ms,
  CAST(substr(local_date, 9, 2) AS INT) % 5 <> 0 AND CAST(substr(local_date, 9, 2) AS INT) % 7 <> 0 AS is_fresh
FROM faces GROUP BY 1"""


@query("J9_freshness", WF + FRESH_SQL)
def _(spark, sf):
    faces = feed.faces(spark, sf)
    return mat.freshness(faces.select("local_date"), faces, _state(spark, sf))


def _with_facts(spark, sf):
    """All tables stored with their day facts: counted once, then a late batch, told twice."""
    from sightline.plans import facts
    from sightline.sources.tables import Tables

    tables = Tables(spark, feed.scratch(spark, "facts"))
    late = F.crc32("event_id") % 5 == 0
    for name, rows in _all_tables(spark, sf).items():
        if name in facts.TIMES:
            tables.append(rows.filter(~late) if name == "face_events" else rows, name)
    facts.ensure(tables)
    more = tables.staged(feed.faces(spark, sf).filter(late), "late")
    tables.append(more, "face_events")
    for _ in range(2):
        facts.add(tables, {"face_events": more}, "late")
    return tables, facts


@query("J9_kept_freshness", WF + FRESH_SQL)
def _(spark, sf):
    tables, facts = _with_facts(spark, sf)
    days = facts.source_facts(facts.kept(tables))
    return mat.freshness(days, None, _state(spark, sf), days)


# Aggregates
def _people_sql(where):
    return (
        WF
        + "SELECT min(person_name) AS person_name, max(seen_at_ms) AS last_seen_ms, count(*) AS event_count"
        f" FROM faces {where} GROUP BY lower(person_name)"
    )


@query("A1_distinct_people", _people_sql(""))
def _(spark, sf):
    return directory.distinct_people(feed.faces(spark, sf))


@query("A2_distinct_people_of_date", _people_sql(f"WHERE local_date = '{TODAY}'"))
def _(spark, sf):
    return directory.distinct_people(feed.faces(spark, sf), date=TODAY)


@query("A3_distinct_people_of_month", _people_sql(f"WHERE local_date LIKE '{MONTH}%'"))
def _(spark, sf):
    return directory.distinct_people(feed.faces(spark, sf), month=MONTH)


@query(
    "A4_distinct_dates",
    WF + f"SELECT DISTINCT local_date FROM faces WHERE local_date LIKE '{MONTH}%'",
)
def _(spark, sf):
    return directory.distinct_dates(feed.faces(spark, sf), MONTH)


@query(
    "A5_date_freshness",
    WF
    + f"SELECT count(*) AS count, coalesce(max(seen_at_ms), 0) AS max_seen_at_ms FROM faces WHERE local_date = '{TODAY}'",
)
def _(spark, sf):
    return mat.date_facts(feed.faces(spark, sf), TODAY)


PEOPLE_SQL = """SELECT person_key, max(person_name) AS person_name, max(person_id) AS person_id,
  min(seen_at_ms) AS first_seen_ms, max(seen_at_ms) AS last_seen_ms, count(*) AS event_count FROM faces"""
PLATES_SQL = """SELECT plate_key, max(plate_text) AS plate_text, min(seen_at_ms) AS first_seen_ms,
  max(seen_at_ms) AS last_seen_ms, count(*) AS event_count FROM vehicles"""


@query("A6_people_directory", WF + PEOPLE_SQL + " GROUP BY 1")
def _(spark, sf):
    return directory.people_directory(feed.faces(spark, sf))


@query("A7_person_identity", WF + PEOPLE_SQL + " WHERE person_key = 'id:7' GROUP BY 1")
def _(spark, sf):
    return directory.person_identities(feed.faces(spark, sf), "id:7")


def _summary(spark, sf):
    found, _ = feed.reports_and_sessions(spark, sf)
    return profiles.visit_summary(found, "person_key", Z, TODAY)


SPAN = "CAST(sum(ended_at_ms - started_at_ms) AS BIGINT)"


@query(
    "A8_session_totals",
    WS
    + f"SELECT person_key, count(*) AS visit_count, {secs(SPAN)} AS observed_span_seconds FROM sess GROUP BY 1",
)
def _(spark, sf):
    return _summary(spark, sf).select("person_key", "visit_count", "observed_span_seconds")


@query(
    "A9_day_windows",
    WS
    + f"""SELECT person_key, local_date, min(started_at_ms) AS started_at_ms, max(ended_at_ms) AS ended_at_ms
FROM sess WHERE local_date >= '{SINCE90}' GROUP BY 1, 2""",
)
def _(spark, sf):
    found, _ = feed.reports_and_sessions(spark, sf)
    recent = found.filter(F.col("local_date") >= times.days_before(F.lit(TODAY), 90))
    spans = profiles.day_spans(recent, "person_key")
    return spans.select("person_key", "local_date", "started_at_ms", "ended_at_ms")


def _cameras_sql(src, key):
    return f"""SELECT {key}, camera_id, event_count, rank FROM (
  SELECT {key}, camera_id, count(*) AS event_count,
    row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, camera_id) AS rank FROM {src} GROUP BY 1, 2)
WHERE rank <= 10"""


@query("A10_person_cameras", WF + _cameras_sql("faces", "person_key"))
def _(spark, sf):
    return profiles.top_cameras(feed.faces(spark, sf), "person_key")


HEAT = f"""SELECT {{key}}, local_date, {secs(SPAN)} AS observed_span_seconds,
  {hours(quarter(SPAN))} AS observed_rounded_hours, count(*) AS session_count
FROM {{src}} WHERE local_date >= '{SINCE365}' GROUP BY 1, 2"""


@query("A11_session_heat", WS + HEAT.format(key="person_key", src="sess"))
def _(spark, sf):
    return _summary(spark, sf).select("person_key", F.inline("heat"))


@query(
    "A12_plates_of_date",
    WV
    + f"""SELECT plate_key, max(plate_text) AS plate_text, max(seen_at_ms) AS last_seen_ms, count(*) AS event_count
FROM vehicles WHERE local_date = '{TODAY}' GROUP BY 1""",
)
def _(spark, sf):
    return directory.distinct_plates(feed.vehicles(spark, sf), TODAY)


@query("A13_vehicle_directory", WV + PLATES_SQL + " GROUP BY 1")
def _(spark, sf):
    return directory.vehicle_directory(feed.vehicles(spark, sf))


@query("A14_vehicle_identity", WV + PLATES_SQL + " WHERE plate_key = 'plate:AB7' GROUP BY 1")
def _(spark, sf):
    return directory.vehicle_identities(feed.vehicles(spark, sf), "plate:AB7")


@query("A15_plate_cameras", WV + _cameras_sql("vehicles", "plate_key"))
def _(spark, sf):
    return profiles.top_cameras(feed.vehicles(spark, sf), "plate_key")


def _visit_summary(spark, sf):
    visits = sessions.vehicle_sessions(feed.vehicles(spark, sf), GAPS_240)
    return profiles.visit_summary(visits, "plate_key", Z, TODAY)


@query(
    "A16_visit_totals",
    WVV
    + f"SELECT plate_key, count(*) AS visit_count, {secs(SPAN)} AS observed_span_seconds FROM visits GROUP BY 1",
)
def _(spark, sf):
    return _visit_summary(spark, sf).select("plate_key", "visit_count", "observed_span_seconds")


@query(
    "A17_visit_day_windows",
    WVV
    + f"""SELECT plate_key, local_date, min(started_at_ms) AS started_at_ms, max(ended_at_ms) AS ended_at_ms
FROM visits WHERE local_date >= '{SINCE90}' GROUP BY 1, 2""",
)
def _(spark, sf):
    visits = sessions.vehicle_sessions(feed.vehicles(spark, sf), GAPS_240)
    recent = visits.filter(F.col("local_date") >= times.days_before(F.lit(TODAY), 90))
    spans = profiles.day_spans(recent, "plate_key")
    return spans.select("plate_key", "local_date", "started_at_ms", "ended_at_ms")


@query("A18_visit_heat", WVV + HEAT.format(key="plate_key", src="visits"))
def _(spark, sf):
    return _visit_summary(spark, sf).select("plate_key", F.inline("heat"))


WEBHOOK_SQL = f"""SELECT max(received_at_ms) AS last_received_at_ms,
  count(*) FILTER (WHERE received_at_ms >= {NOW - HOUR}) AS count_last_hour,
  {NOW} - max(received_at_ms) <= {6 * HOUR} AS healthy FROM notes"""


@query("A19_webhook_health", with_(NOTES) + WEBHOOK_SQL)
def _(spark, sf):
    return health.webhook_health(feed.notifications(spark, sf), NOW - HOUR, NOW)


FACTS = f"""(SELECT max(received_at_ms) FROM notes) AS last_webhook_at_ms,
  (SELECT count(*) FROM notes WHERE received_at_ms >= {NOW - HOUR}) AS webhooks_last_hour,
  (SELECT count(*) FROM notes WHERE received_at_ms >= {NOW - DAYMS}) AS webhooks_last_day,
  (SELECT count(*) FROM notes) AS rows_webhook_notifications,
  (SELECT max(seen_at_ms) FROM faces) AS last_event_at_ms,
  (SELECT count(*) FROM faces WHERE seen_at_ms >= {NOW - HOUR}) AS events_last_hour,
  (SELECT count(*) FROM faces WHERE seen_at_ms >= {NOW - DAYMS}) AS events_last_day,
  (SELECT count(*) FROM faces) AS rows_face_events,
  (SELECT count(*) FROM vehicles) AS rows_vehicle_events,
  (SELECT count(*) FROM reports) AS rows_daily_person_reports,
  (SELECT count(*) FROM sess) AS rows_presence_sessions"""
WALL = with_(FACES, VEHICLES, NOTES, SESSIONS, REPORTS)


def _all_tables(spark, sf):
    found, daily = feed.reports_and_sessions(spark, sf)
    return {
        "webhook_notifications": feed.notifications(spark, sf),
        "face_events": feed.faces(spark, sf),
        "vehicle_events": feed.vehicles(spark, sf),
        "presence_sessions": found,
        "daily_person_reports": daily,
        "materialization_state": _state(spark, sf),
    }


@query("A20_health_facts", WALL + "SELECT " + FACTS)
def _(spark, sf):
    t = _all_tables(spark, sf)
    return health.health_facts(
        t["webhook_notifications"],
        t["face_events"],
        t["vehicle_events"],
        t["daily_person_reports"],
        t["presence_sessions"],
        NOW,
    )


@query("A20_kept_health_facts", WALL + "SELECT " + FACTS)
def _(spark, sf):
    tables, facts = _with_facts(spark, sf)
    return facts.health_facts(tables, facts.kept(tables), NOW)


@query(
    "A21_daily_person_reports",
    WR + f"SELECT {REPORT_COLUMNS}, CAST(0 AS BIGINT) AS generated_at_ms FROM reports",
)
def _(spark, sf):
    return feed.reports_and_sessions(spark, sf)[1]


DAY_FACES = f"day_faces AS (SELECT * FROM faces WHERE local_date = '{TODAY}')"
DAY_VEHICLES = f"day_vehicles AS (SELECT * FROM vehicles WHERE local_date = '{TODAY}')"
DAY_SESS = sql_sessions("dsess", "day_faces", "person_key", "", GAPS_240)
DAY_VISITS = sql_sessions("dvisits", "day_vehicles", "plate_key", "", GAPS_240)
WT = with_(
    FACES, VEHICLES, NOTES, DAY_FACES, DAY_VEHICLES, DAY_SESS, DAY_VISITS
)


def _today_rows(src, key, name):
    last = "last(last_camera_id ORDER BY started_at_ms)"
    return f"""SELECT {key}, {name}, CASE WHEN {NOW} - last_seen_ms <= {gap_after(key, "last_camera_id", GAPS_240)}
  THEN 'present' ELSE 'away' END AS status, first_seen_ms, last_seen_ms, last_camera_id,
  {secs("span")} AS observed_span_seconds, {quarter("span")} AS observed_rounded_minutes,
  {hours(quarter("span"))} AS observed_rounded_hours, session_count, sighting_count
FROM (SELECT {key}, last({name} ORDER BY started_at_ms) AS {name}, min(started_at_ms) AS first_seen_ms,
  max(ended_at_ms) AS last_seen_ms, {last} AS last_camera_id, {SPAN} AS span, count(*) AS session_count,
  CAST(sum(sighting_count) AS BIGINT) AS sighting_count FROM {src} GROUP BY 1)"""


TODAY_PEOPLE = _today_rows("dsess", "person_key", "person_name")
TODAY_VEHICLES = _today_rows("dvisits", "plate_key", "plate_text")


@query("A22_today_people", WT + TODAY_PEOPLE)
def _(spark, sf):
    return today.today_people(feed.faces(spark, sf), TODAY, NOW, GAPS_240)


@query("A23_today_vehicles", WT + TODAY_VEHICLES)
def _(spark, sf):
    return today.today_vehicles(feed.vehicles(spark, sf), TODAY, NOW, GAPS_240)


COUNTS = f"""SELECT '{TODAY}' AS local_date, CAST({NOW} AS BIGINT) AS generated_at_ms,
  (SELECT count(*) FROM ({TODAY_PEOPLE}) WHERE status = 'present') AS present_count,
  (SELECT count(*) FROM ({TODAY_PEOPLE})) AS seen_today_count,
  (SELECT count(*) FROM day_faces WHERE trigger_key = 'face_unknown') AS unknown_face_count,
  (SELECT count(*) FROM day_faces WHERE seen_at_ms >= {NOW - HOUR}) AS events_last_hour,
  (SELECT count(*) FROM ({TODAY_VEHICLES}) WHERE status = 'present') AS vehicles_present_count,
  (SELECT count(*) FROM ({TODAY_VEHICLES})) AS vehicles_seen_today_count,
  (SELECT count(*) FROM day_vehicles WHERE seen_at_ms >= {NOW - HOUR}) AS vehicle_events_last_hour,
  h.* FROM ({WEBHOOK_SQL}) h"""


def _today_tables(spark, sf):
    return feed.faces(spark, sf), feed.vehicles(spark, sf), feed.notifications(spark, sf)


@query("A24_today_counts", WT + COUNTS)
def _(spark, sf):
    return today.today_counts(*_today_tables(spark, sf), TODAY, NOW, GAPS_240)


@query(
    "A28_median",
    "SELECT user_id, median(value) AS median_value, median(event_id) AS median_id FROM events GROUP BY 1",
)
def _(spark, sf):
    return (
        feed.table(spark, sf, "events")
        .groupBy("user_id")
        .agg(
            F.median("value").alias("median_value"), F.median("event_id").alias("median_id")
        )
    )


def _typical_sql(src, key):
    return f"""SELECT {key}, median({minute("s")}) AS arrival, median({minute("e")}) AS departure
FROM (SELECT {key}, local_date, min(started_at_ms) AS s, max(ended_at_ms) AS e FROM {src}
      WHERE local_date >= '{SINCE90}' GROUP BY 1, 2) GROUP BY 1"""


@query("A29_typical_times", WS + _typical_sql("sess", "person_key"))
def _(spark, sf):
    return _summary(spark, sf).select("person_key", "arrival", "departure")


@query(
    "A31_month_summary",
    WF
    + f"""SELECT count(*) AS checked, count(*) FILTER (WHERE NOT is_fresh) AS regenerated
FROM ({FRESH_SQL}) WHERE local_date LIKE '{MONTH}%'""",
)
def _(spark, sf):
    faces = feed.faces(spark, sf)
    dates = directory.distinct_dates(faces, MONTH)
    return mat.freshness(dates, faces, _state(spark, sf)).agg(
        F.count("*").alias("checked"), F.count_if(~F.col("is_fresh")).alias("regenerated")
    )


# Sessions and windows
SESS_COLUMNS = (
    "local_date, person_key, person_name, started_at_ms, ended_at_ms, first_event_id,"
    " last_event_id, first_camera_id, last_camera_id, sighting_count"
)
VISIT_COLUMNS = SESS_COLUMNS.replace("person_key, person_name", "plate_key, plate_text")


@query("W1_face_sessions", WS + f"SELECT {SESS_COLUMNS} FROM sess")
def _(spark, sf):
    return sessions.gap_sessions(feed.faces(spark, sf), GAPS_240)


@query(
    "W1_face_sessions_20_minutes",
    with_(FACES, sql_sessions("s20", "faces", "person_key", "local_date", GAPS_20))
    + f"SELECT {SESS_COLUMNS} FROM s20",
)
def _(spark, sf):
    return sessions.gap_sessions(feed.faces(spark, sf), GAPS_20)


@query("W2_vehicle_sessions", WVV + f"SELECT {VISIT_COLUMNS} FROM visits")
def _(spark, sf):
    return sessions.vehicle_sessions(feed.vehicles(spark, sf), GAPS_240)


@query(
    "W3_presence_sessions",
    with_(FACES, DAY_FACES, DAY_SESS)
    + f"""SELECT local_date, person_key, started_at_ms, {secs("ended_at_ms - started_at_ms")} AS duration_seconds,
  {quarter("ended_at_ms - started_at_ms")} AS rounded_duration_minutes, sighting_count,
  CASE WHEN {NOW} - ended_at_ms <= {gap_after("person_key", "last_camera_id", GAPS_240)} THEN 1 ELSE 0 END AS is_open
FROM dsess""",
)
def _(spark, sf):
    day_faces = feed.faces(spark, sf).filter(F.col("local_date") == TODAY)
    return sessions.presence_sessions(day_faces, GAPS_240, NOW, NOW).select(
        "local_date", "person_key", "started_at_ms", "duration_seconds",
        "rounded_duration_minutes", "sighting_count", "is_open",
    )


@query(
    "W4_first_and_last",
    WR + "SELECT local_date, person_key, first_event_id, last_event_id FROM reports",
)
def _(spark, sf):
    found = feed.reports_and_sessions(spark, sf)[1]
    return found.select("local_date", "person_key", "first_event_id", "last_event_id")


@query(
    "W6_latest_session",
    WT + f"SELECT plate_key, plate_text, last_camera_id FROM ({TODAY_VEHICLES})",
)
def _(spark, sf):
    rows = today.today_vehicles(feed.vehicles(spark, sf), TODAY, NOW, GAPS_240)
    return rows.select("plate_key", "plate_text", "last_camera_id")


HEAT_HOURS = "CASE WHEN observed_rounded_hours <> 0 THEN observed_rounded_hours ELSE observed_span_seconds / 3600 END"
LEVELS = f"""lev AS (SELECT person_key, local_date, h AS hours,
  CAST(floor(least(1, h / greatest(0.25, max(h) OVER (PARTITION BY person_key))) * 10 + 0.5) AS INT) AS level
FROM (SELECT person_key, local_date, {HEAT_HOURS} AS h FROM reports WHERE local_date >= '{SINCE365}'))"""


def _heat(spark, sf):
    _, daily = feed.reports_and_sessions(spark, sf)
    summary = profiles.report_summary(daily, Z, TODAY)
    return summary.select("person_key", F.inline("report_heat"))


@query(
    "W7_heat_level",
    with_(FACES, SESSIONS, REPORTS, LEVELS) + "SELECT person_key, local_date, level FROM lev",
)
def _(spark, sf):
    heat = _heat(spark, sf)
    grid = calendars.heat_grid(heat, "person_key", "2024-01-31")
    seen = heat.select("person_key", "local_date")
    return grid.join(seen, ["person_key", "local_date"], "left_semi").select(
        "person_key", "local_date", "level"
    )


@query(
    "W8_camera_share",
    WF
    + f"""SELECT person_key, camera_id,
  CAST(floor(100.0 * event_count / greatest(1, max(event_count) OVER (PARTITION BY person_key)) + 0.5) AS BIGINT) AS share
FROM ({_cameras_sql("faces", "person_key")})""",
)
def _(spark, sf):
    top = profiles.top_cameras(feed.faces(spark, sf), "person_key")
    return profiles.camera_share(top, "person_key").select("person_key", "camera_id", "share")


# Sorts and top-k. The compare is without order, so ranks are made visible where they matter.
def _ranked(df, order):
    from pyspark.sql import Window

    window = Window.partitionBy("local_date").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window))


@query(
    "K1_by_name",
    _people_sql(""),
)
def _(spark, sf):
    return directory.distinct_people(feed.faces(spark, sf))


@query(
    "K2_by_date_and_name",
    WR + f"SELECT local_date, person_name FROM reports WHERE local_date LIKE '{MONTH}%'",
)
def _(spark, sf):
    found = reports.reports_for_month(feed.reports_and_sessions(spark, sf)[1], MONTH)
    return found.select("local_date", "person_name")


@query(
    "K3_by_time",
    WF
    + "SELECT local_date, event_id, row_number() OVER (PARTITION BY local_date ORDER BY seen_at_ms DESC, event_id) AS rank FROM faces",
)
def _(spark, sf):
    faces = feed.faces(spark, sf).select("local_date", "event_id", "seen_at_ms")
    return _ranked(faces, [F.desc("seen_at_ms"), "event_id"]).drop("seen_at_ms")


def _recent_sql(src, key, limit):
    return f"""SELECT {key}, event_id, rank FROM (SELECT {key}, event_id,
  row_number() OVER (PARTITION BY {key} ORDER BY seen_at_ms DESC, event_id) AS rank FROM {src}) WHERE rank <= {limit}"""


@query("K4_recent_of_entity", WF + _recent_sql("faces", "person_key", 24))
def _(spark, sf):
    stage = feed.staging(spark, "recent")
    found = profiles.recent_sightings(feed.faces(spark, sf), "person_key", stage=stage)
    return found.select("person_key", "event_id", "rank")


RECENT20 = """SELECT event_id, seen_at_ms, person_name, camera_id, trigger_key, image_base64 FROM day_faces
ORDER BY seen_at_ms DESC, event_id LIMIT 20"""


@query("K5_recent_of_today", WT + RECENT20)
def _(spark, sf):
    return today.recent_events(feed.faces(spark, sf), TODAY)


@query("K6_top_cameras", WV + _cameras_sql("vehicles", "plate_key"))
def _(spark, sf):
    return profiles.top_cameras(feed.vehicles(spark, sf), "plate_key")


@query(
    "K7_present_first",
    WT
    + f"""SELECT person_key, row_number() OVER (ORDER BY CASE WHEN status = 'present' THEN 0 ELSE 1 END,
  last_seen_ms DESC, person_key) AS rank FROM ({TODAY_PEOPLE})""",
)
def _(spark, sf):
    rows = today.today_people(feed.faces(spark, sf), TODAY, NOW, GAPS_240)
    return _ranked(
        rows.withColumn("local_date", F.lit(TODAY)), today.presence_order("person_key")
    ).select("person_key", "rank")


@query(
    "K8_sessions_by_start",
    WS
    + "SELECT local_date, person_key, started_at_ms, row_number() OVER (PARTITION BY local_date ORDER BY started_at_ms, person_key) AS rank FROM sess",
)
def _(spark, sf):
    found = sessions.gap_sessions(feed.faces(spark, sf), GAPS_240)
    return _ranked(
        found.select("local_date", "person_key", "started_at_ms"), ["started_at_ms", "person_key"]
    )


@query(
    "K9_recent_thumbs",
    WF
    + """SELECT person_key, event_id, image, position FROM (
  SELECT person_key, event_id, image_base64 AS image, row_number() OVER (PARTITION BY person_key ORDER BY rank) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY person_key ORDER BY seen_at_ms DESC, event_id) AS rank FROM faces)
  WHERE rank <= 24 AND image_base64 LIKE 'aW%') WHERE position <= 12""",
)
def _(spark, sf):
    found = profiles.recent_thumbs(feed.faces(spark, sf), "person_key", feed.staging(spark, "recent"))
    return found.select("person_key", "event_id", "image", "position")


# Set operations
@query(
    "U1_selected_person",
    _people_sql(f"WHERE local_date = '{TODAY}'") + " UNION ALL SELECT 'Nobody Yet', 0, 0",
)
def _(spark, sf):
    people = directory.distinct_people(feed.faces(spark, sf), date=TODAY)
    return directory.with_selected_person(people, "Nobody Yet")


@query(
    "U2_selected_plate",
    WV
    + f"""SELECT plate_key, max(plate_text) AS plate_text, max(seen_at_ms) AS last_seen_ms, count(*) AS event_count
FROM vehicles WHERE local_date = '{TODAY}' GROUP BY 1 UNION ALL SELECT 'plate:ZZ', 'ZZ', 0, 0""",
)
def _(spark, sf):
    plates = directory.distinct_plates(feed.vehicles(spark, sf), TODAY)
    return directory.with_selected_plate(plates, "plate:ZZ")


@query(
    "U3_upsert_state",
    WF
    + """SELECT local_date, count(*) AS source_event_count FROM faces WHERE CAST(substr(local_date, 9, 2) AS INT) % 5 <> 0
OR local_date >= '2024-01-15' GROUP BY 1
""".replace("count(*)", "count(*) - CASE WHEN local_date < '2024-01-15' AND CAST(substr(local_date, 9, 2) AS INT) % 7 = 0 THEN 1 ELSE 0 END"),
)
def _(spark, sf):
    late = feed.faces(spark, sf).filter("local_date >= '2024-01-15'")
    new = mat.state_rows(mat.source_facts(late), 1)
    merged = upserts.upsert(_state(spark, sf), new, ["local_date"])
    return merged.select("local_date", "source_event_count")


U4_SQL = f"""SELECT person_key, median({minute("s")}) AS arrival FROM (
  SELECT person_key, started_at_ms AS s FROM (SELECT person_key, local_date, min(started_at_ms) AS started_at_ms
    FROM sess WHERE started_at_ms % 2 = 0 AND person_key NOT LIKE '%3' GROUP BY 1, 2)
  UNION ALL SELECT person_key, first_seen_ms FROM reports WHERE person_key NOT IN
    (SELECT person_key FROM sess WHERE started_at_ms % 2 = 0 AND person_key NOT LIKE '%3')) GROUP BY 1"""


@query("U4_fallback_relation", WR + U4_SQL)
def _(spark, sf):
    found, daily = feed.reports_and_sessions(spark, sf)
    some = found.filter("started_at_ms % 2 = 0 AND person_key NOT LIKE '%3'")
    profile = profiles.person_profiles(feed.faces(spark, sf), some, daily, TODAY, Z)
    return profile.select("person_key", F.col("typical_arrival_minutes").alias("arrival"))


# Column expressions
def _seen(spark, sf):
    return feed._sightings(spark, sf).withColumnRenamed("n", "event_id")


def _expr(name, columns, sql):
    @query(name, with_() + f"SELECT n AS event_id, {sql} FROM ev")
    def _(spark, sf):
        return _seen(spark, sf).select("event_id", *[c.alias(k) for k, c in columns().items()])


_expr("X1_local_date", lambda: {"d": times.local_date("seen_at_ms", Z)}, f"{day('ms')} AS d")
SPANMS = "(ms % 40000000)"
_span = lambda: F.col("seen_at_ms") % 40_000_000
_expr("X2_ceil_quarter", lambda: {"m": times.ceil_quarter_minutes(_span())}, f"{quarter(SPANMS)} AS m")
_expr(
    "X3_quarter_hours",
    lambda: {"h": times.quarter_hours(times.ceil_quarter_minutes(_span()))},
    f"{hours(quarter(SPANMS))} AS h",
)
_expr(
    "X4_duration",
    lambda: {"s": times.seconds(times.span_ms(F.lit(NOW - 15 * DAYMS), F.col("seen_at_ms")))},
    f"{secs(f'greatest(0, ms - {NOW - 15 * DAYMS})')} AS s",
)
_expr(
    "X5_minute_of_day", lambda: {"m": times.minute_of_day("seen_at_ms", Z)}, f"{minute('ms')} AS m"
)
_expr(
    "X6_minutes_label",
    lambda: {"t": times.minutes_label((F.col("seen_at_ms") % 3000) / F.lit(2.0))},
    f"{label('(ms % 3000) / 2.0')} AS t",
)
_expr(
    "X7_days_before",
    lambda: {"d": times.days_before(times.local_date("seen_at_ms", Z), 90)},
    f"strftime(CAST({day('ms')} AS DATE) - INTERVAL 90 DAY, '%Y-%m-%d') AS d",
)
_expr(
    "X8_shift_day",
    lambda: {
        "before": times.shift_day(times.local_date("seen_at_ms", Z), -1),
        "after": times.shift_day(times.local_date("seen_at_ms", Z), 1),
    },
    f"strftime(CAST({day('ms')} AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS before,"
    f" strftime(CAST({day('ms')} AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') AS after",
)


def _months():
    month = F.substring(F.date_add(F.lit("2023-11-05").cast("date"), (F.col("event_id") % 900).cast("int")).cast("string"), 1, 7)
    return {
        "before": times.shift_month(month, -1),
        "after": times.shift_month(month, 1),
        "weekday": times.first_weekday(month),
        "days": times.days_in_month(month),
    }


_M = "date_trunc('month', DATE '2023-11-05' + CAST(n % 900 AS INT))"
_expr(
    "X9_months",
    _months,
    f"strftime({_M} - INTERVAL 1 MONTH, '%Y-%m') AS before, strftime({_M} + INTERVAL 1 MONTH, '%Y-%m') AS after,"
    f" dayofweek({_M}) AS weekday, day(last_day({_M})) AS days",
)
_A = f"greatest(0, {NOW} - ms) // 1000 * CASE n % 4 WHEN 0 THEN 0 ELSE 1 END"
_expr(
    "X10_age_label",
    lambda: {
        "age": times.age_label("seen_at_ms", NOW),
        "short": times.age_label(F.lit(NOW) - (F.col("event_id") % 8000) * 1000, NOW),
        "never": times.age_label(F.when(F.col("event_id") % 2 == 0, F.col("seen_at_ms")), NOW, "—"),
    },
    "{0} AS age, {1} AS short, CASE WHEN n % 2 = 0 THEN {0} ELSE '—' END AS never".format(
        *[
            f"CASE WHEN {s} < 60 THEN {s} || 's ago' WHEN {s} < 3600 THEN {s} // 60 || 'm ago'"
            f" WHEN {s} < 172800 THEN {s} // 3600 || 'h ago' ELSE {s} // 86400 || 'd ago' END"
            for s in (f"(({NOW} - ms) // 1000)", "(n % 8000)")
        ]
    ),
)
_expr(
    "X11_clock_labels",
    lambda: {
        "hm": times.clock_label("seen_at_ms"),
        "hms": times.clock_label("seen_at_ms", True),
        "moment": times.moment_label("seen_at_ms"),
    },
    f"strftime({clock('ms')}, '%H:%M') AS hm, strftime({clock('ms')}, '%H:%M:%S') AS hms,"
    f" strftime({clock('ms')}, '%b %-d, %Y, %H:%M') AS moment",
)


@query(
    "X12_plate_display",
    WV
    + "SELECT event_id, CASE WHEN plate_text <> '' THEN plate_text ELSE replace(plate_key, 'plate:', '') END AS shown FROM vehicles",
)
def _(spark, sf):
    shown = texts.plate_display("plate_text", "plate_key")
    return feed.vehicles(spark, sf).select("event_id", shown.alias("shown"))


ERRORS = [
    "foreign key mismatch", "UNIQUE failed: x", "NOT NULL failed", "check failed",
    "SQLITE_CONSTRAINT other", "D1_ERROR: busy", "boom", "SQLITE_CONSTRAINT_UNIQUE",
]
_expr(
    "X13_error_code",
    lambda: {
        "code": texts.error_code(
            F.element_at(
                F.array(*[F.lit(e) for e in ERRORS]), (F.col("event_id") % len(ERRORS) + 1).cast("int")
            )
        )
    },
    "CASE n % 8 WHEN 0 THEN 'D1_FK_CONSTRAINT' WHEN 1 THEN 'D1_UNIQUE_CONSTRAINT' WHEN 2 THEN 'D1_NOTNULL_CONSTRAINT'"
    " WHEN 3 THEN 'D1_CHECK_CONSTRAINT' WHEN 4 THEN 'D1_CONSTRAINT' WHEN 5 THEN 'D1_ERROR' WHEN 6 THEN 'D1_FAILURE'"
    " ELSE 'D1_UNIQUE_CONSTRAINT' END AS code",
)


@query(
    "X14_presence_status",
    WT + f"SELECT person_key, status FROM ({TODAY_PEOPLE})",
)
def _(spark, sf):
    rows = today.today_people(feed.faces(spark, sf), TODAY, NOW, GAPS_240)
    return rows.select("person_key", "status")


def _gappy(daily):
    """Reports as older versions left them: without observed values for some people."""
    old = F.col("person_key").rlike("[05]$")
    null = lambda c: F.when(~old, F.col(c))
    return daily.withColumns(
        {c: null(c) for c in ("observed_span_seconds", "observed_rounded_hours", "session_count")}
    )


@query(
    "X15_heat_defaults",
    WR
    + f"""SELECT person_key, local_date,
  CASE WHEN regexp_matches(person_key, '[05]$') THEN raw_span_seconds ELSE observed_span_seconds END AS observed_span_seconds,
  CASE WHEN regexp_matches(person_key, '[05]$') THEN rounded_span_hours ELSE observed_rounded_hours END AS observed_rounded_hours,
  CASE WHEN regexp_matches(person_key, '[05]$') THEN 1 ELSE session_count END AS session_count
FROM reports WHERE local_date >= '{SINCE365}'""",
)
def _(spark, sf):
    daily = _gappy(feed.reports_and_sessions(spark, sf)[1])
    summary = profiles.report_summary(daily, Z, TODAY)
    return summary.select("person_key", F.inline("report_heat"))


@query(
    "X16_observed_or_wall",
    WR
    + f"""SELECT local_date, person_key,
  CASE WHEN regexp_matches(person_key, '[05]$') THEN rounded_span_hours ELSE observed_rounded_hours END AS observed_hours
FROM reports WHERE local_date LIKE '{MONTH}%'""",
)
def _(spark, sf):
    daily = _gappy(feed.reports_and_sessions(spark, sf)[1])
    grid = calendars.month_calendar(daily, MONTH).filter("is_active")
    return grid.select("local_date", "person_key", "observed_hours")
