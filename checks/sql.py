"""DuckDB building blocks: the same sightings and derived tables, written as plain SQL."""

from __future__ import annotations

from .feed import GAPS_240

TZ = "America/New_York"


def clock(ms: str) -> str:
    return f"timezone('{TZ}', timezone('UTC', make_timestamp(CAST({ms} AS BIGINT) * 1000)))"


def day(ms: str) -> str:
    return f"strftime({clock(ms)}, '%Y-%m-%d')"


def minute(ms: str) -> str:
    return f"(hour({clock(ms)}) * 60 + minute({clock(ms)}))"


def quarter(ms: str) -> str:
    return f"CAST(ceil(CAST({ms} AS DOUBLE) / 900000) * 15 AS BIGINT)"


def secs(ms: str) -> str:
    return f"CAST({ms} AS DOUBLE) / 1000"


def hours(minutes: str) -> str:
    return f"CAST({minutes} AS DOUBLE) / 60"


def label(minutes: str) -> str:
    t = f"(CAST(floor({minutes} + 0.5) AS BIGINT) % 1440)"
    return f"(lpad(CAST({t} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 60 AS VARCHAR), 2, '0'))"


EV = "ev AS (SELECT event_id AS n, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events)"

FACES = f"""faces AS (
  SELECT 'f-' || n AS id, 'n-' || (n // 3) AS notification_id, 'ev-' || n AS event_id,
         ms AS seen_at_ms, {day("ms")} AS local_date, 'id:' || user_id AS person_key,
         CASE WHEN n % 2 = 1 THEN 'USER ' ELSE 'User ' END || user_id AS person_name,
         CAST(user_id AS VARCHAR) AS person_id,
         CASE WHEN event_type = 'error' THEN 'face_unknown' ELSE 'face_known' END AS trigger_key,
         'cam-' || (n % 5) AS camera_id, 'Alarm ' || (n % 7) AS alarm_name,
         '{{"value":"User ' || user_id || '"}}' AS raw_trigger_json,
         CASE n % 3 WHEN 0 THEN 'aW1hZ2U=' WHEN 1 THEN 'not an image!' END AS image_base64
  FROM ev WHERE n % 4 <> 0)"""

VEHICLES = f"""vehicles AS (
  SELECT 'v-' || n AS id, 'n-' || (n // 3) AS notification_id, 've-' || n AS event_id,
         ms AS seen_at_ms, {day("ms")} AS local_date, 'plate:AB' || user_id AS plate_key,
         CASE WHEN n % 40 = 0 THEN '' ELSE 'ab-' || user_id END AS plate_text,
         'license_plate_known' AS trigger_key, 'cam-' || (n % 5) AS camera_id,
         'Alarm ' || (n % 7) AS alarm_name, '{{"value":"[redacted]"}}' AS raw_trigger_json,
         CASE WHEN n % 8 = 0 THEN 'aW1hZ2U=' END AS image_base64
  FROM ev WHERE n % 4 = 0)"""

NOTES = f"""notes AS (
  SELECT 'n-' || g AS id, last_ms + 1500 AS received_at_ms, '10.0.0.1' AS source_ip,
         'ev-' || (g * 3) AS event_id, 'Alarm ' || (g % 7) AS alarm_name,
         CASE WHEN g % 6 = 0 THEN '{{}}' ELSE '{{"n":' || g || '}}' END AS payload_json,
         CASE WHEN g % 4 = 0 THEN 'aW1hZ2U=' END AS image_base64, 'k-' || g AS delivery_key,
         {day("last_ms + 1500")} AS local_date
  FROM (SELECT n // 3 AS g, max(ms) AS last_ms FROM ev GROUP BY 1))"""


def _override(column: str, minutes) -> str:
    if not minutes:
        return "NULL"
    cases = " ".join(f"WHEN '{k}' THEN {v * 60000}" for k, v in minutes.items())
    return f"CASE {column} {cases} END"


def gap_after(key: str, camera: str, rules) -> str:
    return (
        f"coalesce({_override(key, rules.by_entity)}, {_override(camera, rules.by_camera)},"
        f" {rules.default_ms})"
    )


def sessions(out: str, src: str, key: str, scope: str, rules) -> str:
    """CTEs that end in `out`: classic lag / running-sum sessions in one pass per key."""
    by = f"{scope + ', ' if scope else ''}{key}"
    if key == "person_key":
        name = "first(person_name ORDER BY seen_at_ms, event_id) AS person_name"
    else:
        name = (
            "coalesce(last(nullif(plate_text, '') ORDER BY seen_at_ms, event_id)"
            " FILTER (WHERE plate_text <> ''), replace(plate_key, 'plate:', '')) AS plate_text"
        )
    gap = (
        f"coalesce({_override(key, rules.by_entity)}, CASE WHEN p_cam = camera_id AND camera_id <> ''"
        f" THEN {_override('camera_id', rules.by_camera)} END, {rules.default_ms})"
    )
    return f"""{out}_l AS (
  SELECT *, lag(seen_at_ms) OVER w AS p_ms, lag(camera_id) OVER w AS p_cam FROM {src}
  WINDOW w AS (PARTITION BY {by} ORDER BY seen_at_ms, event_id)),
{out}_n AS (
  SELECT *, sum(CASE WHEN p_ms IS NULL OR seen_at_ms - p_ms > {gap} THEN 1 ELSE 0 END)
    OVER (PARTITION BY {by} ORDER BY seen_at_ms, event_id) AS sno FROM {out}_l),
{out} AS (
  SELECT {key}, {name}, first(local_date ORDER BY seen_at_ms, event_id) AS local_date,
         min(seen_at_ms) AS started_at_ms, max(seen_at_ms) AS ended_at_ms,
         first(event_id ORDER BY seen_at_ms, event_id) AS first_event_id,
         last(event_id ORDER BY seen_at_ms, event_id) AS last_event_id,
         first(camera_id ORDER BY seen_at_ms, event_id) AS first_camera_id,
         last(camera_id ORDER BY seen_at_ms, event_id) AS last_camera_id,
         count(*) AS sighting_count
  FROM {out}_n GROUP BY {by}, sno)"""


SESSIONS = sessions("sess", "faces", "person_key", "local_date", GAPS_240)
VISITS = sessions("visits", "vehicles", "plate_key", "", GAPS_240)

_RAW = "max(seen_at_ms) - min(seen_at_ms)"
REPORTS = f"""obs AS (
  SELECT local_date, person_key, CAST(sum(ended_at_ms - started_at_ms) AS BIGINT) AS observed_ms,
         count(*) AS session_count FROM sess GROUP BY 1, 2),
reports AS (
  SELECT f.local_date, f.person_key, first(person_name ORDER BY seen_at_ms, event_id) AS person_name,
         min(seen_at_ms) AS first_seen_ms, max(seen_at_ms) AS last_seen_ms,
         {secs(_RAW)} AS raw_span_seconds, {quarter(_RAW)} AS rounded_span_minutes,
         {hours(quarter(_RAW))} AS rounded_span_hours,
         first(event_id ORDER BY seen_at_ms, event_id) AS first_event_id,
         last(event_id ORDER BY seen_at_ms, event_id) AS last_event_id,
         first(camera_id ORDER BY seen_at_ms, event_id) AS first_camera_id,
         last(camera_id ORDER BY seen_at_ms, event_id) AS last_camera_id,
         count(*) AS seen_count, any_value(observed_ms) AS observed_ms,
         {secs("any_value(observed_ms)")} AS observed_span_seconds,
         {quarter("any_value(observed_ms)")} AS observed_rounded_minutes,
         {hours(quarter("any_value(observed_ms)"))} AS observed_rounded_hours,
         any_value(session_count) AS session_count
  FROM faces f JOIN obs USING (local_date, person_key) GROUP BY 1, 2)"""
REPORT_COLUMNS = (
    "local_date, person_key, person_name, first_seen_ms, last_seen_ms, raw_span_seconds,"
    " rounded_span_minutes, rounded_span_hours, first_event_id, last_event_id, first_camera_id,"
    " last_camera_id, seen_count, observed_span_seconds, observed_rounded_minutes,"
    " observed_rounded_hours, session_count"
)

# Raw payloads, re-derived from the rules of the feed without any JSON. `sent` has one row per
# delivery, `trig` one per trigger, `good` the accepted lines.
RAW = f"""trig AS (
  SELECT n, n // 3 AS g, n % 3 AS pos, user_id, ms,
         CASE WHEN n % 17 = 0 THEN 'motion' WHEN n % 4 = 0 THEN 'license_plate_known'
              WHEN event_type = 'error' THEN 'face_unknown' ELSE 'face_known' END AS trigger_key,
         CASE WHEN n % 13 = 0 THEN '' WHEN n % 19 = 0 THEN 'testEventId'
              WHEN n % 23 = 0 THEN 'dup-' || (n % 10) ELSE 'e-' || n END AS eid,
         CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 4 = 0 THEN ' ab-' ELSE 'User  ' END || user_id
              WHEN n % 10 = 0 THEN 'Group ' || user_id END AS label,
         CASE WHEN n % 11 = 0 THEN (ms // 1000) * 1000 ELSE ms END AS seen_at_ms,
         n % 29 = 0 AS bad,
         CASE WHEN n % 7 IN (0, 1) THEN 'QUJD' END AS own_image,
         n % 7 = 2 AS svg, 'Cam-' || (n % 5) AS camera_id
  FROM ev),
pay AS (
  SELECT g, max(ms) AS last_ms,
         string_agg(nullif(eid, ''), chr(10) ORDER BY eid) AS ids,
         coalesce(nullif(first(eid ORDER BY n), ''), 'N/A') AS head_event_id,
         bool_or(bad AND eid <> '' AND trigger_key <> 'motion') AS bad
  FROM trig GROUP BY g),
sent AS (
  SELECT g, last_ms + 1500 + late AS received_at_ms, head_event_id,
         CASE WHEN g % 97 = 5 OR g % 89 = 3 OR g % 211 = 7 THEN 'rejected_json'
              WHEN g % 101 = 9 THEN 'rejected_body'
              WHEN g % 83 = 2 THEN NULL
              WHEN bad THEN 'rejected_json' END AS reason,
         CASE WHEN g % 97 <> 5 AND g % 89 <> 3 AND g % 211 <> 7 AND g % 101 <> 9 AND g % 83 = 2
              THEN true ELSE false END AS no_alarm,
         sha256(CASE WHEN g % 83 = 2 THEN 'v1' || chr(10) || chr(10) || chr(10)
           ELSE 'v1' || chr(10) || 'Alarm ' || (g % 7) || chr(10) || '/e/' || g || chr(10) || last_ms
                || coalesce(chr(10) || ids, '') END) AS delivery_key
  FROM pay, LATERAL (SELECT unnest(CASE WHEN g % 10 = 0 THEN [0, 60000] ELSE [0] END) AS late)),
good AS (
  SELECT s.received_at_ms, s.delivery_key, s.g, t.pos, t.n, t.seen_at_ms, t.trigger_key, t.camera_id,
         CASE WHEN eid = 'testEventId' THEN 'testEventId-' || s.received_at_ms ELSE eid END AS event_id,
         CASE WHEN trigger_key LIKE 'face%' THEN 'face' ELSE 'vehicle' END AS kind,
         'Alarm ' || (s.g % 7) AS alarm_name,
         coalesce(label, 'Unknown') AS person_name, trim(coalesce(label, '')) AS plate_text,
         CASE WHEN s.g % 3 <> 0 AND trigger_key = 'face_known' THEN 'P' || (s.g % 50) ELSE '' END
           AS person_id,
         coalesce(own_image, CASE WHEN s.g % 4 = 0 THEN 'SU1H' END) AS image_base64
  FROM sent s JOIN trig t ON s.g = t.g
  WHERE s.reason IS NULL AND NOT s.no_alarm AND t.trigger_key <> 'motion' AND t.eid <> ''),
named AS (
  SELECT *, {day("seen_at_ms")} AS local_date, {day("received_at_ms")} AS received_date,
         CASE WHEN person_id <> '' THEN 'id:' || person_id
              ELSE 'name:' || regexp_replace(lower(person_name), '\\s+', '_', 'g') END AS person_key,
         'plate:' || coalesce(nullif(upper(regexp_replace(plate_text, '[^a-zA-Z0-9]', '', 'g')), ''),
           'unknown') AS plate_key
  FROM good)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join((EV, *parts)) + "\n"
