"""The driver's `events` table read as camera sightings and as raw alarm payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import times
from sightline.params import DEFAULT_ZONE, GapRules, JobParams

NOW = 1706659200000  # 2024-01-31 00:00 UTC
TODAY = "2024-01-30"
MONTH = "2024-01"
RAW_NOW = 1707955200000  # 2024-02-15: part of the data is past 30 days
YEAR_NOW = 1736899200000  # 2025-01-15: part of the data is past 365 days

GAPS_20 = GapRules(20, {"id:7": 60.0, "plate:AB7": 60.0}, {"cam-1": 30.0})
GAPS_240 = GapRules(240, {"id:7": 60.0, "plate:AB7": 60.0}, {"cam-1": 30.0})
PARAMS = JobParams(zone=DEFAULT_ZONE, gaps=GAPS_240, vehicles=True, max_body_bytes=1500)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts) -> F.Column:
    """Milliseconds of a zone-less UTC timestamp, truncated, whatever the session zone."""
    since = F.col(ts).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes.cast("long") * 60_000 + F.floor(part("SECOND") * 1000).cast("long")


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("n"), "user_id", "event_type", epoch_ms("ts").alias("seen_at_ms")
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four events, as `face_events` rows."""
    user = F.col("user_id").cast("string")
    name = F.concat(F.lit("User "), user)
    return (
        _sightings(spark, sf_dir)
        .filter(F.col("n") % 4 != 0)
        .select(
            F.concat(F.lit("f-"), F.col("n").cast("string")).alias("id"),
            F.concat(F.lit("n-"), F.floor(F.col("n") / 3).cast("string")).alias("notification_id"),
            F.concat(F.lit("ev-"), F.col("n").cast("string")).alias("event_id"),
            "seen_at_ms",
            times.local_date("seen_at_ms", DEFAULT_ZONE).alias("local_date"),
            F.concat(F.lit("id:"), user).alias("person_key"),
            F.when(F.col("n") % 2 == 1, F.upper(name)).otherwise(name).alias("person_name"),
            user.alias("person_id"),
            F.when(F.col("event_type") == "error", "face_unknown")
            .otherwise("face_known")
            .alias("trigger_key"),
            F.concat(F.lit("cam-"), (F.col("n") % 5).cast("string")).alias("camera_id"),
            F.concat(F.lit("Alarm "), (F.col("n") % 7).cast("string")).alias("alarm_name"),
            F.concat(F.lit('{"value":"'), name, F.lit('"}')).alias("raw_trigger_json"),
            F.when(F.col("n") % 3 == 0, F.base64(F.lit("image").cast("binary")))
            .when(F.col("n") % 3 == 1, F.lit("not an image!"))
            .alias("image_base64"),
        )
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth event, as `vehicle_events` rows."""
    user = F.col("user_id").cast("string")
    return (
        _sightings(spark, sf_dir)
        .filter(F.col("n") % 4 == 0)
        .select(
            F.concat(F.lit("v-"), F.col("n").cast("string")).alias("id"),
            F.concat(F.lit("n-"), F.floor(F.col("n") / 3).cast("string")).alias("notification_id"),
            F.concat(F.lit("ve-"), F.col("n").cast("string")).alias("event_id"),
            "seen_at_ms",
            times.local_date("seen_at_ms", DEFAULT_ZONE).alias("local_date"),
            F.concat(F.lit("plate:AB"), user).alias("plate_key"),
            F.when(F.col("n") % 40 == 0, "")
            .otherwise(F.concat(F.lit("ab-"), user))
            .alias("plate_text"),
            F.lit("license_plate_known").alias("trigger_key"),
            F.concat(F.lit("cam-"), (F.col("n") % 5).cast("string")).alias("camera_id"),
            F.concat(F.lit("Alarm "), (F.col("n") % 7).cast("string")).alias("alarm_name"),
            F.lit('{"value":"[redacted]"}').alias("raw_trigger_json"),
            F.when(F.col("n") % 8 == 0, F.base64(F.lit("image").cast("binary"))).alias(
                "image_base64"
            ),
        )
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored notification per three events, received 1.5 s after its last sighting."""
    return (
        _sightings(spark, sf_dir)
        .groupBy(F.floor(F.col("n") / 3).alias("g"))
        .agg(F.max("seen_at_ms").alias("last_ms"))
        .select(
            F.concat(F.lit("n-"), F.col("g").cast("string")).alias("id"),
            (F.col("last_ms") + 1500).alias("received_at_ms"),
            F.lit("10.0.0.1").alias("source_ip"),
            F.concat(F.lit("ev-"), (F.col("g") * 3).cast("string")).alias("event_id"),
            F.concat(F.lit("Alarm "), (F.col("g") % 7).cast("string")).alias("alarm_name"),
            F.when(F.col("g") % 6 == 0, "{}")
            .otherwise(F.concat(F.lit('{"n":'), F.col("g").cast("string"), F.lit("}")))
            .alias("payload_json"),
            F.when(F.col("g") % 4 == 0, F.base64(F.lit("image").cast("binary"))).alias(
                "image_base64"
            ),
            F.concat(F.lit("k-"), F.col("g").cast("string")).alias("delivery_key"),
            times.local_date(F.col("last_ms") + 1500, DEFAULT_ZONE).alias("local_date"),
        )
    )


def reports_and_sessions(spark: SparkSession, sf_dir: str, at: int = 0):
    """(sessions, reports) of all faces, as the daily job would store them."""
    from sightline.operators.reports import reports_from_sessions
    from sightline.operators.sessions import presence_sessions

    sessions = presence_sessions(faces(spark, sf_dir), GAPS_240, at)
    return sessions, reports_from_sessions(sessions, at)


def _text(*parts) -> F.Column:
    """Concatenate literals (plain strings) and columns."""
    return F.concat(
        *[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts]
    )


def raw_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bodies as they would be received: three events per payload, some of them malformed,
    too big, without alarm or with bad timestamps; every tenth payload is delivered twice."""
    n, g, user = F.col("n"), F.col("g"), F.col("user_id")
    ms = F.col("seen_at_ms")
    key = (
        F.when(n % 17 == 0, "motion")
        .when(n % 4 == 0, "license_plate_known")
        .when(F.col("event_type") == "error", "face_unknown")
        .otherwise("face_known")
    )
    event_id = (
        F.when(n % 13 == 0, "")
        .when(n % 19 == 0, "testEventId")
        .when(n % 23 == 0, _text("dup-", n % 10))
        .otherwise(_text("e-", n))
    )
    value = F.when(n % 5 == 0, "").when(n % 4 == 0, _text('"value":" ab-', user, '",')).otherwise(
        _text('"value":"User  ', user, '",')
    )
    group = F.when(n % 10 == 0, _text('"group":{"name":"Group ', user, '","id":3},')).otherwise("")
    image = (
        F.when(n % 7 == 0, '"image":"QUJD",')
        .when(n % 7 == 1, '"image":"data:image/jpeg;base64,QUJD",')
        .when(n % 7 == 2, '"image":"<svg>",')
        .otherwise("")
    )
    stamp = (
        F.when(n % 29 == 0, _text('"', ms, '"'))
        .when(n % 11 == 0, _text(F.floor(ms / 1000)))
        .otherwise(_text(ms))
    )
    trigger = F.concat(
        F.lit("{"), value, group, image,
        _text('"key":"', key, '","device":"Cam-', n % 5, '","eventId":"', event_id,
              '","timestamp":', stamp, "}"),
    )
    grouped = (
        _sightings(spark, sf_dir)
        .withColumn("g", F.floor(n / 3))
        .withColumn("trigger", trigger)
        .groupBy("g")
        .agg(
            F.sort_array(F.collect_list(F.struct("n", "trigger"))).alias("ts"),
            F.max("seen_at_ms").alias("last_ms"),
        )
    )
    triggers = F.array_join(F.transform("ts", lambda t: t["trigger"]), ",")
    conditions = F.when(g % 3 == 0, '{"condition":{"source":"face_unknown"}}').otherwise(
        _text('{"condition":{"type":"is","source":"face_known","value":"P', g % 50,
              '"}},{"condition":{"source":"face_known","value":"other"}}')
    )
    note_image = F.when(g % 4 == 0, '"image":"SU1H",').otherwise("")
    body = F.concat(
        F.lit("{"), note_image,
        _text('"alarm":{"name":"Alarm ', g % 7, '","eventPath":"/e/', g, '","conditions":['),
        conditions, _text('],"triggers":['), triggers,
        _text(']},"timestamp":', F.col("last_ms"), "}"),
    )
    broken = (
        F.when(g % 97 == 5, F.concat(body, F.lit(" trailing")))
        .when(g % 89 == 3, F.substring(body, 1, 40))
        .when(g % 211 == 7, F.lit("null"))
        .when(g % 101 == 9, F.concat(body, F.lit(" " * 1500)))
        .when(g % 83 == 2, _text('{"note":', g, "}"))
        .otherwise(body)
    )
    copies = F.when(g % 10 == 0, F.array(F.lit(0), F.lit(60_000))).otherwise(F.array(F.lit(0)))
    return grouped.select(broken.alias("raw_body"), "last_ms", F.explode(copies).alias("late")).select(
        "raw_body",
        (F.col("last_ms") + 1500 + F.col("late")).alias("received_at_ms"),
        F.lit("10.0.0.1").alias("source_ip"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path: under the cluster's shared folder, or a local one in local tests."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="sightline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staging(spark: SparkSession, name: str):
    """Write a frame and read it back, as the jobs do."""
    from sightline.sources.tables import Tables

    tables = Tables(spark, scratch(spark, name))
    return lambda df: tables.staged(df, name)
