"""Person and vehicle profiles for all entities at once.

Every part is reduced to one row per entity before the parts are joined on the key, so the
joins are between small, equally partitioned results. Lists inside a row are bounded by the
feature: 10 cameras, 24 recent sightings, one heat entry per day of a year.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts, times
from ..params import GapRules
from . import late
from .directory import FACE_COLUMNS, VEHICLE_COLUMNS, person_identities, vehicle_identities
from .sessions import vehicle_sessions

CAMERAS_SHOWN = 10
RECENT_SHOWN = 24
THUMBS_SHOWN = 12
TYPICAL_DAYS = 90
HEAT_DAYS = 365


def ranked(df: DataFrame, by: list[str], order: list, limit: int, rank: str = "rank") -> DataFrame:
    """First `limit` rows per key. Spark cuts each map task to `limit` rows per key before
    the shuffle (WindowGroupLimit), so a hot key stays small."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def top_cameras(sightings: DataFrame, key: str) -> DataFrame:
    """The ten most frequent cameras of each entity."""
    counts = sightings.groupBy(key, "camera_id").agg(F.count("*").alias("event_count"))
    return ranked(counts, [key], [F.desc("event_count"), "camera_id"], CAMERAS_SHOWN)


def camera_share(cameras: DataFrame, key: str) -> DataFrame:
    """Count as a percentage of the entity's busiest camera, halves up."""
    most = F.max("event_count").over(Window.partitionBy(key))
    share = F.col("event_count") * 100 / F.greatest(F.lit(1).cast("long"), most)
    return cameras.withColumn("share", F.floor(share + F.lit(0.5)).cast("long"))


def recent_sightings(
    sightings: DataFrame,
    key: str,
    limit: int = RECENT_SHOWN,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """K4: the newest sightings of each entity.

    Rows read from files are ranked by key, time and id alone and fetched afterwards; `stage`
    (such as `Tables.staged`) makes that a join of known size over the winners' days.
    """
    order = [F.desc("seen_at_ms"), "event_id"]
    wide = late.located(sightings)
    if wide is None:
        return ranked(sightings, [key], order, limit)
    day = [c for c in ("local_date",) if c in sightings.columns and stage]
    narrow = wide.select(key, "seen_at_ms", "event_id", *day, *late.PLACE)
    winners = ranked(narrow, [key], order, limit).select("rank", *day, *late.PLACE)
    return late.fetch_winners(wide, winners, stage)


def recent_thumbs(
    sightings: DataFrame, key: str, stage: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """K9: the first twelve usable images among the recent sightings of each entity.

    An entity has few of them, so they are put in order inside one array.
    """
    shown = recent_sightings(sightings, key, stage=stage)
    usable = shown.withColumn("image", texts.jpeg_base64("image_base64")).filter("image IS NOT NULL")
    columns = [c for c in usable.columns if c not in (key, "rank")]
    items = F.sort_array(F.collect_list(F.struct("rank", F.struct(*columns).alias("item"))))
    first = usable.groupBy(key).agg(F.slice(items, 1, THUMBS_SHOWN).alias("items"))
    each = first.select(key, F.posexplode("items").alias("position", "one"))
    return each.select(key, (F.col("position") + 1).alias("position"), "one.item.*")


def day_spans(sessions: DataFrame, key: str) -> DataFrame:
    """Per entity and day: first start, last end, time seen, visits."""
    return sessions.groupBy(key, "local_date").agg(
        F.min("started_at_ms").alias("started_at_ms"),
        F.max("ended_at_ms").alias("ended_at_ms"),
        F.sum(times.span_ms("started_at_ms", "ended_at_ms")).alias("observed_ms"),
        F.count("*").alias("session_count"),
    )


def _since(today: str, days: int) -> Column:
    return F.col("local_date") >= times.days_before(F.lit(today), days)


def typical_minute(ms: str, zone: str, today: str) -> Column:
    """Exact median of the minute of the day over the last 90 days."""
    minute = times.minute_of_day(F.col(ms), zone)
    return F.median(F.when(_since(today, TYPICAL_DAYS), minute))


def _heat_entry(seconds: Column, hours: Column, count: Column) -> Column:
    return F.struct(
        F.col("local_date"),
        seconds.alias("observed_span_seconds"),
        hours.alias("observed_rounded_hours"),
        count.alias("session_count"),
    )


def _span_heat() -> Column:
    hours = times.quarter_hours(times.ceil_quarter_minutes("observed_ms"))
    return _heat_entry(times.seconds("observed_ms"), hours, F.col("session_count"))


def _report_heat() -> Column:
    """Observed values, else wall-clock ones, else zero."""
    zero = F.lit(0.0)
    return _heat_entry(
        F.coalesce("observed_span_seconds", "raw_span_seconds", zero),
        F.coalesce("observed_rounded_hours", "rounded_span_hours", zero),
        F.coalesce("session_count", F.lit(1).cast("long")),
    )


def _list(entry: Column, today: str) -> Column:
    return F.sort_array(F.collect_list(F.when(_since(today, HEAT_DAYS), entry)))


def visit_summary(sessions: DataFrame, key: str, zone: str, today: str) -> DataFrame:
    """A8/A16 totals, A29 typical times and the heat list of each entity's sessions."""
    total = times.ceil_quarter_minutes("observed_ms")
    return (
        day_spans(sessions, key)
        .groupBy(key)
        .agg(
            F.sum("session_count").alias("visit_count"),
            F.sum("observed_ms").alias("observed_ms"),
            typical_minute("started_at_ms", zone, today).alias("arrival"),
            typical_minute("ended_at_ms", zone, today).alias("departure"),
            _list(_span_heat(), today).alias("heat"),
        )
        .select(
            key,
            "visit_count",
            times.seconds("observed_ms").alias("observed_span_seconds"),
            times.quarter_hours(total).alias("observed_rounded_hours"),
            "arrival",
            "departure",
            "heat",
        )
    )


def report_summary(reports: DataFrame, zone: str, today: str) -> DataFrame:
    """Typical times and heat list as told by the daily reports (one row per person and day)."""
    return reports.groupBy("person_key").agg(
        typical_minute("first_seen_ms", zone, today).alias("report_arrival"),
        typical_minute("last_seen_ms", zone, today).alias("report_departure"),
        _list(_report_heat(), today).alias("report_heat"),
    )


def _collected(rows: DataFrame, key: str, out: str, columns: list[str]) -> DataFrame:
    """At most `limit` ranked rows per key as one sorted array."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.struct(*columns).alias("item"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda r: r["item"]).alias(out))


def _finish(df: DataFrame, key: str, name_columns: list) -> DataFrame:
    zero = F.lit(0.0)
    return df.select(
        key,
        *name_columns,
        "first_seen_ms",
        "last_seen_ms",
        "event_count",
        F.coalesce("visit_count", F.lit(0).cast("long")).alias("visit_count"),
        F.coalesce("observed_span_seconds", zero).alias("observed_span_seconds"),
        F.coalesce("observed_rounded_hours", zero).alias("observed_rounded_hours"),
        F.col("arrival").alias("typical_arrival_minutes"),
        F.col("departure").alias("typical_departure_minutes"),
        times.minutes_label("arrival").alias("typical_arrival_label"),
        times.minutes_label("departure").alias("typical_departure_label"),
        "cameras",
        F.coalesce("heat", F.array()).alias("heatmap"),
        "recent_events",
    )


def _without_images(columns: list[str], images: bool) -> list[str]:
    return [c for c in columns if images or c != "image_base64"]


def person_profiles(
    faces: DataFrame,
    sessions: DataFrame,
    reports: DataFrame,
    today: str,
    zone: str,
    person_key: str | None = None,
    images: bool = True,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per person. Visits come from the materialised tables; U4: typical times
    prefer sessions over reports, heat prefers reports over sessions, person by person."""
    if person_key is not None:
        match = F.col("person_key") == person_key
        faces, sessions, reports = (d.filter(match) for d in (faces, sessions, reports))
    shown = _without_images(FACE_COLUMNS, images)
    recent = recent_sightings(faces.select(*shown), "person_key", stage=stage)
    joined = (
        person_identities(faces)
        .join(visit_summary(sessions, "person_key", zone, today), "person_key", "left")
        .join(report_summary(reports, zone, today), "person_key", "left")
        .join(
            _collected(
                top_cameras(faces, "person_key"),
                "person_key",
                "cameras",
                ["camera_id", "event_count"],
            ),
            "person_key",
            "left",
        )
        .join(_collected(recent, "person_key", "recent_events", shown), "person_key", "left")
        .withColumns(
            {
                "arrival": F.coalesce("arrival", "report_arrival"),
                "departure": F.coalesce("departure", "report_departure"),
                "heat": F.when(F.size("report_heat") > 0, F.col("report_heat")).otherwise(
                    F.col("heat")
                ),
            }
        )
    )
    return _finish(joined, "person_key", ["person_name", "person_id"])


def vehicle_profiles(
    vehicles: DataFrame,
    rules: GapRules,
    today: str,
    zone: str,
    plate_key: str | None = None,
    images: bool = True,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per plate. Visits are cut from all sightings and count on their start day."""
    if plate_key is not None:
        vehicles = vehicles.filter(F.col("plate_key") == plate_key)
    shown = _without_images(VEHICLE_COLUMNS, images)
    recent = recent_sightings(vehicles.select(*shown), "plate_key", stage=stage)
    visits = vehicle_sessions(vehicles, rules)
    joined = (
        vehicle_identities(vehicles)
        .join(visit_summary(visits, "plate_key", zone, today), "plate_key", "left")
        .join(
            _collected(
                top_cameras(vehicles, "plate_key"),
                "plate_key",
                "cameras",
                ["camera_id", "event_count"],
            ),
            "plate_key",
            "left",
        )
        .join(_collected(recent, "plate_key", "recent_events", shown), "plate_key", "left")
    )
    text = F.coalesce(texts.blank_to_null("plate_text"), texts.bare_plate("plate_key"))
    return _finish(joined, "plate_key", [text.alias("plate_text")])
