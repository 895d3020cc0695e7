"""Directories, pick lists and day logs.

Names are text, and a `min`/`max` over text cannot use a hash aggregate: Spark would sort the
whole input by key first. So sightings are first counted per (key, name) with number-only
buffers, which hash-aggregates on the map side, and only that small result is reduced by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts, times

# Pruned scans (S13, S14): never the raw trigger text.
FACE_COLUMNS = [
    "id", "notification_id", "event_id", "seen_at_ms", "local_date", "person_key",
    "person_name", "person_id", "trigger_key", "camera_id", "alarm_name", "image_base64",
]
VEHICLE_COLUMNS = [
    "id", "notification_id", "event_id", "seen_at_ms", "local_date", "plate_key",
    "plate_text", "trigger_key", "camera_id", "alarm_name", "image_base64",
]


def _on(df: DataFrame, date: str | None, month: str | None) -> DataFrame:
    if date:
        df = df.filter(F.col("local_date") == date)
    if month:
        df = df.filter(F.col("local_date").startswith(month))
    return df


def _counted(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min("seen_at_ms").alias("first_seen_ms"),
        F.max("seen_at_ms").alias("last_seen_ms"),
        F.count("*").alias("event_count"),
    )


def _recounted() -> list:
    return [
        F.min("first_seen_ms").alias("first_seen_ms"),
        F.max("last_seen_ms").alias("last_seen_ms"),
        F.sum("event_count").alias("event_count"),
    ]


def distinct_people(faces: DataFrame, date: str | None = None, month: str | None = None):
    """A1–A3: people by name without regard to case; all time, one day or one month."""
    return (
        _counted(_on(faces, date, month), "person_name")
        .groupBy(F.lower("person_name").alias("_name"))
        .agg(F.min("person_name").alias("person_name"), *_recounted())
        .select("person_name", "last_seen_ms", "event_count")
        .orderBy("person_name")
    )


def distinct_dates(faces: DataFrame, month: str) -> DataFrame:
    """A4: days of a month that have face sightings."""
    return _on(faces, None, month).select("local_date").distinct().orderBy("local_date")


def person_identities(faces: DataFrame, person_key: str | None = None) -> DataFrame:
    """A6/A7 unsorted: one row per person key."""
    if person_key is not None:
        faces = faces.filter(F.col("person_key") == person_key)
    return (
        _counted(faces, "person_key", "person_name", "person_id")
        .groupBy("person_key")
        .agg(
            F.max("person_name").alias("person_name"),
            F.max("person_id").alias("person_id"),
            *_recounted(),
        )
    )


def people_directory(faces: DataFrame) -> DataFrame:
    """Directory by stable person key, in name order."""
    return person_identities(faces).orderBy("person_name", "person_key")


def vehicle_identities(vehicles: DataFrame, plate_key: str | None = None) -> DataFrame:
    """A13/A14 unsorted: one row per plate key."""
    if plate_key is not None:
        vehicles = vehicles.filter(F.col("plate_key") == plate_key)
    return (
        _counted(vehicles, "plate_key", "plate_text")
        .groupBy("plate_key")
        .agg(F.max("plate_text").alias("plate_text"), *_recounted())
    )


def vehicle_directory(vehicles: DataFrame) -> DataFrame:
    """Directory by plate key, in text order."""
    return vehicle_identities(vehicles).orderBy("plate_text", "plate_key")


def distinct_plates(vehicles: DataFrame, date: str) -> DataFrame:
    """Plates of one day."""
    return (
        vehicle_identities(_on(vehicles, date, None))
        .select("plate_key", "plate_text", "last_seen_ms", "event_count")
        .orderBy("plate_text", "plate_key")
    )


def _with_row(listed: DataFrame, match, row: dict, order: list[str]) -> DataFrame:
    """Add a row when nothing matches. Counting the matches needs no join."""
    missing = (
        listed.filter(match)
        .agg(F.count("*").alias("_found"))
        .filter("_found = 0")
        .select(*[F.lit(v).cast(listed.schema[k].dataType).alias(k) for k, v in row.items()])
    )
    return listed.unionByName(missing).orderBy(*order)


def with_selected_person(people: DataFrame, name: str | None) -> DataFrame:
    """The chosen person is always in the list, with zero counts if never seen."""
    if not name:
        return people
    row = {"person_name": name, "last_seen_ms": 0, "event_count": 0}
    return _with_row(people, texts.same_text("person_name", name), row, ["person_name"])


def with_selected_plate(plates: DataFrame, plate_key: str | None) -> DataFrame:
    """The chosen plate is always in the list."""
    if not plate_key:
        return plates
    row = {
        "plate_key": plate_key,
        "plate_text": plate_key.removeprefix("plate:"),
        "last_seen_ms": 0,
        "event_count": 0,
    }
    match = F.col("plate_key") == plate_key
    return _with_row(plates, match, row, ["plate_text", "plate_key"])


def person_choices(people: DataFrame, selected: str | None = None) -> DataFrame:
    """Pick list with counts and the chosen entry marked."""
    listed = with_selected_person(people, selected)
    chosen = texts.same_text("person_name", selected) if selected else F.lit(False)
    count = F.col("event_count").cast("string")
    return listed.select(
        "person_name",
        "event_count",
        F.concat("person_name", F.lit(" ("), count, F.lit(")")).alias("label"),
        chosen.alias("is_selected"),
    )


def plate_choices(plates: DataFrame, selected: str | None = None) -> DataFrame:
    """C12 for plates."""
    listed = with_selected_plate(plates, selected)
    shown = texts.plate_display("plate_text", "plate_key")
    count = F.col("event_count").cast("string")
    return listed.select(
        "plate_key",
        "event_count",
        F.concat(shown, F.lit(" ("), count, F.lit(")")).alias("label"),
        (F.col("plate_key") == F.lit(selected or "")).alias("is_selected"),
    )


def events_for_date(faces: DataFrame, date: str, person_name: str | None = None) -> DataFrame:
    """Face log of a day, oldest first."""
    found = faces.select(*FACE_COLUMNS).filter(F.col("local_date") == date)
    if person_name:
        found = found.filter(texts.same_text("person_name", person_name))
    return found.orderBy("seen_at_ms", "event_id")


def events_since(faces: DataFrame, since_ms: int) -> DataFrame:
    """Faces since a moment, newest first (S13, F4, K3). Earlier days are not read."""
    days = F.col("local_date") >= times.first_day(since_ms)
    found = faces.select(*FACE_COLUMNS).filter(days & (F.col("seen_at_ms") >= since_ms))
    return found.orderBy(F.desc("seen_at_ms"), "event_id")


def vehicle_events_for_date(
    vehicles: DataFrame, date: str, plate_key: str | None = None
) -> DataFrame:
    """Vehicle log of a day, oldest first."""
    found = vehicles.select(*VEHICLE_COLUMNS).filter(F.col("local_date") == date)
    if plate_key:
        found = found.filter(F.col("plate_key") == plate_key)
    return found.orderBy("seen_at_ms", "event_id")
