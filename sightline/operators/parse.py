"""Raw alarm payloads → typed alarm lines → notifications, faces, vehicles.

Everything here is narrow: one pass over the raw rows, no shuffle. The all-or-nothing rule
for bad timestamps (P6) is decided inside the row, on the trigger array, before exploding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import loose_json as lj
from ..functions import texts, times
from ..params import JobParams

# Trigger key prefixes, the id sent by test alarms, and timestamp bounds.
FACE_PREFIX = "face_"
PLATE_PREFIX = "license_plate_"
TEST_EVENT_ID = "testEventId"
MAX_EPOCH_MS = 4102444800000  # 2100-01-01 UTC
SECONDS_BELOW = 1e12
REDACTED = "[redacted]"


def sighting_kind(trigger_key: Column, vehicles: bool) -> Column:
    """`face`, `vehicle` or null by key prefix; plates only when switched on."""
    found = F.when(trigger_key.startswith(FACE_PREFIX), F.lit("face"))
    if vehicles:
        found = found.when(trigger_key.startswith(PLATE_PREFIX), F.lit("vehicle"))
    return found


def camera_wanted(camera: Column, params: JobParams) -> Column:
    """camera allow-list; an empty list lets everything through."""
    if not params.cameras:
        return F.lit(True)
    return F.lower(F.coalesce(camera, F.lit(""))).isin(*params.cameras)


def target_wanted(name: Column, person_id: Column, params: JobParams) -> Column:
    """person filter by name or id; no filter set lets everyone through."""
    if not params.target_names and not params.target_ids:
        return F.lit(True)
    hit = F.lit(False)
    if params.target_names:
        hit = hit | F.lower(name).isin(*params.target_names)
    if params.target_ids:
        hit = hit | F.lower(person_id).isin(*params.target_ids)
    return hit


def epoch_ms(raw: Column) -> Column:
    """P5: a number as epoch ms (seconds are scaled), null when invalid."""
    scaled = F.when((raw > 0) & (raw < SECONDS_BELOW), raw * 1000).otherwise(raw)
    ms = scaled.try_cast("bigint")
    return F.when(ms.between(0, MAX_EPOCH_MS), ms)


HEAD_PATHS = {
    "name": "$.alarm.name",
    "path": "$.alarm.eventPath",
    "alarm_ts": "$.alarm.timestamp",
    "root_ts": "$.timestamp",
    "root_image": "$.image",
    "alarm_image": "$.alarm.image",
    "first_event": "$.alarm.triggers[0].eventId",
}
TRIGGER_PATHS = {
    "key": "$.key",
    "device": "$.device",
    "event": "$.eventId",
    "value": "$.value",
    "group": "$.group.name",
    "ts": "$.timestamp",
    "image": "$.image",
}
CONDITION_PATHS = {"source": "$.condition.source", "value": "$.condition.value"}


def delivery_key(head: Column, triggers: Column) -> Column:
    """Hash of alarm identity, time and trigger event ids; no personal data in it.

    `head` and `triggers` are the typed fields of a payload.
    """

    def text(name):
        return F.coalesce(lj.strict_string(head[name]), F.lit(""))

    def stamp(name):
        return F.when(lj.number(head[name]).isNotNull(), lj.number_text(head[name]))

    ids = F.transform(triggers, lambda t: lj.strict_string(t["event"]))
    ids = F.array_sort(F.filter(ids, lambda i: F.coalesce(i != "", F.lit(False))))
    when = F.coalesce(stamp("alarm_ts"), stamp("root_ts"), F.lit(""))
    first = F.array(F.lit("v1"), text("name"), text("path"), when)
    return F.sha2(F.array_join(F.concat(first, ids), "\n"), 256)


def _trigger_texts(typed: Column) -> Column:
    """Typed trigger fields as plain values: texts, the two ids as sent, and the time."""

    def plain(t: Column) -> Column:
        def text(name):
            return lj.truthy_text(t[name])

        return F.struct(
            t["t"].alias("t"),
            t["event"].alias("event"),
            F.coalesce(text("key"), F.lit("")).alias("trigger_key"),
            F.coalesce(text("device"), F.lit("")).alias("camera_id"),
            text("event").alias("raw_event_id"),
            F.coalesce(text("value"), text("group")).alias("label"),
            epoch_ms(lj.number(t["ts"])).alias("seen_at_ms"),
            text("image").alias("image"),
        )

    return F.transform(typed, plain)


def check_payloads(raw: DataFrame, params: JobParams) -> DataFrame:
    """One row per raw body with its typed `triggers` and `reason` of rejection."""
    fits = F.octet_length("raw_body") <= params.max_body_bytes
    parsed = lj.parse_strict(raw, "raw_body", "payload", fits)
    triggers = lj.items(F.col("payload"), "$.alarm.triggers")
    read = parsed.withColumn(
        "triggers", _trigger_texts(lj.typed(triggers, TRIGGER_PATHS, keep="t"))
    )

    def bad_time(t: Column) -> Column:
        counted = (
            sighting_kind(t["trigger_key"], params.vehicles).isNotNull()
            & camera_wanted(t["camera_id"], params)
            & t["raw_event_id"].isNotNull()
        )
        return counted & t["seen_at_ms"].isNull()

    reason = (
        F.when(~fits, F.lit("rejected_body"))
        # A bare `null` body crashes the source system; here it counts as bad JSON.
        .when(F.col("payload").isNull(), F.lit("rejected_json"))
        .when(F.schema_of_variant("payload") == "VOID", F.lit("rejected_json"))
        .when(F.exists("triggers", bad_time), F.lit("rejected_json"))
    )
    return lj.settled(read.withColumn("reason", reason))


def _redacted_plate_json(trigger: Column) -> Column:
    """Trigger text without plate, owner name and image."""
    mask = F.parse_json(F.lit(f'"{REDACTED}"'))
    fields = F.try_variant_get(trigger, "$", "map<string,variant>")
    group = F.try_variant_get(trigger, "$.group", "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin("value", "image", "group"))
    masked_group = F.to_variant_object(
        F.map_concat(
            F.map_filter(group, lambda k, _: k != "name"), F.create_map(F.lit("name"), mask)
        )
    )
    masked = F.map_concat(kept, F.create_map(F.lit("value"), mask))
    return F.when(
        group.isNotNull(),
        F.to_json(F.map_concat(masked, F.create_map(F.lit("group"), masked_group))),
    ).otherwise(F.to_json(masked))


_HEAD_COLUMNS = [
    "reason", "notification_id", "delivery_key", "received_at_ms", "source_ip", "head_event_id",
    "local_date", "alarm_text", "note_image", "outer_image", "conditions",
]


def alarm_lines(raw: DataFrame, params: JobParams) -> DataFrame:
    """One row per trigger (P1); payloads without triggers and rejects keep one row.

    `kind` is `face`, `vehicle` or null. `is_head` marks the one row per payload that also
    carries the notification itself, so a single parsed frame feeds every sink.
    """
    ok = F.col("reason").isNull()
    p = F.when(ok, F.col("payload"))
    conditions = F.transform(
        lj.typed(lj.items(p, "$.alarm.conditions"), CONDITION_PATHS),
        lambda c: F.struct(
            lj.strict_string(c["source"]).alias("source"),
            F.coalesce(lj.truthy_text(c["value"]), F.lit("")).alias("value"),
        ),
    )
    h = F.col("head")
    heads = (
        check_payloads(raw, params)
        .withColumns({"head": lj.typed_one(p, HEAD_PATHS), "conditions": conditions})
        .withColumns(
            {
                "notification_id": F.sha2(
                    F.concat_ws("\n", "received_at_ms", "source_ip", "raw_body"), 256
                ),
                "local_date": times.local_date("received_at_ms", params.zone),
                "triggers": F.when(ok & (F.size("triggers") > 0), F.col("triggers")),
                "delivery_key": F.when(
                    ok, delivery_key(h, F.coalesce("triggers", F.array()))
                ),
                "head_event_id": F.coalesce(lj.truthy_text(h["first_event"]), F.lit("N/A")),
                "alarm_text": lj.truthy_text(h["name"]),
                "outer_image": F.coalesce(
                    lj.truthy_text(h["root_image"]), lj.truthy_text(h["alarm_image"])
                ),
            }
        )
        .withColumn("note_image", texts.jpeg_base64("outer_image"))
    )
    # The full body travels with the first line only and the parsed payload with none, so
    # a payload with many triggers is not copied once per trigger. All columns are generated
    # ones, for the reason given at `settled`. `inline` without `outer` would make Spark infer
    # a "not empty" filter below the parsing.
    def line(t: Column, i: Column) -> Column:
        return F.struct(
            *[F.col(c).alias(c) for c in _HEAD_COLUMNS],
            F.when(i == 0, F.col("raw_body")).alias("raw_body"),
            F.when(t.isNotNull(), i).alias("pos"),
            t["t"].alias("t"),
            F.coalesce(t["trigger_key"], F.lit("")).alias("trigger_key"),
            F.coalesce(t["camera_id"], F.lit("")).alias("camera_id"),
            *[t[c].alias(c) for c in ("raw_event_id", "label", "seen_at_ms", "image")],
        )

    entries = F.transform(F.coalesce("triggers", F.array(F.lit(None))), line)
    pulled = heads.select(F.inline_outer(entries))
    match = F.get(
        F.filter(
            "conditions",
            lambda c: F.coalesce(c["source"] == F.col("trigger_key"), F.lit(False)),
        ),
        F.lit(0),
    )
    named = pulled.withColumns(
        {
            "person_id": F.coalesce(match["value"], F.lit("")),
            "person_name": F.coalesce("label", F.lit("Unknown")),
            "own_image": F.coalesce("image", "outer_image"),
        }
    )
    t = F.col("t")
    found = sighting_kind(F.col("trigger_key"), params.vehicles)
    usable = F.col("raw_event_id").isNotNull() & camera_wanted(F.col("camera_id"), params)
    wanted = (found == "vehicle") | target_wanted(
        F.col("person_name"), F.col("person_id"), params
    )
    typed = named.withColumn("kind", F.when(usable & wanted, found))
    is_face, is_vehicle = F.col("kind") == "face", F.col("kind") == "vehicle"
    plate_text = F.coalesce(texts.trimmed("label"), F.lit(""))
    is_head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return typed.select(
        "reason",
        "kind",
        is_head.alias("is_head"),
        "notification_id",
        "delivery_key",
        "received_at_ms",
        "source_ip",
        "head_event_id",
        F.col("local_date").alias("received_date"),
        "raw_body",
        "note_image",
        F.col("alarm_text"),
        F.col("pos"),
        F.sha2(F.concat_ws("\n", "notification_id", "pos"), 256).alias("id"),
        F.when(
            F.col("raw_event_id") == TEST_EVENT_ID,
            F.concat(F.lit(TEST_EVENT_ID + "-"), F.col("received_at_ms").cast("string")),
        )
        .otherwise(F.col("raw_event_id"))
        .alias("event_id"),
        "seen_at_ms",
        times.local_date("seen_at_ms", params.zone).alias("local_date"),
        F.when(is_face, texts.person_key(F.col("person_id"), F.col("person_name"))).alias(
            "person_key"
        ),
        F.when(is_face, F.col("person_name")).alias("person_name"),
        F.when(is_face, F.col("person_id")).alias("person_id"),
        F.when(is_vehicle, texts.plate_key(plate_text)).alias("plate_key"),
        F.when(is_vehicle, plate_text).alias("plate_text"),
        "trigger_key",
        "camera_id",
        F.when(is_face, F.to_json("t"))
        .when(is_vehicle, _redacted_plate_json(t))
        .alias("raw_trigger_json"),
        F.coalesce(texts.jpeg_base64("own_image"), F.col("note_image")).alias("image_base64"),
    )


def notifications_of(lines: DataFrame) -> DataFrame:
    """One notification row per accepted payload, before deduplication."""
    return lines.filter(F.col("is_head") & F.col("reason").isNull()).select(
        F.col("notification_id").alias("id"),
        "received_at_ms",
        "source_ip",
        F.col("head_event_id").alias("event_id"),
        F.coalesce("alarm_text", F.lit("N/A")).alias("alarm_name"),
        F.col("raw_body").alias("payload_json"),
        F.col("note_image").alias("image_base64"),
        "delivery_key",
        F.col("received_date").alias("local_date"),
    )


_SHARED = ["id", "notification_id", "event_id", "seen_at_ms", "local_date"]
_TAIL = ["trigger_key", "camera_id", "alarm_name", "raw_trigger_json", "image_base64"]
_ORDER = ["received_at_ms", "pos", "delivery_key"]


def _sightings_of(lines: DataFrame, kind: str, own: list[str]) -> DataFrame:
    return (
        lines.filter((F.col("kind") == kind) & F.col("reason").isNull())
        .withColumn("alarm_name", F.coalesce("alarm_text", F.lit("")))
        .select(*_SHARED, *own, *_TAIL, *_ORDER)
    )


def faces_of(lines: DataFrame) -> DataFrame:
    """Face sightings with their arrival order columns, before deduplication."""
    return _sightings_of(lines, "face", ["person_key", "person_name", "person_id"])


def vehicles_of(lines: DataFrame) -> DataFrame:
    """Vehicle sightings with their arrival order columns, before deduplication."""
    return _sightings_of(lines, "vehicle", ["plate_key", "plate_text"])


def rejects_of(lines: DataFrame) -> DataFrame:
    """Rejected bodies with the reason (`rejected_body` or `rejected_json`)."""
    return lines.filter(F.col("is_head") & F.col("reason").isNotNull()).select(
        "raw_body",
        "received_at_ms",
        "source_ip",
        "reason",
        F.col("received_date").alias("local_date"),
    )


def parse_payloads(raw: DataFrame, params: JobParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, vehicles, rejects) of a raw frame."""
    lines = alarm_lines(raw, params)
    return faces_of(lines), vehicles_of(lines), rejects_of(lines)
