"""Gap sessionisation.

Skew: one key (say `plate:unknown`) may hold a large part of all sightings, so no key's
rows are ever sorted by one task as a whole. The same stitching step runs twice:

1. by (scope, key, time slice): sightings of a slice become fragments, cut by the gap rule;
2. by (scope, key): neighbouring fragments are merged if their facing ends are within the gap.

Cutting looks only at neighbours in time, and the neighbours across a slice border are the
last fragment of one slice and the first of the next, so the result equals one pass over the
sorted sightings. Fragments of one slice lie more than a gap apart: a key has at most
`time span / min(gap, slice)` fragments, whatever its number of sightings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts, times
from ..params import HOUR_MS, GapRules
from .gaps import attach_gaps, gap_after, gap_between

SLICE_MS = HOUR_MS


def _stitch(pieces: DataFrame, by: list[str], rules: GapRules) -> DataFrame:
    """Merge neighbouring pieces within the gap. One shuffle and one sort, no aggregate.

    A piece opens a session if the gap before it is too long and closes one if the gap after
    it is. Only those border rows are kept, and each opening row takes its end from the next.
    """
    order = Window.partitionBy(*by).orderBy("start_ms", "start_event")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap_before = gap_between(
        F.lag("end_camera").over(order),
        F.col("start_camera"),
        F.col("start_camera_gap_ms"),
        rules,
    )
    gap_behind = gap_between(
        F.lead("start_camera").over(order),
        F.col("end_camera"),
        F.col("end_camera_gap_ms"),
        rules,
    )
    opens = F.col("start_ms") - F.lag("end_ms").over(order) > gap_before
    closes = F.lead("start_ms").over(order) - F.col("end_ms") > gap_behind
    last_text = F.last(
        F.when(F.col("text").isNotNull(), F.struct("start_ms", "start_event", "text")),
        ignorenulls=True,
    )
    borders = pieces.withColumns(
        {
            "_opens": F.coalesce(opens, F.lit(True)),
            "_closes": F.coalesce(closes, F.lit(True)),
            "_upto": F.sum("n").over(upto),
            "_text": last_text.over(upto),
        }
    ).filter("_opens OR _closes")
    end = F.struct("end_ms", "end_event", "end_camera", "end_camera_gap_ms", "_upto", "_text")
    paired = borders.withColumn(
        "_end", F.when(F.col("_closes"), end).otherwise(F.lead(end).over(order))
    ).filter("_opens")
    text_since_start = F.struct("_end._text.start_ms", "_end._text.start_event") >= F.struct(
        "start_ms", "start_event"
    )
    return paired.select(
        *by,
        "name",
        "day",
        "entity_gap_ms",
        "start_ms",
        "start_event",
        "start_camera",
        "start_camera_gap_ms",
        F.col("_end.end_ms").alias("end_ms"),
        F.col("_end.end_event").alias("end_event"),
        F.col("_end.end_camera").alias("end_camera"),
        F.col("_end.end_camera_gap_ms").alias("end_camera_gap_ms"),
        F.when(text_since_start, F.col("_end._text.text")).alias("text"),
        (F.col("_end._upto") - F.col("_upto") + F.col("n")).alias("n"),
    )


def stitched_sessions(
    sightings: DataFrame,
    key: str,
    rules: GapRules,
    scope: tuple[str, ...] = (),
    name: str | None = None,
    last_text: str | None = None,
    slice_ms: int | None = SLICE_MS,
) -> DataFrame:
    """Sessions with working columns (gaps of the last camera); see `gap_sessions`."""
    by = [c for c in dict.fromkeys((*scope, key))]

    def text(column):
        return F.col(column) if column else F.lit(None).cast("string")

    pieces = attach_gaps(sightings, key, "camera_id", rules).select(
        *by,
        text(name).alias("name"),
        F.col("local_date").alias("day"),
        "entity_gap_ms",
        F.col("seen_at_ms").alias("start_ms"),
        F.col("event_id").alias("start_event"),
        F.col("camera_id").alias("start_camera"),
        F.col("camera_gap_ms").alias("start_camera_gap_ms"),
        F.col("seen_at_ms").alias("end_ms"),
        F.col("event_id").alias("end_event"),
        F.col("camera_id").alias("end_camera"),
        F.col("camera_gap_ms").alias("end_camera_gap_ms"),
        texts.blank_to_null(text(last_text)).alias("text"),
        F.lit(1).cast("long").alias("n"),
    )
    if slice_ms:
        sliced = pieces.withColumn("_slice", F.floor(F.col("start_ms") / F.lit(slice_ms)))
        pieces = _stitch(sliced, [*by, "_slice"], rules).drop("_slice")
    return _stitch(pieces, by, rules)


def _columns(df: DataFrame, key: str, scope: tuple[str, ...], middle: list) -> DataFrame:
    keep = [c for c in scope if c not in (key, "local_date")]
    return df.select(
        *keep,
        F.col(key),
        *middle,
        # With days in the scope, keep its column: it carries the partitioning onwards.
        F.col("local_date" if "local_date" in scope else "day").alias("local_date"),
        F.col("start_ms").alias("started_at_ms"),
        F.col("end_ms").alias("ended_at_ms"),
        F.col("start_event").alias("first_event_id"),
        F.col("end_event").alias("last_event_id"),
        F.col("start_camera").alias("first_camera_id"),
        F.col("end_camera").alias("last_camera_id"),
        F.col("n").alias("sighting_count"),
        "entity_gap_ms",
        "end_camera_gap_ms",
    )


_WORKING = ("entity_gap_ms", "end_camera_gap_ms")


def gap_sessions(
    faces: DataFrame,
    rules: GapRules,
    scope: tuple[str, ...] = ("local_date",),
    slice_ms: int | None = SLICE_MS,
    keep_gaps: bool = False,
) -> DataFrame:
    """Face sessions by person, within one local day unless `scope` is empty.

    A new session starts when a sighting comes *more* than the gap after the previous one.
    """
    found = stitched_sessions(faces, "person_key", rules, scope, "person_name", None, slice_ms)
    out = _columns(found, "person_key", scope, [F.col("name").alias("person_name")])
    return out if keep_gaps else out.drop(*_WORKING)


def vehicle_sessions(
    vehicles: DataFrame,
    rules: GapRules,
    scope: tuple[str, ...] = (),
    slice_ms: int | None = SLICE_MS,
    keep_gaps: bool = False,
) -> DataFrame:
    """Visits by plate over all days; the text is the last one read, else the bare key."""
    found = stitched_sessions(vehicles, "plate_key", rules, scope, None, "plate_text", slice_ms)
    plate = F.coalesce("text", texts.bare_plate("plate_key")).alias("plate_text")
    out = _columns(found, "plate_key", scope, [plate])
    return out if keep_gaps else out.drop(*_WORKING)


def is_recent(ended_at: str, now_ms: int, rules: GapRules):
    """Still within the gap of the person and the last camera at `now`."""
    gap = gap_after(F.col("last_camera_id"), F.col("end_camera_gap_ms"), rules)
    return F.lit(now_ms) - F.col(ended_at) <= gap


def presence_sessions(
    faces: DataFrame,
    rules: GapRules,
    generated_at_ms: int,
    now_ms: int | None = None,
    scope: tuple[str, ...] = ("local_date",),
) -> DataFrame:
    """Rows of the `presence_sessions` table. `is_open` needs a `now`, else it is 0."""
    drafts = gap_sessions(faces, rules, scope, keep_gaps=True)
    span = times.span_ms("started_at_ms", "ended_at_ms")
    is_open = F.lit(0)
    if now_ms is not None:
        is_open = F.when(is_recent("ended_at_ms", now_ms, rules), 1).otherwise(0)
    return drafts.select(
        F.sha2(F.concat_ws("\n", "person_key", "started_at_ms", "first_event_id"), 256).alias("id"),
        "local_date",
        "person_key",
        "person_name",
        "started_at_ms",
        "ended_at_ms",
        times.seconds(span).alias("duration_seconds"),
        times.ceil_quarter_minutes(span).alias("rounded_duration_minutes"),
        "sighting_count",
        "first_event_id",
        "last_event_id",
        "first_camera_id",
        "last_camera_id",
        is_open.cast("int").alias("is_open"),
        F.lit(generated_at_ms).cast("long").alias("generated_at_ms"),
    )
