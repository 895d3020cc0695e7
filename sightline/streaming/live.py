"""Live sessions on a stream (T4, T5).

`session_window` merges a sighting that comes exactly one gap later, as the batch rule does.
Its gap belongs to single sightings, so it can carry a default and per-entity overrides, but
not the camera override, which depends on two neighbours. With camera overrides the sessions
come from the stateful processor in `camera_sessions`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import GapRules
from .camera_sessions import camera_sessions


def entity_gap(key: str, rules: GapRules) -> Column:
    """Gap of an entity as interval text for `session_window`."""
    pairs = [(name, _milliseconds(minutes * 60_000)) for name, minutes in rules.by_entity.items()]
    gaps = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    return F.coalesce(F.try_element_at(gaps, F.col(key)), F.lit(_milliseconds(rules.default_ms)))


def _milliseconds(ms: float) -> str:
    return f"{int(ms)} milliseconds"


def live_sessions(
    sightings: DataFrame, key: str, rules: GapRules, watermark: str = "10 minutes"
) -> DataFrame:
    """T4/T5: sessions by entity of a stream with `seen_ts`; in append mode closed ones only.

    `spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition` merges sessions on
    the map side, so a hot entity sends merged sessions, not sightings, through the shuffle.
    """
    if rules.by_camera:
        found = camera_sessions(sightings, key, rules, watermark)
        return found.select(key, "started_at_ms", "ended_at_ms", "sighting_count")
    gap = entity_gap(key, rules) if rules.by_entity else _milliseconds(rules.default_ms)
    window = F.session_window("seen_ts", gap)
    return (
        sightings.withWatermark("seen_ts", watermark)
        .groupBy(window.alias("session"), key)
        .agg(
            F.min("seen_at_ms").alias("started_at_ms"),
            F.max("seen_at_ms").alias("ended_at_ms"),
            F.count("*").alias("sighting_count"),
        )
        .select(key, "started_at_ms", "ended_at_ms", "sighting_count")
    )
