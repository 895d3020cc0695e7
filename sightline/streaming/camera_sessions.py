"""Live sessions whose gap depends on both neighbours (T5): a stateful processor per entity.

A sighting that comes late may stand between two others, so what a camera override decides is
open until the watermark has passed. The state of an entity is a list of fragments in order of
time. Sightings closer together than the smallest gap that any pair of neighbours can have
never part again, whatever arrives between them, so they are one fragment at once, and a
million sightings in a row are one entry of the state. A boundary between two fragments is
decided when the watermark reaches the later one; a session leaves the state once the
watermark is past every sighting that could still join it. An event-time timer wakes the
entity for the next of these moments, so quiet entities are closed and forgotten as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..params import GapRules

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

COLUMNS = (
    "started_at_ms long, first_event_id string, first_camera_id string,"
    " ended_at_ms long, last_event_id string, last_camera_id string, sighting_count long"
)


class Fragment(NamedTuple):
    """Sightings that belong together, by the first and the last of them."""

    started_at_ms: int
    first_event_id: str
    first_camera_id: str
    ended_at_ms: int
    last_event_id: str
    last_camera_id: str
    sighting_count: int

    def joined(self, other: Fragment) -> Fragment:
        first, last = min(self[:3], other[:3]), max(self[3:6], other[3:6])
        return Fragment(*first, *last, self.sighting_count + other.sighting_count)


class Gaps:
    """The gap rule of one entity, in milliseconds."""

    def __init__(self, key: str, rules: GapRules):
        minutes = rules.by_entity.get(key)
        self.default = rules.default_ms if minutes is None else minutes * 60_000.0
        self.cameras = {} if minutes is not None else {c: m * 60_000.0 for c, m in rules.by_camera.items() if c}
        self.least = min([self.default, *self.cameras.values()])

    def between(self, left: str, right: str) -> float:
        return self.cameras.get(left, self.default) if left == right else self.default

    def most_after(self, camera: str) -> float:
        """The longest gap to any sighting that may follow one of this camera."""
        return max(self.default, self.cameras.get(camera, 0.0))


def gathered(pieces: Iterable[Fragment], least: float) -> list[Fragment]:
    """Pieces in order of time, with those that cannot part any more put together."""
    out: list[Fragment] = []
    for piece in sorted(pieces):
        if out and piece.started_at_ms - out[-1].ended_at_ms <= least:
            out[-1] = out[-1].joined(piece)
        else:
            out.append(piece)
    return out


def settled(pieces: list[Fragment], gaps: Gaps, watermark: float) -> tuple[list[Fragment], list[Fragment]]:
    """(closed sessions, what stays): sightings at or before the watermark are all there."""
    closed, rest = [], list(pieces)
    while rest:
        head = rest[0]
        if len(rest) > 1 and rest[1].started_at_ms <= watermark:
            gap = gaps.between(head.last_camera_id, rest[1].first_camera_id)
            if rest[1].started_at_ms - head.ended_at_ms <= gap:
                rest[:2] = [head.joined(rest[1])]
                continue
        elif head.ended_at_ms + gaps.most_after(head.last_camera_id) > watermark:
            break
        closed.append(rest.pop(0))
    return closed, rest


def next_moment(rest: list[Fragment], gaps: Gaps) -> int:
    """The watermark at which `settled` can go on."""
    due = rest[0].ended_at_ms + gaps.most_after(rest[0].last_camera_id)
    return int(min([due, *(p.started_at_ms for p in rest[1:2])]))


class CameraSessions(StatefulProcessor):
    def __init__(self, key: str, rules: GapRules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gaps = Gaps(key[0], self.rules)
        new: list[Fragment] = []
        for batch in rows:
            columns = [batch[c].tolist() for c in ("seen_at_ms", "event_id", "camera_id")]
            arrived = (Fragment(int(t), e, c, int(t), e, c, 1) for t, e, c in zip(*columns, strict=True))
            new = gathered([*new, *arrived], gaps.least)
        return self._advance(key, gathered([*self._kept(), *new], gaps.least), gaps, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, self._kept(), Gaps(key[0], self.rules), timerValues)

    def _kept(self) -> list[Fragment]:
        return [Fragment(*row) for row in self.pieces.get()] if self.pieces.exists() else []

    def _advance(self, key, pieces, gaps, timerValues) -> Iterator[pd.DataFrame]:
        closed, rest = settled(pieces, gaps, timerValues.getCurrentWatermarkInMs())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.pieces.put([tuple(p) for p in rest])
            self.handle.registerTimer(next_moment(rest, gaps))
        else:
            self.pieces.clear()
        if closed:
            found = pd.DataFrame(closed, columns=Fragment._fields)
            found.insert(0, self.key, key[0])
            yield found

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """State in RocksDB, as the processor needs it, and this package on the workers' path.

    A cluster ships the package with --py-files; the provider counts for queries started later.
    """
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
        spark.conf.set(CHANGELOG, "true")
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def camera_sessions(sightings: DataFrame, key: str, rules: GapRules, watermark: str) -> DataFrame:
    """T5: closed sessions of a stream with `seen_ts`, camera overrides included.

    Sightings at or before the watermark when they arrive are dropped. Rows without an entity
    form one entity of their own; a null camera counts as no camera.
    """
    prepare(sightings.sparkSession)
    rows = sightings.withWatermark("seen_ts", watermark).select(
        F.coalesce(key, F.lit("")).alias(key),
        "seen_ts",
        "seen_at_ms",
        F.coalesce("event_id", F.lit("")).alias("event_id"),
        F.coalesce("camera_id", F.lit("")).alias("camera_id"),
    )
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=CameraSessions(key, rules),
        outputStructType=f"{key} string, {COLUMNS}",
        outputMode="append",
        timeMode="eventTime",
    )
