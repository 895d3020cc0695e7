"""Gap overrides by entity and by camera."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import GapRules


def _minutes_for(df: DataFrame, column: str, overrides, out: str) -> DataFrame:
    if not overrides:
        return df.withColumn(out, F.lit(None).cast("double"))
    in_ms = {k: float(v) * 60_000.0 for k, v in overrides.items()}
    # An Arrow table keeps its exact size in the plan: Spark broadcasts it only below
    # spark.sql.autoBroadcastJoinThreshold and otherwise joins by shuffle.
    table = df.sparkSession.createDataFrame(
        pa.table({"_k": list(in_ms), out: list(in_ms.values())})
    )
    return df.join(table, df[column] == table["_k"], "left").drop("_k")


def attach_gaps(df: DataFrame, entity: str, camera: str, rules: GapRules) -> DataFrame:
    """Add `entity_gap_ms` and `camera_gap_ms`, null where there is no override."""
    out = _minutes_for(df, entity, rules.by_entity, "entity_gap_ms")
    return _minutes_for(out, camera, rules.by_camera, "camera_gap_ms")


def gap_between(
    left_camera: Column, right_camera: Column, camera_gap: Column, rules: GapRules
) -> Column:
    """Gap of two neighbours: the camera override counts only on one and the same camera.

    Only the entity override is read by name (`entity_gap_ms`); `camera_gap` may be the
    override of either side, as it counts only when the cameras are equal.
    """
    same = (left_camera == right_camera) & (right_camera != "")
    return F.coalesce(
        F.col("entity_gap_ms"), F.when(same, camera_gap), F.lit(rules.default_ms)
    )


def gap_after(camera: Column, camera_gap: Column, rules: GapRules) -> Column:
    """Gap after the last sighting, for open / present tests: its own camera counts."""
    return F.coalesce(
        F.col("entity_gap_ms"), F.when(camera != "", camera_gap), F.lit(rules.default_ms)
    )
