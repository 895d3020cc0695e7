"""Helper for one-row results made of several aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Columns of one-row frames in one row: a union and a final aggregate, no cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.any_value(c, True).alias(c) for c in stacked.columns])
