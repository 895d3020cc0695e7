"""Late materialisation: rank narrow rows, fetch the wide ones of the winners.

A row of a file is known by its file and its place there. What decides a rank is a few short
columns; raw text and images, which make up nearly all of a row, are read afterwards and
only take part in one equi-join on the place, never in a sort or a group limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["_file", "_row"]


def located(df: DataFrame) -> DataFrame | None:
    """`df` with the place of each row; none if it is not read from files row by row."""
    try:
        return df.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
        )
    except AnalysisException:
        return None


def fetched(wide: DataFrame, chosen: DataFrame) -> DataFrame:
    """Located rows at the places in `chosen`, with its further columns.

    A staged `chosen` has a size that Spark knows: below its broadcast threshold nothing wide
    is shuffled.
    """
    return wide.join(chosen, PLACE).drop(*PLACE)


def fetch_winners(
    wide: DataFrame, winners: DataFrame, stage: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Wide rows of ranked places. With `stage`, which writes the winners and reads them back,
    only days that have a winner are read; without it a hash table of the winners spares the
    wide side a sort."""
    if stage is None:
        return fetched(wide, winners.hint("shuffle_hash"))
    winners = stage(winners)
    if "local_date" in wide.columns and "local_date" in winners.columns:
        days = [r.local_date for r in winners.select("local_date").distinct().collect()]
        wide, winners = wide.filter(F.col("local_date").isin(days)), winners.drop("local_date")
    return fetched(wide, winners)
