"""Month calendar and year heat grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from .reports import reports_for_month

HEAT_LEVELS = 10
LEAST_MAX_HOURS = 0.25
GRID_MONTHS = 12


def month_calendar(reports: DataFrame, month: str, person_name: str | None = None) -> DataFrame:
    """Every day of a month with its people; days without reports keep one empty row.

    The empty days are found by an anti-join of the (at most 31) days with the distinct report
    days and then added. A join of days to reports would gather each day in one task.
    """
    found = reports_for_month(reports, month, person_name).select(
        "local_date",
        "person_key",
        "person_name",
        times.clock_label("first_seen_ms").alias("first_time"),
        times.clock_label("last_seen_ms").alias("last_time"),
        F.coalesce("observed_rounded_hours", "rounded_span_hours").alias("observed_hours"),
        F.col("rounded_span_hours").alias("wall_hours"),
        "session_count",
    )
    spine = reports.sparkSession.range(1).select(
        F.explode(times.month_days(F.lit(month))).alias("local_date")
    )
    empty = spine.join(found.select("local_date").distinct(), "local_date", "left_anti")
    cells = found.unionByName(empty, allowMissingColumns=True)
    weekday = F.dayofweek(F.col("local_date").cast("date")) - 1
    return cells.select(
        "*",
        F.dayofmonth(F.col("local_date").cast("date")).alias("day"),
        weekday.alias("weekday"),
        F.col("person_key").isNotNull().alias("is_active"),
    ).orderBy("local_date", "person_name", "person_key")


def heat_hours() -> F.Column:
    """Rounded hours of a heat entry, or the exact ones where those are zero or missing."""
    rounded = F.col("observed_rounded_hours")
    return F.when(rounded != 0, rounded).otherwise(F.col("observed_span_seconds") / F.lit(3600.0))


def heat_level(hours: F.Column, most: F.Column) -> F.Column:
    """0..10 in relation to the busiest day (taken as at least a quarter hour)."""
    share = F.least(F.lit(1.0), hours / F.greatest(F.lit(LEAST_MAX_HOURS), most))
    level = F.floor(share * HEAT_LEVELS + F.lit(0.5))
    return F.greatest(F.lit(0), F.least(F.lit(HEAT_LEVELS), level)).cast("int")


def grid_bounds(utc_today: str) -> tuple[F.Column, F.Column]:
    """First and last day of the grid. Going back keeps the day of the month and lets it run
    over into the next month where the target month is shorter."""
    today = F.lit(utc_today).cast("date")
    back = F.add_months(F.trunc(today, "MM"), 1 - GRID_MONTHS)
    start = F.trunc(F.date_add(back, F.dayofmonth(today) - 1), "MM")
    return start, F.last_day(today)


def heat_grid(heat: DataFrame, key: str, utc_today: str) -> DataFrame:
    """C11: one row per entity and day of the last twelve months, with hours and level.

    `heat` has one row per entity and day (`local_date`, `observed_span_seconds`,
    `observed_rounded_hours`). The spine is made inside each entity's row from its map of at
    most a year of days, so entities are neither crossed with days nor shuffled again.
    """
    start, end = grid_bounds(utc_today)
    per_entity = (
        heat.withColumn("hours", heat_hours())
        .groupBy(key)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("local_date", "hours"))).alias("by_day"),
            F.max("hours").alias("most"),
        )
    )
    cells = F.transform(
        F.sequence(start, end),
        lambda d: F.struct(
            d.cast("string").alias("local_date"),
            F.try_element_at("by_day", d.cast("string")).alias("found"),
        ),
    )
    found = F.col("found")
    level = F.when(found.isNull(), 0).otherwise(heat_level(found, F.col("most")))
    return per_entity.select(key, "most", F.inline(cells)).select(
        key,
        "local_date",
        F.coalesce(found, F.lit(0.0)).alias("hours"),
        level.cast("int").alias("level"),
    )


def profile_heat(profiles: DataFrame, key: str) -> DataFrame:
    """Heat lists of profiles as rows."""
    return profiles.select(key, F.inline("heatmap"))
