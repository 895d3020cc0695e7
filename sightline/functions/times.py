"""Time expressions over epoch milliseconds.

They work on integers and zone-less days, so results do not depend on
`spark.sql.session.timeZone`.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER_MS = 900_000.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_ms(ms, zone: str) -> Column:
    """Wall clock of an epoch in an IANA zone, as milliseconds since 1970 on that clock.

    `from_utc_timestamp` is about ten times faster here than `convert_timezone`, which looks
    the zone up for every row. Going on in integers keeps the session zone out of it.
    """
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(_col(ms)), zone))


def _local_day(ms, zone: str) -> Column:
    return F.date_from_unix_date(F.floor(local_ms(ms, zone) / F.lit(86_400_000.0)).cast("int"))


def _of_day(ms, zone: str) -> Column:
    return F.pmod(local_ms(ms, zone), F.lit(86_400_000))


def local_date(ms, zone: str) -> Column:
    """Calendar day of an epoch in a zone, as text."""
    return _local_day(ms, zone).cast("string")


def ceil_quarter_minutes(ms) -> Column:
    """Minutes, rounded *up* to the next quarter hour."""
    return (F.ceil(_col(ms) / F.lit(QUARTER_MS)) * 15).cast("long")


def quarter_hours(minutes) -> Column:
    """Rounded minutes as hours (always a multiple of .25)."""
    return _col(minutes) / F.lit(60.0)


def span_ms(start, end) -> Column:
    """X4 in milliseconds, never negative. Sum these and divide once."""
    return F.greatest(F.lit(0).cast("long"), _col(end) - _col(start))


def seconds(ms) -> Column:
    return _col(ms) / F.lit(1000.0)


def minute_of_day(ms, zone: str) -> Column:
    """Minutes from local midnight."""
    return F.floor(_of_day(ms, zone) / F.lit(60_000.0)).cast("int")


def minutes_label(minutes) -> Column:
    """Minutes as `HH:MM`, halves up, wrapped at 24 h; null stays null."""
    total = F.floor(_col(minutes) + F.lit(0.5)) % 1440
    return F.concat(
        F.lpad(F.floor(total / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((total % 60).cast("string"), 2, "0"),
    )


#: No clock on Earth has been further from UTC, local mean times of the 19th century included.
FARTHEST_HOURS = 16


def _utc_day(ms: int) -> str:
    return str((datetime(1970, 1, 1) + timedelta(milliseconds=ms)).date())


def first_day(since_ms: int) -> str:
    """The earliest local date, in any zone, of a moment at or after `since_ms`.

    Beside an exact test on epoch columns it lets Spark leave out day partitions.
    """
    return _utc_day(since_ms - FARTHEST_HOURS * 3_600_000)


def last_day(until_ms: int) -> str:
    """The latest local date, in any zone, of a moment at or before `until_ms`."""
    return _utc_day(until_ms + FARTHEST_HOURS * 3_600_000)


def days_before(date_text, days: int) -> Column:
    """The calendar day N days earlier."""
    return F.date_sub(_col(date_text).cast("date"), days).cast("string")


def shift_day(date_text, days: int) -> Column:
    """Previous (-1) / next (+1) day."""
    return F.date_add(_col(date_text).cast("date"), days).cast("string")


def _first_of_month(month_text) -> Column:
    return F.concat(_col(month_text), F.lit("-01")).cast("date")


def shift_month(month_text, months: int) -> Column:
    """Previous / next month as `YYYY-MM`."""
    return F.substring(F.add_months(_first_of_month(month_text), months).cast("string"), 1, 7)


def first_weekday(month_text) -> Column:
    """Weekday of the 1st, Sunday = 0."""
    return F.dayofweek(_first_of_month(month_text)) - 1


def days_in_month(month_text) -> Column:
    """Number of days."""
    return F.dayofmonth(F.last_day(_first_of_month(month_text)))


def month_days(month_text) -> Column:
    """Array of every day of a month, as text (at most 31)."""
    first = _first_of_month(month_text)
    return F.transform(F.sequence(first, F.last_day(first)), lambda d: d.cast("string"))


def age_label(ms, now_ms, never: str = "never") -> Column:
    """`12s ago` / `5m ago` / `47h ago` / `2d ago`; null gives `never`."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else _col(now_ms)
    secs = F.greatest(F.lit(0).cast("long"), F.floor((now - _col(ms)) / F.lit(1000.0)))
    mins, hours = F.floor(secs / 60.0), F.floor(secs / 3600.0)

    def label(value, unit):
        return F.concat(value.cast("long").cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(_col(ms).isNull(), F.lit(never))
        .when(secs < 60, label(secs, "s"))
        .when(mins < 60, label(mins, "m"))
        .when(hours < 48, label(hours, "h"))
        .otherwise(label(F.floor(hours / 24.0), "d"))
    )


# Screens show clocks in this zone whatever the job zone is.
DISPLAY_ZONE = "America/New_York"


def clock_label(ms, with_seconds: bool = False) -> Column:
    """X11: `HH:mm` or `HH:mm:ss`."""
    second = F.floor(_of_day(ms, DISPLAY_ZONE) / F.lit(1000.0))
    parts = [second / 3600, second / 60 % 60, second % 60]
    two = [F.lpad(F.floor(p).cast("string"), 2, "0") for p in parts]
    return F.concat_ws(":", *two[: 3 if with_seconds else 2])


def moment_label(ms) -> Column:
    """X11: `Jan 5, 2024, 09:03`."""
    day = F.date_format(_local_day(ms, DISPLAY_ZONE), "MMM d, yyyy")
    return F.concat(day, F.lit(", "), clock_label(ms))


def valid_month(text) -> Column:
    """`YYYY-MM` with a real month, years 2000–2100."""
    c = _col(text)
    year = F.substring(c, 1, 4).try_cast("int")
    month = F.substring(c, 6, 2).try_cast("int")
    ok = c.rlike(r"\A[0-9]{4}-[0-9]{2}\z") & month.between(1, 12) & year.between(2000, 2100)
    return F.coalesce(ok, F.lit(False))


def valid_date(text) -> Column:
    """a real `YYYY-MM-DD` day, years 2000–2100."""
    c = _col(text)
    ok = (
        c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
        & c.try_cast("date").isNotNull()
        & F.substring(c, 1, 4).try_cast("int").between(2000, 2100)
    )
    return F.coalesce(ok, F.lit(False))
