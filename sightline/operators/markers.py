"""Operational markers: an append-only log of key/value pairs, newest wins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import loose_json as lj

# Marker keys.
REPORT_AT = "ops:last_cron_report_at_ms"
REPORT_DATE = "ops:last_cron_report_date"
CLEANUP_AT = "ops:last_cleanup_at_ms"
CLEANUP_SUMMARY = "ops:last_cleanup_summary"
FK_CHECK_AT = "ops:last_fk_check_at_ms"
FK_CHECK_OK = "ops:last_fk_check_ok"
STORE_ERROR_AT = "ops:last_d1_error_at_ms"
STORE_ERROR = "ops:last_d1_error"
CRON_ERROR = "ops:last_cron_error"

_CODE_CHARS = 64
REDACTED = "[redacted]"


def report_ok(date: str, at_ms: int) -> list[tuple]:
    """A successful report also clears the last scheduled-job error."""
    return [(REPORT_AT, str(at_ms), at_ms), (REPORT_DATE, date, at_ms), (CRON_ERROR, None, at_ms)]


def cleanup_ok(summary: dict[str, int], at_ms: int) -> list[tuple]:
    return [(CLEANUP_AT, str(at_ms), at_ms), (CLEANUP_SUMMARY, json.dumps(summary), at_ms)]


def fk_check_ok(at_ms: int) -> list[tuple]:
    return [(FK_CHECK_AT, str(at_ms), at_ms), (FK_CHECK_OK, "1", at_ms)]


def _error(code: str, operation: str, at_ms: int) -> str:
    fields = {"code": code[:_CODE_CHARS], "operation": operation[:_CODE_CHARS], "at_ms": at_ms}
    return json.dumps(fields)


def store_error(code: str, operation: str, at_ms: int) -> list[tuple]:
    return [
        (STORE_ERROR_AT, str(at_ms), at_ms),
        (STORE_ERROR, _error(code, operation, at_ms), at_ms),
    ]


def cron_error(code: str, operation: str, at_ms: int) -> list[tuple]:
    return [(CRON_ERROR, _error(code, operation, at_ms), at_ms)]


def latest_markers(markers: DataFrame) -> DataFrame:
    """Newest value per key; a null value is a deletion.

    Of values with one time the greatest text counts, and any text before a deletion.
    """
    newest = markers.groupBy("key").agg(F.max(F.struct("at_ms", "value")).alias("newest"))
    newest = newest.select("key", "newest.value")
    return newest.filter("value IS NOT NULL")


def _error_struct(value: str, parsed: str, now_ms: int) -> F.Column:
    """Typed error marker. Text that is not JSON is an old-style marker; other JSON is none.

    The message of an old marker may hold a statement with values, so it is never shown.
    """
    fields = lj.typed_one(
        F.col(parsed), {"code": "$.code", "operation": "$.operation", "at_ms": "$.at_ms", "message": "$.message"}
    )

    def text(name, default):
        return F.coalesce(lj.strict_string(fields[name]), F.lit(default))

    kind = F.schema_of_variant(parsed)
    at_ms = F.coalesce(lj.number(fields["at_ms"]).cast("long"), F.lit(now_ms))
    redacted = F.lit(REDACTED)
    typed = F.struct(
        text("code", "UNKNOWN").alias("code"),
        text("operation", "unknown").alias("operation"),
        at_ms.cast("long").alias("at_ms"),
        F.when(lj.strict_string(fields["message"]).isNotNull(), redacted).alias("message"),
    )
    legacy = F.struct(
        F.lit("LEGACY").alias("code"),
        F.lit("unknown").alias("operation"),
        F.lit(now_ms).cast("long").alias("at_ms"),
        redacted.alias("message"),
    )
    return (
        F.when(F.col(value).isNull() | (F.col(value) == ""), None)
        .when(F.col(parsed).isNull(), legacy)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), typed)
    )


def read_markers(markers: DataFrame, now_ms: int) -> DataFrame:
    """All markers decoded into one row."""
    wide = latest_markers(markers).agg(
        *[
            F.max(F.when(F.col("key") == key, F.col("value"))).alias(name)
            for name, key in {
                "report_at": REPORT_AT,
                "report_date": REPORT_DATE,
                "cleanup_at": CLEANUP_AT,
                "cleanup_summary": CLEANUP_SUMMARY,
                "fk_at": FK_CHECK_AT,
                "fk_ok": FK_CHECK_OK,
                "store_at": STORE_ERROR_AT,
                "store_error": STORE_ERROR,
                "cron_error": CRON_ERROR,
            }.items()
        ]
    )
    wide = lj.parse_strict(wide, "store_error", "store_json", F.lit(True))
    wide = lj.parse_strict(wide, "cron_error", "cron_json", F.lit(True))
    wide = wide.withColumns(
        {
            "d1": _error_struct("store_error", "store_json", now_ms),
            "cron": _error_struct("cron_error", "cron_json", now_ms),
        }
    )

    def number(c):
        return F.col(c).try_cast("double").cast("long")

    return wide.select(
        number("report_at").alias("last_cron_report_at_ms"),
        F.col("report_date").alias("last_cron_report_date"),
        number("cleanup_at").alias("last_cleanup_at_ms"),
        F.from_json("cleanup_summary", "map<string,bigint>").alias("last_cleanup_summary"),
        number("fk_at").alias("last_fk_check_at_ms"),
        (F.col("fk_ok") == "1").alias("last_fk_check_ok"),
        F.coalesce(number("store_at"), F.col("d1.at_ms")).alias("last_d1_error_at_ms"),
        F.col("d1").alias("last_d1_error"),
        F.col("cron").alias("last_cron_error"),
    )
