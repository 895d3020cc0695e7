"""Scheduled jobs: retention on the stored tables, and the daily run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts, times
from ..operators import markers, retention
from ..operators.upserts import orphans
from ..params import HOUR_MS, JobParams
from ..schemas import MARKERS
from ..sources.tables import Tables
from . import facts, key_ledger
from .materialize import materialize_date

REPORT_LAG_MS = 12 * HOUR_MS


def _aged_days(tables: Tables, table: str, now_ms: int) -> tuple[set[str], dict[str, int]]:
    """(days with rows to drop or scrub, their numbers by metric), in one pass over old days."""
    found = retention.day_counts(tables.read(table), table, now_ms).collect()
    names = {n: metric for (n, t), metric in retention.COUNTS.items() if t == table}
    return {r.local_date for r in found}, {metric: sum(r[n] for r in found) for n, metric in names.items()}


def _orphaned_days(tables: Tables, table: str, expired: DataFrame) -> set[str]:
    """Days with children of expired parents."""
    parents = expired.select(F.col("id").alias("notification_id"))
    children = tables.read(table).filter("notification_id IS NOT NULL").select("notification_id", "local_date")
    days = children.join(parents, "notification_id", "left_semi").select("local_date").distinct()
    return {r.local_date for r in days.collect()}


def _rewrite(tables: Tables, table: str, rows: DataFrame, days: list[str]) -> None:
    """Replace some days of a table with new content, by way of a staged copy."""
    if not days:
        return
    with tables.staging():
        kept = tables.staged(rows, f"aged-{table}")
        left = {r.local_date for r in kept.select("local_date").distinct().collect()}
        tables.replace_days(kept, table)
    tables.clear_days(table, sorted(set(days) - left))


def apply_retention(tables: Tables, now_ms: int) -> dict[str, int]:
    """D1–D9 on the stored tables; returns the eight counts.

    Children are rewritten before their expired parents go, so a run that dies in between
    leaves no dangling reference and can be repeated.
    """
    stored = tables.all()
    kept = facts.kept(tables) is not None
    counts = {metric: 0 for metric in retention.COUNTS.values()}
    notes = stored["webhook_notifications"]
    expired = notes.filter(retention.expires("webhook_notifications", now_ms)).select("id")
    order = [t for t in retention.AGED if t != "webhook_notifications"]
    for table in [*order, "webhook_notifications"]:
        aged, found = _aged_days(tables, table, now_ms)
        counts |= found
        if table in ("face_events", "vehicle_events"):
            aged |= _orphaned_days(tables, table, expired)
        days = sorted(aged)
        pruned = dict(stored, **{table: tables.only_days(table, days)})
        _rewrite(tables, table, retention.aged_tables(pruned, now_ms)[table], days)
        if kept and days:
            facts.recount(tables, table, days)
    key_ledger.drop_expired(tables, now_ms)
    state = tables.read("materialization_state")
    faces = tables.read("face_events").select("local_date").distinct()
    gone = state.join(faces, "local_date", "left_anti").select("local_date").collect()
    tables.clear_days("materialization_state", [r.local_date for r in gone])
    return counts


def _mark(tables: Tables, rows: list[tuple]) -> None:
    tables.append(tables.spark.createDataFrame(rows, MARKERS), "ops_markers")


def run_daily(tables: Tables, params: JobParams, now_ms: int) -> dict:
    """Forced report of the day 12 hours ago, then retention, then the reference check.

    A failed report is marked and does not stop the cleanup.
    """
    spark = tables.spark
    day = spark.range(1).select(
        times.local_date(F.lit(now_ms - REPORT_LAG_MS), params.zone).alias("d")
    )
    date = day.first().d
    result: dict = {"report_date": date, "report_ok": False, "cleanup": None, "fk_ok": None}
    try:
        materialize_date(tables, params, date, now_ms, force=True)
        _mark(tables, markers.report_ok(date, now_ms))
        result["report_ok"] = True
    except Exception as e:  # noqa: BLE001 - the job must go on to the cleanup
        code = texts.error_code_of(str(e))
        _mark(tables, markers.cron_error(code, "generateDailyReport", now_ms))
    try:
        result["cleanup"] = apply_retention(tables, now_ms)
        _mark(tables, markers.cleanup_ok(result["cleanup"], now_ms + 1))
        notes = tables.read("webhook_notifications")
        lost = [
            orphans(tables.read(t), notes).isEmpty() for t in ("face_events", "vehicle_events")
        ]
        result["fk_ok"] = all(lost)
        if result["fk_ok"]:
            _mark(tables, markers.fk_check_ok(now_ms + 1))
        else:
            _mark(
                tables,
                markers.cron_error("D1_FK_CHECK_FAILED", "foreign_key_check", now_ms + 1),
            )
    except Exception as e:  # noqa: BLE001
        code = texts.error_code_of(str(e))
        _mark(tables, markers.cron_error(code, "runRetentionCleanup", now_ms + 1))
    return result
