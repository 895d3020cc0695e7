"""Batch ingest: raw bodies → stored tables (S1–S6, J1, J2, W5, A27, counters)."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts, times
from ..operators import late, markers, parse
from ..operators.upserts import canonical_ids, keep_first, stored_matches
from ..params import JobParams
from ..schemas import MARKERS
from ..session import require_settings
from ..sources.tables import Tables
from . import facts, key_ledger
from .key_ledger import KINDS

NOTE_ORDER = ["received_at_ms", "id"]
SIGHTING_ORDER = ["received_at_ms", "notification_id", "pos"]


def added_rows(new: dict[str, DataFrame], zone: str) -> DataFrame:
    """Number of new notifications, faces and vehicles by (`kind`, `received_date`, `local_date`)."""
    received = times.local_date("received_at_ms", zone).alias("received_date")
    parts = [new[k].select(F.lit(k).alias("kind"), received, "local_date") for k in ("notes", "face", "vehicle")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("kind", "received_date", "local_date").agg(F.count("*").alias("value"))


def counter_rows(lines: DataFrame, added: DataFrame) -> DataFrame:
    """Increments by day of receipt, as (`local_date`, `field`, `value`).

    `lines` are all parsed lines; `added` the numbers of inserted rows. Duplicates are attempts
    less insertions.
    """

    def per_day(df, day, **fields):
        sums = df.groupBy(F.col(day).alias("local_date")).agg(
            *[F.sum(v.cast("long")).alias(k) for k, v in fields.items()]
        )
        pairs = [F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in fields]
        return sums.select("local_date", F.inline(F.array(*pairs)))

    one = F.lit(1)
    ok = F.col("reason").isNull()
    face, vehicle = ok & (F.col("kind") == "face"), ok & (F.col("kind") == "vehicle")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    rejected = [
        flag(F.col("is_head") & (F.col("reason") == r)) for r in ("rejected_json", "rejected_body")
    ]
    attempts = per_day(
        lines,
        "received_date",
        rejected_json=rejected[0],
        rejected_body=rejected[1],
        events_attempted=flag(face),
        vehicles_attempted=flag(vehicle),
        duplicates=flag(face),
        vehicle_duplicates=flag(vehicle),
    )
    # A payload is without sightings if none of its lines has a kind.
    silent = (
        lines.filter(ok)
        .groupBy("notification_id", "received_date")
        .agg(F.max(flag(F.col("kind").isNotNull())).alias("any"))
        .filter("any = 0")
    )
    parts = [
        attempts,
        per_day(silent, "received_date", zero_face_webhooks=one),
    ]
    value = F.col("value")
    for kind, fields in (
        ("notes", {"ingested_webhooks": value}),
        ("face", {"events_inserted": value, "duplicates": -value}),
        ("vehicle", {"vehicles_inserted": value, "vehicle_duplicates": -value}),
    ):
        parts.append(per_day(added.filter(F.col("kind") == kind), "received_date", **fields))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return (
        union.groupBy("local_date", "field")
        .agg(F.sum("value").alias("value"))
        .filter("value <> 0")
    )


def batch_rows(lines: DataFrame) -> dict[str, DataFrame]:
    """Rows of a batch by kind, copies included."""
    return {
        "notes": parse.notifications_of(lines),
        "face": parse.faces_of(lines),
        "vehicle": parse.vehicles_of(lines),
    }


def keyed_lines(lines: DataFrame, *more: str) -> DataFrame:
    """What decides which rows are stored: `kind`, `key` and the order of arrival.

    A line that carries a notification and a sighting gives two rows.
    """
    accepted = lines.filter(F.col("reason").isNull())
    order = ["received_at_ms", "notification_id", "pos"]

    def rows(kind, key, wanted, pos):
        columns = [F.lit(kind).alias("kind"), F.col(key).alias("key"), *order[:2], pos.alias("pos")]
        return accepted.filter(wanted).select(*columns, "delivery_key", *more)

    heads = rows("notes", "delivery_key", F.col("is_head"), F.lit(0))
    kinds = [rows(k, "event_id", F.col("kind") == k, F.col("pos")) for k in ("face", "vehicle")]
    return heads.unionByName(kinds[0]).unionByName(kinds[1])


def choose(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Places of the lines to store, as (`kind`, `canonical_id`, place); `lines` come with places.

    `known`: (`kind`, `key`, `ref`), the stored keys, deliveries with the id they have. Copies
    collapse first, on narrow rows, so the joins see each key once.
    """
    first = keep_first(keyed_lines(lines, *late.PLACE), ["kind", "key"], SIGHTING_ORDER)
    notes = F.col("kind") == "notes"
    ids = canonical_ids(
        first.filter(notes).select("delivery_key", F.col("notification_id").alias("id")),
        known.filter(notes).select(F.col("key").alias("delivery_key"), F.col("ref").alias("id")),
    )
    fresh = first.join(known.select("kind", "key"), ["kind", "key"], "left_anti")
    return fresh.join(ids, "delivery_key", "left").select("kind", "canonical_id", *late.PLACE)


def chosen_rows(lines: DataFrame, chosen: DataFrame) -> dict[str, DataFrame]:
    """Rows to append to each table: whole lines, fetched by their places."""
    out = {"rejects": parse.rejects_of(lines)}
    for kind in KINDS:
        some = chosen.filter(F.col("kind") == kind).drop("kind")
        picked = late.fetched(lines, some)
        if kind != "notes":
            picked = picked.withColumn("notification_id", F.col("canonical_id"))
        out[kind] = batch_rows(picked)[kind]
    return out


def plan_ingest(
    lines: DataFrame,
    stored: dict[str, DataFrame],
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """Rows to append to each table, by a look at the stored tables themselves.

    `lines` are read from files; `stage` writes the chosen places, so that they are found once.
    """
    lines = late.located(lines)
    keys = keyed_lines(lines)
    known = []
    for kind, (table, key, _) in KINDS.items():
        own = keys.filter(F.col("kind") == kind).select(F.col("key").alias(key))
        columns = [key, "id"] if kind == "notes" else [key]
        found = stored_matches(stored[table], own, key, columns)
        ref = F.col("id") if kind == "notes" else F.lit(None).cast("string")
        known.append(found.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), ref.alias("ref")))
    return chosen_rows(lines, stage(choose(lines, known[0].unionByName(known[1]).unionByName(known[2]))))


def fingerprint(lines: DataFrame) -> str:
    """Number and checksum of the lines of a batch."""
    content = F.xxhash64("notification_id", "delivery_key", "pos", "received_at_ms", "reason", "event_id")
    seen = lines.agg(F.count("*").alias("n"), F.sum(content.cast("decimal(38,0)")).alias("sum")).first()
    return f"{seen.n}:{seen.sum}"


def record_of(tables: Tables, batch: str, mark: str) -> DataFrame:
    """What a batch adds, as written down before its first try stored anything.

    A repeat, known by name and content, gets the numbers of the first try, however much of
    it was stored. Other content under the same name is a batch of its own.
    """
    same = (F.col("batch") == batch) & (F.col("fingerprint") == mark)
    return tables.read("ingest_batches").filter(same)


def unstored(tables: Tables, new: DataFrame, kind: str) -> DataFrame:
    """Of a repeated batch: the rows its earlier tries did not store. Reads the rows' own days."""
    table, key, _ = KINDS[kind]
    days = [r.local_date for r in new.select("local_date").distinct().collect()]
    return new.join(tables.only_days(table, days).select(key), key, "left_anti")


def record_failure(tables: Tables, params: JobParams, error: Exception, now_ms: int) -> None:
    """One more failed store call on this day, and the marker of the last one.

    Its own errors are swallowed: what failed before is what the caller must see.
    """
    with suppress(Exception):
        code = texts.error_code_of(str(error))
        tables.append(tables.spark.createDataFrame(markers.store_error(code, "ingestWebhook", now_ms), MARKERS), "ops_markers")
        day = times.local_date(F.lit(now_ms), params.zone).alias("local_date")
        failed = F.lit(f"failed-{uuid.uuid4().hex}").alias("batch")
        one = tables.spark.range(1).select(day, F.lit("d1_failures").alias("field"), F.lit(1).cast("long").alias("value"), failed)
        tables.append(one, "ops_daily_counters")


def ingest(
    raw: DataFrame, tables: Tables, params: JobParams, batch: str = "0", now_ms: int | None = None
) -> list[str]:
    """`ingest_batch`, with failures counted and marked at `now_ms` (else the clock) before they go on."""
    try:
        return ingest_batch(raw, tables, params, batch)
    except Exception as error:
        record_failure(tables, params, error, int(time.time() * 1000) if now_ms is None else now_ms)
        raise


def ingest_batch(raw: DataFrame, tables: Tables, params: JobParams, batch: str = "0") -> list[str]:
    """Parse a raw batch once, append what is new, and return the days that got new faces.

    Whether a key is stored is asked of the key ledger, so a batch reads no history. Safe to
    repeat: a second run of the same batch stores what the first one did not come to, writes
    its rejects and counters again and returns the same days. The ledger is written before
    the rows, parents before children and counters last. The counters of the batch are in
    `ops_daily_counters`. The returned list has one short text per calendar day.
    """
    require_settings(tables.spark)
    with tables.staging():
        lines = late.located(tables.staged(parse.alarm_lines(raw, params), "alarm-lines"))
        mark = fingerprint(lines)
        name = hashlib.md5(f"{batch}\n{mark}".encode()).hexdigest()
        repeated = not record_of(tables, batch, mark).isEmpty()
        key_ledger.ensure(tables)
        lost = key_ledger.recover(tables, name)
        facts.ensure(tables)
        keys = keyed_lines(lines).select("kind", "key").distinct()
        known = tables.staged(key_ledger.known(tables, keys, name), "known-keys")
        chosen = tables.staged(choose(lines, known), "chosen-lines")
        planned = chosen_rows(lines, chosen)
        new = {k: tables.staged(planned[k], f"new-{k}") for k in KINDS}
        files = key_ledger.add(tables, new, name)
        if not repeated:
            added = added_rows(new, params.zone).withColumn("fingerprint", F.lit(mark))
            tables.replace_days(added.withColumn("batch", F.lit(batch)), "ingest_batches")
        added = record_of(tables, batch, mark)
        for kind, (table, _, _) in KINDS.items():
            tables.append(unstored(tables, new[kind], kind) if repeated else new[kind], table)
        key_ledger.commit(tables, files, name)
        stored = {table: new[kind] for kind, (table, _, _) in KINDS.items()}
        if not (repeated or lost):
            facts.add(tables, stored, name)
        for table, rows in stored.items() if repeated or lost else ():
            # An unfinished batch may have stored rows on any day.
            found = rows.select("local_date").distinct().collect() if not lost else None
            facts.recount(tables, table, found and [r.local_date for r in found])
        tables.replace_days(planned["rejects"].withColumn("batch", F.lit(batch)), "rejected_alarms")
        counts = counter_rows(lines, added)
        tables.replace_days(counts.withColumn("batch", F.lit(batch)), "ops_daily_counters")
        key_ledger.merge_parts(tables)
        days = added.filter("kind = 'face'").select("local_date").distinct()
        return [r.local_date for r in days.collect()]


def batch_counters(tables: Tables, batch: str = "0") -> DataFrame:
    """Counter increments of one ingested batch."""
    stored = tables.read("ops_daily_counters").filter(F.col("batch") == batch)
    return stored.select("local_date", "field", "value")
