"""Data-quality checks (Q1–Q4): long results of (table, rule, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TABLES
from .upserts import orphans

DAY_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"

# Columns under each kind of check.
NOT_EMPTY = {
    "face_events": ["id", "event_id", "person_key", "notification_id"],
    "vehicle_events": ["id", "event_id", "plate_key", "notification_id"],
    "presence_sessions": ["id", "person_key"],
    "ops_daily_counters": ["field"],
}
NOT_NEGATIVE = {
    "face_events": ["seen_at_ms"],
    "vehicle_events": ["seen_at_ms"],
    "presence_sessions": [
        "started_at_ms",
        "ended_at_ms",
        "duration_seconds",
        "sighting_count",
        "generated_at_ms",
    ],
    "materialization_state": ["source_event_count", "max_seen_at_ms", "generated_at_ms"],
    "ops_daily_counters": ["value"],
}
DATED = [
    "face_events",
    "vehicle_events",
    "presence_sessions",
    "materialization_state",
    "ops_daily_counters",
]
UNIQUE = {
    "webhook_notifications": [["id"], ["delivery_key"]],
    "face_events": [["id"], ["event_id"]],
    "vehicle_events": [["id"], ["event_id"]],
    "presence_sessions": [["id"]],
    "daily_person_reports": [["local_date", "person_key"]],
    "materialization_state": [["local_date"]],
}


def rules(table: str) -> dict[str, Column]:
    """Q1, Q4: rule name → condition that every row must meet (null counts as met in Q1)."""
    out = {}
    for c in NOT_EMPTY.get(table, []):
        out[f"{c} not empty"] = F.length(c) > 0
    for c in NOT_NEGATIVE.get(table, []):
        out[f"{c} >= 0"] = F.col(c) >= 0
    if table in DATED:
        out["local_date shape"] = F.col("local_date").rlike(DAY_SHAPE)
    if table == "presence_sessions":
        out["is_open in (0, 1)"] = F.col("is_open").isin(0, 1)
    if table == "materialization_state":
        out["materializer_version > 0"] = F.col("materializer_version") > 0
    for field in TABLES[table].fields:
        if not field.nullable:
            out[f"{field.name} not null"] = F.col(field.name).isNotNull()
    return out


def check_rules(df: DataFrame, table: str) -> DataFrame:
    """Q1 and Q4 of one table in one pass."""
    found = {n: r for n, r in rules(table).items() if n.split()[0] in df.columns}
    names = list(found)
    counted = df.agg(*[F.count_if(~found[n]).alias(f"c{i}") for i, n in enumerate(names)])
    rows = [
        F.struct(
            F.lit(table).alias("table"),
            F.lit(n).alias("rule"),
            F.col(f"c{i}").alias("violations"),
        )
        for i, n in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*rows)))


def check_unique(df: DataFrame, table: str) -> DataFrame:
    """Q2: number of keys that occur more than once; nulls are not compared."""
    parts = []
    for keys in UNIQUE.get(table, []):
        twice = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        parts.append(
            twice.agg(F.count("*").alias("violations")).select(
                F.lit(table).alias("table"),
                F.lit("unique " + ", ".join(keys)).alias("rule"),
                "violations",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def check_references(children: DataFrame, parents: DataFrame, table: str) -> DataFrame:
    """Q3: children whose notification does not exist."""
    lost = orphans(children, parents).agg(
        F.coalesce(F.sum("children"), F.lit(0)).cast("long").alias("violations")
    )
    return lost.select(
        F.lit(table).alias("table"), F.lit("notification exists").alias("rule"), "violations"
    )


def check_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Every check on every given table."""
    parts = [check_rules(df, t) for t, df in tables.items() if rules(t)]
    parts += [check_unique(df, t) for t, df in tables.items() if t in UNIQUE]
    notes = tables.get("webhook_notifications")
    for t in ("face_events", "vehicle_events"):
        if notes is not None and t in tables:
            parts.append(check_references(tables[t], notes, t))
    return reduce(DataFrame.unionByName, parts)
