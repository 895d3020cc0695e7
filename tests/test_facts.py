"""Kept day facts against the tables themselves: late rows, repeats, emptied days, retention, renewals."""

import pytest

from sightline.params import DAY_MS, JobParams
from sightline.plans import daily, facts, materialize as mat
from sightline.sources.tables import Tables

from .builders import face, faces

T = 1746970990000
DAY = "2025-05-11"


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "store"))


def kept(tables, table="face_events"):
    found = facts.kept(tables).filter(f"table = '{table}'").collect()
    return {r.local_date: (r.rows, r.max_ms) for r in found}


def counted(tables, table="face_events"):
    found = tables.read(table).groupBy("local_date").agg({"*": "count", facts.TIMES[table]: "max"}).collect()
    return {r[0]: (r["count(1)"], r[f"max({facts.TIMES[table]})"]) for r in found}


def test_facts_follow_batches_renewals_and_retention(spark, tables):
    assert facts.kept(tables) is None
    old = T - 400 * DAY_MS
    tables.append(faces(spark, face("f1", T, date=DAY), face("f2", old, date="2024-04-06")), "face_events")
    facts.ensure(tables)
    late = faces(spark, face("f3", T + 5, date=DAY))
    tables.append(late, "face_events")
    facts.add(tables, {"face_events": late}, "b2")
    facts.add(tables, {"face_events": late}, "b2")
    assert kept(tables) == counted(tables) == {DAY: (2, T + 5), "2024-04-06": (1, old)}
    # The renewal goes by the facts, and counts what it writes.
    assert mat.materialize_month(tables, JobParams(), DAY[:7], T) == {"checked": 1, "regenerated": 1}
    assert mat.materialize_month(tables, JobParams(), DAY[:7], T + 1) == {"checked": 1, "regenerated": 0}
    assert kept(tables, "presence_sessions") == counted(tables, "presence_sessions")
    # Retention empties a day.
    daily.apply_retention(tables, T)
    assert kept(tables) == counted(tables) == {DAY: (2, T + 5)}


def test_freshness_and_health_read_no_old_sightings(spark, tables):
    tables.append(faces(spark, face("f1", T, date=DAY), face("f2", T - 9 * DAY_MS, date="2025-05-02")), "face_events")
    facts.ensure(tables)
    days = facts.source_facts(facts.kept(tables))
    fresh = mat.freshness(days, None, tables.read("materialization_state"), days)
    assert "face_events" not in fresh._jdf.queryExecution().executedPlan().toString().replace("= face_events", "")
    health = facts.health_facts(tables, facts.kept(tables), T)
    text = health._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(local_date" in text
    row = health.first()
    assert (row.rows_face_events, row.events_last_day, row.last_event_at_ms) == (2, 1, T)
