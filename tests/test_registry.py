"""A sample of the registered queries against DuckDB on the smallest data set.

`python -m checks.compare sf0.01` runs all of them.
"""

import pytest

from checks import registry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "A21_daily_person_reports", "W1_face_sessions", "W2_vehicle_sessions", "W3_presence_sessions",
    "A1_distinct_people", "A22_today_people", "A24_today_counts", "C2_person_profile", "C3_vehicle_profile",
    "C10_month_calendar", "C11_heat_grid", "S5_face_sink", "P13_raw_trigger_json", "P17_delivery_key",
    "A25_daily_counters", "J4_detach_expired_parents", "J9_freshness", "A30_retention_summary",
    "U4_fallback_relation", "Q2_unique_keys", "T5_live_sessions_by_person", "S7_replace_days",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, duck, name):
    rows, verdict = compare(spark, duck, SF, registry.QUERIES[name], registry.ORACLES[name])
    assert verdict == "ok" and rows > 0


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)
