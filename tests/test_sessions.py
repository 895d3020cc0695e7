"""Sessionisation against hand-made cases and a plain fold."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sightline.operators import profiles, reports, sessions
from sightline.params import GapRules
from sightline.streaming.live import entity_gap

from .builders import face, faces, vehicle, vehicles

MIN = 60_000
T0 = 1751371200000


def cut(spark, rows, rules=GapRules(), **more):
    found = sessions.gap_sessions(faces(spark, *rows), rules, **more)
    return sorted(found.collect(), key=lambda s: (s.started_at_ms, s.person_key))


def test_single_and_empty(spark):
    assert cut(spark, []) == []
    (one,) = cut(spark, [face("a", T0)])
    assert one.sighting_count == 1 and one.started_at_ms == one.ended_at_ms == T0


def test_within_at_and_over_the_gap(spark):
    rows = [face("a", T0), face("b", T0 + 10 * MIN, camera="cam-2")]
    (one,) = cut(spark, rows)
    assert (one.first_camera_id, one.last_camera_id) == ("cam-1", "cam-2")
    assert one.ended_at_ms - one.started_at_ms == 600_000
    assert len(cut(spark, [face("a", T0), face("b", T0 + 20 * MIN)])) == 1
    assert len(cut(spark, [face("a", T0), face("b", T0 + 20 * MIN + 1)])) == 2


def test_people_are_separate_and_midnight_cuts_people_only(spark):
    rows = [face("a", T0), face("b", T0 + MIN, "id:b"), face("c", T0 + 5 * MIN)]
    assert [(s.person_key, s.sighting_count) for s in cut(spark, rows)] == [("id:a", 2), ("id:b", 1)]
    over = [face("a", T0), face("b", T0 + MIN, date="2025-07-02")]
    assert len(cut(spark, over)) == 2
    cars = vehicles(spark, vehicle("a", T0), vehicle("b", T0 + MIN, date="2025-07-02"))
    (visit,) = sessions.vehicle_sessions(cars, GapRules()).collect()
    assert visit.sighting_count == 2 and visit.local_date == "2025-07-01"


def test_gap_precedence(spark):
    rules = GapRules(20, {"id:p": 45.0}, {"cam-1": 5.0})
    assert len(cut(spark, [face("a", T0), face("b", T0 + 10 * MIN)], rules)) == 2
    other = [face("a", T0), face("b", T0 + 10 * MIN, camera="cam-2")]
    assert len(cut(spark, other, rules)) == 1
    person = [face("a", T0, "id:p"), face("b", T0 + 40 * MIN, "id:p")]
    assert len(cut(spark, person, rules)) == 1
    blank = [face("a", T0, camera=""), face("b", T0 + 10 * MIN, camera="")]
    assert len(cut(spark, blank, GapRules(20, {}, {"": 5.0}))) == 1


def test_plate_text_is_the_last_one_read(spark):
    rows = [
        vehicle("a", T0, text=""), vehicle("b", T0 + MIN, text="x"), vehicle("c", T0 + 2 * MIN, text=""),
        vehicle("d", T0 + 90 * MIN, text=""),
    ]
    for size in (None, MIN, 3_600_000):
        found = sessions.vehicle_sessions(vehicles(spark, *rows), GapRules(), slice_ms=size)
        got = sorted(found.collect(), key=lambda s: s.started_at_ms)
        assert [s.plate_text for s in got] == ["x", "AAA"]


def test_open_sessions_and_reports(spark):
    rows = [face("a", T0), face("b", T0 + 8 * 60 * MIN, name="alice")]
    found = sessions.presence_sessions(faces(spark, *rows), GapRules(), T0, T0 + 8 * 60 * MIN + 20 * MIN)
    got = sorted(found.collect(), key=lambda s: s.started_at_ms)
    assert [s.is_open for s in got] == [0, 1]
    (report,) = reports.reports_from_sessions(found, T0).collect()
    assert report.person_name == "Alice" and report.seen_count == 2 and report.session_count == 2
    assert report.observed_span_seconds == 0.0 and report.raw_span_seconds == 8 * 3600.0
    assert report.rounded_span_minutes == 480 and report.rounded_span_hours == 8.0


def test_typical_times(spark):
    days = [("2025-07-01", 0), ("2025-07-02", 1), ("2025-07-03", 2)]
    base = 1751374800000  # 2025-07-01 09:00 in New York
    rows = []
    for date, n in days:
        start = base + n * 86_400_000
        rows += [face(f"a{n}", start, date=date), face(f"b{n}", start + 8 * 60 * MIN, date=date)]
    found = sessions.presence_sessions(faces(spark, *rows), GapRules(), T0)
    got = profiles.person_profiles(
        faces(spark, *rows), found, reports.reports_from_sessions(found, T0), "2025-07-04",
        "America/New_York",
    ).first()
    assert (got.typical_arrival_minutes, got.typical_departure_minutes) == (540.0, 1020.0)
    assert (got.typical_arrival_label, got.typical_departure_label) == ("09:00", "17:00")
    assert got.visit_count == 6 and len(got.heatmap) == 3 and len(got.recent_events) == 6


def fold(rows, rules):
    """Plain sequential reading of the rule."""
    out = []
    by_key = {}
    for r in sorted(rows, key=lambda r: (r["seen_at_ms"], r["event_id"])):
        by_key.setdefault((r["local_date"], r["person_key"]), []).append(r)
    for key, seq in by_key.items():
        last = None
        for r in seq:
            same = last and last["camera_id"] == r["camera_id"] and r["camera_id"]
            gap = rules.by_entity.get(key[1])
            if gap is None:
                gap = rules.by_camera.get(r["camera_id"]) if same else None
            gap = rules.default_minutes if gap is None else gap
            if last is None or r["seen_at_ms"] - last["seen_at_ms"] > gap * MIN:
                out.append([key, r["event_id"], r["event_id"], 0])
            out[-1][2] = r["event_id"]
            out[-1][3] += 1
            last = r
    return sorted(map(tuple, out))


sighting = st.tuples(
    st.sampled_from(["id:a", "id:b", "id:c"]),
    st.integers(0, 300),
    st.sampled_from(["cam-1", "cam-2", ""]),
    st.sampled_from(["2025-07-01", "2025-07-02"]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(sighting, min_size=30, max_size=200), st.sampled_from([None, 7 * MIN, 60 * MIN]))
def test_equals_a_sequential_fold(spark, found, size):
    rules = GapRules(10, {"id:b": 25.0}, {"cam-1": 3.0})
    rows = [
        face(f"e{i:04d}", T0 + minute * MIN, person, camera=camera, date=date)
        for i, (person, minute, camera, date) in enumerate(found)
    ]
    got = cut(spark, rows, rules, slice_ms=size)
    have = sorted(
        ((s.local_date, s.person_key), s.first_event_id, s.last_event_id, s.sighting_count)
        for s in got
    )
    assert have == fold(rows, rules)


def test_many_overrides_are_joined_as_a_table(spark):
    many = {f"id:{i}": 1.0 for i in range(200)}
    rows = [face("a", T0), face("b", T0 + 10 * MIN), face("c", T0, "id:7"), face("d", T0 + 10 * MIN, "id:7")]
    got = cut(spark, rows, GapRules(20, many))
    assert [(s.person_key, s.sighting_count) for s in got] == [("id:7", 1), ("id:a", 2), ("id:7", 1)]


def test_many_overrides_of_live_sessions(spark):
    many = {f"id:{i}": 1.0 for i in range(3000)}
    rows = spark.createDataFrame([("id:2999",), ("id:x",)], "person_key string")
    gaps = rows.select(entity_gap("person_key", GapRules(20, many)).alias("gap")).collect()
    assert [r.gap for r in gaps] == ["60000 milliseconds", "1200000 milliseconds"]
