"""Plans: what must and must not be in them."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from checks import feed, q_jobs, registry
from sightline.functions import times
from sightline.operators import directory, profiles, reports, sessions, upserts
from sightline.params import GapRules
from sightline.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)


def test_reports_reuse_the_partitioning_of_the_sessions(spark):
    found = sessions.presence_sessions(feed.faces(spark, SF), feed.GAPS_240, 0)
    text = plan(reports.reports_from_sessions(found, 0))
    by = exchanges(text)
    assert len(by) == 2, by
    assert "_slice" in by[1] and "_slice" not in by[0]
    assert text.count("Sort [") == 2


def test_first_and_top_rows_are_cut_before_the_shuffle(spark):
    faces = feed.faces(spark, SF)
    for df in (
        upserts.keep_first(faces, "event_id", ["seen_at_ms"]),
        upserts.keep_first(faces, ["person_key", "event_id"], ["seen_at_ms"]),
        profiles.recent_sightings(faces, "person_key"),
        profiles.top_cameras(faces, "person_key"),
    ):
        assert "Partial" in plan(df) and "WindowGroupLimit" in plan(df)


def test_sightings_are_hash_aggregated_before_names(spark):
    text = plan(directory.person_identities(feed.faces(spark, SF)))
    assert "HashAggregate" in text.split("Scan parquet")[0].split("Exchange")[-1]


def test_day_filters_prune_partitions_and_columns(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    tables.append(feed.faces(spark, SF), "face_events")
    text = plan(directory.events_for_date(tables.read("face_events"), feed.TODAY))
    assert re.search(r"PartitionFilters: \[.*local_date", text) and "raw_trigger_json" not in text


def test_epoch_bounds_prune_days(spark, tmp_path):
    from sightline.operators import retention

    tables = Tables(spark, str(tmp_path))
    tables.append(feed.faces(spark, SF), "face_events")
    faces = tables.read("face_events")
    since = directory.events_since(faces, feed.NOW - 3_600_000)
    for df in (since, retention.day_counts(faces, "face_events", feed.RAW_NOW)):
        text = plan(df)
        assert re.search(r"PartitionFilters: \[[^\]]*local_date#\w+ [<>]=", text), text
    assert faces.filter(F.col("local_date") >= times.first_day(feed.NOW - 3_600_000)).count() < faces.count()
    want = faces.filter(F.col("seen_at_ms") >= feed.NOW - 3_600_000)
    assert {r.event_id for r in since.collect()} == {r.event_id for r in want.collect()}


@pytest.mark.parametrize("zone", ["Pacific/Kiritimati", "Pacific/Niue", "Asia/Manila", "America/New_York", "UTC"])
def test_local_dates_lie_within_the_implied_days(spark, zone):
    at = [-5_000_000_000_000, 0, 1_711_846_799_999, 1_711_846_800_000, 1_720_000_000_000]
    rows = spark.createDataFrame([(m,) for m in at], "ms long").select("ms", times.local_date("ms", zone).alias("d"))
    for r in rows.collect():
        assert times.first_day(r.ms) <= r.d <= times.last_day(r.ms)


def test_small_gap_overrides_shuffle_no_sighting(spark):
    faces = feed.faces(spark, SF)
    text = plan(sessions.gap_sessions(faces, feed.GAPS_240))
    assert set(re.findall(r"\w+Join", text)) <= {"BroadcastHashJoin"}
    plain = plan(sessions.gap_sessions(faces, GapRules(240)))
    names = [[re.sub(r"#\w+", "", by) for by in exchanges(t)] for t in (text, plain)]
    assert names[0] == names[1] and len(names[0]) == 2


def test_large_gap_overrides_are_joined_by_shuffle_with_the_same_rows(spark):
    faces = feed.faces(spark, SF)
    small = sessions.gap_sessions(faces, feed.GAPS_240).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        # A camera with all sightings: what is joined is dealt by entity next, not gathered.
        df = sessions.gap_sessions(faces, feed.GAPS_240)
        assert "SortMergeJoin" in plan(df)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("staged", [True, False])
def test_images_are_fetched_after_ranking(spark, tmp_path, staged):
    tables = Tables(spark, str(tmp_path))
    tables.append(feed.faces(spark, SF), "face_events")
    stage = (lambda df: tables.staged(df, "winners")) if staged else None
    df = profiles.recent_sightings(tables.read("face_events"), "person_key", stage=stage)
    tree = df._jdf.queryExecution().executedPlan().toString()
    for node in nodes_with_output(df, ("Sort", "WindowGroupLimit", "Window")):
        assert not {"image_base64", "raw_trigger_json"} & node, tree
    if staged:
        assert "WindowGroupLimit" not in tree and re.search(r"PartitionFilters: \[.*local_date", tree)
    else:
        assert "ShuffledHashJoin" in tree
    got = {(r.event_id, r["rank"], r.image_base64) for r in df.collect()}
    plain = profiles.ranked(tables.read("face_events"), ["person_key"], [F.desc("seen_at_ms"), "event_id"], 24)
    assert got == {(r.event_id, r["rank"], r.image_base64) for r in plain.collect()}


def nodes_with_output(df, names):
    """Output columns of each physical node whose name is one of `names`."""
    found = []

    def walk(node):
        if node.nodeName() in names:
            output = node.output()
            found.append({output.apply(i).name() for i in range(output.size())})
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.initialPlan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_payloads_are_parsed_once(spark):
    from sightline.operators import parse

    lines = parse.alarm_lines(feed.raw_alarms(spark, SF), feed.PARAMS)
    text = plan(parse.faces_of(lines).filter("person_key = 'id:P7'"))
    assert text.count("parseJson") == 1


@pytest.mark.parametrize(
    "name",
    ["C2_person_profile", "C3_vehicle_profile", "C10_month_calendar", "C11_heat_grid", "A24_today_counts",
     "A20_health_facts", "A30_retention_summary", "A27_ingest_counts", "U1_selected_person", "D9_drop_notifications"],
)
def test_no_cross_joins(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.fixture
def few_events(spark, tmp_path):
    rows = spark.range(60).selectExpr(
        "id AS event_id",
        "timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(id * 12 AS int)) AS ts",
        "id % 5 AS user_id",
        "'view' AS event_type",
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_keys_asked_for_four_times_are_parsed_once(spark, few_events):
    found = registry.QUERIES["J2_insert_if_absent"](spark, few_events)
    assert few_events not in "".join(found.inputFiles())


def test_deliveries_are_dealt_once(spark, few_events):
    deliver, stream = q_jobs._delivered(spark, few_events, "dealt")
    dealt = inspect.getclosurevars(deliver).nonlocals["dealt"]
    assert few_events not in "".join(dealt.inputFiles())
    deliver(range(1, 5))
    path = inspect.getclosurevars(deliver).nonlocals["path"]
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) == 5
    assert stored.count() == stored.select("event_id").distinct().count() == 45
