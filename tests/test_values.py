"""Scalar expressions and parameters against known values."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import loose_json as lj
from sightline.functions import texts, times
from sightline.operators import counters
from sightline.params import GapRules, JobParams, minutes_map

NY = "America/New_York"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "minutes, rounded", [(0, 0), (1, 15), (14, 15), (15, 15), (16, 30), (221, 225)]
)
def test_ceil_to_quarter_hours(spark, minutes, rounded):
    assert value(spark, times.ceil_quarter_minutes(F.lit(minutes * 60_000))) == rounded


@pytest.mark.parametrize(
    "number, text",
    [
        (1e-12, "1e-12"), (2.5e-7, "2.5e-7"), (1e-6, "0.000001"), (0.00012, "0.00012"), (-0.5, "-0.5"),
        (1.5, "1.5"), (-0.0, "0"), (1746970986798.25, "1746970986798.25"), (12345678.0, "12345678"),
        (1e20, "100000000000000000000"), (1e21, "1e+21"), (-1.5e300, "-1.5e+300"),
    ],
)
def test_text_of_numbers(spark, number, text):
    assert value(spark, lj.double_text(F.lit(number))) == text


def test_quarter_hours(spark):
    assert value(spark, times.quarter_hours(F.lit(225))) == 3.75


@pytest.mark.parametrize("zone", ["UTC", "Australia/Lord_Howe"])
def test_local_clock_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ms = F.lit(1719655200000)
        assert value(spark, times.local_date(ms, NY)) == "2024-06-29"
        assert value(spark, times.minute_of_day(ms, NY)) == 360
        assert value(spark, times.clock_label(ms, True)) == "06:00:00"
        assert value(spark, times.moment_label(ms)) == "Jun 29, 2024, 06:00"
        assert value(spark, times.local_date(F.lit(1000), NY)) == "1969-12-31"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_labels_and_days(spark):
    assert value(spark, times.minutes_label(F.lit(540))) == "09:00"
    assert value(spark, times.minutes_label(F.lit(1439.5))) == "00:00"
    assert value(spark, times.minutes_label(F.lit(None).cast("double"))) is None
    assert value(spark, times.days_before(F.lit("2025-07-14"), 90)) == "2025-04-15"
    assert value(spark, times.shift_month(F.lit("2025-01"), -1)) == "2024-12"
    assert value(spark, times.first_weekday(F.lit("2024-02"))) == 4
    assert value(spark, times.days_in_month(F.lit("2024-02"))) == 29
    now = 10_000_000_000
    ages = {59_000: "59s ago", 60_000: "1m ago", 47 * 3_600_000: "47h ago", 48 * 3_600_000: "2d ago"}
    for back, text in ages.items():
        assert value(spark, times.age_label(F.lit(now - back), now)) == text


@pytest.mark.parametrize(
    "text, ok", [("2024-02-29", True), ("2023-02-29", False), ("1999-01-01", False), ("2024-1-1", False)]
)
def test_valid_date(spark, text, ok):
    assert value(spark, times.valid_date(F.lit(text))) is ok


def test_median_is_exact(spark):
    rows = spark.createDataFrame([(float(x),) for x in (10, 1, 4, 2)], "x double")
    assert rows.agg(F.median("x")).first()[0] == 3.0
    assert rows.filter("x > 99").agg(F.median("x")).first()[0] is None


def test_keys_and_images(spark):
    assert value(spark, texts.person_key(F.lit(""), F.lit("Ann  B"))) == "name:ann_b"
    assert value(spark, texts.plate_key(F.lit("ab-12 x"))) == "plate:AB12X"
    assert value(spark, texts.plate_key(F.lit("--"))) == "plate:unknown"
    assert value(spark, texts.plate_display(F.lit(" "), F.lit("plate:Q1"))) == "Q1"
    assert value(spark, texts.plate_display(F.lit("\t\u00a0AB 1\n\ufeff"), F.lit("plate:AB1"))) == "AB 1"
    jpeg = {
        "QUJD": "QUJD",
        "data:image/JPEG;base64,QUJD": "QUJD",
        "data:image/png;base64,QUJD": None,
        "<svg>": None,
        "": None,
        "A" * 512_000: "A" * 512_000,
        "A" * 512_001: None,
        "QUJD\n": None,
    }
    for raw, kept in jpeg.items():
        assert value(spark, texts.jpeg_base64(F.lit(raw))) == kept


@pytest.mark.parametrize(
    "message, code",
    [
        ("SQLITE_CONSTRAINT_FOREIGNKEY", "D1_FK_CONSTRAINT"),
        ("unique constraint failed", "D1_UNIQUE_CONSTRAINT"),
        ("d1_error: x", "D1_ERROR"),
        ("other", "D1_FAILURE"),
    ],
)
def test_error_codes(spark, message, code):
    assert value(spark, texts.error_code(F.lit(message))) == code


@pytest.mark.parametrize(
    "json, text",
    [
        ('"0"', "0"), ("0", None), ("false", None), ("true", "true"), ('""', None), ("null", None),
        ("1.50", "1.5"), ("1e3", "1000"), ("1746970986798", "1746970986798"), ("{}", "[object Object]"),
        ('["a",null,2]', "a,,2"), ("12345678901234567890", "12345678901234567000"),
    ],
)
def test_truthy_text(spark, json, text):
    pair = lj.typed_one(F.parse_json(F.lit(json)), {"v": "$"})
    assert value(spark, lj.truthy_text(pair["v"])) == text


@pytest.mark.parametrize("body, ok", [("{}", True), (" [1] ", True), ("{} x", False), ("", False),
                                      ("1,2", False), ("{}] x", False), ("{'a':1}", False)])
def test_strict_json(spark, body, ok):
    df = spark.createDataFrame([(body,)], "b string")
    row = lj.parse_strict(df, "b", "v", F.lit(True)).select(F.col("v").isNotNull().alias("ok"))
    assert row.first().ok is ok


def test_counters_defaults_and_merge(spark):
    stored = spark.createDataFrame([('{"duplicates":2}',), ("bad",), (None,)], "raw string")
    assert [r.duplicates for r in counters.decode_counters(stored, "raw").collect()] == [2, 0, 0]
    one = spark.createDataFrame([("2025-07-01", "duplicates", 1)], "local_date string, field string, value long")
    merged = counters.add_counters(one, one.union(one)).collect()
    assert [r.value for r in merged] == [3]
    odd = one.union(spark.createDataFrame([("2025-07-01", "other", 5)], one.schema))
    wide = counters.daily_counters(odd).first().asDict()
    assert wide["duplicates"] == 1 and wide["events_inserted"] == 0 and "other" not in wide


def test_params():
    assert minutes_map('{"a": "30", "b": 0, "c": "x", "d": 5}') == {"a": 30.0, "d": 5.0}
    assert minutes_map("nonsense") == {} and minutes_map(None) == {}
    p = JobParams.from_options({"gap_minutes": "x", "cameras": " A, ,b ", "vehicles": "TRUE"})
    assert p.gaps.default_ms == 20 * 60_000 and p.cameras == ("a", "b") and p.vehicles
    assert GapRules(-1).default_ms == 20 * 60_000
    with pytest.raises(ValueError):
        JobParams.from_options({"max_body_bytes": "10"})
