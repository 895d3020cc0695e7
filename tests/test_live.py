"""Live sessions with camera gaps: the settling rule, and the stream with late rows and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.params import GapRules
from sightline.streaming.camera_sessions import Fragment, Gaps, camera_sessions, gathered, next_moment, settled
from sightline.streaming.live import live_sessions

MIN = 60_000
RULES = GapRules(20, {"id:b": 45.0}, {"cam-1": 5.0, "cam-2": 60.0})


def fold(sightings, key, rules):
    """Sessions of one entity's (time, id, camera), read in order."""
    out = []
    for t, e, c in sorted(sightings):
        if out:
            last = out[-1][-1]
            gap = rules.by_entity.get(key)
            if gap is None:
                gap = rules.by_camera.get(c, rules.default_minutes) if c == last[2] and c else rules.default_minutes
            if t - last[0] <= gap * MIN:
                out[-1].append((t, e, c))
                continue
        out.append([(t, e, c)])
    return [(*s[0], *s[-1], len(s)) for s in out]


@pytest.mark.parametrize("key", ["id:a", "id:b"])
def test_settling_equals_a_fold_in_any_order_of_arrival(key):
    rng = random.Random(4)
    for _ in range(150):
        gaps, kept, closed, seen = Gaps(key, RULES), [], [], []
        clock, watermark = 0, -1
        for batch in range(rng.randrange(1, 8)):
            clock += rng.choice([0, 10, 100]) * MIN
            for i in range(rng.randrange(6)):
                t = clock - rng.randrange(60) * MIN
                if t > watermark:
                    seen.append((t, f"e{batch}{i}", rng.choice(["cam-1", "cam-2", "cam-3", ""])))
                    kept = gathered([*kept, Fragment(*seen[-1], *seen[-1], 1)], gaps.least)
            watermark = max(watermark, clock - 40 * MIN)
            done, kept = settled(kept, gaps, watermark)
            closed += done
            # The timer is not later than the next change.
            if kept:
                due = next_moment(kept, gaps)
                assert due > watermark
                assert settled(kept, gaps, due - 1)[0] == []
        closed += settled(kept, gaps, 10**15)[0]
        assert sorted(map(tuple, closed)) == fold(seen, key, RULES)


def test_a_run_of_sightings_is_one_fragment():
    gaps = Gaps("id:a", RULES)
    run = [Fragment(i * MIN, f"e{i:04d}", f"cam-{i % 4}", i * MIN, f"e{i:04d}", f"cam-{i % 4}", 1) for i in range(1000)]
    random.Random(1).shuffle(run)
    kept = []
    for i in range(0, 1000, 50):
        kept = gathered([*kept, *run[i : i + 50]], gaps.least)
    assert len(kept) == 1 and kept[0].sighting_count == 1000


def deliver(spark, path, *rows):
    schema = "event_id string, seen_at_ms long, person_key string, camera_id string"
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_with_late_rows_and_restart(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema("event_id string, seen_at_ms long, person_key string, camera_id string")
        rows = stream.option("maxFilesPerTrigger", 1).parquet(path).withColumn("seen_ts", F.timestamp_millis("seen_at_ms"))
        found = camera_sessions(rows, "person_key", RULES, "30 minutes")
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.read.schema(found.schema).parquet(out)
        return query.lastProgress, sorted((r.person_key, r.first_event_id, r.last_event_id, r.sighting_count) for r in got.collect())

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        deliver(spark, path, ("a1", 100 * MIN, "id:a", "cam-1"), ("a3", 112 * MIN, "id:a", "cam-1"), ("b1", 100 * MIN, "id:b", ""))
        assert run()[1] == []
        # a2 comes late and has another camera: what a camera gap would part holds together.
        deliver(spark, path, ("a2", 106 * MIN, "id:a", "cam-2"), ("c1", 150 * MIN, "id:c", None))
        assert run()[1] == []
        # Past the watermark (120 minutes): dropped. Then time goes on and closes what is open.
        deliver(spark, path, ("a0", 90 * MIN, "id:a", "cam-1"), ("d1", 400 * MIN, None, "cam-1"))
        progress, got = run()
        assert got == [("id:a", "a1", "a3", 3), ("id:b", "b1", "b1", 1), ("id:c", "c1", "c1", 1)]
        deliver(spark, path, ("d2", 2000 * MIN, "id:d", "cam-1"))
        progress, got = run()
        assert got[0] == ("", "d1", "d1", 1) and len(got) == 4
        # One fragment and its timer are left, and what Spark keeps to find them.
        assert progress["stateOperators"][0]["numRowsTotal"] <= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_live_sessions_with_camera_gaps_have_the_usual_columns(spark, tmp_path):
    path = str(tmp_path / "in")
    deliver(spark, path, ("a1", MIN, "id:a", "cam-1"))
    stream = spark.readStream.schema("event_id string, seen_at_ms long, person_key string, camera_id string").parquet(path)
    found = live_sessions(stream.withColumn("seen_ts", F.timestamp_millis("seen_at_ms")), "person_key", RULES)
    assert found.columns == ["person_key", "started_at_ms", "ended_at_ms", "sighting_count"] and found.isStreaming
