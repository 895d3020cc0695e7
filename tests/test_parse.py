"""Payload parsing on small payloads."""

import hashlib
import json

from sightline.operators import parse
from sightline.params import JobParams
from sightline.schemas import RAW_ALARMS

RECEIVED = 1746970999000
BOTH = JobParams(vehicles=True)


def trigger(key="face_known", event="e1", ts=1746970986798, device="cam", **more):
    return {"key": key, "eventId": event, "timestamp": ts, "device": device, **more}


def payload(*triggers, conditions=(), **more):
    return {"alarm": {"name": "A", "triggers": list(triggers), "conditions": list(conditions)}, **more}


def run(spark, params, *bodies):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    raw = spark.createDataFrame([(t, RECEIVED, "10.0.0.1") for t in texts], RAW_ALARMS)
    lines = parse.alarm_lines(raw, params)
    return (
        parse.faces_of(lines).collect(),
        parse.vehicles_of(lines).collect(),
        parse.rejects_of(lines).collect(),
        parse.notifications_of(lines).collect(),
    )


def test_known_and_unknown_face(spark):
    known = {"condition": {"source": "face_known", "value": "pid"}}
    body = payload(
        trigger(value="Example Person"), trigger("face_unknown", "e2"), conditions=[known]
    )
    faces, vehicles, rejects, notes = run(spark, BOTH, body)
    assert [(f.person_key, f.person_name) for f in sorted(faces, key=lambda f: f.pos)] == [
        ("id:pid", "Example Person"),
        ("name:unknown", "Unknown"),
    ]
    assert faces[0].local_date == "2025-05-11" and not vehicles and not rejects
    assert [(n.event_id, n.alarm_name) for n in notes] == [("e1", "A")]


def test_first_condition_counts_even_without_value(spark):
    empty = {"condition": {"source": "face_known"}}
    later = {"condition": {"source": "face_known", "value": "late"}}
    faces, *_ = run(spark, BOTH, payload(trigger(value="Bo"), conditions=[empty, later]))
    assert faces[0].person_key == "name:bo" and faces[0].person_id == ""


def test_plates(spark):
    plate = trigger("license_plate_known", value="\t ab-12\u00a0\n", group={"name": "Owner", "id": 3}, image="QUJD")
    test_fire = trigger("license_plate_unknown", "testEventId")
    assert run(spark, JobParams(), payload(plate))[1] == []
    _, vehicles, _, _ = run(spark, BOTH, payload(plate, test_fire))
    first, second = sorted(vehicles, key=lambda v: v.pos)
    assert (first.plate_key, first.plate_text) == ("plate:AB12", "ab-12")
    kept = json.loads(first.raw_trigger_json)
    assert kept["value"] == "[redacted]" and kept["group"] == {"name": "[redacted]", "id": 3}
    assert "image" not in kept and first.image_base64 == "QUJD"
    assert (second.plate_key, second.event_id) == ("plate:unknown", f"testEventId-{RECEIVED}")


def test_seconds_and_mixed(spark):
    body = payload(trigger(ts=1000), trigger("license_plate_known", "e2", 2000, value="x"))
    faces, vehicles, _, _ = run(spark, BOTH, body)
    assert faces[0].seen_at_ms == 1_000_000 and vehicles[0].seen_at_ms == 2_000_000


def test_one_bad_timestamp_rejects_the_payload(spark):
    for bad in ("1746970986798", None, -5, 9e15):
        body = payload(trigger(), trigger(event="e2", ts=bad))
        faces, _, rejects, notes = run(spark, BOTH, body)
        assert (faces, notes) == ([], []) and rejects[0].reason == "rejected_json"
    # The rule does not look at triggers that are dropped anyway.
    fine = payload(trigger(), trigger("motion", "e2", "x"), trigger(event="", ts="x"))
    assert len(run(spark, BOTH, fine)[0]) == 1
    elsewhere = payload(trigger(device="Cam"), trigger(event="e2", ts="x", device="other"))
    assert len(run(spark, JobParams(cameras=("cam",)), elsewhere)[0]) == 1


def test_gates_and_empty_payloads(spark):
    small = JobParams(max_body_bytes=100)
    bodies = ["{} x", "", "null", "5", '{"alarm":5}', '{"p":"' + "x" * 200 + '"}']
    _, _, rejects, notes = run(spark, small, *bodies)
    assert sorted(r.reason for r in rejects) == ["rejected_body"] + ["rejected_json"] * 3
    assert [n.alarm_name for n in notes] == ["N/A", "N/A"]


def test_person_filters(spark):
    body = payload(trigger(value="Ann"), trigger(event="e2", value="Bob"))
    assert [f.person_name for f in run(spark, JobParams(target_names=("bob",)), body)[0]] == ["Bob"]
    cond = {"condition": {"source": "face_known", "value": "ID1"}}
    with_id = payload(trigger(value="Ann"), conditions=[cond])
    assert len(run(spark, JobParams(target_ids=("id1",)), with_id)[0]) == 1
    assert run(spark, JobParams(target_ids=("id2",)), with_id)[0] == []


def test_images_fall_back(spark):
    body = payload(trigger(image="<svg>"), trigger(event="e2"), image="SU1H")
    faces, _, _, notes = run(spark, BOTH, body)
    assert [f.image_base64 for f in faces] == ["SU1H", "SU1H"] and notes[0].image_base64 == "SU1H"


def test_delivery_key(spark):
    body = payload(trigger(event="b"), trigger(event="a"), trigger(event=7), timestamp=1746970986798)
    body["alarm"]["eventPath"] = "/x"
    key = run(spark, BOTH, body)[3][0].delivery_key
    text = "v1\nA\n/x\n1746970986798\na\nb"
    assert key == hashlib.sha256(text.encode()).hexdigest()
    bare = run(spark, BOTH, "{}")[3][0].delivery_key
    assert bare == hashlib.sha256(b"v1\n\n\n").hexdigest()
