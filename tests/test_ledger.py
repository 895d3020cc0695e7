"""The key ledger: what a batch reads, unfinished batches, merging, retention."""

import json

import pytest

from sightline.params import DAY_MS, JobParams
from sightline.plans import daily, key_ledger
from sightline.plans.ingest import batch_counters, ingest
from sightline.schemas import RAW_ALARMS
from sightline.sources.tables import Tables

from .builders import face, faces, note, notes, vehicle, vehicles

PARAMS = JobParams(vehicles=True)
T = 1746970990000
HISTORY = {"webhook_notifications", "face_events", "vehicle_events"}


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "store"))


def raw(spark, *ids, name="A", at=T):
    triggers = [
        {"key": "face_known" if i[0] == "f" else "license_plate_known", "eventId": i, "timestamp": at, "value": "P"} for i in ids
    ]
    body = json.dumps({"alarm": {"name": name, "triggers": triggers}, "timestamp": at})
    return spark.createDataFrame([(body, at, "10.0.0.1")], RAW_ALARMS)


def stored(tables, table="face_events"):
    return sorted(r.event_id for r in tables.read(table).collect())


def store(spark, tables, part, *events, at=T):
    """Rows of some events, with one delivery, stored and listed."""
    new = {
        "notes": notes(spark, note(f"n-{part}", at)),
        "face": faces(spark, *[face(e, at) for e in events if e[0] == "f"]),
        "vehicle": vehicles(spark, *[vehicle(e, at) for e in events if e[0] == "v"]),
    }
    files = key_ledger.add(tables, new, part)
    for kind, (table, _, _) in key_ledger.KINDS.items():
        tables.append(new[kind], table)
    key_ledger.commit(tables, files, part)


def listed(spark, tables, kind, *names):
    with tables.staging():
        return sorted(r.key for r in key_ledger.known(tables, keys(spark, kind, *names)).collect())


def keys(spark, kind, *names):
    return spark.createDataFrame([(kind, n) for n in names], "kind string, key string")


def test_a_batch_reads_no_history(spark, tables, monkeypatch):
    ingest(raw(spark, "f1", "v1"), tables, PARAMS, "1")
    seen, read = [], tables.read

    def watched(table):
        seen.append(table)
        return read(table)

    monkeypatch.setattr(tables, "read", watched)
    ingest(raw(spark, "f1", "f2", "v1", name="B"), tables, PARAMS, "2")
    monkeypatch.undo()
    assert not HISTORY & set(seen)
    assert stored(tables) == ["f1", "f2"] and stored(tables, "vehicle_events") == ["v1"]
    got = {r.field: r.value for r in batch_counters(tables, "2").collect()}
    assert (got["duplicates"], got["vehicle_duplicates"], got["events_inserted"]) == (1, 1, 1)


def test_new_keys_touch_no_part_and_known_ones_a_single_one(spark, tables):
    for i in range(3):
        store(spark, tables, f"p{i}", *[f"f{i}-{n}" for n in range(50)])
    with tables.staging():
        _, places = key_ledger.parts_to_read(tables, keys(spark, "face", *[f"new{n}" for n in range(200)]))
        assert len(places) <= 3
        _, places = key_ledger.parts_to_read(tables, keys(spark, "face", "f2-7"))
        assert len(places) == 1
        found = key_ledger.known(tables, keys(spark, "face", "f2-7", "f1-9", "f9-9"))
        assert sorted(r.key for r in found.collect()) == ["f1-9", "f2-7"]
        text = found._jdf.queryExecution().toString()
        assert any("part#" in x.split("]")[0] for x in text.split("PartitionFilters: [")[1:])
        # The same text as another kind of key is another key; a delivery comes with its id.
        assert key_ledger.known(tables, keys(spark, "vehicle", "f2-7")).count() == 0
        assert key_ledger.known(tables, keys(spark, "notes", "key-n-p1")).first().ref == "n-p1"
        # A batch's own part is left out.
        assert key_ledger.known(tables, keys(spark, "face", "f2-7"), "p2").count() == 0


def test_merging_keeps_every_key(spark, tables):
    for i in range(4):
        store(spark, tables, f"p{i}", f"f{i}", f"v{i}")
    before = {(r.digest, r.check, r.ref) for r in tables.read("key_ledger").collect()}
    assert key_ledger.merge_parts(tables, most=8) == []
    assert len(key_ledger.merge_parts(tables, most=2)) == 3
    assert {(r.digest, r.check, r.ref) for r in tables.read("key_ledger").collect()} == before and len(before) == 12
    assert tables.read("ledger_files").select("part").distinct().count() == 2
    assert listed(spark, tables, "face", *[f"f{i}" for i in range(6)]) == [f"f{i}" for i in range(4)]


def test_an_unfinished_batch_is_compared_with_the_tables(spark, tables, monkeypatch):
    append = tables.append

    def failing(df, table):
        if table == "vehicle_events":
            raise OSError("lost")
        append(df, table)

    monkeypatch.setattr(tables, "append", failing)
    with pytest.raises(OSError):
        ingest(raw(spark, "f1", "v1"), tables, PARAMS, "1")
    monkeypatch.undo()
    # The batch never comes back under its name; its rows come with others.
    ingest(raw(spark, "f1", "f2", "v1", name="B"), tables, PARAMS, "2")
    assert stored(tables) == ["f1", "f2"] and stored(tables, "vehicle_events") == ["v1"]
    assert tables.read("ledger_open").isEmpty()
    # Nor does it add anything twice when it does.
    ingest(raw(spark, "f1", "v1"), tables, PARAMS, "1")
    assert stored(tables) == ["f1", "f2"] and stored(tables, "vehicle_events") == ["v1"]
    assert tables.read("webhook_notifications").count() == 2


def test_a_store_without_a_ledger_gets_one(spark, tables):
    tables.append(faces(spark, face("f1", T)), "face_events")
    key_ledger.ensure(tables)
    assert listed(spark, tables, "face", "f1", "f2") == ["f1"]


def test_retention_unlists_what_it_deletes(spark, tables):
    store(spark, tables, "p1", "f1", "v1")
    store(spark, tables, "p2", "f2", at=T + 300 * DAY_MS)
    key_ledger.drop_expired(tables, T + 370 * DAY_MS)
    assert listed(spark, tables, "face", "f1", "f2") == ["f2"]
    assert listed(spark, tables, "notes", "key-n-p1", "key-n-p2") == [] and listed(spark, tables, "vehicle", "v1") == []
    key_ledger.drop_expired(tables, T + 370 * DAY_MS)
    assert [r.kind for r in tables.read("key_ledger").collect()] == ["face"]


def test_a_ledger_without_parts_is_asked_nothing(spark, tables, monkeypatch):
    keys = spark.createDataFrame([("face", "f1"), ("notes", None)], "kind string, key string")
    monkeypatch.setattr(key_ledger, "parts_to_read", lambda *_: pytest.fail("the keys were read"))
    found = key_ledger.known(tables, keys)
    assert found.columns == ["kind", "key", "ref"] and found.count() == 0
    monkeypatch.undo()
    store(spark, tables, "own", "f1")
    assert key_ledger.known(tables, keys, "own").count() == 0
    assert [r.key for r in key_ledger.known(tables, keys, "other").collect()] == ["f1"]
