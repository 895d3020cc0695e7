"""Small sightings tables for tests."""

from sightline.schemas import FACES, NOTIFICATIONS, VEHICLES

CAM = "cam-1"


def face(event_id, ms, person="id:a", name="Alice", camera=CAM, date="2025-07-01", **more):
    row = {
        "id": f"row-{event_id}", "notification_id": None, "event_id": event_id, "seen_at_ms": ms,
        "local_date": date, "person_key": person, "person_name": name, "person_id": "",
        "trigger_key": "face_known", "camera_id": camera, "alarm_name": "Alarm",
        "raw_trigger_json": '{"k":1}', "image_base64": None,
    }
    return {**row, **more}


def vehicle(event_id, ms, plate="plate:AAA", text="AAA", camera=CAM, date="2025-07-01", **more):
    row = {
        "id": f"row-{event_id}", "notification_id": None, "event_id": event_id, "seen_at_ms": ms,
        "local_date": date, "plate_key": plate, "plate_text": text,
        "trigger_key": "license_plate_known", "camera_id": camera, "alarm_name": "Alarm",
        "raw_trigger_json": '{"k":1}', "image_base64": None,
    }
    return {**row, **more}


def note(id_, ms, date="2025-07-01", **more):
    row = {
        "id": id_, "received_at_ms": ms, "source_ip": "10.0.0.1", "event_id": "e",
        "alarm_name": "Alarm", "payload_json": '{"p":1}', "image_base64": "QUJD",
        "delivery_key": f"key-{id_}", "local_date": date,
    }
    return {**row, **more}


def _frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)


def faces(spark, *rows):
    return _frame(spark, rows, FACES)


def vehicles(spark, *rows):
    return _frame(spark, rows, VEHICLES)


def notes(spark, *rows):
    return _frame(spark, rows, NOTIFICATIONS)
