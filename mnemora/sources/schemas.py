"""Schemas of sealed records, for `functions.json_schema`."""

from __future__ import annotations

from mnemora.functions.labels import LABELS

# The forms of identifiers, times, event types and seals in durable records.
_UUID7 = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
_EVENT_TYPE = "^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)+$"
_SEAL = "^sha256:[0-9a-f]{64}$"


def event_schema(data: dict | bool = True, version: str | None = None) -> dict:
    """An event of the log; `data` is the schema of its data. With a version, records must name it and their type."""
    identifier = {"type": "string", "pattern": _UUID7}
    fields = {
        "id": identifier, "sequence": {"type": "integer", "minimum": 1}, "previous_event": {"oneOf": [identifier, {"type": "null"}]}, "event_type": {"type": "string", "pattern": _EVENT_TYPE},
        "recorded_at": {"type": "string", "format": "date-time", "pattern": _TIME}, "actor": {"type": "string", "minLength": 1}, "target": identifier, "data": data,
        "sensitivity": {"enum": list(LABELS)}, "sealed": {"const": True}, "integrity": {"type": "string", "pattern": _SEAL},
    }
    if version is not None:
        fields |= {"schema": {"const": version}, "record_type": {"const": "event"}}
    return {"type": "object", "required": [f for f in fields if f != "target"], "properties": fields}
