"""Compiled schemas against a plain checker."""

import json
import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from mnemora.functions.json_schema import faults, json_faults

ID = r"^[0-9a-f]{4}-7$"
SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["id", "kind", "list"], "additionalProperties": False,
    "properties": {
        "id": {"$ref": "#/$defs/id"}, "kind": {"enum": ["a", "b", 3, None]}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "at": {"$ref": "#/$defs/at"}, "day": {"anyOf": [{"type": "null"}, {"type": "string", "format": "date"}]},
        "list": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"oneOf": [{"$ref": "#/$defs/id"}, {"type": "object", "required": ["id"], "properties": {"id": {"$ref": "#/$defs/id"}, "x-role": {"type": "string", "minLength": 1, "maxLength": 3}}, "additionalProperties": False}]}},
        "map": {"type": "object", "minProperties": 1, "additionalProperties": {"type": "number"}}, "flag": {"const": True}, "free": True, "bare": {"not": {"type": "string"}},
    },
    "allOf": [{"if": {"properties": {"kind": {"const": "b"}}, "required": ["kind"]}, "then": {"required": ["map"]}, "else": {"properties": {"flag": {"type": "boolean"}}}}],
    "$defs": {"id": {"type": "string", "pattern": ID}, "at": {"type": "string", "format": "date-time"}},
}
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def is_a(v, kind):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return number and (kind == "number" or v == int(v)) if kind in ("number", "integer") else isinstance(v, KINDS[kind])


def same(a, b):
    return type(a) is type(b) and a == b or all(is_a(x, "number") for x in (a, b)) and a == b


def timed(v, kind):
    try:
        if kind == "date":
            return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) and date.fromisoformat(v))
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})", v) and datetime.fromisoformat(v))
    except ValueError:
        return False


def plain(s, v, at="$"):
    out = set()
    if s is True:
        return out
    if "$ref" in s:
        out |= plain(SCHEMA["$defs"][s["$ref"].split("/")[-1]], v, at)
    if "type" in s and not any(is_a(v, k) for k in ([s["type"]] if isinstance(s["type"], str) else s["type"])):
        out.add(f"{at}: type")
    if "const" in s and not same(v, s["const"]):
        out.add(f"{at}: const")
    if "enum" in s and not any(same(v, x) for x in s["enum"]):
        out.add(f"{at}: enum")
    if isinstance(v, str):
        bad = {"pattern": "pattern" in s and not re.search(s["pattern"], v), "minLength": len(v) < s.get("minLength", 0), "maxLength": len(v) > s.get("maxLength", 99), "format": "format" in s and not timed(v, s["format"])}
        out |= {f"{at}: {k}" for k, x in bad.items() if x}
    if is_a(v, "number"):
        out |= {f"{at}: {k}" for k, x in {"minimum": v < s.get("minimum", v), "maximum": v > s.get("maximum", v)}.items() if x}
    if isinstance(v, dict):
        out |= {f"{at}: required {k}" for k in s.get("required", []) if k not in v}
        if len(v) < s.get("minProperties", 0):
            out.add(f"{at}: minProperties")
        for k, x in v.items():
            if k in s.get("properties", {}):
                out |= plain(s["properties"][k], x, f"{at}.{k}")
            elif s.get("additionalProperties") is False:
                out.add(f"{at}: additionalProperties {k}")
            elif "additionalProperties" in s:
                out |= plain(s["additionalProperties"], x, f"{at}.{k}")
    if isinstance(v, list):
        said = [json.dumps(x, sort_keys=True) for x in v]
        bad = {"minItems": len(v) < s.get("minItems", 0), "maxItems": len(v) > s.get("maxItems", 99), "uniqueItems": s.get("uniqueItems") and len(set(said)) < len(said)}
        out |= {f"{at}: {k}" for k, x in bad.items() if x}
        for i, x in enumerate(v if "items" in s else []):
            out |= plain(s["items"], x, f"{at}.{i}")
    for sub in s.get("allOf", []):
        out |= plain(sub, v, at)
    if "anyOf" in s and all(plain(sub, v, at) for sub in s["anyOf"]):
        out.add(f"{at}: anyOf")
    if "oneOf" in s and sum(not plain(sub, v, at) for sub in s["oneOf"]) != 1:
        out.add(f"{at}: oneOf")
    if "not" in s and not plain(s["not"], v, at):
        out.add(f"{at}: not")
    if "if" in s:
        out |= plain(s.get("else" if plain(s["if"], v, at) else "then", True), v, at)
    return out


def test_generated_records_against_the_plain_checker(spark):
    rng = random.Random(4)
    ids = ["00ff-7", "00ff-7\n", "00FF-7", "", 7]
    pick = {
        "id": ids, "kind": ["a", "b", 3, 3.0, None, "c", True], "n": [1, 9.0, 0, 10, 1.5, None, "1", True], "at": ["2024-02-29T00:00:00Z", "2023-02-29T00:00:00Z", "2024-01-01T00:00:00+01:00", "2024-01-01", 5], "day": ["2024-02-29", "2024-02-30", None, 4],
        "list": [[], ["00ff-7"], ["00ff-7", "00ff-7"], [{"id": "00ff-7"}, "0000-7"], [{"id": "x", "x-role": "ab"}], [{"x-role": "long", "id": "00ff-7"}], [1], [{"id": "00ff-7", "other": 1}], "no", [["00ff-7"], "0000-7", "0001-7", "0002-7"]],
        "map": [{}, {"a": 1, "b": 2.5}, {"a": "x"}, 4], "flag": [True, False, 1, None], "free": [{"any": [1]}], "bare": ["s", 1], "other": [1, None],
    }
    records = [{k: rng.choice(v) for k, v in pick.items() if rng.random() < 0.7} for _ in range(400)] + [{"id": "00ff-7", "kind": "a", "list": ["00ff-7"]}, [], "x", None, 5]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, text string")
    got = {r.i: r.f for r in df.select("i", json_faults(SCHEMA, F.col("text")).alias("f")).collect()}
    for i, r in enumerate(records):
        assert got[i] == sorted(plain(SCHEMA, r)), r
    assert sum(not x for x in got.values()) >= 1


def test_texts_that_are_no_json_and_schemas_that_cannot_be_compiled(spark):
    df = spark.createDataFrame([("{",), (None,), ("1",)], "t string")
    assert [r[0] for r in df.select(json_faults({"type": "object"}, F.col("t"))).collect()] == [["$: json"], ["$: json"], ["$: type"]]
    for bad in ({"contains": 1}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"$ref": "other.json"}, {"const": [1]}):
        with pytest.raises(ValueError):
            faults(bad, F.col("v"))


def test_a_record_is_parsed_once_and_places_are_read_once(spark):
    """The plan of a record made from other columns holds its text once, whatever the schema asks of it."""
    df = spark.createDataFrame([(1, "b")], "id long, kind string")
    record = F.concat(F.lit('{"id": "00ff-7", "list": ["00ff-7"], "kind": "'), F.col("kind"), F.lit('"}'))
    out = df.select(json_faults(SCHEMA, record).alias("f"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count('{"id": "00ff-7"') <= 1
    assert out.first().f == ["$: required map"]


def test_required_keys_that_no_path_names(spark):
    df = spark.createDataFrame([('{"it\'s": 1, "a.b": null}',), ("{}",), ("[]",)], "t string")
    got = [r[0] for r in df.select(json_faults({"required": ["it's", "a.b"]}, F.col("t"))).collect()]
    assert got == [[], ["$: required a.b", "$: required it's"], []]
