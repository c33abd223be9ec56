"""Requests checked whole, against a plain reading of their JSON."""

from __future__ import annotations

import json

import pytest

from tidemark.operators.contract import RecordRule
from tidemark.operators.envelopes import check_requests, request_records

RULES = [RecordRule("name", "text"), RecordRule("age", "integer", minimum=0), RecordRule("note", "text", optional=True)]


def _errors(body):
    try:
        parsed = json.loads(body)
    except (TypeError, ValueError):
        parsed = None
    if not isinstance(parsed, dict):
        return ["body:json"]
    found, listed = [], parsed.get("instances")
    if "instances" not in parsed:
        found.append("instances:missing")
    elif not isinstance(listed, list):
        found.append("instances:array")
    elif not listed:
        found.append("instances:too_short")
    elif len(listed) > 3:
        found.append("instances:too_long")
    found += [f"{k}:extra" for k in sorted(parsed) if k != "instances"]
    for i, record in enumerate(listed if isinstance(listed, list) else []):
        at = f"instances.{i}."
        if not isinstance(record, dict):
            found.append(at + "record:object")
            continue
        if not str(record.get("name") or "").strip():
            found.append(at + "name:text")
        age = record.get("age")
        if not (isinstance(age, (int, float)) and age == int(age) and age >= 0):
            found.append(at + "age:integer")
        found += [f"{at}{k}:extra" for k in sorted(record) if k not in ("name", "age", "note")]
    return found


GOOD = {"name": "a", "age": 3}
BODIES = [
    json.dumps({"instances": [GOOD]}), json.dumps({"instances": [GOOD] * 3}), json.dumps({"instances": [GOOD] * 4}),
    json.dumps({"instances": []}), json.dumps({"instances": None}), json.dumps({"instances": {"0": GOOD}}),
    json.dumps({"instances": [GOOD], "b": 1, "a": None}), json.dumps({}), json.dumps([]), json.dumps([GOOD]), "1", "",
    "{", "null", None, json.dumps({"instances": [1, None, "x"]}), json.dumps({"instances": [{}, [GOOD]]}),
    json.dumps({"instances": [{"name": " \t", "age": -1, "z": 1, "note": None}]}),
    json.dumps({"instances": [{"name": "x" * 50_000, "age": 2.0, "y.y": {}, "it's": 1}]}),
    json.dumps({"instances": [{"name": "a", "age": 2.5}, {"name": None, "age": None}]}),
]


def test_requests_are_checked_whole(spark):
    df = spark.createDataFrame([(i, b, "kept") for i, b in enumerate(BODIES)], "id int, body string, errors_seen string")
    got = {r["id"]: r for r in check_requests(df, "body", RULES, maximum=3).collect()}
    for i, body in enumerate(BODIES):
        assert got[i]["errors"] == _errors(body), body
        assert got[i]["accepted"] == (not _errors(body)) and got[i]["errors_seen"] == "kept"
    assert [got[i]["record_count"] for i in (0, 1, 2, 3, 4, 5, 12, 15)] == [1, 3, 4, 0, 0, 0, 0, 3]


def test_records_of_requests(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    rows = request_records(df, "body", ["name", "age"]).orderBy("id", "record_pos").collect()
    assert [(r["id"], r["record_pos"]) for r in rows if r["id"] in (0, 1, 3, 15)] == [
        (0, 0), (1, 0), (1, 1), (1, 2), (15, 0), (15, 1), (15, 2)]
    assert (rows[0]["name"], rows[0]["age"], json.loads(rows[0]["record"])) == ("a", "3", GOOD)
    assert check_requests(df.limit(0), "body", RULES).count() == 0
    with pytest.raises(ValueError, match="path"):
        request_records(df, "body", ["it's"])
