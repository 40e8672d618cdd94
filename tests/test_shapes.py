"""Documents against schemas: every keyword on hand-made documents, and random ones against a plain validator."""

from __future__ import annotations

import json
import random

from storynet.operators import shapes

REF = {"type": "object", "additionalProperties": False, "required": ["id", "type"], "properties": {"id": {"type": "string", "pattern": "^[a-z]+_[0-9]+$"}, "type": {"const": "item"}}}
SCHEMA = {
    "type": "object", "required": ["schema_version", "data"], "unevaluatedProperties": False, "allOf": [{"$ref": "base"}],
    "properties": {"data": {"type": "object", "additionalProperties": False, "required": ["states"], "properties": {
        "states": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["kind", "status"], "properties": {"kind": {"type": "string", "minLength": 2, "maxLength": 5}, "status": {"enum": ["active", "inactive", 3]}, "target_ref": {"$ref": "ref"}}}},
        "tags": {"type": "array", "uniqueItems": True, "items": {"type": "string"}}, "amount": {"type": "number", "minimum": 0, "maximum": 10}, "count": {"type": "integer"}, "open": {"type": "object"}, "a/b": {"type": ["string", "null"]}}}},
}
BASE = {"properties": {"schema_version": {"const": "0.1.0"}}}


def plain(value, schema, path=""):
    """(path, code) of a document, by recursion."""
    schema = shapes._merged(schema, {"base": BASE, "ref": REF})
    ref = any(p.endswith("_ref") for p in path.split("/"))
    kind = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}.get(type(value), "null")
    types = schema.get("type")
    types = [types] if isinstance(types, str) else types
    if types and kind not in types and not (kind == "integer" and "number" in types) and not (kind == "number" and "integer" in types and value == int(value)):
        yield path, "INVALID_TYPE"
    elif kind == "object":
        for k in schema.get("required", []):
            if k not in value:
                yield f"{path}/{k.replace('/', '~1')}", "INVALID_REFERENCE" if ref else "MISSING_REQUIRED_FIELD"
    elif kind == "array":
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", 99):
            yield path, "INVALID_VALUE"
        flat = [json.dumps(v) for v in value if not isinstance(v, dict | list)]
        if schema.get("uniqueItems") and len(set(flat)) < len(flat):
            yield path, "INVALID_VALUE"
    else:
        import re

        allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
        choice = allowed is not None and json.dumps(value) not in [json.dumps(a) for a in allowed]
        pattern = kind == "string" and "pattern" in schema and not re.search(schema["pattern"], value)
        number = kind in ("integer", "number") and not schema.get("minimum", -1e9) <= value <= schema.get("maximum", 1e9)
        size = kind == "string" and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 99)
        if choice or pattern or number or size:
            yield path, "INVALID_REFERENCE" if ref and (pattern or choice and len(allowed) == 1) else "INVALID_VALUE"
    if kind == "object":
        closed = schema.get("additionalProperties") is False or schema.get("unevaluatedProperties") is False
        for k, v in value.items():
            at = f"{path}/{k.replace('/', '~1')}"
            if k in schema.get("properties", {}):
                yield from plain(v, schema["properties"][k], at)
            elif closed:
                yield at, "INVALID_REFERENCE" if any(p.endswith("_ref") for p in at.split("/")) else "UNKNOWN_FIELD"
    if kind == "array" and "items" in schema:
        for i, v in enumerate(value):
            yield from plain(v, schema["items"], f"{path}/#{i}")


def random_value(rng, depth=0):
    pick = rng.random()
    if depth < 3 and pick < 0.25:
        return {rng.choice(["kind", "id", "x"]): random_value(rng, depth + 1) for _ in range(rng.randint(0, 2))}
    if depth < 3 and pick < 0.4:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 3, -1, 2.0, 2.5, 11, "active", "t", "inactive", "item_1", "item", "0.1.0", "long text"])


def documents(n):
    rng, out = random.Random(1), []
    some = lambda good: good if rng.random() < 0.8 else random_value(rng)
    for i in range(n):
        state = lambda: some({k: some(v) for k, v in {"kind": "rain", "status": rng.choice(["active", 3]), "target_ref": some({k: some(v) for k, v in {"id": "item_1", "type": "item", "more": 1}.items() if rng.random() < 0.8})}.items() if rng.random() < 0.85})
        data = {"states": some([state() for _ in range(rng.randint(0, 4))]), "tags": some([rng.choice("abc") for _ in range(rng.randint(0, 3))]), "amount": some(3), "count": some(2), "open": some({"z": [1, {"q": 2}]}), "a/b": some("x"), "extra": 1}
        data = {k: v for k, v in data.items() if rng.random() < 0.85}
        out.append((str(i), "c", {k: v for k, v in {"schema_version": some("0.1.0"), "data": some(data), "odd": 1}.items() if rng.random() < 0.85}))
    return out


def test_violations_equal_a_plain_validator(spark):
    docs = documents(150)
    rows = spark.createDataFrame([(i, c, json.dumps(d)) for i, c, d in docs] + [("bad", "c", "{"), ("none", "c", None), ("other", "x", "{}")], "entity_id string, component string, data string")
    rules = shapes.rules_of(spark, {"c": SCHEMA}, {"base": BASE, "ref": REF})
    got = sorted((r.entity_id, r.path, r.code) for r in shapes.document_violations(rows, rules).collect())
    want = sorted((i, p, code) for i, _, d in docs for p, code in plain(d, SCHEMA))
    assert got == sorted([*want, ("bad", "", "INVALID_TYPE")])
    assert {"INVALID_TYPE", "INVALID_VALUE", "INVALID_REFERENCE", "UNKNOWN_FIELD", "MISSING_REQUIRED_FIELD"} <= {c for *_, c in got}


def test_documents_of_a_constant_component_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shapes, "saved", lambda df: df, raising=False)
    rows = spark.range(1000).selectExpr("cast(id as string) as entity_id", "'c' as component", "'{\"odd\":1}' as data")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = shapes.document_violations(rows, shapes.rules_of(spark, {"c": {"type": "object", "additionalProperties": False}}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BuildLeft" not in plan
    assert out.filter("path = '/odd' and code = 'UNKNOWN_FIELD'").count() == 1000
