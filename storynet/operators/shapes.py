"""Component schemas as rules, and documents checked against them.

``rules_of`` reads JSON Schema documents, given as data, into one row for each place that a document may have: its path with
``*`` for every position of an array, and what must hold there. ``document_violations`` flattens documents into paths and
joins them to these rows, so that nested objects and every entry of a list are checked at any size of data. Read are type,
required, properties, items, $ref, allOf, enum, const, pattern, minimum, maximum, minLength, maxLength, minItems, maxItems,
uniqueItems (of scalars), additionalProperties and unevaluatedProperties: false. Conditional keywords are rows of
``audit.conditional_rules``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.functions.shared import saved, spread
from storynet.operators.audit import violations
from storynet.operators.nesting import escape, flatten

KEYS = ("entity_id", "component")
RULES = (
    "component string, place string, parent string, name string, kinds array<string>, required boolean, closed boolean, allowed array<string>, pattern string, low double, high double, "
    "min_length int, max_length int, min_items int, max_items int, unique boolean, declared boolean"
)


def _merged(schema: dict, named: dict[str, dict]) -> dict:
    """A schema with its references and parts put together."""
    out: dict = {}
    parts = [named[schema["$ref"]]] if schema.get("$ref") in named else []
    for part in [*parts, *schema.get("allOf", [])]:
        part = _merged(part, named)
        for k, v in part.items():
            out[k] = {**out[k], **v} if k == "properties" and k in out else [*out[k], *v] if k == "required" and k in out else v
    for k, v in schema.items():
        if k not in ("$ref", "allOf"):
            out[k] = {**out[k], **v} if k == "properties" and k in out else [*out[k], *v] if k == "required" and k in out else v
    return out


def rules_of(spark: SparkSession, schemas: dict[str, dict], named: dict[str, dict] | None = None) -> DataFrame:
    """``schemas`` by component and what they refer to by $ref: rows of ``RULES``. A schema that refers to itself is read to eight levels."""
    rows: list[tuple] = []

    def read(component: str, schema: dict, place: str, parent: str | None, name: str | None, required: bool, depth: int) -> None:
        schema = _merged(schema, named or {})
        kinds = schema.get("type")
        kinds = [kinds] if isinstance(kinds, str) else kinds
        allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
        closed = schema.get("additionalProperties") is False or schema.get("unevaluatedProperties") is False
        number = lambda k: None if k not in schema else float(schema[k])
        rows.append((
            component, place, parent, name, kinds, required, closed, None if allowed is None else [json.dumps(a, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for a in allowed], schema.get("pattern"),
            number("minimum"), number("maximum"), *(schema.get(k) for k in ("minLength", "maxLength", "minItems", "maxItems")), bool(schema.get("uniqueItems")), True,
        ))
        if depth == 8:
            return
        for key, inner in schema.get("properties", {}).items():
            read(component, inner, f"{place}/{escape(key)}", place, key, key in schema.get("required", []), depth + 1)
        for key in sorted(set(schema.get("required", [])) - set(schema.get("properties", {}))):  # needed, but of no stated shape
            rows.append((component, f"{place}/{escape(key)}", place, key, None, True, False, *[None] * 8, False, False))
        if isinstance(schema.get("items"), dict):
            read(component, schema["items"], f"{place}/*", place, "*", False, depth + 1)

    for component, schema in schemas.items():
        read(component, schema, "", None, None, False, 0)
    return spark.createDataFrame(rows, RULES)


def document_violations(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """``docs``(entity_id, component, data as JSON) against ``rules``: entity_id, component, path, code. Components without rules are not looked at; malformed data has an INVALID_TYPE at its root.

    What stands under an unknown field, or where a value has the wrong type, is not looked at again. A place whose path has a
    key that ends in _ref reports pattern, const, required and unknown fields as INVALID_REFERENCE. The rules, which come from
    schema files read on the driver, are broadcast; documents are flattened once, dealt out by entity, and saved.
    """
    parts = F.split("path", "/")
    rules = F.broadcast(rules)  # never the documents, which Spark else broadcasts where their component is a constant
    asked = docs.join(F.broadcast(rules.select("component").distinct()), "component", "left_semi")
    rows = saved(flatten(spread(asked, *KEYS), KEYS, arrays=True))
    rows = rows.withColumn("place", F.array_join(F.transform(parts, lambda p: F.when(p.startswith("#"), "*").otherwise(p)), "/"))
    cut = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    rows = rows.withColumns({"parent": F.when(F.col("path") != "", cut("place")), "above": F.when(F.col("path") != "", cut("path"))})
    in_ref = F.exists(F.split("path", "/"), lambda p: p.endswith("_ref"))
    met = rows.join(rules.drop("parent", "required"), ["component", "place"])

    # unknown fields of closed objects
    shut = rules.filter("closed").select("component", F.col("place").alias("parent"))
    unknown = rows.join(rules.filter("declared").select("component", "place"), ["component", "place"], "left_anti").join(shut, ["component", "parent"]).filter(~F.element_at(F.split("path", "/"), -1).startswith("#"))
    out = [violations(unknown, F.when(in_ref, "INVALID_REFERENCE").otherwise("UNKNOWN_FIELD"), entity="entity_id")]

    # required fields of each object that is there
    needed = rules.filter("required").select("component", F.col("parent").alias("place"), "name")
    wanted = met.filter("kind = 'object'").select(*KEYS, "place", F.col("path").alias("at")).join(needed, ["component", "place"])
    key = F.replace(F.replace(F.col("name"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    wanted = wanted.withColumn("path", F.concat("at", F.lit("/"), F.when(key.startswith("#"), F.concat(F.lit("~2"), F.substr(key, F.lit(2)))).otherwise(key)))
    absent = wanted.join(rows.select(*KEYS, "path"), [*KEYS, "path"], "left_anti")
    ref_above = F.exists(F.split("at", "/"), lambda p: p.endswith("_ref"))
    out.append(violations(absent, F.when(ref_above, "INVALID_REFERENCE").otherwise("MISSING_REQUIRED_FIELD"), entity="entity_id"))

    # types and values
    kinds, kind, value = F.col("kinds"), F.col("kind"), F.col("value")
    fits = kinds.isNull() | F.array_contains(kinds, kind) | ((kind == "integer") & F.array_contains(kinds, "number")) | ((kind == "number") & F.array_contains(kinds, "integer") & value.try_cast("double").eqNullSafe(F.floor(value.try_cast("double")).cast("double")))
    wrong = (kind == "invalid") | ~F.coalesce(fits, F.lit(True))
    out.append(violations(met.filter(wrong), "INVALID_TYPE", entity="entity_id"))
    said = F.when(kind == "string", F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))
    number = F.when(kind.isin("integer", "number"), value.try_cast("double"))
    no = lambda c: F.coalesce(c, F.lit(False))
    pattern, choice = no(~F.rlike(said, F.col("pattern"))), no(F.col("allowed").isNotNull() & ~F.array_contains("allowed", value))
    other = no(number < F.col("low")) | no(number > F.col("high")) | no(F.length(said) < F.col("min_length")) | no(F.length(said) > F.col("max_length"))
    pointed = in_ref & (pattern | (choice & (F.size("allowed") == 1)))
    bad = met.filter(~wrong & kind.isin("string", "integer", "number", "boolean", "null")).withColumn("code", F.when(pointed, "INVALID_REFERENCE").when(pattern | choice | other, "INVALID_VALUE"))
    out.append(violations(bad.filter("code is not null"), F.col("code"), entity="entity_id"))

    # how many entries an array has, and which of them come twice
    arrays = met.filter("kind = 'array' and (min_items is not null or max_items is not null)")
    n = rows.filter(F.element_at(parts, -1).startswith("#")).groupBy(*KEYS, F.col("above").alias("path")).agg(F.count("*").alias("n"))
    sized = arrays.join(n, [*KEYS, "path"], "left").fillna(0, ["n"])
    out.append(violations(sized.filter("n < min_items or n > max_items"), "INVALID_VALUE", entity="entity_id"))
    lists = met.filter("kind = 'array' and `unique`").select(*KEYS, F.col("path").alias("above"))
    entries = rows.filter(F.element_at(parts, -1).startswith("#") & ~kind.isin("object", "array")).join(lists, [*KEYS, "above"])
    twice = entries.groupBy(*KEYS, F.col("above").alias("path"), "kind", "value").count().filter("count > 1").select(*KEYS, "path").distinct()
    out.append(violations(twice, "INVALID_VALUE", entity="entity_id"))
    return reduce(DataFrame.unionByName, out)


