"""Typed components from candidate data, by tables: which section of which type gives which component.

``sections``(entity_id, type, section, data): a candidate's sections as JSON objects, a row for each. One pass over them:
each section's object is read as a map, its fields picked by the rules, and components without what they need are left out.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.operators.audit import PLACEMENT_ROLES

# Type, section, component, fields of the component schemas, and the ones needed ("all", "any", or a list).
SECTIONS = (
    ("character", "profile", "character_profile", "species gender age_description background appearance", "species background"),
    ("character", "state", "character_state", "physical_condition mental_condition current_emotions", "all"),
    ("location", "profile", "location_profile", "location_kind primary_functions scale_description spatial_characteristics", "all"),
    ("location", "environment", "environment_profile", "terrain_and_landform climate_tendencies natural_resources fixed_facilities persistent_conditions", "any"),
    ("location", "atmosphere", "location_atmosphere", "atmosphere_summary sensory_features cultural_impressions", "all"),
    ("item", "profile", "item_profile", "item_kind instance_mode primary_functions materials form_description", "all"),
    ("item", "characteristic", "item_characteristic", "appearance_and_sensory craftsmanship typical_behavior symbolic_meanings", "any"),
    ("item", "container", "container_profile", "capacity_description allowed_contents forbidden_contents stable_capabilities access_requirements", "all"),
    ("organization", "profile", "organization_profile", "organization_kind public_role operating_scope continuity_basis", "all"),
    ("organization", "structure", "organization_structure", "governance_model roles", "governance_model"),
    ("organization", "culture", "organization_culture", "summary core_values norms taboos behavioral_style", "all"),
    ("organization", "strategy", "organization_strategy", "decision_style long_term_directions", "decision_style"),
    ("skill", "definition", "skill_definition", "skill_kind domain primary_capabilities form_description", "all"),
    ("skill", "characteristic", "skill_characteristic", "style_summary sensory_signatures tactical_tendencies distinguishing_features", "all"),
    ("concept", "definition", "concept_definition", "concept_kind definition epistemic_status operational_role scope_summary", "all"),
    ("concept", "applicability", "applicability", "applies_to_entity_types conditions exclusions exceptions prerequisites", "all"),
)
# The most entries that a list keeps.
CAPS = {"personality_traits": 24, "motivations": 32, "preferences": 48, "objectives": 24, "current_emotions": 16, "long_term_directions": 32}


def project_components(sections: DataFrame, rules=SECTIONS) -> DataFrame:
    """entity_id, type, component, schema_version, data (JSON) of every section that has what its component needs; blank fields count as missing."""
    body = F.from_json("data", "map<string,string>")
    full = F.map_filter(body, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    rows = sections.withColumn("m", full).filter("m is not null")
    found = F.lit(None).cast("struct<component:string,data:map<string,string>>")
    for kind, section, component, fields, need in rules:
        names = fields.split()
        wanted = names if need in ("all", "any") else need.split()
        has = [F.map_contains_key("m", F.lit(n)) for n in wanted]
        enough = reduce(Column.__or__ if need == "any" else Column.__and__, has)
        kept = _kept(names)
        hit = (F.col("type") == kind) & (F.col("section") == section) & enough
        found = F.when(hit, F.struct(F.lit(component).alias("component"), kept.alias("data"))).otherwise(found)
    rows = rows.withColumn("c", found).filter("c is not null")
    return rows.select("entity_id", "type", F.col("c.component").alias("component"), F.lit("0.1.0").alias("schema_version"), F.to_json("c.data").alias("data"))


def _kept(names: list[str]) -> Column:
    """The section's map with these keys only."""

    def keep(k: Column, _: Column) -> Column:
        return k.isin(*names)

    return F.map_filter("m", keep)


def project_lists(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """List components: ``entries``(entity_id, type, section, ord, value as JSON) by ``rules``(type, section, component, field, most): each list as the field of its component, its first ``most``
    entries: entity_id, type, component, data. Lists without an entry give no component."""
    met = entries.filter("value is not null").join(rules, ["type", "section"])
    n = F.row_number().over(W.partitionBy("entity_id", "type", "component", "field").orderBy("ord", "value"))
    kept = met.withColumn("n", n).filter("n <= most")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), ",")
    one = kept.groupBy("entity_id", "type", "component", "field").agg(listed.alias("v"))
    text = F.concat(F.lit('"'), F.col("field"), F.lit('":['), F.col("v"), F.lit("]"))
    out = one.groupBy("entity_id", "type", "component").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("d"))
    return out.select("entity_id", "type", "component", F.concat(F.lit("{"), "d", F.lit("}")).alias("data"))


#: Type, section, component, field and the most entries of the list components.
LISTS = (
    ("character", "traits", "character_behavior_profile", "personality_traits", 24), ("character", "motivations", "character_behavior_profile", "motivations", 32),
    ("character", "preferences", "character_behavior_profile", "preferences", 48), ("character", "objectives", "character_objective", "objectives", 24),
    ("organization", "objectives", "organization_objective", "objectives", 24), ("organization", "directions", "organization_strategy", "long_term_directions", 32),
    ("organization", "roles", "organization_structure", "roles", 64), ("location", "states", "location_state", "states", 24), ("organization", "states", "organization_state", "states", 24),
    ("skill", "mechanics", "skill_mechanics", "mechanics", 64), ("skill", "requirements", "skill_requirements", "requirements", 64), ("concept", "rules", "concept_rules", "rules", 64),
)


def project_parents(claims: DataFrame) -> DataFrame:
    """``claims``(entity_id, type, parent_id, parent_type): parent components of locations and organizations; a parent has the same type and is not the entity itself."""
    good = claims.filter("type in ('location', 'organization') and parent_type = type and parent_id <> entity_id")
    one = good.groupBy("entity_id", "type").agg(F.min("parent_id").alias("parent_id"))
    name = F.concat("type", F.lit("_ref"))
    data = F.concat(F.lit('{"parent_'), name, F.lit('":{"id":"'), "parent_id", F.lit('","type":"'), "type", F.lit('"}}'))
    return one.select("entity_id", "type", F.concat(F.lit("parent_"), "type", F.lit("_reference")).alias("component"), data.alias("data"))


def role_keys(roles: DataFrame) -> DataFrame:
    """``roles``(entity_id, ord, name): each role's key in snake case, numbered where it repeats: entity_id, ord, name, role_key."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.trim("name"), r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")
    rows = roles.withColumn("base", F.when(plain == "", "role").otherwise(plain))
    n = F.row_number().over(W.partitionBy("entity_id", "base").orderBy("ord"))
    return rows.withColumn("n", n).select("entity_id", "ord", "name", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))).alias("role_key"))


def skill_references(skills: DataFrame) -> DataFrame:
    """``skills``(entity_id, ord, skill_id, framework_id, stage): a character's skills as one component, of the later version if any has a stage: entity_id, component, schema_version, n_skills, n_staged."""
    known = skills.filter("skill_id is not null").groupBy("entity_id", "skill_id").agg(F.max(F.col("stage").isNotNull() & F.col("framework_id").isNotNull()).alias("staged"))
    n = known.groupBy("entity_id").agg(F.count("*").alias("n_skills"), F.count_if("staged").alias("n_staged"))
    return n.select("entity_id", F.lit("skill_reference").alias("component"), F.when(F.col("n_staged") > 0, "0.2.0").otherwise("0.1.0").alias("schema_version"), "n_skills", "n_staged")


def stage_ids(stages: DataFrame) -> DataFrame:
    """``stages``(entity_id, kind, ord, name): ids of bindings, stages and context blocks, stable for a name and numbered where it repeats: entity_id, kind, ord, id."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.trim("name"), r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")
    rows = stages.withColumn("base", F.concat("kind", F.lit("_"), F.when(plain == "", F.left(F.md5("name"), F.lit(8))).otherwise(plain)))
    n = F.row_number().over(W.partitionBy("entity_id", "kind", "base").orderBy("ord"))
    return rows.withColumn("n", n).select("entity_id", "kind", "ord", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))).alias("id"))


def related_concepts(links: DataFrame) -> DataFrame:
    """``links``(entity_id, type, concept_id): one component of each entity that is no character, with its distinct concepts in order: entity_id, type, component, ids."""
    rows = links.filter("type <> 'character' and concept_id is not null and concept_id <> entity_id")
    return rows.groupBy("entity_id", "type").agg(F.array_sort(F.collect_set("concept_id")).alias("ids")).select("entity_id", "type", F.lit("related_concept_reference").alias("component"), "ids")


def maintenance_records(unclassified: DataFrame, revisions: DataFrame) -> DataFrame:
    """``unclassified``(entity_id, field, value) and ``revisions``(entity_id, field, ord, value), the values that others replaced: one maintenance component of each entity that has any:
    entity_id, component, n_unclassified, n_revisions, fields."""
    a = unclassified.select("entity_id", "field", F.lit(1).alias("u"), F.lit(0).alias("r"))
    b = revisions.select("entity_id", "field", F.lit(0).alias("u"), F.lit(1).alias("r"))
    out = a.unionByName(b).groupBy("entity_id").agg(F.sum("u").alias("n_unclassified"), F.sum("r").alias("n_revisions"), F.array_sort(F.collect_set("field")).alias("fields"))
    return out.select("entity_id", F.lit("entity_field_maintenance").alias("component"), "n_unclassified", "n_revisions", "fields")


def cap_lists(entries: DataFrame) -> DataFrame:
    """``entries``(entity_id, field, ord, value): at most CAPS of each list, the first ones."""
    limit = F.lit(None).cast("int")
    for field, n in CAPS.items():
        limit = F.when(F.col("field") == field, n).otherwise(limit)
    listed = entries.groupBy("entity_id", "field").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"))
    cut = F.when(limit.isNull(), F.col("v")).otherwise(F.slice("v", F.lit(1), F.coalesce(limit, F.lit(1))))
    return listed.select("entity_id", "field", F.transform(cut, lambda x: x["value"]).alias("values"))


def project_placements(stated: DataFrame, hints: DataFrame) -> DataFrame:
    """``stated`` and ``hints``(item, target, target_type, role): the stated placement of an item, else the hint; a role must fit the target's type, and an item is not in itself."""
    both = stated.withColumn("rank", F.lit(0)).unionByName(hints.withColumn("rank", F.lit(1)))
    best = both.groupBy("item").agg(F.min(F.struct("rank", "target", "target_type", "role")).alias("m")).select("item", "m.target", "m.target_type", "m.role")
    fits = F.lit(False)
    for kind, roles in PLACEMENT_ROLES.items():
        fits = fits | ((F.col("target_type") == kind) & F.col("role").isin(*roles))
    return best.filter(fits & (F.col("item") != F.col("target")))


def overlay_open_fields(components: DataFrame, open_fields: DataFrame) -> DataFrame:
    """``components``(entity_id, type, component, schema_version, data) with open semantic ones of the same columns: the later version of a component wins, by the numbers of its parts."""
    numbers = F.transform(F.split("schema_version", r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))).alias("n")
    both = components.unionByName(open_fields)
    best = F.max(F.struct(numbers, "schema_version", "type", "data"))
    return both.groupBy("entity_id", "component").agg(best.alias("m")).select("entity_id", "m.type", "component", "m.schema_version", "m.data")


_KINDS = ("null", "boolean", "integer", "number", "string", "object", "array", "invalid")
_KIND = {t: _KINDS.index(k) for t, k in ((type(None), "null"), (bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (dict, "object"), (list, "array"))}
_STRING, _OBJECT, _ARRAY, _INVALID = (_KINDS.index(k) for k in ("string", "object", "array", "invalid"))


@lru_cache(maxsize=4096)
def _step(key: str | int) -> str:
    return "/" + (str(key) if isinstance(key, int) else key.replace("~", "~0").replace("/", "~1"))


def _leaves(value, path: str, paths: list[str], kinds: list[int], values: list[str]) -> None:
    """Adds the leaves of an object or array that holds something; it calls itself for those only, not for each leaf."""
    for k, v in value.items() if type(value) is dict else enumerate(value):
        kind = _KIND[type(v)]
        if kind == _STRING:
            text = v
        elif v and kind >= _OBJECT:
            _leaves(v, path + _step(k), paths, kinds, values)
            continue
        else:
            text = json.dumps(v)
        paths.append(path + _step(k))
        kinds.append(kind)
        values.append(text)


def _repeated(cells: list[str]) -> pa.Array:
    """The array of texts of which few differ: each of those becomes Arrow's once."""
    index: dict[str, int] = {}
    at = [index.setdefault(c, len(index)) for c in cells]
    return pa.array(list(index), pa.string()).take(pa.array(np.array(at, dtype=np.int32)))


def flatten_json(rows: DataFrame) -> DataFrame:
    """``rows``(entity_id, component, data as JSON) to entity_id, component, path, type, value: every leaf, empty objects and lists included; malformed data gives one row of type invalid."""

    def scan(batches):
        for b in batches:
            paths, kinds, values, ends = [], [], [], [0]
            for data in b.column("data").to_pylist():
                try:
                    value = json.loads(data or "")
                except ValueError:
                    paths.append("")
                    kinds.append(_INVALID)
                    values.append("null")
                else:
                    if value and isinstance(value, (dict, list)):
                        _leaves(value, "", paths, kinds, values)
                    else:
                        paths.append("")
                        kinds.append(_KIND[type(value)])
                        values.append(value if isinstance(value, str) else json.dumps(value))
                ends.append(len(paths))
            # what names a document is repeated for its leaves as it stands, without becoming Python's
            at = pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends)))
            named = [b.column(c).cast(pa.string()).take(at) for c in ("entity_id", "component")]
            kind = pa.array(_KINDS).take(pa.array(np.array(kinds, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*named, _repeated(paths), kind, pa.array(values, pa.string())], ["entity_id", "component", "path", "type", "value"])

    kind = "entity_id string, component string, path string, type string, value string"
    return rows.select("entity_id", "component", "data").mapInArrow(scan, kind)


def extract_proposals(batches: DataFrame, extractor, schema: str) -> DataFrame:
    """Proposals of any extractor over batches of text: ``extractor`` is a function of an iterator of pandas frames, as mapInPandas takes; a table of stored replies needs none."""
    return batches.mapInPandas(extractor, schema)


def normalise_plan(plan: DataFrame, steps) -> DataFrame:
    """A plan through normalisers and validators, functions of DataFrame to DataFrame, in order."""
    return reduce(DataFrame.transform, steps, plan)
