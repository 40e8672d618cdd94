"""The whole typed projection: candidates, events, relations and memories to entities and components, data as VARIANT.

A candidate is one VARIANT, so arrays, numbers, booleans and nested objects keep their types on the way into a component.
What a component takes from which section is stated in rule tables; entries of lists are checked field by field, and an
entry that lacks what its component needs is left out. Everything is built by Spark expressions in one pass over each
input; ids of what a row refers to are joined to it before, as a map of the keys that this row names.

``candidates``(chat_id, key as type:name, body), ``events``(chat_id, event_id, body), ``relations``(chat_id, body) and
``memories``(chat_id, memory_id, body): bodies are VARIANT, names of their fields as the rules have them. Text is trimmed;
blank text, null and a missing field are all missing. A row without a usable key or id gives nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storynet.functions.shared import saved, spread
from storynet.operators.audit import PLACEMENT_ROLES
from storynet.operators.nesting import overlay_documents
from storynet.operators.network import mint_ids

# Entity types of candidates, and modes, horizons, roles and other words that a field may hold.
TYPES = ("character", "location", "item", "organization", "skill", "concept")
MODES = ("semantic", "numeric_derived", "hybrid")
HORIZONS = ("short_term", "medium_term")
STATUSES = ("active", "inactive")
VALUE_SOURCES = ("host", "character_skill_reference", "external_variable_store")
PURPOSES = ("character_behavior", "interaction", "narration", "skill_use", "resolver_rule")
EVENT_STATUSES = ("forming", "pending_finalization", "finalized")
SNAKE = "^[a-z][a-z0-9_]*$"
#: Fixed value: what is taken off the ends of a text, that is what \\s and \\p{Z} match.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Type, sections (the first that is there), component, fields, and whether some of the fields are enough.
COPIED = (
    ("location", ("profile",), "location_profile", ("location_kind", "primary_functions", "scale_description", "spatial_characteristics"), False),
    ("location", ("environment",), "environment_profile", ("terrain_and_landform", "climate_tendencies", "natural_resources", "fixed_facilities", "persistent_conditions"), True),
    ("location", ("atmosphere",), "location_atmosphere", ("atmosphere_summary", "sensory_features", "cultural_impressions"), False),
    ("item", ("profile",), "item_profile", ("item_kind", "instance_mode", "primary_functions", "materials", "form_description"), False),
    ("item", ("characteristic",), "item_characteristic", ("appearance_and_sensory", "craftsmanship", "typical_behavior", "symbolic_meanings"), True),
    ("item", ("container",), "container_profile", ("capacity_description", "allowed_contents", "forbidden_contents", "stable_capabilities", "access_requirements"), False),
    ("organization", ("profile",), "organization_profile", ("organization_kind", "public_role", "operating_scope", "continuity_basis"), False),
    ("organization", ("culture",), "organization_culture", ("summary", "core_values", "norms", "taboos", "behavioral_style"), False),
    ("skill", ("definition", "profile"), "skill_definition", ("skill_kind", "domain", "primary_capabilities", "form_description"), False),
    ("skill", ("characteristic",), "skill_characteristic", ("style_summary", "sensory_signatures", "tactical_tendencies", "distinguishing_features"), False),
    ("concept", ("definition", "profile"), "concept_definition", ("concept_kind", "definition", "epistemic_status", "operational_role", "scope_summary"), False),
    ("concept", ("applicability",), "applicability", ("applies_to_entity_types", "conditions", "exclusions", "exceptions", "prerequisites"), False),
)


@dataclass(frozen=True)
class Entries:
    """A list of objects: ``fields`` are (name, pattern or the words it may hold, or None), all needed; an entry's id comes from ``own_key`` or else from ``parts``."""

    kind: str
    id_field: str
    fields: tuple[tuple[str, str | tuple[str, ...] | None], ...]
    own_key: str | None
    parts: tuple[str, ...]


# Id kinds and fields of the entries that components list.
_STATED = (("kind", None), ("description", None), ("status", STATUSES))
LOCATION_STATES = Entries("location_state", "location_state_id", _STATED, "state_key", ("kind", "description"))
ITEM_STATES = Entries("item_state", "item_state_id", _STATED, "state_key", ("kind", "description"))
ORGANIZATION_STATES = Entries("organization_state", "organization_state_id", _STATED, "state_key", ("kind", "description"))
OBJECTIVES = Entries("objective", "objective_id", (("description", None), ("horizon", HORIZONS)), "objective_key", ("description",))
ROLES = Entries("organization_role", "organization_role_id", (("role_key", SNAKE), ("name", None), ("description", None)), None, ("role_key",))
MECHANICS = Entries("skill_mechanic", "skill_mechanic_id", (("kind", SNAKE), ("description", None)), "entry_key", ("kind", "description"))
REQUIREMENTS = Entries(
    "skill_requirement", "skill_requirement_id", (("kind", SNAKE), ("description", None), ("requirement_role", ("required", "optional", "alternative"))), "entry_key", ("kind", "description")
)
RULES = Entries(
    "concept_rule", "concept_rule_id",
    (("kind", SNAKE), ("statement", None), ("applicability", None), ("consequence", None), ("status", ("active", "inactive", "superseded"))), "rule_key", ("kind", "statement"),
)


# --- expressions over VARIANT


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def word(v: Column, path: str = "$") -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.btrim(get(v, path, "string"), F.lit(BLANKS)), F.lit(""))


def listed(v: Column, path: str, most: int | None = None) -> Column:
    """The array there, empty if there is none."""
    out = F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.slice(out, 1, most) if most else out


def is_object(v: Column) -> Column:
    return get(v, "$", "struct<>").isNotNull()  # without looking at its fields


def is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def objects(v: Column, path: str, most: int | None = None) -> Column:
    return F.filter(listed(v, path, most), is_object)


def words(v: Column, path: str, most: int | None = None) -> Column:
    """Different non-blank texts in order, null if there are none."""
    out = F.array_distinct(F.filter(F.transform(listed(v, path), lambda x: word(x)), lambda x: x.isNotNull()))
    return F.slice(out, 1, most) if most else out


def some(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of a value that is worked out once, however often it is used: a function of an array's only element."""
    return F.transform(F.array(value), build)[0]


def obj(**fields: Column | _Nested) -> Column:
    """An object as VARIANT without the fields that are null."""
    names = F.expr(f"array({', '.join(map(repr, fields))})")
    pairs = F.map_from_arrays(names, F.array(*[as_variant(c) for c in fields.values()]))
    return F.to_variant_object(F.map_filter(pairs, lambda _, v: v.isNotNull()))


class _Nested:
    """Marks arrays, which become VARIANT by another function than scalars."""

    def __init__(self, column: Column):
        self.column = column


def many(column: Column) -> _Nested:
    return _Nested(column)


def as_variant(c: Column | _Nested) -> Column:
    return F.when(c.column.isNotNull(), F.to_variant_object(c.column)) if isinstance(c, _Nested) else c.cast("variant")


def type_of(key: Column) -> Column:
    """The type of an entity key type:name, null if it is none."""
    head, tail = F.substring_index(key, ":", 1), F.regexp_extract(key, r"^[^:]*:(?s)(.*)$", 1)
    return F.when(key.contains(":") & head.isin(*TYPES) & (F.trim(tail) != ""), head)


def local_id(kind: str, *parts: Column) -> Column:
    """An id of its kind from a digest of what it stands for, so that a rerun gives the same."""
    digest = F.sha2(F.concat_ws(":", F.lit(kind), *parts), 256)
    return F.concat(F.lit(f"{kind}_0"), F.upper(F.left(digest, F.lit(25))))


class Row:
    """The columns of a candidate that expressions use."""

    def __init__(self):
        self.chat, self.key, self.type, self.body, self.ids = (F.col(c) for c in ("chat_id", "key", "type", "body", "ids"))
        self.domain, self.character = F.col("domain_data"), F.col("character_data")  # parts of the body

    def local(self, kind: str, *parts: Column) -> Column:
        return local_id(kind, self.chat, self.key, *parts)

    def ref(self, key: Column, only: str | None = None) -> Column:
        """Reference to an entity key, null if it is none or of another type."""
        kind = type_of(key)
        known = F.element_at(self.ids, key)
        fits = kind.isNotNull() & known.isNotNull()
        return F.when(fits & (kind == only) if only else fits, obj(id=known, type=kind))

    def refs(self, keys: Column) -> Column:
        return F.filter(F.transform(keys, lambda k: self.ref(k)), lambda x: x.isNotNull())

    def entries(self, rule: Entries, items: Column, **more) -> Column:
        """The entries that have all fields of their rule, as VARIANT."""

        def fits(x: Column) -> Column:
            checks = []
            for name, test in rule.fields:
                value = word(x, f"$.{name}")
                checks.append(value.isNotNull() if test is None else F.coalesce(value.rlike(test) if isinstance(test, str) else get(x, f"$.{name}", "string").isin(*test), F.lit(False)))
            return reduce(Column.__and__, checks)

        def build(x: Column) -> Column:
            derived = F.concat_ws(":", *[word(x, f"$.{p}") for p in rule.parts])
            own = F.coalesce(word(x, f"$.{rule.own_key}"), derived) if rule.own_key else derived
            fields = {name: word(x, f"$.{name}") for name, _ in rule.fields}
            return obj(**{rule.id_field: self.local(rule.kind, own)}, **fields, **{k: f(x) for k, f in more.items()})

        return F.transform(F.filter(items, fits), build)


# --- components of candidates


def _first(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(is_object(get(v, p)), get(v, p)) for p in paths])


def _copied(r: Row, rule: tuple) -> tuple[str, Column, Column]:
    kind, sections, component, fields, partial = rule
    section = _first(r.domain, *[f"$.{s}" for s in sections])

    def copied(found: Column) -> Column:
        enough = reduce(Column.__or__ if partial else Column.__and__, [found[f].isNotNull() for f in fields])
        return F.when(enough, obj(**{f: found[f] for f in fields}))

    data = once(section, lambda s: once(F.struct(*[get(s, f"$.{f}").alias(f) for f in fields]), copied))
    return component, F.lit("0.1.0"), F.when(r.type == kind, data)


def _stage_framework(r: Row, kind: str, component: str, paths: tuple[str, ...]) -> tuple[str, Column, Column]:
    """Stages of a skill or concept with ids of bindings, stages and context blocks."""
    skill = kind == "skill"
    summary_field = "progression_summary" if skill else "framework_summary"
    binding_kind, stage_kind, context_kind = ("skill_numeric_binding", "skill_stage", "skill_stage_context") if skill else ("stage_numeric_binding", "concept_stage", "concept_stage_context")
    raw = _first(r.domain, *[f"$.{p}" for p in paths])
    summary = F.coalesce(word(raw, f"$.{summary_field}"), word(raw, "$.summary"))
    evaluation = _first(raw, "$.stage_evaluation", "$.evaluation")
    mode = get(evaluation, "$.mode", "string")

    def bound(b: Column) -> Column:
        checks = word(b, "$.binding_key").isNotNull() & word(b, "$.provider").rlike(SNAKE) & word(b, "$.variable_key").isNotNull()
        return F.coalesce(checks & get(b, "$.value_source", "string").isin(*VALUE_SOURCES), F.lit(False))

    bindings = F.filter(objects(evaluation, "$.numeric_bindings"), bound)
    known = F.transform(bindings, lambda b: word(b, "$.binding_key"))

    def binding(b: Column) -> Column:
        own = {k: word(b, f"$.{k}") for k in ("provider", "variable_key", "value_source")}
        return obj(numeric_binding_id=r.local(binding_kind, word(b, "$.binding_key")), **own)

    def guides(g: Column) -> Column:
        return F.coalesce(F.array_contains(known, get(g, "$.binding_key", "string")), F.lit(False)) & is_number(get(g, "$.min_inclusive")) & is_number(get(g, "$.max_exclusive"))

    def guidance(g: Column) -> Column:
        return obj(numeric_binding_id=r.local(binding_kind, get(g, "$.binding_key", "string")), min_inclusive=get(g, "$.min_inclusive"), max_exclusive=get(g, "$.max_exclusive"))

    def stage(s: Column) -> Column:
        own = word(s, "$.stage_key")

        def block(b: Column) -> Column:
            purpose = get(b, "$.purpose", "string")
            return obj(stage_context_id=r.local(context_kind, own, F.coalesce(word(b, "$.context_key"), purpose)), purpose=purpose, content=word(b, "$.content"))

        blocks = F.filter(objects(s, "$.context_blocks"), lambda b: F.coalesce(get(b, "$.purpose", "string").isin(*PURPOSES) & word(b, "$.content").isNotNull(), F.lit(False)))
        whole = F.schema_of_variant(get(s, "$.order")) == "BIGINT"
        return obj(
            **{"skill_stage_id" if skill else "stage_id": r.local(stage_kind, own)},
            **{k: word(s, f"$.{k}") for k in ("name", "description", "entry_guidance", "exit_guidance")},
            order=F.when(whole, get(s, "$.order")),
            numeric_guidance=many(F.transform(F.filter(objects(s, "$.numeric_guidance"), guides), guidance)),
            context_blocks=many(F.transform(blocks, block)),
        )

    named = F.filter(objects(raw, "$.stages"), lambda s: word(s, "$.stage_key").isNotNull() & word(s, "$.name").isNotNull() & word(s, "$.description").isNotNull())
    ordered = get(raw, "$.ordered")
    enough = summary.isNotNull() & (F.schema_of_variant(ordered) == "BOOLEAN") & mode.isin(*MODES)
    data = obj(
        **{summary_field: summary}, ordered=ordered, stages=many(F.transform(named, stage)),
        stage_evaluation=obj(mode=mode, numeric_bindings=many(F.transform(bindings, binding))),
    )
    return component, F.lit("0.1.0"), F.when((r.type == kind) & enough, data)


def _character(r: Row) -> list[tuple[str, Column, Column]]:
    d, first = r.character, F.lit("0.1.0")
    of = lambda c: F.when(r.type == "character", c)
    out = []
    profile = {f: word(d, f"$.profile.{f}") for f in ("species", "gender", "age_description", "background", "appearance")}
    out.append(("character_profile", first, of(F.when(profile["species"].isNotNull() & profile["background"].isNotNull(), obj(**profile)))))
    body, mind = word(d, "$.state.physical_condition"), word(d, "$.state.mental_condition")
    feels = get(d, "$.state.current_emotions").isNotNull()
    state = obj(physical_condition=body, mental_condition=mind, current_emotions=many(words(d, "$.state.current_emotions", 16)))
    out.append(("character_state", first, of(F.when(body.isNotNull() & mind.isNotNull() & feels, state))))

    summary = word(d, "$.personality.summary")
    personality = obj(summary=summary, traits=many(some(words(d, "$.personality.traits", 24))), behavioral_tendencies=many(some(words(d, "$.personality.behavioral_tendencies", 24))))
    motives = F.transform(words(d, "$.motivations", 32), lambda w: obj(motivation_id=r.local("motivation", w), description=w))
    likes = lambda p: F.coalesce(get(p, "$.attitude", "string").isin("like", "dislike") & word(p, "$.subject").isNotNull(), F.lit(False))

    def preference(p: Column) -> Column:
        attitude, subject = get(p, "$.attitude", "string"), word(p, "$.subject")
        related = r.ref(get(p, "$.related_entity_key", "string"))
        return obj(preference_id=r.local("preference", attitude, subject), attitude=attitude, subject=subject, description=word(p, "$.description"), related_entity_ref=related)

    prefers = F.transform(F.filter(objects(d, "$.preferences", 48), likes), preference)
    out.append(("character_behavior_profile", first, of(F.when(summary.isNotNull(), obj(personality=personality, motivations=many(motives), preferences=many(prefers))))))

    aims = _objectives(r, objects(d, "$.objectives", 24))
    out.append(("character_objective", first, of(F.when(F.size(aims) > 0, obj(objectives=many(aims))))))
    place = r.ref(get(d, "$.current_location_key", "string"), "location")
    out.append(("current_location_reference", first, of(F.when(place.isNotNull(), obj(location_ref=place)))))

    def usable(s: Column) -> Column:
        return (type_of(get(s, "$.skill_key", "string")) == "skill") & word(s, "$.proficiency_description").isNotNull()

    def staged(s: Column) -> Column:
        frame = F.coalesce(word(s, "$.stage_state.framework_key"), get(s, "$.skill_key", "string"))
        return F.coalesce(get(s, "$.stage_state.evaluation_mode", "string").isin(*MODES) & type_of(frame).isin("skill", "concept"), F.lit(False))

    def skill(s: Column) -> Column:
        raw = get(s, "$.stage_state")
        frame = F.coalesce(word(raw, "$.framework_key"), get(s, "$.skill_key", "string"))
        own = type_of(frame) == "skill"
        of_frame = lambda kind, name: local_id(kind, r.chat, frame, name)
        stage = word(raw, "$.current_stage_key")
        good = F.filter(objects(raw, "$.muv_values"), lambda x: is_number(get(x, "$.value")) & word(x, "$.binding_key").isNotNull())

        def value(x: Column) -> Column:
            name = word(x, "$.binding_key")
            return obj(numeric_binding_id=F.when(own, of_frame("skill_numeric_binding", name)).otherwise(of_frame("stage_numeric_binding", name)), value=get(x, "$.value"))

        state = obj(
            evaluation_mode=get(raw, "$.evaluation_mode", "string"), framework_ref=r.ref(frame), numeric_values=many(F.transform(good, value)),
            current_stage_id=F.when(stage.isNotNull(), F.when(own, of_frame("skill_stage", stage)).otherwise(of_frame("concept_stage", stage))),
        )
        return obj(skill_ref=r.ref(get(s, "$.skill_key", "string")), proficiency_description=word(s, "$.proficiency_description"), stage_state=F.when(staged(s), state))

    known = F.filter(objects(d, "$.skills"), lambda s: F.coalesce(usable(s), F.lit(False)))
    version = F.when(F.exists(known, staged), F.lit("0.2.0")).otherwise(first)
    out.append(("skill_reference", version, of(F.when(F.size(known) > 0, obj(skill_refs=many(F.transform(known, skill)))))))
    return out


def _objectives(r: Row, items: Column) -> Column:
    return r.entries(OBJECTIVES, items, related_entity_refs=lambda x: many(some(r.refs(F.transform(listed(x, "$.related_entity_keys"), lambda k: get(k, "$", "string"))))))


def _domain(r: Row) -> list[tuple[str, Column, Column]]:
    d, first = r.domain, F.lit("0.1.0")
    of = lambda kind, c: F.when(r.type == kind, c)
    out = [_copied(r, rule) for rule in COPIED]
    for kind, component, field, rule, paths in (
        ("location", "location_state", "states", LOCATION_STATES, ("states",)), ("organization", "organization_state", "states", ORGANIZATION_STATES, ("states",)),
        ("skill", "skill_mechanics", "mechanics", MECHANICS, ("mechanics",)), ("skill", "skill_requirement", "requirements", REQUIREMENTS, ("requirements",)),
        ("concept", "concept_rule", "rules", RULES, ("rules", "mechanics_or_rules")),
    ):
        raw = F.coalesce(*[some(listed(d, f"$.{p}")) for p in paths], F.array().cast("array<variant>"))
        found = r.entries(rule, F.filter(raw, is_object))
        out.append((component, first, of(kind, F.when(F.size(found) > 0, obj(**{field: many(found)})))))
    for kind in ("location", "organization"):
        key = get(d, "$.parent_key", "string")
        parent = r.ref(key, kind)
        out.append((f"parent_{kind}_reference", first, of(kind, F.when(parent.isNotNull() & (key != r.key), obj(**{f"parent_{kind}_ref": parent})))))

    states, amount, unit = r.entries(ITEM_STATES, objects(d, "$.states")), get(d, "$.quantity.amount"), word(d, "$.quantity.unit")
    quantity = F.when(is_number(amount) & unit.isNotNull(), obj(amount=amount, unit=unit))
    out.append(("item_state", first, of("item", F.when((F.size(states) > 0) | quantity.isNotNull(), obj(states=many(states), quantity=quantity)))))
    stated = is_object(get(d, "$.placement"))
    target = F.when(stated, get(d, "$.placement.target_key", "string")).otherwise(F.col("hint_key"))
    role = F.when(stated, get(d, "$.placement.role", "string")).otherwise(F.col("hint_role"))
    fits = reduce(Column.__or__, [(type_of(target) == kind) & role.isin(*roles) for kind, roles in PLACEMENT_ROLES.items()])
    placed = obj(placement_ref=r.ref(target), placement_role=role, placement_detail=F.when(stated, word(d, "$.placement.detail")))
    out.append(("current_placement_reference", first, of("item", F.when(fits & (target != r.key), placed))))

    model, style = word(d, "$.structure.governance_model"), word(d, "$.strategy.decision_style")
    out.append(("organization_structure", first, of("organization", F.when(model.isNotNull(), obj(governance_model=model, roles=many(r.entries(ROLES, objects(d, "$.structure.roles"))))))))

    def direction(x: Column) -> Column:
        said = F.when(is_object(x), word(x, "$.description")).otherwise(word(x))
        own = F.coalesce(F.when(is_object(x), word(x, "$.direction_key")), said)
        return F.when(said.isNotNull(), obj(organization_direction_id=r.local("organization_direction", own), description=said))

    ways = F.filter(F.transform(listed(d, "$.strategy.long_term_directions", 32), direction), lambda x: x.isNotNull())
    out.append(("organization_strategy", first, of("organization", F.when(style.isNotNull(), obj(long_term_directions=many(ways), decision_style=style)))))
    aims = _objectives(r, objects(d, "$.objectives"))
    out.append(("organization_objective", first, of("organization", F.when(F.size(aims) > 0, obj(objectives=many(aims))))))
    out.append(_stage_framework(r, "skill", "skill_progression", ("progression", "progression_or_stage_framework")))
    out.append(_stage_framework(r, "concept", "stage_framework", ("stage_framework", "progression_or_stage_framework")))
    related = r.refs(F.filter(F.transform(listed(d, "$.related_concepts"), _concept_key), lambda k: F.coalesce(type_of(k) == "concept", F.lit(False))))
    out.append(("related_concept_reference", first, F.when((r.type != "character") & (F.size(related) > 0), obj(concept_refs=many(related)))))
    return out


def _concept_key(x: Column) -> Column:
    return F.when(is_object(x), get(x, "$.concept_key", "string")).otherwise(get(x, "$", "string"))


def _common(r: Row, at: str) -> list[tuple[str, Column, Column]]:
    name = F.coalesce(word(r.body, "$.primary_name"), F.regexp_extract(r.key, r"^[^:]*:(?s)(.*)$", 1))
    facts = get(r.body, "$.facts")
    out = [
        ("entity_management", F.lit("0.2.0"), _management(at)),
        ("identity", F.lit("0.1.0"), obj(primary_name=name, aliases=many(words(r.body, "$.aliases")))),
        ("entity_facts", F.lit("0.1.0"), F.when(is_object(facts) & (F.to_json(facts) != "{}"), obj(facts=facts))),
    ]

    def recorded(field: str, kind: str, id_field: str, build) -> Column:
        def entry(x: Column, at: Column) -> Column:
            return obj(**{id_field: r.local(kind, at.cast("string"), F.to_json(x))}, **build(x))

        return some(F.transform(objects(r.body, f"$.{field}"), entry))

    def loose_fields(x: Column) -> dict:
        reason = F.coalesce(get(x, "$.reason", "string"), F.lit("unclassified"))
        proposed = F.coalesce(word(x, "$.proposed_field_name"), F.lit(""))
        return {"proposed_field_name": proposed, "value": get(x, "$.value"), "reason": reason, "evidence_refs": many(listed(x, "$.evidence_refs"))}

    def revised_fields(x: Column) -> dict:
        name = F.coalesce(get(x, "$.field_name", "string"), F.lit(""))
        return {"field_name": name, "previous_value": get(x, "$.previous_value"), "replaced_by_evidence_refs": many(listed(x, "$.replaced_by_evidence_refs"))}

    loose = recorded("unclassified_field_updates", "field_update", "update_id", loose_fields)
    past = recorded("semantic_field_revisions", "field_revision", "revision_id", revised_fields)
    kept = obj(unclassified_updates=many(loose), revision_history=many(past))
    return [*out, ("entity_field_maintenance", F.lit("0.1.0"), F.when(loose.isNotNull() | past.isNotNull(), kept))]


def _management(at: str) -> Column:
    return obj(created_at=F.lit(at), updated_at=F.lit(at), data_source=F.lit("system_generated"), revision=F.lit(1), lifecycle_status=F.lit("active"))


def _exploded(rows: DataFrame, made: list[tuple[str, Column, Column]]) -> DataFrame:
    """A row for each component that a row has."""
    each = F.array(*[F.struct(F.lit(n).alias("component"), v.alias("schema_version"), d.alias("data")) for n, v, d in made])
    out = rows.select("chat_id", "id", "type", F.inline(F.filter(each, lambda c: c["data"].isNotNull())))
    return out.withColumnRenamed("id", "entity_id")


# --- ids


def _named(v: Column) -> Column:
    """Every entity key that a candidate may refer to."""
    c, d = get(v, "$.character_data"), get(v, "$.domain_data")
    text = lambda path: lambda x: get(x, path, "string")
    aims = F.flatten(F.transform(F.concat(objects(c, "$.objectives"), objects(d, "$.objectives")), lambda x: listed(x, "$.related_entity_keys")))
    lists = [
        F.transform(objects(c, "$.preferences"), text("$.related_entity_key")), F.transform(aims, text("$")), F.transform(objects(c, "$.skills"), text("$.skill_key")),
        F.transform(objects(c, "$.skills"), text("$.stage_state.framework_key")), F.transform(listed(d, "$.related_concepts"), _concept_key),
        F.array(*[get(v, p, "string") for p in ("$.character_data.current_location_key", "$.domain_data.parent_key", "$.domain_data.placement.target_key")], F.col("hint_key")),
    ]
    return F.array_distinct(F.filter(F.concat(*lists), lambda k: type_of(k).isNotNull()))


def _mapped(rows: DataFrame, names: Column, ids: DataFrame, own: str) -> DataFrame:
    """``rows`` with ``ids``, a map of those of ``names`` that have an id; ``own`` tells rows of a chat apart."""
    asked = rows.select("chat_id", own, F.explode(names).alias("name"))
    met = asked.join(ids.select("chat_id", F.col("key").alias("name"), F.col("id").alias("found")), ["chat_id", "name"])
    each = met.groupBy("chat_id", own).agg(F.map_from_entries(F.collect_list(F.struct("name", "found"))).alias("ids"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.join(each, ["chat_id", own], "left").withColumn("ids", F.coalesce("ids", empty))


def known_ids(candidates: DataFrame, events: DataFrame, relations: DataFrame, memories: DataFrame, known: DataFrame) -> DataFrame:
    """chat_id, type, key, id: ``known`` and an id for every key that is used; keys of other rows than candidates have their type before them."""
    own = candidates.select("chat_id", "key", F.explode(F.array_union(F.array("key"), F.col("names"))).alias("name"))
    people = relations.select("chat_id", F.explode("pair").alias("name"))
    said = events.select("chat_id", F.explode("names").alias("name"))
    owners = memories.select("chat_id", F.col("owner").alias("name"))
    entity = reduce(DataFrame.unionByName, [own.select("chat_id", "name"), people, said, owners]).select("chat_id", type_of(F.col("name")).alias("type"), F.col("name").alias("key"))
    others = [df.select("chat_id", F.lit(kind).alias("type"), F.concat(F.lit(f"{kind}:"), key).alias("key")) for df, kind, key in ((events, "event", "event_id"), (relations, "character_relation", "relation"), (memories, "memory", "memory_id"))]
    return mint_ids(reduce(DataFrame.unionByName, [entity, *others]).filter("type is not null and key is not null"), known)


# --- the projection


def project(candidates: DataFrame, events: DataFrame, relations: DataFrame, memories: DataFrame, known: DataFrame, hints: DataFrame | None = None, at: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (chat_id, id, type, description), components (chat_id, entity_id, type, component, schema_version, data) and the id map (chat_id, type, key, id).

    ``known`` is the id map so far; its ids never change. ``hints``(chat_id, key, target_key, role): where an item is if its own
    candidate does not say so. ``at`` goes into entity_management.
    """
    c = candidates.select("chat_id", "key", "body", type_of(F.col("key")).alias("type")).filter("type is not null")
    if hints is None:
        c = c.withColumns({"hint_key": F.lit(None).cast("string"), "hint_role": F.lit(None).cast("string")})
    else:
        c = c.join(hints.select("chat_id", "key", F.col("target_key").alias("hint_key"), F.col("role").alias("hint_role")), ["chat_id", "key"], "left")
    c = saved(c.withColumn("names", _named(F.col("body"))))
    relations, events, memories = saved(_relations(relations)), saved(_events(events)), saved(_memories(memories))
    ids = saved(known_ids(c, events, relations, memories, known))

    own = lambda df, key: df.join(ids.select("chat_id", F.col("key").alias("own_key"), "id"), (ids["chat_id"] == df["chat_id"]) & (F.col("own_key") == key)).drop(ids["chat_id"]).drop("own_key")
    c = saved(_mapped(own(c, F.col("key")), F.col("names"), ids, "key"))
    r = Row()
    parts = {part: get(F.col("body"), f"$.{part}") for part in ("domain_data", "character_data")}
    made = saved(_exploded(spread(c, "chat_id", "key").withColumns(parts), [*_common(r, at), *_character(r), *_domain(r)]))
    made = _open_fields(made, c)
    named = [c.select("chat_id", "id", "type", F.coalesce(word(F.col("body"), "$.description"), F.regexp_extract("key", r"^[^:]*:(?s)(.*)$", 1)).alias("description"))]

    related = _mapped(own(relations, F.concat(F.lit("character_relation:"), "relation")), F.col("pair"), ids, "relation")
    linked = ids.join(relations.select("chat_id", F.concat(F.lit("character_relation:"), "relation").alias("key")).distinct(), ["chat_id", "key"], "left_semi")
    plain = ids.filter(F.col("type").isin(*TYPES))
    told = _mapped(own(events, F.concat(F.lit("event:"), "event_id")), F.concat("names", "pairs"), plain.unionByName(linked), "event_id")
    happened = ids.join(events.select("chat_id", F.concat(F.lit("event:"), "event_id").alias("key")).distinct(), ["chat_id", "key"], "left_semi")
    kept = _mapped(own(memories, F.concat(F.lit("memory:"), "memory_id")), F.concat(F.array("owner"), "happened", "pairs"), plain.unionByName(linked).unionByName(happened), "memory_id")
    kept = kept.withColumn("at_events", F.filter(F.transform("happened", lambda k: F.element_at("ids", k)), lambda x: x.isNotNull())).filter(F.size("at_events") > 0)
    kept = _with_aspects(kept, relations)
    for rows, make, text in ((told, _event_components, _event_text()), (related, _relation_components, F.coalesce(word(F.col("body"), "$.description"), F.lit("two characters who are related"))), (kept, _memory_components, F.coalesce(word(F.col("body"), "$.description"), F.lit("")))):
        made = made.unionByName(_exploded(rows, [("entity_management", F.lit("0.2.0"), _management(at)), *make()]))
        named.append(rows.select("chat_id", "id", "type", text.alias("description")))
    return reduce(DataFrame.unionByName, named), made, ids


def _open_fields(made: DataFrame, candidates: DataFrame) -> DataFrame:
    """Open semantic fields over the typed components: objects key by key, all else whole; such a component has version 0.2.0."""
    fields = F.map_filter(get(F.col("body"), "$.semantic_fields", "map<string,variant>"), lambda _, v: is_object(v) & (F.to_json(v) != "{}"))
    patch = candidates.select("chat_id", F.col("id").alias("entity_id"), "type", F.explode(fields).alias("component", "patch"))
    keys = ["chat_id", "entity_id", "type", "component"]
    over = patch.select(*keys, F.to_json("patch").alias("data"))
    under = made.join(over.select(*keys), keys, "left_semi").select(*keys, F.to_json("data").alias("data"))
    merged = overlay_documents(under, over.limit(0), over, keys=tuple(keys))
    opened = merged.select(*keys, F.lit("0.2.0").alias("schema_version"), F.parse_json("data").alias("data"))
    return made.join(over.select(*keys), keys, "left_anti").unionByName(opened)


def relation_key(pair: Column) -> Column:
    return F.array_join(F.array_sort(pair), "|")


def _pairs(path: str) -> Column:
    two = F.transform(listed(F.col("body"), path), lambda p: F.transform(listed(p, "$"), lambda k: get(k, "$", "string")))
    return F.transform(F.filter(two, lambda p: F.size(p) == 2), lambda p: F.concat(F.lit("character_relation:"), relation_key(p)))


def _relations(relations: DataFrame) -> DataFrame:
    pair = F.array_sort(F.filter(F.transform(listed(F.col("body"), "$.participant_keys"), lambda k: get(k, "$", "string")), lambda k: F.coalesce(type_of(k) == "character", F.lit(False))))
    rows = relations.withColumn("pair", pair).filter((F.size("pair") == 2) & (F.col("pair")[0] != F.col("pair")[1]))
    return rows.select("chat_id", relation_key(F.col("pair")).alias("relation"), "pair", "body", F.lit("character_relation").alias("type"))


def _events(events: DataFrame) -> DataFrame:
    v = F.col("body")
    text = lambda path: lambda x: get(x, path, "string")
    names = F.concat(F.transform(objects(v, "$.key_details"), text("$.actor")), F.transform(objects(v, "$.location_occurrences"), text("$.entity_key")), F.transform(listed(v, "$.related_entity_keys"), text("$")))
    names = F.array_distinct(F.filter(names, lambda k: type_of(k).isNotNull()))
    return events.filter("event_id is not null").select("chat_id", F.col("event_id").cast("string").alias("event_id"), "body", F.lit("event").alias("type"), names.alias("names"), F.array_distinct(_pairs("$.related_relation_pairs")).alias("pairs"))


def _memories(memories: DataFrame) -> DataFrame:
    v = F.col("body")
    owner = get(v, "$.owner_key", "string")
    happened = F.array_distinct(F.transform(listed(v, "$.event_ids"), lambda x: F.concat(F.lit("event:"), get(x, "$", "string"))))
    rows = memories.filter("memory_id is not null").withColumn("owner", F.when(type_of(owner) == "character", owner)).filter("owner is not null")
    return rows.select("chat_id", F.col("memory_id").cast("string").alias("memory_id"), "body", F.lit("memory").alias("type"), "owner", happened.alias("happened"), _pairs("$.related_relation_pairs").alias("pairs"))


def _event_text() -> Column:
    v = F.col("body")
    return F.coalesce(word(v, "$.description"), word(v, "$.story_summary"), F.lit("an event that is forming"))


def _event_components() -> list[tuple[str, Column, Column]]:
    v, ids, first = F.col("body"), F.col("ids"), F.lit("0.1.0")
    chat, event = F.col("chat_id"), F.col("event_id")
    ref = lambda key: F.when(F.element_at(ids, key).isNotNull(), obj(id=F.element_at(ids, key), type=F.coalesce(type_of(key), F.lit("character_relation"))))

    def detail(x: Column) -> Column:
        content, actor = word(x, "$.content"), word(x, "$.actor")
        faithful = word(x, "$.fidelity")
        return obj(
            detail_id=local_id("event_detail", chat, event, F.coalesce(word(x, "$.id"), content)), kind=word(x, "$.kind"), content=content,
            fidelity=F.when(faithful.isin("verbatim", "paraphrase"), faithful).otherwise(F.lit("paraphrase")), actor_ref=F.when(type_of(actor) == "character", ref(actor)),
        )

    summary, status = word(v, "$.story_summary"), word(v, "$.status")
    details = F.filter(objects(v, "$.key_details"), lambda x: F.coalesce(word(x, "$.kind").isin("statement", "action") & word(x, "$.content").isNotNull(), F.lit(False)))
    content = obj(status=status, story_summary=summary, key_details=many(F.transform(details, detail)))
    start, end = get(v, "$.event_time.start_time"), get(v, "$.event_time.end_time")
    time = F.when(is_object(start), obj(start_time=start, end_time=F.when(is_object(end), end)))
    seen = F.transform(listed(v, "$.location_occurrences"), lambda x, i: obj(location_ref=F.when(type_of(get(x, "$.entity_key", "string")) == "location", ref(get(x, "$.entity_key", "string"))), sequence=i))
    places = F.filter(seen, lambda x: get(x, "$.location_ref").isNotNull())
    keys = F.array_distinct(F.filter(F.transform(listed(v, "$.related_entity_keys"), lambda k: get(k, "$", "string")), lambda k: type_of(k).isNotNull()))
    related = F.filter(F.transform(F.concat(keys, F.col("pairs")), ref), lambda x: x.isNotNull())
    return [
        ("event_content", first, F.when(summary.isNotNull() & status.isin(*EVENT_STATUSES), content)), ("event_time", first, time),
        ("event_location_reference", first, F.when(F.size(places) > 0, obj(location_refs=many(places)))), ("event_related_entity_reference", first, F.when(F.size(related) > 0, obj(related_entity_refs=many(related)))),
    ]


def _aspect_id(chat: Column, relation: Column, kind: Column) -> Column:
    return local_id("relation_aspect", chat, relation, kind)


def _aspects(v: Column) -> Column:
    return F.filter(objects(v, "$.aspects"), lambda a: word(a, "$.kind").isNotNull() & word(a, "$.description").isNotNull())


def _relation_components() -> list[tuple[str, Column, Column]]:
    """Endpoints in order of their ids; an aspect has both characters with their roles; a direction joins the two."""
    v, ids, pair, first = F.col("body"), F.col("ids"), F.col("pair"), F.lit("0.1.0")
    person = lambda key: obj(id=F.element_at(ids, key), type=F.lit("character"))
    ends = F.transform(F.array_sort(F.transform(pair, lambda k: F.struct(F.element_at(ids, k).alias("id"), k.alias("key")))), lambda x: x["key"])

    def aspect(a: Column) -> Column:
        def roles(key: Column) -> Column:
            own = F.filter(objects(a, "$.participant_roles"), lambda x: get(x, "$.character_key", "string") == key)
            said = F.when(F.size(own) > 0, some(words(F.element_at(own, -1), "$.roles", 8)))
            return obj(character_ref=person(key), roles=many(F.coalesce(said, F.array(F.lit("related_person")))))

        return obj(
            aspect_id=_aspect_id(F.col("chat_id"), F.col("relation"), word(a, "$.kind")), kind=word(a, "$.kind"), description=word(a, "$.description"),
            status=F.coalesce(get(a, "$.status"), F.lit("active").cast("variant")), perspective=obj(mode=F.lit("shared_fact")), participant_roles=many(F.transform(ends, roles)),
            disclosure=obj(visibility=F.coalesce(get(a, "$.visibility"), F.lit("private").cast("variant")), concealed_from_refs=many(F.array().cast("array<variant>"))),
        )

    def both(s: Column) -> Column:
        a, b = get(s, "$.from_key", "string"), get(s, "$.toward_key", "string")
        return F.coalesce((a != b) & F.array_contains(pair, a) & F.array_contains(pair, b) & word(s, "$.summary").isNotNull(), F.lit(False))

    def state(s: Column) -> Column:
        a, b = get(s, "$.from_key", "string"), get(s, "$.toward_key", "string")
        return obj(from_character_ref=person(a), toward_character_ref=person(b), summary=word(s, "$.summary"), tags=many(some(words(s, "$.tags"))))

    aspects, states, facts = F.transform(_aspects(v), aspect), F.transform(F.filter(objects(v, "$.directional_states"), both), state), get(v, "$.facts")
    return [
        ("relation_endpoint_reference", first, obj(participant_refs=many(F.transform(ends, person)))), ("character_relation_aspects", first, F.when(F.size(aspects) > 0, obj(aspects=many(aspects)))),
        ("character_relation_state", first, F.when(F.size(states) > 0, obj(directional_states=many(states)))), ("entity_facts", first, F.when(is_object(facts) & (F.to_json(facts) != "{}"), obj(facts=facts))),
    ]


def _with_aspects(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """``memories`` with ``aspects``, a map of the relations they name to the ids of these relations' aspects."""
    found = relations.select("chat_id", "relation", F.transform(_aspects(F.col("body")), lambda a: _aspect_id(F.col("chat_id"), F.col("relation"), word(a, "$.kind"))).alias("aspect_ids"))
    asked = memories.select("chat_id", "memory_id", F.explode(F.array_distinct("pairs")).alias("name"))
    met = asked.join(found.select("chat_id", F.concat(F.lit("character_relation:"), "relation").alias("name"), "aspect_ids"), ["chat_id", "name"])
    each = met.groupBy("chat_id", "memory_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "aspect_ids"))).alias("aspects"))
    return memories.join(each, ["chat_id", "memory_id"], "left")


def _memory_components() -> list[tuple[str, Column, Column]]:
    v, ids, first = F.col("body"), F.col("ids"), F.lit("0.1.0")
    role = F.when(get(v, "$.importance", "string") == "core", "important").otherwise(F.lit("current_basis"))
    known = F.filter("pairs", lambda p: F.element_at(ids, p).isNotNull())
    none = F.array().cast("array<string>")
    links = F.transform(known, lambda p: obj(relation_ref=obj(id=F.element_at(ids, p), type=F.lit("character_relation")), related_aspect_ids=many(F.coalesce(F.element_at("aspects", p), none)), context_roles=many(F.array(role))))
    refs = F.transform(F.array_distinct("at_events"), lambda i: obj(id=i, type=F.lit("event")))
    mode = F.coalesce(get(v, "$.acquisition_mode"), F.lit("unknown_from_event").cast("variant"))
    return [
        ("memory_owner_reference", first, obj(owner_ref=obj(id=F.element_at(ids, F.col("owner")), type=F.lit("character")))), ("source_event_reference", first, obj(event_refs=many(refs), acquisition_mode=mode)),
        ("relation_context_reference", first, F.when(F.size(links) > 0, obj(relation_links=many(links)))),
    ]
