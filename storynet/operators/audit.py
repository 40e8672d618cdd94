"""Integrity rules of entities and of the network: each code is a query whose rows are violations.

All return entity_id, component, path, code. Rules that look at other entities are
joins on ids; duplicates are windows; chains are followed by pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.functions.shared import saved

# Entity types, the shape of ids, placement roles by target.
ENTITY_TYPES = ("character", "location", "item", "organization", "skill", "concept", "event", "memory", "character_relation")
ID_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*_[0-7][0-9A-HJKMNP-TV-Z]{25}$"
PLACEMENT_ROLES = {"character": ("carried", "equipped", "worn"), "item": ("contained", "stored"), "location": ("placed", "stored")}


def violations(rows: DataFrame, code: str | Column, component: str | Column = "component", path: str | Column = "path", entity: str = "src_id") -> DataFrame:
    as_col = lambda x, known: x if isinstance(x, Column) else F.col(x) if x in known else F.lit(x)
    return rows.select(
        F.col(entity).alias("entity_id"),
        as_col(component, rows.columns).alias("component"),
        as_col(path, rows.columns).alias("path"),
        (code if isinstance(code, Column) else F.lit(code)).alias("code"),
    )


def _place() -> Column:
    return F.concat(F.lit("/"), F.col("ord").cast("string"))


def shell(entities: DataFrame) -> DataFrame:
    """Type, id and description of ``entities``(id, type, description)."""
    prefix = F.regexp_replace("id", r"_[0-9A-Z]{26}$", "")
    bad_id = F.coalesce(~F.col("id").rlike(ID_PATTERN) | (prefix != F.col("type")), F.lit(True))
    codes = F.array(
        F.when(~F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False)), "INVALID_ENTITY_TYPE"),
        F.when(bad_id, "INVALID_ENTITY_ID"),
        F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "INVALID_ENTITY_DESCRIPTION"),
    )
    rows = entities.withColumn("code", F.explode(F.filter(codes, lambda c: c.isNotNull())))
    return violations(rows, F.col("code"), F.lit("entity"), F.lit("/"), "id")


def json_shell(rows: DataFrame) -> DataFrame:
    """``rows``(pos, entity_json) of a stored network: entries that are no object, and objects whose components, or one of them, are none."""
    place = F.concat(F.lit("/"), F.col("pos").cast("string"))
    whole = rows.withColumn("v", F.try_parse_json("entity_json"))
    is_object = lambda c: F.coalesce(F.startswith(F.schema_of_variant(c), F.lit("OBJECT")), F.lit(False))
    whole = whole.withColumn("ok", is_object(F.col("v"))).withColumn("id", F.when(F.col("ok"), F.try_variant_get("v", "$.id", "string")))
    whole = whole.withColumn("c", F.when(F.col("ok"), F.try_variant_get("v", "$.components", "variant"))).withColumn("c_ok", is_object(F.col("c")))
    each = whole.filter("c_ok").select("id", "pos", F.explode(F.try_variant_get("c", "$", "map<string,variant>")).alias("component", "body"))
    bad = each.filter(~is_object(F.col("body")))
    return (
        violations(whole.filter("not ok"), "INVALID_NETWORK_ENTITY", F.lit("network"), place, "id")
        .unionByName(violations(whole.filter("ok and not c_ok"), "INVALID_COMPONENTS", F.lit("entity"), place, "id"))
        .unionByName(violations(bad, "INVALID_COMPONENT_INSTANCE", "component", place, "id"))
    )


def conditional_rules(fields: DataFrame, conditions: DataFrame) -> DataFrame:
    """Flattened ``fields``(entity_id, component, path, value) against ``conditions``(component, if_path, if_values, then_path, allowed): where the field at if_path has one of the values, that at
    then_path must exist (MISSING_REQUIRED_FIELD) and, if ``allowed`` is not null, have one of its values (INVALID_VALUE)."""
    met = fields.withColumnsRenamed({"path": "if_path", "value": "is"}).join(conditions, ["component", "if_path"]).filter(F.expr("array_contains(if_values, is)"))
    then = fields.select("entity_id", "component", F.col("path").alias("then_path"), F.col("value").alias("has"), F.lit(True).alias("there"))
    rows = met.join(then, ["entity_id", "component", "then_path"], "left")
    code = F.when(F.col("there").isNull(), "MISSING_REQUIRED_FIELD").when(F.col("allowed").isNotNull() & ~F.expr("array_contains(allowed, has)"), "INVALID_VALUE")
    return violations(rows.withColumn("code", code).filter("code is not null"), F.col("code"), path="then_path", entity="entity_id")


# What a whole character relation has.
RELATION_COMPONENTS = ("entity_management", "relation_endpoint_reference", "character_relation_aspects", "character_relation_state")


def relation_components(present: DataFrame, subjective: DataFrame) -> DataFrame:
    """``present``(relation, component) of all relations, ``subjective``(relation): those with an aspect that one character sees, which need the derived memory index as well."""
    all_ = present.select("relation").distinct()
    need = all_.select("relation", F.explode(F.array(*map(F.lit, RELATION_COMPONENTS))).alias("component")).withColumn("code", F.lit("MISSING_RELATION_COMPONENT"))
    more = subjective.select("relation").distinct().select("relation", F.lit("relation_memory_index").alias("component"), F.lit("RELATION_MEMORY_INDEX_REQUIRED").alias("code"))
    rows = need.unionByName(more).join(present.select("relation", "component"), ["relation", "component"], "left_anti")
    return violations(rows, F.col("code"), "component", F.lit("/"), "relation")


def component_rules(components: DataFrame, allowed: DataFrame, versions: DataFrame) -> DataFrame:
    """``components``(entity_id, entity_type, component, schema_version) against ``allowed``(component, entity_type) and ``versions``(component, schema_version)."""
    known = components.join(versions.select("component").distinct(), "component", "left_semi")
    out = [
        (components.join(versions.select("component").distinct(), "component", "left_anti"), "UNKNOWN_COMPONENT", "/"),
        (known.join(allowed, ["component", "entity_type"], "left_anti"), "COMPONENT_NOT_ALLOWED_ON_ENTITY", "/"),
        (known.filter("schema_version is null"), "MISSING_REQUIRED_FIELD", "/schema_version"),
        (known.filter("schema_version is not null").join(versions, ["component", "schema_version"], "left_anti"), "UNSUPPORTED_VERSION", "/schema_version"),
    ]
    rows = [violations(df, code, "component", F.lit(path), "entity_id") for df, code, path in out]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def field_rules(fields: DataFrame, rules: DataFrame, present: DataFrame) -> DataFrame:
    """Flattened ``fields``(entity_id, component, path, type, value) against ``rules``(component, path, type, required, pattern, low, high, allowed).

    ``present``(entity_id, component) lists the component instances, for fields that must exist. The rules are
    small and given by the caller, a row for each path of a schema.
    """
    ref = F.element_at(F.split("path", "/"), -1).endswith("_ref")
    unknown = fields.join(rules.select("component", "path"), ["component", "path"], "left_anti")
    met = fields.join(rules.withColumnRenamed("type", "rule_type"), ["component", "path"])
    wrong_type = F.col("type") != F.col("rule_type")
    number = F.col("value").try_cast("double")
    bad = (
        (F.col("pattern").isNotNull() & ~F.rlike("value", F.col("pattern")))
        | (F.col("low").isNotNull() & (number < F.col("low")))
        | (F.col("high").isNotNull() & (number > F.col("high")))
        | (F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value")))
    )
    code = F.when(wrong_type, "INVALID_TYPE").when(bad, F.when(ref & F.col("pattern").isNotNull(), "INVALID_REFERENCE").otherwise("INVALID_VALUE"))
    valued = met.withColumn("code", code).filter("code is not null")
    needed = present.join(rules.filter("required").select("component", "path"), "component")
    absent = needed.join(fields.select("entity_id", "component", "path"), ["entity_id", "component", "path"], "left_anti")
    return (
        violations(unknown, F.when(ref, "INVALID_REFERENCE").otherwise("UNKNOWN_FIELD"), entity="entity_id")
        .unionByName(violations(valued, F.col("code"), entity="entity_id"))
        .unionByName(violations(absent, F.when(ref, "INVALID_REFERENCE").otherwise("MISSING_REQUIRED_FIELD"), entity="entity_id"))
    )


def duplicate_items(items: DataFrame) -> DataFrame:
    """``items``(entity_id, component, array_path, ord, item_id): the second and later use of a local id in one array."""
    again = F.row_number().over(W.partitionBy("entity_id", "component", "array_path", "item_id").orderBy("ord"))
    rows = items.filter("item_id is not null").withColumn("n", again).filter("n > 1")
    return violations(rows, "DUPLICATE_ITEM_ID", path=F.concat("array_path", _place()), entity="entity_id")


def reference_ids(refs: DataFrame) -> DataFrame:
    """The type in a reference's id is its declared type."""
    prefix = F.regexp_replace("tgt_id", r"_[0-9A-Z]{26}$", "")
    return violations(refs.filter(prefix != F.col("tgt_type")), "INVALID_REFERENCE_ID", path=_place())


def duplicate_entities(entities: DataFrame) -> DataFrame:
    """Rows after the first (by pos) with one id."""
    n = F.row_number().over(W.partitionBy("id").orderBy("pos"))
    rows = entities.withColumn("n", n).filter("n > 1")
    return violations(rows, "DUPLICATE_ENTITY_ID", F.lit("entity"), F.concat(F.lit("/"), F.col("pos").cast("string")), "id")


def missing_targets(refs: DataFrame, entities: DataFrame) -> DataFrame:
    # not left_anti: Spark would move it below the union that references come from, one join with all entities for each part of it
    known = entities.select(F.col("id").alias("tgt_id")).distinct().withColumn("known", F.lit(True))
    rows = refs.join(known, "tgt_id", "left").filter("known is null")
    return violations(rows, "MISSING_REFERENCE_TARGET", path=_place())


def mistyped_targets(refs: DataFrame, entities: DataFrame) -> DataFrame:
    own = entities.groupBy(F.col("id").alias("tgt_id")).agg(F.min("type").alias("type"))
    return violations(refs.join(own, "tgt_id").filter("type <> tgt_type"), "REFERENCE_TARGET_TYPE_MISMATCH", path=_place())


def incomplete_memories(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """A memory needs an owner and a source event."""
    names = ("memory_owner_reference", "source_event_reference")
    # memories and references meet in one aggregation of numbers: how often a memory is there, and a bit for each needed component
    own = entities.filter("type = 'memory'").select(F.col("id").alias("src_id"), F.lit(1).alias("own"), F.lit(0).alias("bit"))
    has = refs.filter(F.col("component").isin(*names)).select("src_id", F.lit(0).alias("own"), F.when(F.col("component") == names[0], 1).otherwise(2).alias("bit"))
    rows = own.unionByName(has).groupBy("src_id").agg(F.sum("own").cast("int").alias("n"), F.bit_or("bit").alias("held")).filter("n > 0 and held < 3")
    lacks = [F.when(F.col("held").bitwiseAND(bit) == 0, F.lit(name)) for bit, name in zip((1, 2), names, strict=True)]
    rows = rows.select("src_id", "n", F.explode(F.array_compact(F.array(*lacks))).alias("component")).withColumn("n", F.explode(F.array_repeat("n", F.col("n"))))
    return violations(rows, "MISSING_MEMORY_NETWORK_COMPONENT", path=F.lit("/"))


def _owners(refs: DataFrame) -> DataFrame:
    own = refs.filter("component = 'memory_owner_reference'")
    return own.groupBy(F.col("src_id").alias("memory")).agg(F.min("tgt_id").alias("owner"))


def memory_owners(refs: DataFrame) -> DataFrame:
    """A character pins only its own memories."""
    pinned = refs.filter("component = 'memory_reference' and src_type = 'character'")
    rows = pinned.join(_owners(refs), F.col("tgt_id") == F.col("memory")).filter("owner <> src_id")
    return violations(rows, "MEMORY_REFERENCE_OWNER_MISMATCH", path=_place())


def relation_memory_owners(links: DataFrame, aspects: DataFrame, refs: DataFrame) -> DataFrame:
    """``links``(relation, memory, aspect, role) and ``aspects``(relation, aspect, owner), those seen by one character.

    A memory that forms such an aspect belongs to its owner.
    """
    formed = links.filter("role = 'formation_basis'").select("relation", "memory", "aspect").distinct()
    rows = formed.join(aspects.withColumnRenamed("owner", "expected"), ["relation", "aspect"]).join(_owners(refs), "memory", "left")
    rows = rows.filter(~F.col("owner").eqNullSafe(F.col("expected")))
    return violations(rows, "RELATION_MEMORY_OWNER_MISMATCH", F.lit("relation_memory_index"), F.concat(F.lit("/"), "memory", F.lit("/"), F.col("aspect").cast("string")), "relation")


def duplicate_related(refs: DataFrame) -> DataFrame:
    """An event names an entity once."""
    n = F.row_number().over(W.partitionBy("src_id", "tgt_id").orderBy("ord"))
    rows = refs.filter("component = 'event_related_entity_reference'").withColumn("n", n).filter("n > 1")
    return violations(rows, "DUPLICATE_EVENT_RELATED_ENTITY", path=_place())


def duplicate_sequences(refs: DataFrame) -> DataFrame:
    """An event uses a place number once; coming back to a place is fine."""
    n = F.row_number().over(W.partitionBy("src_id", "num").orderBy("ord"))
    rows = refs.filter("component = 'event_location_reference'").withColumn("n", n).filter("n > 1")
    return violations(rows, "DUPLICATE_EVENT_LOCATION_SEQUENCE", path=_place())


def non_containers(refs: DataFrame, containers: DataFrame) -> DataFrame:
    """``containers``(id): an item lies only in an item that can hold others."""
    rows = refs.filter("component = 'current_placement_reference' and tgt_type = 'item'")
    return violations(rows.join(containers.select(F.col("id").alias("tgt_id")), "tgt_id", "left_anti"), "ITEM_PLACED_IN_NON_CONTAINER", path=F.lit("/data/placement_ref"))


def reaches_cycle(parents: DataFrame) -> DataFrame:
    """``parents``(node, parent), one parent each: node, on_cycle and cycle (its smallest node) of every node whose chain reaches a cycle.

    Pointer jumping: after k rounds each node points 2**k steps up, so log2 of the longest chain rounds decide, and of the longest
    cycle for its smallest node, which each node of a cycle keeps of those that it has passed.
    """
    jump = saved(parents.select("node", F.col("parent").alias("up")))
    before, now = None, _ends(jump)
    while now != before:  # once no end falls away any more, all ends lie on cycles, and every node of a cycle is one
        jump = saved(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
        before, now = now, _ends(jump)
    ring = jump.select(F.col("up").alias("node")).distinct().join(parents, "node")
    ring = saved(ring.select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("low")))
    before, now = None, _lows(ring)
    while now != before:  # windows of a round that all have the minimum of the next, twice as long, have that of their cycle
        step = ring.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("low").alias("far"))
        ring = saved(ring.join(step, "up").select("node", F.col("next").alias("up"), F.least("low", "far").alias("low")))
        before, now = now, _lows(ring)
    cycle = ring.select("node", F.col("low").alias("cycle"))
    ends = jump.join(cycle.select(F.col("node").alias("up"), "cycle"), "up").select("node", "cycle")
    return ends.join(cycle.select("node", F.lit(True).alias("on")), "node", "left").select("node", F.coalesce("on", F.lit(False)).alias("on_cycle"), "cycle")


def _ends(jump: DataFrame) -> tuple:
    return tuple(jump.agg(F.count("*"), F.countDistinct("up")).first())


def _lows(ring: DataFrame):
    return ring.agg(F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()[0]


def _parents(refs: DataFrame, component: str, tgt_type: str | None = None) -> DataFrame:
    own = refs.filter(F.col("component") == component)
    own = own.filter(F.col("tgt_type") == tgt_type) if tgt_type else own
    return own.groupBy(F.col("src_id").alias("node")).agg(F.min("tgt_id").alias("parent"))


def placement_cycles(refs: DataFrame) -> DataFrame:
    """Every item whose chain of containers reaches a cycle, tails included."""
    rows = reaches_cycle(_parents(refs, "current_placement_reference", "item"))
    return violations(rows, "ITEM_PLACEMENT_CYCLE", F.lit("current_placement_reference"), F.lit("/"), "node")


def parent_cycles(refs: DataFrame, component: str, code: str) -> DataFrame:
    """One row for each cycle, its smallest node, and one for each node of a tail."""
    rows = reaches_cycle(_parents(refs, component)).filter("not on_cycle or node = cycle")
    return violations(rows, code, F.lit(component), F.lit("/"), "node")


ORDERED = ("history_index",)


def ids_digest(ids: str | Column = "ids", ordered: tuple[str, ...] = ORDERED) -> Column:
    """MD5 of an index row's ids, whatever their order but in the ``ordered`` indexes; null if ids are null."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.unhex(F.md5(F.array_join(F.when(F.col("component").isin(*ordered), ids).otherwise(F.sort_array(ids)), ",")))


def entries_digest(place: str | Column = "place", id: str | Column = "id", ordered: tuple[str, ...] = ORDERED) -> Column:
    """As ``ids_digest``, an aggregate over an index's entries, each with its ``place`` in the list; those without place or id do not count.

    It holds their number and 128 bits, the exclusive or of hashes of the ids, with the place in the ``ordered`` indexes. Lists with equal
    digests are equal if one of them has every id once, as a rebuilt one has.
    """
    place, id = (F.col(c) if isinstance(c, str) else c for c in (place, id))
    at = F.when(F.col("component").isin(*ordered), place.cast("long")).otherwise(F.lit(0).cast("long"))
    own = lambda c: F.when(place.isNotNull() & id.isNotNull(), c)
    # the seed comes first, so that the two hashes of an entry are not made of each other
    return F.struct(F.count(own(F.lit(1))).alias("n"), *[F.bit_xor(own(F.xxhash64(F.lit(seed), at, id))).alias(f"bits{seed}") for seed in range(2)])


def stale_indexes(stored: DataFrame, rebuilt: DataFrame, required: bool = True, ordered: tuple[str, ...] = ORDERED) -> DataFrame:
    """Stored index rows (entity_id, component, ids) against rebuilt ones, whatever the order of ids but in the ``ordered`` indexes."""
    # digests are made where the rows are: an id of a hot entity's index is neither shuffled nor sorted again
    told = lambda rows: rows.select("entity_id", "component", ids_digest("ids", ordered).alias("digest"))
    return stale_digests(told(stored), told(rebuilt), required)


def stale_digests(stored: DataFrame, rebuilt: DataFrame, required: bool = True) -> DataFrame:
    """As ``stale_indexes``, from (entity_id, component, digest) of both sides."""
    a, b = (rows.select("entity_id", "component", F.col("digest").alias(name)) for rows, name in ((stored, "stored"), (rebuilt, "rebuilt")))
    both = a.join(b, ["entity_id", "component"], "full")
    missing = F.col("stored").isNull()
    code = F.when(missing, F.lit("MISSING_DERIVED_INDEX") if required else F.lit(None)).when(~F.col("stored").eqNullSafe(F.col("rebuilt")), "STALE_DERIVED_INDEX")
    rows = both.withColumn("code", code).filter("code is not null")
    return violations(rows, F.col("code"), path=F.lit("/"), entity="entity_id")


def placements(refs: DataFrame) -> DataFrame:
    """The role of a placement fits the type of its target."""
    own = refs.filter("component = 'current_placement_reference'")
    fits = F.lit(None).cast("boolean")
    for kind, roles in PLACEMENT_ROLES.items():
        fits = F.when(F.col("tgt_type") == kind, F.col("role").isin(*roles)).otherwise(fits)
    code = F.when(fits.isNull(), "ITEM_PLACEMENT_TARGET_TYPE").when(~fits, "ITEM_PLACEMENT_ROLE_MISMATCH")
    return violations(own.withColumn("code", code).filter("code is not null"), F.col("code"), path=F.lit("/data/placement_role"))


def quantities(items: DataFrame) -> DataFrame:
    """``items``(entity_id, mode, quantity): stacks have a quantity, others none."""
    code = F.when((F.col("mode") == "stack") & F.col("quantity").isNull(), "STACK_ITEM_QUANTITY_REQUIRED").when(
        (F.col("mode") != "stack") & F.col("quantity").isNotNull(), "NON_STACK_ITEM_HAS_QUANTITY"
    )
    rows = items.withColumn("code", code).filter("code is not null")
    return violations(rows, F.col("code"), F.lit("item_quantity"), F.lit("/data/quantity"), "entity_id")


def relations(endpoints: DataFrame, roles: DataFrame, states: DataFrame, memories: DataFrame) -> DataFrame:
    """Inner agreement of relations.

    ``endpoints``(relation, ord, character); ``roles``(relation, aspect, character, owner, concealed): participants of an aspect, the owner of its
    view (null if none) and whom it is concealed from (null if none); ``states``(relation, ord, src, dst); ``memories``(relation, ord, memory, aspect).
    """
    ends = endpoints.groupBy("relation").agg(
        F.array_sort(F.collect_list("character")).alias("ends"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "character"))), lambda x: x["character"]).alias("given")
    )
    order = violations(ends.filter("given <> ends"), "NON_CANONICAL_RELATION_ENDPOINT_ORDER", F.lit("relation_endpoint_reference"), F.lit("/"), "relation")
    each = roles.groupBy("relation", "aspect").agg(F.array_sort(F.collect_set("character")).alias("who"), F.max("owner").alias("owner"), F.max("concealed").alias("concealed"))
    each = each.join(ends, "relation")
    codes = F.array(
        F.when(F.col("who") != F.array_sort(F.array_distinct("ends")), "RELATION_ASPECT_PARTICIPANT_MISMATCH"),
        F.when(F.col("owner").isNotNull() & ~F.expr("array_contains(ends, owner)"), "RELATION_PERSPECTIVE_OWNER_MISMATCH"),
        F.when(F.col("concealed").isNotNull() & ~F.expr("array_contains(ends, concealed)"), "RELATION_DISCLOSURE_TARGET_MISMATCH"),
    )
    aspects = each.withColumn("code", F.explode(F.filter(codes, lambda c: c.isNotNull())))
    aspects = violations(aspects, F.col("code"), F.lit("character_relation_aspects"), F.concat(F.lit("/"), F.col("aspect").cast("string")), "relation")
    told = states.join(ends, "relation")
    outside = told.filter("src = dst or not array_contains(ends, src) or not array_contains(ends, dst)")
    n = F.row_number().over(W.partitionBy("relation", "src", "dst").orderBy("ord"))
    twice = states.withColumn("n", n).filter("n > 1")
    state = violations(outside, "RELATION_STATE_ENDPOINT_MISMATCH", F.lit("character_relation_state"), _place(), "relation").unionByName(
        violations(twice, "DUPLICATE_RELATION_DIRECTION", F.lit("character_relation_state"), _place(), "relation")
    )
    m = F.row_number().over(W.partitionBy("relation", "memory", "aspect").orderBy("ord"))
    again = memories.withColumn("n", m).filter("n > 1")
    known = roles.select("relation", "aspect").distinct()
    unknown = memories.join(known, ["relation", "aspect"], "left_anti")
    bare = known.join(memories.select("relation", "aspect"), ["relation", "aspect"], "left_anti")
    at = F.lit("relation_memory_index")
    memory = (
        violations(again, "DUPLICATE_RELATION_MEMORY", at, _place(), "relation")
        .unionByName(violations(unknown, "UNKNOWN_RELATION_ASPECT_REFERENCE", at, _place(), "relation"))
        .unionByName(violations(bare, "RELATION_ASPECT_WITHOUT_MEMORY_BASIS", at, F.concat(F.lit("/"), F.col("aspect").cast("string")), "relation"))
    )
    return order.unionByName(aspects).unionByName(state).unionByName(memory)


def permissions(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """``changes``(change_id, component, path, operation, role) against ``rules``(component, pattern, operation, roles); pattern null is the default.

    A pattern has as many parts as the path, ``*`` for any; the one with most other parts wins.
    """
    # rules are broadcast, a row with all rules for each operation and component: a change is judged where it is, however many share its operation
    operations = rules.groupBy("operation").agg(F.lit(True).alias("listed"))
    wrong = changes.join(F.broadcast(operations), "operation", "left").filter("listed is null")
    wrong = violations(wrong, "INVALID_PERMISSION_OPERATION", entity="change_id")
    regex = F.concat(F.lit("^"), F.replace("pattern", F.lit("*"), F.lit("[^/]+")), F.lit("$"))
    special = F.size(F.filter(F.split("pattern", "/"), lambda x: (x != "*") & (x != "")))
    rank = F.when(F.col("pattern").isNull(), 1).otherwise(-special)
    each = F.struct(rank.alias("rank"), F.col("pattern"), regex.alias("regex"), F.col("roles"))
    sets = rules.groupBy("component", "operation").agg(F.array_sort(F.collect_list(each)).alias("rules"))
    fits = F.filter("rules", lambda r: r["pattern"].isNull() | F.rlike(F.col("path"), r["regex"]))
    met = changes.join(F.broadcast(sets), ["component", "operation"]).withColumn("rule", F.get(fits, F.lit(0)))
    denied = met.filter("rule is not null and not array_contains(rule.roles, role)")
    return wrong.unionByName(violations(denied, "PERMISSION_DENIED", entity="change_id"))
