"""Reference edges of the entity network and the indexes rebuilt from them.

Edges have src_id, src_type, component, ord, role, num, tgt_id, tgt_type. Every
index is one filter and one grouped aggregation over them, so partial
aggregation runs before each shuffle; nothing is collected to the driver. Its
lists are arrays, or entries as rows for whoever need not hold a list whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The reference paths of the component schemas (component, path, target types, derived).
REF_RULES = (
    ("current_location_reference", "location_ref", "location", False),
    ("related_concept_reference", "concept_refs/*", "concept", False),
    ("history_index", "event_refs/*", "event", True),
    ("character_behavior_profile", "preferences/*/related_entity_ref", "any", False),
    ("character_objective", "objectives/*/related_entity_refs/*", "any", False),
    ("organization_objective", "objectives/*/related_entity_refs/*", "any", False),
    ("memory_reference", "memory_refs/*/memory_ref", "memory", False),
    ("skill_reference", "skill_refs/*/skill_ref", "skill", False),
    ("skill_reference", "skill_refs/*/stage_state/framework_ref", "skill,concept", False),
    ("memory_index", "memory_refs/*", "memory", True),
    ("relation_index", "relation_refs/*", "character_relation", True),
    ("inventory_index", "item_refs/*/item_ref", "item", True),
    ("event_content", "key_details/*/actor_ref", "character", False),
    ("event_location_reference", "location_refs/*/location_ref", "location", False),
    ("event_related_entity_reference", "related_entity_refs/*", "any", False),
    ("event_memory_index", "memory_refs/*", "memory", True),
    ("current_placement_reference", "placement_ref", "character,item,location", False),
    ("contents_index", "item_refs/*", "item", True),
    ("parent_location_reference", "parent_location_ref", "location", False),
    ("child_location_index", "location_refs/*", "location", True),
    ("containment_index", "entity_refs/*/entity_ref", "character,item", True),
    ("parent_organization_reference", "parent_organization_ref", "organization", False),
    ("child_organization_index", "organization_refs/*", "organization", True),
    ("memory_owner_reference", "owner_ref", "character", False),
    ("source_event_reference", "event_refs/*", "event", False),
    ("relation_context_reference", "relation_links/*/relation_ref", "character_relation", False),
    ("relation_endpoint_reference", "participant_refs/*", "character", False),
    ("character_relation_aspects", "aspects/*/participant_roles/*/character_ref", "character", False),
    ("character_relation_aspects", "aspects/*/perspective/owner_ref", "character", False),
    ("character_relation_aspects", "aspects/*/disclosure/concealed_from_refs/*", "character", False),
    ("character_relation_state", "directional_states/*/from_character_ref", "character", False),
    ("character_relation_state", "directional_states/*/toward_character_ref", "character", False),
    ("relation_memory_index", "memory_refs/*/memory_ref", "memory", True),
)
DERIVED = tuple(c for c, _, _, derived in REF_RULES if derived)
REF = "struct<id:string,type:string>"


def _schema(paths: list[list[str]]) -> str:
    """The type that holds some paths of one component, so that parsing reads nothing else."""
    if [] in paths:
        return REF
    heads: dict[str, list[list[str]]] = {}
    for head, *rest in paths:
        heads.setdefault(head, []).append(rest)
    if "*" in heads:
        return f"array<{_schema(heads['*'])}>"
    return f"struct<{','.join(f'{h}:{_schema(rest)}' for h, rest in heads.items())}>"


_NO_ROWS = "array<struct<id:string,type:string,rule:int,{places}>>"


def _walk(at: Column, parts: list[str], rule: int, places: list[Column], depth: int) -> Column:
    """References below ``at`` along a path, as an array: id, type, the number of the rule, and the places in its lists, outermost first."""
    if "*" not in parts:
        for head in parts:
            at = at[head]
        held = [*places, *[F.lit(None).cast("long")] * (depth - len(places))]
        found = F.struct(at["id"].alias("id"), at["type"].alias("type"), F.lit(rule).alias("rule"), *[p.alias(f"place{k}") for k, p in enumerate(held)])
        return found if places else F.array(found)
    here = parts.index("*")
    for head in parts[:here]:
        at = at[head]
    inside = F.transform(at, lambda x, i: _walk(x, parts[here + 1 :], rule, [*places, i.cast("long")], depth))
    if "*" in parts[here + 1 :]:  # one element without the path must not hide the others
        inside = F.flatten(F.filter(inside, lambda x: x.isNotNull()))
    return inside


def _path(rules: list[list[str]], depth: int) -> Column:
    """The path of a reference, from its rule and places."""
    pieces = [["".join(f"/{p}" for p in piece.split("/") if p) for piece in "/".join(["data", *rule]).split("*")] for rule in rules]
    nth = lambda k: F.element_at(F.array(*[F.lit(p[k] if k < len(p) else None).cast("string") for p in pieces]), F.col("rule") + 1)
    return F.concat_ws("", nth(0), *[c for k in range(depth) for c in (F.concat(F.lit("/"), F.col(f"place{k}").cast("string")), nth(k + 1))])


def extract_refs(components: DataFrame, rules=REF_RULES) -> DataFrame:
    """Applies reference paths to ``components``(entity_id, entity_type, component, data as JSON text), in one pass.

    Returns src_id, src_type, component, path, ord (place in the innermost list), tgt_id, tgt_type, derived.
    A path that a component does not hold gives no row; so does a reference without id.
    """
    paths = [path.split("/") for _, path, _, _ in rules]
    depth = max((path.count("*") for path in paths), default=0)
    none = F.array().cast(_NO_ROWS.format(places=",".join(f"place{k}:bigint" for k in range(depth))).replace(",>", ">"))
    by_component: dict[str, list[int]] = {}
    for n, (component, *_) in enumerate(rules):
        by_component.setdefault(component, []).append(n)

    def along(own: list[int]) -> Callable[[Column], Column]:
        """A function of a parsed component to the references along all its paths."""

        def found(at: Column) -> Column:
            walks = [_walk(at, paths[n], n, [], depth) for n in own]
            return walks[0] if len(walks) == 1 else F.concat(*[F.coalesce(w, none) for w in walks])

        return found

    every = none
    for component, own in by_component.items():
        parsed = F.from_json("data", _schema([paths[n] for n in own]))
        # a function of an array's only element, so that the row is parsed once for all its paths
        every = F.when(F.col("component") == component, F.transform(F.array(parsed), along(own))[0]).otherwise(every)
    rows = components.filter(F.col("component").isin(*by_component)).select(
        F.col("entity_id").alias("src_id"), F.col("entity_type").alias("src_type"), "component", F.inline(every)
    )
    # what follows from rule and place is no matter of the rows that are made, and costs nothing where it isn't asked for
    place = F.coalesce(*[F.col(f"place{k}") for k in reversed(range(depth))], F.lit(0).cast("long"))
    derived = F.element_at(F.array(*[F.lit(bool(r[3])) for r in rules]), F.col("rule") + 1)
    return rows.filter("id is not null").select("src_id", "src_type", "component", _path(paths, depth).alias("path"), place.alias("ord"), F.col("id").alias("tgt_id"), F.col("type").alias("tgt_type"), derived.alias("derived"))


def _wrapped(leaf: str):
    """A function of an edge to its reference, inside an object's field ``leaf`` if there is one."""

    def wrap(x: Column) -> Column:
        ref = F.struct(x["id"].alias("id"), x["type"].alias("type"))
        return F.struct(ref.alias(leaf)) if leaf else ref

    return wrap


def as_components(refs: DataFrame) -> DataFrame:
    """Edges to component rows (entity_id, entity_type, component, data): the inverse of ``extract_refs`` for authoritative components."""
    # dealt out before they are collected: arrays that hold a few rows of a key are not made, sorted and shuffled first
    rows = refs.select("src_id", "src_type", "component", "ord", "tgt_id", "tgt_type").repartition("src_id", "component").groupBy("src_id", "src_type", "component").agg(
        F.sort_array(F.collect_list(F.struct("ord", F.col("tgt_id").alias("id"), F.col("tgt_type").alias("type")))).alias("refs")
    )
    data = F.lit(None).cast("string")
    for component, path, _, derived in REF_RULES:
        if derived or re.search("stage_state|aspects|directional|preferences|objectives|key_details", path):
            continue
        head, _, rest = path.partition("/")
        leaf = rest.partition("/")[2]
        held = F.transform("refs", _wrapped(leaf)) if rest else _wrapped("")(F.col("refs")[0])
        data = F.when(F.col("component") == component, F.to_json(F.struct(held.alias(head)))).otherwise(data)
    return rows.select(F.col("src_id").alias("entity_id"), F.col("src_type").alias("entity_type"), "component", data.alias("data"))


def formal_refs(refs: DataFrame) -> DataFrame:
    """Distinct authoritative edges (src_id, component, tgt_id); the first target type wins."""
    first = F.min(F.struct("ord", "tgt_type"))
    own = refs.filter(~F.col("component").isin(*DERIVED)).groupBy("src_id", "component", "tgt_id").agg(first.alias("m"))
    return own.select("src_id", "component", "tgt_id", F.col("m.tgt_type").alias("tgt_type"))


#: A function of an index's entries (entity_id, place, n, id), the place-th of the n ids of an entity in their order, to a row for each entity.
#: Rows of an entity are together in a partition. An entity whose ids are all null has rows without id.
Told = Callable[[DataFrame], DataFrame]


def _listed(rows: DataFrame, column: str | Column, told: Told | None = None) -> DataFrame:
    """The sorted set of ``column`` for each entity_id, as ids, or what ``told`` makes of its entries."""
    if told:
        return told(_placed(_dealt(rows.select("entity_id", (F.col(column) if isinstance(column, str) else column).alias("id")))))
    return rows.groupBy("entity_id").agg(F.sort_array(F.collect_set(column)).alias("ids"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.filter("entity_id is not null").repartition("entity_id")


def _placed(entries: DataFrame) -> DataFrame:
    """Distinct entries (entity_id, id) with place and n. They are sorted on disk where memory is short: no entity's ids need fit in it."""
    ids = W.partitionBy("entity_id").orderBy(F.asc_nulls_last("id"))
    # sorted once; repeated ids are next to each other
    first = entries.select("entity_id", "id", F.row_number().over(ids).alias("nth"), F.lag("id").over(ids).alias("before")).filter("nth = 1 or not (before <=> id)")
    n = F.count("id").over(ids.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return first.select("entity_id", F.row_number().over(ids).cast("long").alias("place"), n.alias("n"), "id")


def existing(index: DataFrame, entities: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Index rows of entities that exist with one of the types; others cannot carry the index."""
    own = entities.filter(F.col("type").isin(*types)).select(F.col("id").alias("entity_id"), F.col("type").alias("entity_type"))
    return index.join(own.distinct(), "entity_id")


def _sources(refs: DataFrame, told: Told | None) -> DataFrame:
    return _listed(refs.select(F.col("tgt_id").alias("entity_id"), "src_id"), "src_id", told)


def _simple(refs: DataFrame, told: Told | None, component: str, tgt_type: str | None = None) -> DataFrame:
    own = refs.filter(F.col("component") == component)
    own = own.filter(F.col("tgt_type") == tgt_type) if tgt_type else own
    return _sources(own, told)


def memory_index(refs, entities, told=None):
    """Owner to memories."""
    return existing(_simple(refs, told, "memory_owner_reference"), entities, ("character",))


def event_memory_index(refs, entities, told=None):
    """Event to memories."""
    return existing(_simple(refs, told, "source_event_reference"), entities, ("event",))


def relation_index(refs, entities, told=None):
    """Character to relations."""
    return existing(_simple(refs, told, "relation_endpoint_reference"), entities, ("character",))


HISTORY_TYPES = ("character", "location", "item", "organization", "skill", "concept", "character_relation")


def history_index(refs, entities, told=None):
    """Entity to the events that name it as related or as a location."""
    own = refs.filter(F.col("component").isin("event_related_entity_reference", "event_location_reference"))
    return existing(_sources(own, told), entities, HISTORY_TYPES)


def contents_index(refs, entities, told=None):
    """Item to the items placed in it."""
    return existing(_simple(refs, told, "current_placement_reference", "item"), entities, ("item",))


def child_location_index(refs, entities, told=None):
    return existing(_simple(refs, told, "parent_location_reference"), entities, ("location",))


def child_organization_index(refs, entities, told=None):
    return existing(_simple(refs, told, "parent_organization_reference"), entities, ("organization",))


def _entries(index: DataFrame, told: Told | None) -> DataFrame:
    """Groups (entity_id, item, role) to sorted entries item:role."""
    return _listed(index, F.concat_ws(":", "item", "role"), told)


def inventory_index(refs, entities, told=None):
    """Character to items carried, equipped or worn, with the role."""
    own = refs.filter("component = 'current_placement_reference' and tgt_type = 'character' and role in ('carried', 'equipped', 'worn')")
    return existing(_entries(own.selectExpr("tgt_id as entity_id", "src_id as item", "role"), told), entities, ("character",))


def containment_index(refs, entities, told=None):
    """Location to characters (present) and items (stored or placed)."""
    here = refs.filter("component = 'current_location_reference'").selectExpr("tgt_id as entity_id", "src_id as item", "'present' as role")
    put = refs.filter("component = 'current_placement_reference' and tgt_type = 'location'").selectExpr(
        "tgt_id as entity_id", "src_id as item", "case when role = 'stored' then 'stored' else 'placed' end as role"
    )
    return existing(_entries(here.unionByName(put), told), entities, ("location",))


def _held(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often and in whatever loop it is looked at."""
    return F.transform(F.array(x), then)[0]


def _runs(rows: Column, field: str) -> Column:
    """Sorted structs cut where a field changes, in time linear in them."""
    first = lambda i: (i == 0) | ~F.get(rows, i)[field].eqNullSafe(F.get(rows, i - 1)[field])
    starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), first)
    return _held(starts, lambda at: F.transform(at, lambda i, k: F.slice(rows, i + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - i)))


def relation_memory_index(refs, entities, told=None):
    """Relation to its memories, each with the union of aspects and of roles."""
    own = refs.filter("component = 'relation_context_reference'").select(F.col("tgt_id").alias("entity_id"), "src_id", F.col("num").cast("string").alias("num"), "role")
    if told:
        each = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "+")
        memories = _dealt(own).groupBy("entity_id", "src_id").agg(each("num").alias("num"), each("role").alias("role"))
        entries = memories.select("entity_id", F.concat_ws(":", "src_id", "num", "role").alias("id"))
        return existing(told(_placed(entries)), entities, ("character_relation",))
    # one aggregation for each relation: one for each memory first would shuffle and sort every row once more
    rows = _listed(own, F.struct("src_id", "num", "role"))
    union = lambda run, c: F.array_join(F.sort_array(F.array_distinct(F.transform(run, lambda x: x[c]))), "+")
    entry = lambda run: F.concat_ws(":", run[0]["src_id"], union(run, "num"), union(run, "role"))
    ids = _held(F.col("ids"), lambda x: F.transform(_runs(x, "src_id"), entry))
    return existing(rows.withColumn("ids", F.sort_array(F.array_distinct(ids))), entities, ("character_relation",))


INDEXES = {
    "memory_index": memory_index,
    "event_memory_index": event_memory_index,
    "relation_index": relation_index,
    "history_index": history_index,
    "relation_memory_index": relation_memory_index,
    "inventory_index": inventory_index,
    "contents_index": contents_index,
    "containment_index": containment_index,
    "child_location_index": child_location_index,
    "child_organization_index": child_organization_index,
}


def rebuild_indexes(refs: DataFrame, entities: DataFrame, told: Told | None = None) -> DataFrame:
    """All derived index rows: entity_id, component, ids. An entity without entries has no row.

    With ``told``, a function of the entries (entity_id, component, place, n, id), its columns in place of ids, and ids are not collected; it must keep entity_id and component.
    """
    out = None
    for name, build in INDEXES.items():
        named = lambda rows, name=name: rows.withColumn("component", F.lit(name))
        rows = build(refs, entities, lambda rows, named=named: told(named(rows))) if told else named(build(refs, entities))
        rows = rows.drop("entity_type")
        out = rows if out is None else out.unionByName(rows)
    return out.select("entity_id", "component", *[c for c in out.columns if c not in ("entity_id", "component")])


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def mint_ids(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The id map with ids for new (chat_id, type, key) rows; known ids never change.

    An id is the type and 26 Crockford digits from a digest of the key, so a rerun mints the same.
    """
    digest = F.sha2(F.concat_ws("\u0001", "chat_id", "type", "key"), 256)
    # two hex digits give one base-32 digit by their value modulo 32; the first digit is at most 7
    digit = lambda i: F.substr(
        F.lit(CROCKFORD), (F.conv(F.substr(digest, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int") % (8 if i == 0 else 32) + 1), F.lit(1)
    )
    new = keys.select("chat_id", "type", "key").distinct().join(known, ["chat_id", "type", "key"], "left_anti")
    new = new.withColumn("id", F.concat("type", F.lit("_"), *[digit(i) for i in range(26)]))
    return known.select("chat_id", "type", "key", "id").unionByName(new)


def overlay(current: DataFrame, base: DataFrame, new: DataFrame) -> DataFrame:
    """Three-way merge of flattened values (entity_id, path, value).

    A value that the new projection changed against the base replaces the current one; all else of the
    current rows stays, also what the projection dropped, and entity_management paths are never touched.
    """
    keys = ["entity_id", "path"]
    b = base.select(*keys, F.struct("value").alias("b"))
    n = new.select(*keys, F.struct("value").alias("n"))
    c = current.select(*keys, F.struct("value").alias("c"))
    both = c.join(b, keys, "full").join(n, keys, "full")
    changed = F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.col("b"))
    managed = F.col("path").startswith("/entity_management") & F.col("c").isNotNull()
    value = F.when(changed & ~managed, F.col("n")).otherwise(F.col("c"))
    return both.withColumn("v", value).filter("v is not null").select(*keys, F.col("v.value").alias("value"))


def restore_state(entities: DataFrame) -> DataFrame:
    """Entities (id, type, name) to candidate keys type:name, or type:id where a name repeats within its type."""
    same = F.count("*").over(W.partitionBy("type", "name"))
    tail = F.when((same > 1) | F.col("name").isNull(), F.col("id")).otherwise(F.col("name"))
    return entities.withColumn("key", F.concat_ws(":", "type", tail)).select("id", "type", "key")


def materialise_memories(memories: DataFrame, id_map: DataFrame) -> DataFrame:
    """Memory candidates (key, owner_key, event_keys) to component edges; a memory needs a known owner and at least one known event."""
    ids = lambda t, c: id_map.filter(F.col("type") == t).select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    rows = memories.join(ids("memory", "key"), "key").join(ids("character", "owner_key"), "owner_key")
    events = rows.withColumn("event_key", F.explode("event_keys")).join(ids("event", "event_key"), "event_key")
    anchored = events.select("key_id", "owner_key_id").distinct()
    owner = anchored.select(F.col("key_id").alias("src_id"), F.lit("memory_owner_reference").alias("component"), F.col("owner_key_id").alias("tgt_id"))
    source = events.select(F.col("key_id").alias("src_id"), F.lit("source_event_reference").alias("component"), F.col("event_key_id").alias("tgt_id"))
    return owner.unionByName(source.distinct())
