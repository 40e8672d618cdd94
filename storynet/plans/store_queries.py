"""Queries over audits, rounds, receipts and the entity store."""

from __future__ import annotations

from pyspark.sql import functions as F

from storynet.functions.shared import saved
from storynet.operators import audit, network, rounds, store
from storynet.plans import network_queries
from storynet.plans.network_queries import WITH, net
from storynet.sources import chats
from storynet.sources import tables as t

_V = ["entity_id", "component", "path", "code"]


def _audit(rule):
    return lambda spark, d: rule(spark, d).select(*_V)


def _sql(code: str, rows: str, component: str = "component", path: str = "'/' || cast(ord as varchar)", entity: str = "src_id") -> str:
    return t.oracle(f"{WITH} select {entity} as entity_id, {component} as component, {path} as path, '{code}' as code from {rows}")


def _stored(entries):
    """Entries of the rebuilt indexes to digests of them and of what is stored: the first entry removed of entities whose key is a multiple of 73, nothing of those whose key is one of 71; others are stored in another order, which matters to the history."""
    key = F.substring("entity_id", -24, 24).cast("long")
    place = F.when(key % 73 == 0, F.expr("nullif(place - 1, 0)")).when(key % 67 == 0, F.expr("n + 1 - place")).otherwise(F.col("place"))
    rows = entries.groupBy("entity_id", "component").agg(audit.entries_digest().alias("rebuilt"), audit.entries_digest(place).alias("stored"))
    return rows.withColumn("has", key % 71 != 0)


def incomplete_memories(spark, d):
    refs, entities = net(spark, d)
    return audit.incomplete_memories(entities, refs.filter("not (component = 'source_event_reference' and right(src_id, 1) = '3')"))


def stale(spark, d):
    index = saved(network.rebuild_indexes(*net(spark, d), _stored))
    side = lambda rows, c: rows.select("entity_id", "component", F.col(c).alias("digest"))
    return audit.stale_digests(side(index.filter("has"), "stored"), side(index, "rebuilt"))


def field_audit(spark, d):
    part = t.load(spark, d, "select * from {part}")
    fields = part.selectExpr(
        "cast(p_partkey as string) as entity_id", "'item_profile' as component",
        "stack(4, '/data/size', 'integer', case when p_partkey % 11 = 0 then '99' else cast(p_size as string) end, "
        "'/data/brand', case when p_partkey % 13 = 0 then 'number' else 'string' end, p_brand, "
        "'/data/extra', 'string', case when p_partkey % 17 = 0 then 'x' end, "
        "'/data/type', 'string', case when p_partkey % 19 <> 0 then p_type end) as (path, type, value)",
    ).filter("value is not null")
    rules = spark.createDataFrame(
        [("item_profile", "/data/size", "integer", True, None, 1.0, 60.0, None), ("item_profile", "/data/brand", "string", True, "^Brand#[0-9]+$", None, None, None),
         ("item_profile", "/data/type", "string", True, None, None, None, None)],
        "component string, path string, type string, required boolean, pattern string, low double, high double, allowed array<string>",
    )
    return audit.field_rules(fields, rules, fields.select("entity_id", "component").distinct())


def _cycle_sql(component: str, code: str, where: str, keep: str) -> str:
    return t.oracle(f"""with recursive refs as ({t.REFS}), p as (select src_id as node, tgt_id as parent from refs where component = '{component}'{where}),
      w as (select node, parent as up, 1 as n from p union all select w.node, p.parent, n + 1 from w join p on p.node = w.up where n < 700),
      c as (select node, min(up) as cycle, bool_or(up = node) as on_cycle from w where n > 0 group by node having max(n) = 700),
      l as (select w.node, min(w.up) as cycle from w where n > 350 group by w.node)
      select c.node as entity_id, '{component}' as component, '/' as path, '{code}' as code from c join l on l.node = c.node where {keep}""")


def messages(spark, d):
    return t.load(spark, d, t.MESSAGES)


def msg_rounds(spark, d):
    return rounds.assign_rounds(messages(spark, d)).select("chat_id", "floor", F.col("round_ix").cast("long").alias("round_ix"))


def msg_batches(spark, d):
    sizes = rounds.assign_rounds(messages(spark, d)).groupBy("chat_id", "round_ix").agg(F.sum(F.length("content")).cast("long").alias("size"))
    return rounds.budget_batches(sizes, 2, 2000)


def msg_versions(spark, d):
    return chats.stamp_versions(messages(spark, d)).select("chat_id", "floor", "version", "ref")


def _second_copy(spark, d):
    rows = messages(spark, d).withColumn("sha", F.sha2("content", 256)).withColumn("ref", F.concat(F.lit("m"), F.col("floor").cast("string")))
    again = rows.withColumn("sha", F.when((F.col("floor") + F.col("chat_id").cast("long")) % 23 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("sha")))
    return rows.filter("floor < 4").select("chat_id", "ref", "sha"), again.select("chat_id", "ref", "sha")


def msg_source_conflicts(spark, d):
    return chats.append_sources(*_second_copy(spark, d))[1]


def msg_sources_appended(spark, d):
    return chats.append_sources(*_second_copy(spark, d))[0]


def chat_events(spark, d):
    return rounds.event_status(t.load(spark, d, t.CHAT_EVENTS))


def place_clues(spark, d):
    rows = t.load(spark, d, t.CHAT_EVENTS).selectExpr("chat_id", "event_no as ix", "array(event_type) as places")
    return rounds.place_changes(rows)


def _boundaries(spark, d):
    return t.load(spark, d, t.CHAT_EVENTS).selectExpr("chat_id", "event_id as id", "cast(floor(event_no / 3) as bigint) as floor", "event_no % 3 as offset", "event_type in ('signup', 'error') as confirmed", "cast(floor(event_no / 4) as bigint) as batch_ix")


def open_boundaries(spark, d):
    return rounds.resolve_open_boundaries(_boundaries(spark, d))


def boundary_workspace(spark, d):
    return rounds.boundary_workspace(_boundaries(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def receipts(spark, d):
    return t.load(spark, d, t.RECEIPTS)


def covered(spark, d):
    return rounds.covered_through(receipts(spark, d))


def dashboard(spark, d):
    settings = messages(spark, d).select("chat_id").distinct().withColumn("interval", F.col("chat_id").cast("long") % 3).withColumn("tail", F.col("chat_id").cast("long") % 2)
    return rounds.extraction_dashboard(messages(spark, d), receipts(spark, d), settings)


def unprocessed(spark, d):
    return store.unprocessed_messages(messages(spark, d), receipts(spark, d)).select("chat_id", "floor")


def stale_sources(spark, d):
    own = messages(spark, d).withColumn("version", F.sha2("content", 256))
    old = own.withColumn("version", F.when((F.col("floor") + F.col("chat_id").cast("long")) % 23 == 0, F.lit("old")).otherwise(F.col("version")))
    return store.stale_sources(old.select("chat_id", "floor", "source_id", "version"), own.filter("floor % 19 <> 18"))


def units(spark, d):
    return rounds.source_units(t.load(spark, d, "select cast(doc_id as string) as ref, coalesce(text, '') as content from {documents}"))


def blocks(spark, d):
    return rounds.round_blocks(rounds.assign_rounds(messages(spark, d))).withColumn("round_ix", F.col("round_ix").cast("long"))


def narrative(spark, d):
    """Every message has a scene header, some in the middle."""
    head = F.expr("case floor % 3 when 1 then concat('[scene] noon\n\n', content) when 2 then concat(substring(content, 1, 5), '\n[时间：夜]x') else concat('[场景时间 a]', substring(content, 1, 5), '\n[scene] b\nx') end")
    rows = rounds.narrative_text(messages(spark, d).withColumn("content", head))
    return rows.select("chat_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"))


def occurrences(spark, d):
    refs = net(spark, d)[0].filter("component = 'event_location_reference'")
    rows = rounds.location_occurrences(refs.selectExpr("src_id as event_id", "ord", "tgt_id as location"))
    return rows.withColumn("sequence", F.col("sequence").cast("long"))


def tail_view(spark, d):
    return rounds.event_tail_view(chat_events(spark, d).withColumn("description", F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))))


def continuity(spark, d):
    rows = chat_events(spark, d).select("chat_id", "status", F.repeat(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")), (F.col("event_id") % 200).cast("int")).alias("text"))
    return rounds.continuity_window(rows.filter("status <> 'finalized'"))


def list_items(spark, d):
    ents = net(spark, d)[1].withColumn("updated", F.col("id"))
    return store.list_entities(ents, audit.ENTITY_TYPES, "item", "B", sort="name", ascending=True, limit=50).select("id", "name", "description")


def type_counts(spark, d):
    return rounds.type_counts(net(spark, d)[1], [*audit.ENTITY_TYPES, "faction"])


def neighbours_page(spark, d):
    refs, ents = net(spark, d)
    return store.neighbours(network.formal_refs(refs), ents, "location_0N" + "0" * 23 + "7", 5, 40)


def neighbour_counts(spark, d):
    return store.neighbour_counts(network.formal_refs(net(spark, d)[0]))


def delete_guard(spark, d):
    refs, ents = net(spark, d)
    ids = ents.filter("type = 'character' and cast(right(id, 24) as bigint) % 10 = 0").select("id")
    return store.delete_guard(ids, network.formal_refs(refs), ents.filter("type = 'character' and cast(right(id, 24) as bigint) % 20 = 0").select("id"))


def _relations(spark, d):
    return t.load(spark, d, f"select {t.CHARACTER('o_custkey')} as source, {t.CHARACTER('o_custkey + o_orderkey % 7')} as target, o_orderpriority as relation_type, o_orderkey as created from {{orders}}")


def manual_relations(spark, d):
    return store.manual_relations(_relations(spark, d), net(spark, d)[1].filter("type = 'character'"))


def redirect_relations(spark, d):
    mapping = net(spark, d)[1].filter("type = 'character' and cast(right(id, 24) as bigint) % 5 <> 0")
    to = mapping.select("id", F.concat(F.lit("character_0C"), F.lpad((F.substring("id", -24, 24).cast("long") - F.substring("id", -24, 24).cast("long") % 5).cast("string"), 24, "0")).alias("survivor"))
    return store.redirect_relations(_relations(spark, d), to)


def merge_entities(spark, d):
    rows = t.load(spark, d, "select * from {customer}").selectExpr(
        "c_custkey div 4 as group_id", "cast(c_custkey as string) as id", "case when c_custkey % 41 = 0 then 'item' else 'character' end as type",
        "c_name as name", "array(c_mktsegment) as aliases", "c_mktsegment as description", "c_custkey % 4 * 7 % 5 as created",
    )
    return store.merge_entities(rows).withColumn("aliases", F.array_join("aliases", "|"))


def upserted(spark, d):
    part = t.load(spark, d, "select * from {part}")
    current = part.filter("p_partkey % 3 <> 0").selectExpr("p_partkey as id", "p_type as type", "p_name as body", "cast(2 as bigint) as revision")
    new = part.filter("p_partkey % 2 = 0").selectExpr(
        "p_partkey as id", "case when p_partkey % 10 = 0 then 'other' else p_type end as type", "case when p_partkey % 4 = 0 then upper(p_name) else p_name end as body",
        "cast(case when p_partkey % 14 = 0 then 1 when p_partkey % 3 <> 0 then 2 end as bigint) as expected",
    )
    return current, new, part.filter("p_partkey % 22 = 0").selectExpr("p_partkey as src_id")


def upsert_entities(spark, d):
    return store.upsert_entities(*upserted(spark, d))[0]


def upsert_rejected(spark, d):
    return store.upsert_entities(*upserted(spark, d))[1]


def commit_guard(spark, d):
    ents = t.load(spark, d, "select cast(o_custkey as string) as chat_id, cast(o_orderkey as string) as id, o_orderkey % 5 as revision from {orders}")
    now = store.fingerprint(ents)
    batches = now.select("chat_id", F.concat(F.lit("b"), "chat_id").alias("batch_key"), F.when(F.col("chat_id").cast("long") % 6 == 0, F.lit("old")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return store.commit_guard(batches, batches.filter("cast(chat_id as bigint) % 4 = 0"), now)


def entity_names(spark, d):
    rows = t.load(spark, d, "select * from {part}").selectExpr(
        "cast(p_partkey as string) as id", "case when p_partkey % 2 = 0 then ' ' else p_name end as primary_name", "case when p_partkey % 3 = 0 then p_type end as title",
        "cast(null as string) as name", "case when p_partkey % 5 = 0 then repeat(p_brand, 50) end as story_summary", "'' as description",
    )
    return store.entity_name(rows).select("id", "display_name")


def state_report(spark, d):
    own = messages(spark, d).withColumn("version", F.sha2("content", 256))
    return chats.state_report(chat_events(spark, d), own.filter("role = 'system'"), own)


_RECEIPTS = t.oracle(t.RECEIPTS)
_MESSAGES = t.oracle(t.MESSAGES)
_EVENTS = t.oracle(t.CHAT_EVENTS)
_STATUS = f"select *, case row_number() over (partition by chat_id order by event_no desc) when 1 then 'forming' when 2 then 'pending_finalization' else 'finalized' end as status from ({_EVENTS})"
_ROUNDS = f"""select chat_id, floor, role, content, least(coalesce(sum(c) over (partition by chat_id order by floor rows between unbounded preceding and 1 preceding), 0), t - 1) as round_ix
  from (select *, sum(c) over (partition by chat_id) as t from (select *, case when role = 'assistant' and trim(content) <> '' then 1 else 0 end as c from ({_MESSAGES}))) where t > 0"""
_COVER = f"""select chat_id, coalesce(max(end_floor) filter (b = 0), -1) as through from (select *, max(g) over (partition by chat_id order by start_floor, end_floor) as b from (
  select *, case when start_floor > coalesce(max(end_floor) over (partition by chat_id order by start_floor, end_floor rows between unbounded preceding and 1 preceding), -1) + 1 then 1 else 0 end as g
  from ({_RECEIPTS}))) group by chat_id"""
_FORMAL = "(select src_id, component, tgt_id, min_by(tgt_type, (ord, tgt_type)) as tgt_type from refs group by all)"
_BOUND = f"select chat_id, event_id as id, event_no // 3 as floor, event_no % 3 as offs, event_type in ('signup', 'error') as confirmed, event_no // 4 as batch_ix from ({_EVENTS})"

_RULES = {
    "audit_missing_target": (lambda s, d: audit.missing_targets(*net(s, d)), _sql("MISSING_REFERENCE_TARGET", "refs where tgt_id not in (select id from entities)")),
    "audit_type_mismatch": (
        lambda s, d: audit.mistyped_targets(*net(s, d)),
        _sql("REFERENCE_TARGET_TYPE_MISMATCH", "refs join (select id, min(type) as type from entities group by id) e on e.id = tgt_id where e.type <> tgt_type"),
    ),
    "audit_reference_id": (lambda s, d: audit.reference_ids(net(s, d)[0]), _sql("INVALID_REFERENCE_ID", "refs where left(tgt_id, length(tgt_id) - 27) <> tgt_type")),
    "audit_duplicate_related": (
        lambda s, d: audit.duplicate_related(net(s, d)[0]),
        _sql("DUPLICATE_EVENT_RELATED_ENTITY", "(select *, row_number() over (partition by src_id, tgt_id order by ord) as n from refs where component = 'event_related_entity_reference') where n > 1"),
    ),
    "audit_location_sequence": (
        lambda s, d: audit.duplicate_sequences(net(s, d)[0]),
        _sql("DUPLICATE_EVENT_LOCATION_SEQUENCE", "(select *, row_number() over (partition by src_id, num order by ord) as n from refs where component = 'event_location_reference') where n > 1"),
    ),
    "audit_memory_owner": (
        lambda s, d: audit.memory_owners(net(s, d)[0]),
        _sql("MEMORY_REFERENCE_OWNER_MISMATCH", "refs join (select src_id as m, tgt_id as o from refs where component = 'memory_owner_reference') on m = tgt_id where component = 'memory_reference' and o <> src_id"),
    ),
    "audit_memory_incomplete": (
        incomplete_memories,
        _sql("MISSING_MEMORY_NETWORK_COMPONENT", "entities where type = 'memory' and right(id, 1) = '3'", "'source_event_reference'", "'/'", "id"),
    ),
    "audit_non_container": (
        lambda s, d: audit.non_containers(net(s, d)[0], t.load(s, d, t.CONTAINERS)),
        _sql("ITEM_PLACED_IN_NON_CONTAINER", f"refs where component = 'current_placement_reference' and tgt_type = 'item' and tgt_id not in ({t.CONTAINERS})", path="'/data/placement_ref'"),
    ),
    "audit_placement_role": (
        lambda s, d: audit.placements(net(s, d)[0].withColumn("role", F.expr("case when right(src_id, 2) = '07' then 'worn' else role end"))),
        _sql("ITEM_PLACEMENT_ROLE_MISMATCH", "refs where component = 'current_placement_reference' and right(src_id, 2) = '07' and tgt_type <> 'character'", path="'/data/placement_role'"),
    ),
    "audit_shell": (
        lambda s, d: audit.shell(net(s, d)[1].withColumn("type", F.expr("case when right(id, 2) = '11' then 'ghost' else type end"))),
        t.oracle(f"{WITH} select id as entity_id, 'entity' as component, '/' as path, unnest(['INVALID_ENTITY_TYPE', 'INVALID_ENTITY_ID']) as code from entities where right(id, 2) = '11'"),
    ),
    "audit_duplicate_entity": (
        lambda s, d: audit.duplicate_entities(net(s, d)[1].selectExpr("id", "stack(2, 0, case when right(id, 2) = '05' then 1 end) as (pos)").filter("pos is not null")),
        _sql("DUPLICATE_ENTITY_ID", "entities where right(id, 2) = '05'", "'entity'", "'/1'", "id"),
    ),
    "audit_stale_index": (
        stale,
        "select entity_id, component, '/' as path, case when k % 71 = 0 then 'MISSING_DERIVED_INDEX' else 'STALE_DERIVED_INDEX' end as code from (select *, cast(right(entity_id, 24) as bigint) as k from ("
        + " union all ".join(f"select entity_id, '{name}' as component, n from ({network_queries.SQL['net_' + name]})" for name in network.INDEXES)
        + ")) where k % 71 = 0 or k % 73 = 0 or (k % 67 = 0 and component = 'history_index' and n > 1)",
    ),
    "audit_org_cycle": (
        lambda s, d: audit.parent_cycles(net(s, d)[0], "parent_organization_reference", "ORGANIZATION_PARENT_CYCLE"),
        _cycle_sql("parent_organization_reference", "ORGANIZATION_PARENT_CYCLE", "", "not on_cycle or c.node = l.cycle"),
    ),
    "audit_item_cycle": (
        lambda s, d: audit.placement_cycles(net(s, d)[0]),
        _cycle_sql("current_placement_reference", "ITEM_PLACEMENT_CYCLE", " and tgt_type = 'item'", "true"),
    ),
    "audit_fields": (
        field_audit,
        """select cast(p_partkey as varchar) as entity_id, 'item_profile' as component, x.p as path, x.c as code from (select p_partkey, unnest([
          {'p': '/data/size', 'c': case when p_partkey % 11 = 0 or p_size > 60 then 'INVALID_VALUE' end}, {'p': '/data/brand', 'c': case when p_partkey % 13 = 0 then 'INVALID_TYPE' end},
          {'p': '/data/extra', 'c': case when p_partkey % 17 = 0 then 'UNKNOWN_FIELD' end}, {'p': '/data/type', 'c': case when p_partkey % 19 = 0 then 'MISSING_REQUIRED_FIELD' end}]) as x from part) where x.c is not null""",
    ),
}

QUERIES = {name: _audit(rule) for name, (rule, _) in _RULES.items()} | {
    "msg_rounds": msg_rounds,
    "msg_pairs": lambda s, d: rounds.pair_rounds(messages(s, d)),
    "msg_batches": msg_batches,
    "msg_versions": msg_versions,
    "msg_source_conflicts": msg_source_conflicts,
    "msg_sources_appended": msg_sources_appended,
    "event_status": lambda s, d: chat_events(s, d).select("chat_id", "event_id", "status"),
    "event_clues": place_clues,
    "open_boundaries": open_boundaries,
    "boundary_workspace": boundary_workspace,
    "covered_through": covered,
    "dashboard": dashboard,
    "unprocessed": unprocessed,
    "stale_sources": stale_sources,
    "source_units": units,
    "round_blocks": blocks,
    "narrative_text": narrative,
    "location_occurrences": occurrences,
    "event_tail_view": tail_view,
    "continuity_window": continuity,
    "list_entities": list_items,
    "type_counts": type_counts,
    "neighbours_page": neighbours_page,
    "neighbour_counts": neighbour_counts,
    "delete_guard": delete_guard,
    "manual_relations": manual_relations,
    "redirect_relations": redirect_relations,
    "merge_entities": merge_entities,
    "upsert_entities": upsert_entities,
    "upsert_rejected": upsert_rejected,
    "commit_guard": commit_guard,
    "entity_names": entity_names,
    "state_report": state_report,
}

_REL = t.oracle(f"select {t.CHARACTER('o_custkey')} as source, {t.CHARACTER('o_custkey + o_orderkey % 7')} as target, o_orderpriority as relation_type, o_orderkey as created from {{orders}}")
_UP = """with c as (select p_partkey as id, p_type as type, p_name as body, 2 as revision from part where p_partkey % 3 <> 0),
  n as (select p_partkey as id, case when p_partkey % 10 = 0 then 'other' else p_type end as type, case when p_partkey % 4 = 0 then upper(p_name) else p_name end as body,
    case when p_partkey % 14 = 0 then 1 when p_partkey % 3 <> 0 then 2 end as expected, p_partkey % 22 = 0 as bad from part where p_partkey % 2 = 0),
  j as (select coalesce(c.id, n.id) as id, c.type, c.body, c.revision, n.id is not null as given, n.type as nt, n.body as nb,
    case when n.id is null then null when c.type <> n.type then 'type_change' when expected is not null and expected is distinct from coalesce(revision, 0) then 'revision_conflict' when bad then 'missing_reference' end as reason
    from c full join n on c.id = n.id) """

SQL = {name: sql for name, (_, sql) in _RULES.items()} | {
    "msg_rounds": f"select chat_id, floor, cast(round_ix as bigint) as round_ix from ({_ROUNDS})",
    "msg_pairs": f"""select chat_id, max(floor) filter (role = 'user') as user_floor, max(floor) filter (role <> 'user') as assistant_floor from (
      select *, coalesce(sum(case when role <> 'user' then 1 else 0 end) over (partition by chat_id order by floor rows between unbounded preceding and 1 preceding), 0) as g from ({_MESSAGES}))
      group by chat_id, g having user_floor is not null and assistant_floor is not null""",
    "msg_batches": f"""with recursive r as (select chat_id, cast(round_ix as bigint) as round_ix, cast(sum(length(content)) as bigint) as size from ({_ROUNDS}) group by all),
      b as (select chat_id, round_ix, size, cast(0 as bigint) as batch_ix, 1 as n, size as chars from r where round_ix = 0
        union all select r.chat_id, r.round_ix, r.size, case when n >= 2 or chars + r.size > 2000 then batch_ix + 1 else batch_ix end,
          case when n >= 2 or chars + r.size > 2000 then 1 else n + 1 end, case when n >= 2 or chars + r.size > 2000 then r.size else chars + r.size end
        from b join r on r.chat_id = b.chat_id and r.round_ix = b.round_ix + 1)
      select chat_id, round_ix, size, batch_ix, size > 2000 as oversize from b""",
    "msg_source_conflicts": f"""select chat_id, 'm' || cast(floor as varchar) as ref, sha256(content) as kept_sha, sha256(content || '!') as new_sha from ({_MESSAGES})
      where floor < 4 and (floor + cast(chat_id as bigint)) % 23 = 0""",
    "msg_sources_appended": f"""select chat_id, 'm' || cast(floor as varchar) as ref, case when floor >= 4 and (floor + cast(chat_id as bigint)) % 23 = 0 then sha256(content || '!') else sha256(content) end as sha from ({_MESSAGES})""",
    "event_status": f"select chat_id, event_id, status from ({_STATUS})",
    "event_clues": f"select * from (select chat_id, event_no as ix, lag(event_type) over (partition by chat_id order by event_no) as was, event_type as now from ({_EVENTS})) where was <> now",
    "open_boundaries": f"""with b as ({_BOUND}) select x.chat_id, x.id, x.floor, x.offs as offset, (select min_by(y.id, (y.floor, y.offs)) from b y where y.chat_id = x.chat_id and y.confirmed and (y.floor, y.offs) > (x.floor, x.offs)) as closed_by
      from b x where not confirmed""",
    "boundary_workspace": f"""with b as ({_BOUND}), o as (select *, max(batch_ix) filter (confirmed) over (partition by chat_id) as last from b)
      select chat_id, id, batch_ix, rank from (select *, row_number() over (partition by chat_id order by batch_ix desc, id desc) as rank from o where not confirmed and (last is null or batch_ix > last)) where rank <= 16""",
    "covered_through": _COVER,
    "dashboard": f"""select m.chat_id, messages, greatest(0, messages - coalesce(nullif(cast(m.chat_id as bigint) % 2, 0), 4) - (coalesce(through, -1) + 1)) as unextracted,
      coalesce(through, -1) + coalesce(nullif(cast(m.chat_id as bigint) % 3, 0), 10) + coalesce(nullif(cast(m.chat_id as bigint) % 2, 0), 4) as next_trigger
      from (select chat_id, count(*) as messages from ({_MESSAGES}) group by chat_id) m left join ({_COVER}) c on c.chat_id = m.chat_id""",
    "unprocessed": f"select chat_id, floor from ({_MESSAGES}) m where not exists (select 1 from ({_RECEIPTS}) r where r.chat_id = m.chat_id and m.floor between start_floor and end_floor)",
    "stale_sources": f"select chat_id, floor, source_id, floor % 19 = 18 as gone from ({_MESSAGES}) where floor % 19 = 18 or (floor + cast(chat_id as bigint)) % 23 = 0",
    "round_blocks": f"""select chat_id, cast(round_ix as bigint) as round_ix, min(floor) as first_floor, max(floor) as last_floor, count(*) as n_messages,
      left(trim(regexp_replace(min_by(content, floor) filter (k), '\\s+', ' ', 'g')), 48) as opening, right(trim(regexp_replace(max_by(content, floor) filter (k), '\\s+', ' ', 'g')), 72) as closing,
      string_agg(content, chr(10) order by floor) filter (k) as text from (select *, role = 'assistant' and trim(content) <> '' as k from ({_ROUNDS})) group by all""",
    "narrative_text": rf"""select chat_id, length(x) as n, sha256(x) as sha from (select chat_id, string_agg(b, chr(10) || chr(10) order by floor) as x from (
      select chat_id, floor, regexp_replace(case floor % 3 when 1 then content when 2 then substring(content, 1, 5) || chr(10) || 'x' else substring(content, 1, 5) || chr(10) || chr(10) || 'x' end, '^\s+|\s+$', '', 'g') as b from ({_MESSAGES}) where role = 'assistant') where b <> '' group by chat_id)""",
    "location_occurrences": t.oracle(f"""{WITH}, f as (select src_id as event_id, tgt_id as location, min(ord) as ord from refs where component = 'event_location_reference' group by all),
      s as (select *, row_number() over (partition by event_id order by ord, location) as sequence, count(*) over (partition by event_id) as n from f)
      select event_id, location, sequence, case when n = 1 then 'primary' when sequence = 1 then 'start' when sequence = n then 'end' else 'transit' end as role from s"""),
    "event_tail_view": f"""select chat_id, max_by(d, event_no) filter (status = 'finalized') as last_final, max_by(d, event_no) filter (status = 'pending_finalization') as pending,
      max_by(d, event_no) filter (status = 'forming') as forming from (select *, event_type || ' ' || cast(event_id as varchar) as d from ({_STATUS})) group by chat_id""",
    "continuity_window": f"""select chat_id, case when length(f) <= 1400 then f else left(f, 700) || chr(10) || '…' || chr(10) || right(f, 700) end as forming, right(p, 700) as pending from (
      select chat_id, max(x) filter (status = 'forming') as f, max(x) filter (status = 'pending_finalization') as p from (
        select *, repeat(event_type || ' ' || cast(event_id as varchar), event_id % 200) as x from ({_STATUS})) group by chat_id)""",
    "list_entities": t.oracle(f"{WITH} select id, name, description from entities where type = 'item' and (contains(lower(name), 'b') or contains(lower(description), 'b')) order by name, id limit 50"),
    "type_counts": t.oracle(f"{WITH} select t.type, count(e.id) as n from (select unnest([{', '.join(repr(x) for x in (*audit.ENTITY_TYPES, 'faction'))}]) as type) t left join entities e on e.type = t.type group by t.type"),
    "neighbours_page": t.oracle(f"""{WITH}, n as (select id, min(name) as name from entities group by id), x as (select 'location_0N{"0" * 23}7' as id),
      r as (select f.src_id, component, tgt_id, tgt_type, f.src_id = x.id as outgoing, a.name as src_name, b.name as tgt_name from {_FORMAL} f join x on f.src_id = x.id or f.tgt_id = x.id
        join n a on a.id = f.src_id left join n b on b.id = f.tgt_id)
      select *, case when outgoing then coalesce(tgt_name, '') <> '' else true end as resolved, count(*) over () as total from r order by src_id, component, tgt_id limit 40 offset 5"""),
    "neighbour_counts": t.oracle(f"{WITH} select entity_id, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from (select src_id as entity_id, 1 as o, 0 as i from {_FORMAL} union all select tgt_id, 0, 1 from {_FORMAL} where src_id <> tgt_id) group by entity_id"),
    "delete_guard": t.oracle(f"""{WITH}, d as (select id from entities where type = 'character' and cast(right(id, 24) as bigint) % 10 = 0), b as (select tgt_id as id, count(*) as n from {_FORMAL} where src_id not in (select id from d) group by tgt_id)
      select d.id, coalesce(n, 0) as n_blockers, cast(right(d.id, 24) as bigint) % 20 = 0 as in_map, coalesce(n, 0) = 0 and cast(right(d.id, 24) as bigint) % 20 <> 0 as allowed from d left join b on b.id = d.id"""),
    "manual_relations": t.oracle(f"{WITH} select r.*, a.name as source_name, b.name as target_name from ({_REL}) r join entities a on a.id = source and a.type = 'character' join entities b on b.id = target and b.type = 'character'"),
    "redirect_relations": t.oracle(f"""{WITH}, m as (select id, 'character_0C' || lpad(cast(cast(right(id, 24) as bigint) - cast(right(id, 24) as bigint) % 5 as varchar), 24, '0') as s from entities where type = 'character')
      select distinct coalesce(a.s, source) as source, coalesce(b.s, target) as target, relation_type from ({_REL}) r left join m a on a.id = source left join m b on b.id = target where coalesce(a.s, source) <> coalesce(b.s, target)"""),
    "commit_guard": "select distinct cast(o_custkey as varchar) as chat_id, 'b' || cast(o_custkey as varchar) as batch_key, case when o_custkey % 4 = 0 then 'reused' when o_custkey % 6 = 0 then 'rejected' else 'commit' end as decision from orders",
    "entity_names": "select cast(p_partkey as varchar) as id, left(coalesce(nullif(trim(case when p_partkey % 2 = 0 then ' ' else p_name end), ''), case when p_partkey % 3 = 0 then p_type end, case when p_partkey % 5 = 0 then repeat(p_brand, 50) end, cast(p_partkey as varchar)), 240) as display_name from part",
    "upsert_entities": _UP + """select id, coalesce(type, nt) as type, case when given and reason is null then nb else body end as body,
      coalesce(revision, 0) + case when given and reason is null and body is distinct from nb then 1 else 0 end as revision,
      case when not (given and reason is null) then 'kept' when revision is null then 'created' when body is distinct from nb then 'updated' else 'unchanged' end as action
      from j where (given and reason is null) or revision is not null""",
    "upsert_rejected": _UP + "select id, reason from j where reason is not null",
    "merge_entities": """with m as (select c_custkey // 4 as group_id, c_custkey, cast(c_custkey as varchar) as id, case when c_custkey % 41 = 0 then 'item' else 'character' end as type, c_name, c_mktsegment, c_custkey % 4 * 7 % 5 as created from customer),
      a as (select group_id, list(struct_pack(k := (created, id), n := c_name, s := c_mktsegment, id := id) order by created, id) as l, min(type) as type from m group by group_id having count(*) >= 2 and count(distinct type) = 1),
      e as (select group_id, l[1].id as id, type, l[1].n as name, generate_subscripts(l, 1) as i, unnest(l) as x, l[1].n as first from a),
      f as (select group_id, x.s as s, min(i) as i from e group by all), v as (select group_id, unnest([{'v': x.n, 'i': i * 2}, {'v': x.s, 'i': i * 2 + 1}]) as y, first from e),
      w as (select group_id, y.v as v, min(y.i) as i from v where y.v <> first group by all)
      select a.group_id, l[1].id as id, type, l[1].n as name, (select string_agg(s, chr(10) || chr(10) order by i) from f where f.group_id = a.group_id) as description,
        (select string_agg(v, '|' order by i) from w where w.group_id = a.group_id) as aliases from a""",
    "state_report": f"""with m as (select chat_id, count(*) as n_messages, cast(sum(length(content)) as bigint) as n_chars, count(distinct sha256(content)) as n_versions, count(*) filter (role = 'system') as n_memories from ({_MESSAGES}) group by chat_id),
      e as (select chat_id, count(*) filter (status = 'forming') as f, count(*) filter (status = 'pending_finalization') as p, count(*) filter (status = 'finalized') as z from ({_STATUS}) group by chat_id)
      select m.chat_id, n_messages, n_chars, n_versions, coalesce(f, 0) as n_forming, coalesce(p, 0) as n_pending_finalization, coalesce(z, 0) as n_finalized, n_memories from m left join e on e.chat_id = m.chat_id""",
}

_VERSION = """sha256(cast(to_json([content, case when role = 'user' then 'user' else 'assistant' end, cast(role = 'user' as varchar), cast(role = 'system' as varchar), 'null', source_id]) as varchar))"""
SQL |= {
    "msg_versions": f"select chat_id, floor, version, 'm' || cast(floor as varchar) || '.' || left(version, 12) || '.' || role as ref from (select *, {_VERSION} as version from ({_MESSAGES}))",
    "source_units": r"""with p as (select cast(doc_id as varchar) as ref, list_filter(regexp_extract_all(coalesce(text, ''), '(?s)(.*?(?:[。！？!?][”’」』"'']*|\n+|$))', 1), lambda x: x <> '') as l from documents),
      e as (select ref, generate_subscripts(l, 1) as k, unnest(l) as piece from p), a as (select *, coalesce(sum(length(piece)) over (partition by ref order by k rows between unbounded preceding and 1 preceding), 0) as place from e),
      b as (select *, row_number() over (partition by ref order by k) as n, length(regexp_extract(piece, '^(\s*)', 1)) as gap, regexp_replace(piece, '^\s+|\s+$', '', 'g') as t from a where trim(translate(piece, chr(10) || chr(9) || chr(13), '   ')) <> '')
      select ref, ref || '.u' || lpad(cast(n as varchar), greatest(3, 3), '0') as unit, t as text, cast(place + gap as bigint) as start, cast(place + gap + length(t) as bigint) as "end" from b""",
}
