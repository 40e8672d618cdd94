"""Queries over plans: projections, restrictions, links and hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from storynet.operators import network, projection, resolve
from storynet.plans.network_queries import WITH, net
from storynet.plans.store_queries import messages
from storynet.sources import tables as t


def projected_components(spark, d):
    rows = t.load(spark, d, "select * from {part}").selectExpr(
        "cast(p_partkey as string) as entity_id", "'item' as type",
        "stack(2, 'profile', to_json(named_struct('item_kind', p_type, 'instance_mode', case when p_partkey % 4 = 0 then ' ' else 'single' end, 'primary_functions', p_brand, 'materials', p_type, 'form_description', p_name, 'other', 'x')), "
        "'characteristic', to_json(named_struct('craftsmanship', case when p_partkey % 3 = 0 then p_brand end, 'unknown', 'y'))) as (section, data)",
    )
    return projection.project_components(rows)


def flattened_json(spark, d):
    rows = t.load(spark, d, "select cast(event_id as string) as entity_id, event_type as component, props as data from {events}")
    return projection.flatten_json(rows).groupBy("component", "path", "type").agg(F.count("*").alias("n"))


def component_leaves(spark, d):
    refs, _ = net(spark, d)
    return projection.flatten_json(network.as_components(refs))


def split_workloads(spark, d):
    rows = t.load(spark, d, "select cast(o_custkey as string) as chat_id, o_orderpriority as segment, case o_orderkey % 4 when 0 then 'create' when 1 then 'update' else o_orderstatus end as action, cast(o_orderkey as string) as item_id from {orders}")
    return resolve.split_workloads(rows).withColumn("items", F.array_join("items", ","))


def _proposals(spark, d):
    rows = t.load(spark, d, "select '1' as chat_id, cast(p_partkey as string) as key, case when p_partkey % 2 = 0 then 'create' else 'update' end as action from {part}")
    return rows, rows.filter("cast(key as bigint) % 5 <> 0").select("chat_id", "key"), rows.filter("cast(key as bigint) % 3 = 0").select("chat_id", "key")


def restricted(spark, d):
    return resolve.restrict_to_directory(*_proposals(spark, d))[0]


def restricted_dropped(spark, d):
    return resolve.restrict_to_directory(*_proposals(spark, d))[1]


def filtered_placements(spark, d):
    refs, ents = net(spark, d)
    claims = refs.filter("component = 'current_placement_reference'").selectExpr("'1' as chat_id", "src_id as item", "case when right(src_id, 1) = '7' then 'worn' else role end as role", "case when right(src_id, 2) = '13' then src_id when right(src_id, 2) = '21' then 'nowhere' else tgt_id end as target")
    return resolve.filter_placements(claims, ents.selectExpr("'1' as chat_id", "id as key", "type"))[1]


def filtered_pairs(spark, d):
    rows = t.load(spark, d, f"select '1' as chat_id, {t.CHARACTER('o_custkey')} as a, {t.CHARACTER('o_custkey + o_orderkey % 9')} as b, o_orderkey from {{orders}}")
    return resolve.filter_pairs(rows, net(spark, d)[1].selectExpr("'1' as chat_id", "id as key", "type"))


def mentions(spark, d):
    rows = messages(spark, d)
    names = rows.selectExpr("chat_id", "concat('k', floor) as key", "array(left(content, 5), substring(content, 10, 4)) as names")
    return resolve.mention_scan(names, rows.selectExpr("chat_id", "floor as batch_ix", "content as text"))


def inferred_evidence(spark, d):
    rows = messages(spark, d)
    names = rows.selectExpr("chat_id", "concat('k', floor) as key", "array(substring(content, 3, 7)) as names")
    return resolve.infer_evidence(names, rows.selectExpr("chat_id", "concat('m', floor) as ref", "role", "role as speaker", "content"))


def _links(spark, d):
    """Quotes of messages, linked to the events (pairs of messages, overlapping) that hold them. A third each for entities, locations and relations; some have a wrong quote or message."""
    rows = messages(spark, d)
    slices = rows.selectExpr("chat_id", "explode(array_distinct(array(floor div 2, (floor + 1) div 2))) as e", "floor", "content")
    slices = slices.selectExpr("chat_id", "concat('e', e) as event_id", "concat('m', floor) as ref", "case when e % 2 = 0 then content else left(content, 30) end as text")
    quote = "case when floor % 5 = 4 then 'nowhere' when floor % 4 = 1 then left(content, 20) else substring(content, 35, 20) end as quote"
    evidence = rows.selectExpr("chat_id", "floor as evidence_id", "element_at(array('entity', 'location', 'relation'), cast(floor % 3 + 1 as int)) as kind",
                               "concat('k', floor) as a", "concat('k', 9 - floor) as b", "concat('m', case when floor % 7 = 6 then 99 else floor end) as ref", quote)
    evidence = evidence.withColumn("key", F.when(F.col("kind") == "relation", resolve.pair_key("a", "b")).otherwise(F.col("a"))).drop("a", "b")
    return resolve.link_to_events(evidence, slices, rows.selectExpr("chat_id", "concat('m', floor) as ref", "content"))


def linked_events(spark, d):
    return _links(spark, d)[0]


def unlinked(spark, d):
    return _links(spark, d)[1].select("chat_id", "evidence_id", "reason")


def event_members(spark, d):
    return resolve.event_members(_links(spark, d)[0]).withColumn("refs", F.array_join("refs", ","))


def player_identity(spark, d):
    lines = messages(spark, d).selectExpr("chat_id", "floor as line", "case when cast(chat_id as bigint) % 3 = 0 then concat('P', chat_id) end as persona", "case when cast(chat_id as bigint) % 3 = 1 then 'User' end as user_name", "role = 'user' as is_user", "concat('n', floor) as name")
    return resolve.player_identity(lines)


QUERIES = {
    "projected_components": projected_components,
    "flattened_json": flattened_json,
    "component_leaves": component_leaves,
    "split_workloads": split_workloads,
    "restricted_plan": restricted,
    "restricted_dropped": restricted_dropped,
    "filtered_placements": filtered_placements,
    "filtered_pairs": filtered_pairs,
    "mention_scan": mentions,
    "inferred_evidence": inferred_evidence,
    "linked_events": linked_events,
    "unlinked_evidence": unlinked,
    "event_members": event_members,
    "player_identity": player_identity,
}

_M = t.oracle(t.MESSAGES)
_Q = r"""'[\s"''“”‘’「」『』]'"""
SQL = {
    "split_workloads": """select cast(o_custkey as varchar) as chat_id, o_orderpriority as segment, case o_orderkey % 4 when 0 then 'create' when 1 then 'update' else 'unresolved' end as action,
      string_agg(cast(o_orderkey as varchar), ',' order by cast(o_orderkey as varchar)) as items from orders group by all""",
    "restricted_plan": "select '1' as chat_id, cast(p_partkey as varchar) as key, case when p_partkey % 2 = 0 then 'create' else 'update' end as action from part where p_partkey % 5 <> 0 and (p_partkey % 2 = 0) <> (p_partkey % 3 = 0)",
    "restricted_dropped": """select '1' as chat_id, cast(p_partkey as varchar) as key, case when p_partkey % 2 = 0 then 'create' else 'update' end as action,
      case when p_partkey % 5 = 0 then 'not_in_directory' when p_partkey % 2 = 0 then 'create_known' else 'update_unknown' end as reason from part where not (p_partkey % 5 <> 0 and (p_partkey % 2 = 0) <> (p_partkey % 3 = 0))""",
    "filtered_placements": t.oracle(f"""{WITH}, c as (select src_id as item, case when right(src_id, 1) = '7' then 'worn' else role end as role, case when right(src_id, 2) = '13' then src_id when right(src_id, 2) = '21' then 'nowhere' else tgt_id end as target
        from refs where component = 'current_placement_reference'), j as (select c.*, type from c left join entities e on e.id = target),
      r as (select *, case when type is null then 'unknown_target' when item = target then 'self' when not coalesce(case when role = 'placed' then type in ('item', 'location') when role in ('carried', 'equipped', 'worn') then type = 'character'
        when role in ('contained', 'stored') then type = 'item' end, false) then 'role_mismatch' end as reason from j) select '1' as chat_id, item, role, target, reason from r where reason is not null"""),
    "filtered_pairs": t.oracle(f"""{WITH} select '1' as chat_id, a, b, o_orderkey from (select {t.CHARACTER('o_custkey')} as a, {t.CHARACTER('o_custkey + o_orderkey % 9')} as b, o_orderkey from {{orders}}) o
      where a <> b and a in (select id from entities where type = 'character') and b in (select id from entities where type = 'character')"""),
    "mention_scan": f"""with m as (select chat_id, floor, content from ({_M})), n as (select distinct chat_id, 'k' || cast(floor as varchar) as key, x from (select *, unnest([left(content, 5), substring(content, 10, 4)]) as x from m) where trim(x) <> '')
      select n.chat_id, m.floor as batch_ix, key, count(*) as n_names from n join m on m.chat_id = n.chat_id and contains(content, trim(x)) group by all""",
    "inferred_evidence": f"""with m as (select chat_id, floor, role, content from ({_M})), n as (select chat_id, 'k' || cast(floor as varchar) as key, substring(content, 3, 7) as x from m where trim(substring(content, 3, 7)) <> '')
      select distinct n.chat_id, key, 'm' || cast(m.floor as varchar) as ref from n join m on m.chat_id = n.chat_id and (contains(content, x) or (role = 'user' and role = x))""",
    "player_identity": f"""select chat_id, case when cast(chat_id as bigint) % 3 = 0 then 'P' || chat_id else 'n' || cast(min(floor) filter (role = 'user') as varchar) end as player from ({_M}) where floor < 50 group by chat_id having player is not null""",
}

_LINK = f"""with m as (select chat_id, floor, content, regexp_replace(content, {_Q}, '', 'g') as body from ({_M})),
  v as (select chat_id, floor as evidence_id, ['entity', 'location', 'relation'][cast(floor % 3 + 1 as int)] as kind,
      case when floor % 3 = 2 then 'k' || cast(least(floor, 9 - floor) as varchar) || ' / k' || cast(greatest(floor, 9 - floor) as varchar) else 'k' || cast(floor as varchar) end as key, case when floor % 7 = 6 then 99 else floor end as f,
      regexp_replace(case when floor % 5 = 4 then 'nowhere' when floor % 4 = 1 then left(content, 20) else substring(content, 35, 20) end, {_Q}, '', 'g') as q from m),
  o as (select v.*, m.floor is not null as there, coalesce(q <> '' and contains(body, q), false) as found, (select count(distinct e) from (select unnest([f // 2, (f + 1) // 2]) as e)) as n,
      (f // 2) % 2 = 0 or contains(regexp_replace(left(content, 30), {_Q}, '', 'g'), q) as h0, ((f + 1) // 2) % 2 = 0 or contains(regexp_replace(left(content, 30), {_Q}, '', 'g'), q) as h1
    from v left join m on m.chat_id = v.chat_id and m.floor = f),
  r as (select *, case when not there then 'unknown_ref' when not found then 'quote_not_found' when n = 2 and h0 = h1 then 'not_unique' end as reason, 'e' || cast(case when n = 1 or h0 then f // 2 else (f + 1) // 2 end as varchar) as event_id from o)"""
SQL |= {
    "linked_events": f"{_LINK} select chat_id, evidence_id, kind, key, 'm' || cast(f as varchar) as ref, event_id from r where reason is null",
    "unlinked_evidence": f"{_LINK} select chat_id, evidence_id, reason from r where reason is not null",
    "event_members": f"""{_LINK}, w as (select *, unnest(case kind when 'relation' then ['related_pairs'] when 'location' then ['related_entities', 'locations'] else ['related_entities'] end) as list from r where reason is null)
      select chat_id, event_id, list, key, coalesce(string_agg(distinct 'm' || cast(f as varchar), ',' order by 'm' || cast(f as varchar)) filter (list = 'locations'), '') as refs from w group by all""",
    "projected_components": """select cast(p_partkey as varchar) as entity_id, 'item' as type, 'item_profile' as component, '0.1.0' as schema_version,
        '{"item_kind":"' || p_type || '","instance_mode":"single","primary_functions":"' || p_brand || '","materials":"' || p_type || '","form_description":"' || p_name || '"}' as data from part where p_partkey % 4 <> 0
      union all select cast(p_partkey as varchar), 'item', 'item_characteristic', '0.1.0', '{"craftsmanship":"' || p_brand || '"}' from part where p_partkey % 3 = 0""",
    "flattened_json": """select component, path, type, count(*) as n from (select event_type as component, '/' || unnest(json_keys(props)) as path, case json_type(props, '$.' || unnest(json_keys(props))) when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer'
      when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' else 'null' end as type from events) group by all""",
    "component_leaves": t.oracle(f"""{WITH}, r as (select src_id, component, tgt_id, tgt_type, row_number() over (partition by src_id, component order by ord, tgt_id, tgt_type) - 1 as k from refs),
      p as (select *, case component when 'current_location_reference' then '/location_ref' when 'current_placement_reference' then '/placement_ref' when 'parent_location_reference' then '/parent_location_ref'
        when 'parent_organization_reference' then '/parent_organization_ref' when 'memory_owner_reference' then '/owner_ref' when 'related_concept_reference' then '/concept_refs/' || cast(k as varchar)
        when 'memory_reference' then '/memory_refs/' || cast(k as varchar) || '/memory_ref' when 'skill_reference' then '/skill_refs/' || cast(k as varchar) || '/skill_ref' when 'event_location_reference' then '/location_refs/' || cast(k as varchar) || '/location_ref'
        when 'event_related_entity_reference' then '/related_entity_refs/' || cast(k as varchar) when 'source_event_reference' then '/event_refs/' || cast(k as varchar)
        when 'relation_context_reference' then '/relation_links/' || cast(k as varchar) || '/relation_ref' when 'relation_endpoint_reference' then '/participant_refs/' || cast(k as varchar) end as place from r)
      select src_id as entity_id, component, place || '/' || unnest(['id', 'type']) as path, 'string' as type, unnest([tgt_id, tgt_type]) as value from p
      where k = 0 or component not in ('current_location_reference', 'current_placement_reference', 'parent_location_reference', 'parent_organization_reference', 'memory_owner_reference')"""),
}
