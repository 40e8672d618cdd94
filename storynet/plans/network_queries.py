"""Queries over the entity network."""

from __future__ import annotations

from pyspark.sql import functions as F

from storynet.operators import network
from storynet.sources import tables as t

WITH = f"with entities as ({t.ENTITIES}), refs as ({t.REFS})"


def net(spark, sf_dir):
    return t.load_all(spark, sf_dir, t.REFS, t.ENTITIES)


def _index(name):
    def query(spark, sf_dir):
        rows = network.INDEXES[name](*net(spark, sf_dir))
        return rows.select("entity_id", "entity_type", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"))

    return query


def _index_sql(entry: str, where: str, types: tuple[str, ...]) -> str:
    kinds = ", ".join(f"'{x}'" for x in types)
    return t.oracle(
        f"""{WITH}, x as (select distinct tgt_id as entity_id, {entry} as e from refs where {where}),
        i as (select entity_id, string_agg(e, ',' order by e) as ids, count(*) as n from x group by entity_id)
        select i.entity_id, e.type as entity_type, ids, n from i join (select distinct id, type from entities) e on e.id = i.entity_id
        where e.type in ({kinds})"""
    )


def _from(component: str) -> str:
    return f"component = '{component}'"


def net_refs(spark, sf_dir):
    refs, _ = net(spark, sf_dir)
    return network.extract_refs(network.as_components(refs)).drop("path", "derived")


def net_formal_refs(spark, sf_dir):
    return network.formal_refs(net(spark, sf_dir)[0])


def minted_ids(spark, sf_dir):
    keys = net(spark, sf_dir)[1].selectExpr("'1' as chat_id", "type", "id as key")
    known = keys.filter("type = 'location'").withColumn("id", F.col("key"))
    return network.mint_ids(keys, known)


def restored_state(spark, sf_dir):
    return network.restore_state(net(spark, sf_dir)[1])


def overlay_fields(spark, sf_dir):
    part = t.load(spark, sf_dir, "select * from {part}")
    pick = lambda e: part.selectExpr(
        "p_partkey as entity_id", f"stack(3, '/identity/name', {e[0]}, '/state/size', {e[1]}, '/entity_management/origin', {e[2]}) as (path, value)"
    ).filter("value is not null")
    base = pick(("p_name", "cast(p_size as string)", "'a'"))
    current = pick(("case when p_partkey % 5 = 0 then 'edited' else p_name end", "cast(p_size as string)", "'a'"))
    new = pick(("case when p_partkey % 3 = 0 then upper(p_name) else p_name end", "case when p_partkey % 7 <> 0 then cast(p_size + p_partkey % 2 as string) end", "'b'"))
    return network.overlay(current, base, new)


QUERIES = {f"net_{name}": _index(name) for name in network.INDEXES} | {
    "net_refs": net_refs,
    "net_formal_refs": net_formal_refs,
    "minted_ids": minted_ids,
    "restored_state": restored_state,
    "overlay_fields": overlay_fields,
}

_HEX = "sha256('1' || chr(1) || type || chr(1) || id)"
_DIGITS = " || ".join(
    f"substring('{network.CROCKFORD}', cast(cast('0x' || substring(h, {2 * i + 1}, 2) as int) % {8 if i == 0 else 32} + 1 as int), 1)" for i in range(26)
)
SQL = {
    "minted_ids": t.oracle(f"""{WITH} select distinct '1' as chat_id, type, id as key, case when type = 'location' then id else type || '_' || {_DIGITS} end as id from (select type, id, {_HEX} as h from entities)"""),
    "net_memory_index": _index_sql("src_id", _from("memory_owner_reference"), ("character",)),
    "net_event_memory_index": _index_sql("src_id", _from("source_event_reference"), ("event",)),
    "net_relation_index": _index_sql("src_id", _from("relation_endpoint_reference"), ("character",)),
    "net_history_index": _index_sql("src_id", "component in ('event_related_entity_reference', 'event_location_reference')", network.HISTORY_TYPES),
    "net_contents_index": _index_sql("src_id", _from("current_placement_reference") + " and tgt_type = 'item'", ("item",)),
    "net_child_location_index": _index_sql("src_id", _from("parent_location_reference"), ("location",)),
    "net_child_organization_index": _index_sql("src_id", _from("parent_organization_reference"), ("organization",)),
    "net_inventory_index": _index_sql(
        "src_id || ':' || role", _from("current_placement_reference") + " and tgt_type = 'character' and role in ('carried', 'equipped', 'worn')", ("character",)
    ),
    "net_containment_index": _index_sql(
        "src_id || ':' || case when component = 'current_location_reference' then 'present' when role = 'stored' then 'stored' else 'placed' end",
        "component = 'current_location_reference' or component = 'current_placement_reference' and tgt_type = 'location'",
        ("location",),
    ),
    "net_relation_memory_index": t.oracle(
        f"""{WITH}, m as (select tgt_id, src_id, string_agg(distinct cast(num as varchar), '+' order by cast(num as varchar)) as a,
          string_agg(distinct role, '+' order by role) as r from refs where component = 'relation_context_reference' group by all),
        i as (select tgt_id as entity_id, string_agg(src_id || ':' || a || ':' || r, ',' order by src_id) as ids, count(*) as n from m group by tgt_id)
        select entity_id, e.type as entity_type, ids, n from i join (select distinct id, type from entities) e on e.id = i.entity_id
        where e.type = 'character_relation'"""
    ),
    "net_refs": t.oracle(
        f"""{WITH} select src_id, src_type, component,
          case when component in ('current_location_reference', 'parent_location_reference', 'parent_organization_reference', 'current_placement_reference',
            'memory_owner_reference') then 0
            else row_number() over (partition by src_id, component order by ord, tgt_id) - 1 end as ord, tgt_id, tgt_type from refs"""
    ),
    "net_formal_refs": t.oracle(f"{WITH} select src_id, component, tgt_id, min_by(tgt_type, (ord, tgt_type)) as tgt_type from refs group by all"),
    "restored_state": t.oracle(
        f"{WITH} select id, type, type || ':' || case when count(*) over (partition by type, name) > 1 then id else name end as key from entities"
    ),
    "overlay_fields": """
      with b as (select p_partkey as entity_id, unnest([{'p': '/identity/name', 'b': p_name, 'c': case when p_partkey % 5 = 0 then 'edited' else p_name end,
          'n': case when p_partkey % 3 = 0 then upper(p_name) else p_name end},
        {'p': '/state/size', 'b': cast(p_size as varchar), 'c': cast(p_size as varchar),
          'n': case when p_partkey % 7 <> 0 then cast(p_size + p_partkey % 2 as varchar) end},
        {'p': '/entity_management/origin', 'b': 'a', 'c': 'a', 'n': 'b'}]) as x from part)
      select entity_id, x.p as path, case when x.n is not null and x.n is distinct from x.b and x.p <> '/entity_management/origin' then x.n else x.c end as value
      from b where x.c is not null or x.n is not null""",
}
