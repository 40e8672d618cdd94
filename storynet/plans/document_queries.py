"""Queries over whole documents: the typed projection, overlays of nested documents, and protected keys taken out."""

from __future__ import annotations

from pyspark.sql import functions as F

from storynet.operators import components, nesting, shapes
from storynet.sources import tables as t

#: chat_id, key, json of candidates; the same SQL gives the oracle its rows.
CANDIDATES = """
select 'c' as chat_id, 'character:' || cast(c_custkey as string) as key, '{{{{"primary_name":" ' || c_name || ' ","aliases":["' || c_mktsegment || '"," ","' || c_mktsegment || '"],"character_data":{{{{"profile":{{{{"species":"human","background":"' ||
    case when c_custkey % 5 = 0 then ' ' else c_mktsegment end || '","age_description":' || cast(c_nationkey as string) || '}}}},"personality":{{{{"summary":"s","traits":["a",' || cast(c_custkey % 3 as string) || ',"a"]}}}},"preferences":[{{{{"attitude":"' ||
    case when c_custkey % 3 = 0 then 'hates' else 'like' end || '","subject":"tea"}}}},"x"],"current_location_key":"' || case when c_custkey % 7 = 0 then 'item:1' else 'location:' || cast(c_nationkey as string) end || '"}}}}}}}}' as json from {customer}
union all select 'c', 'location:' || cast(n_nationkey as string), '{{{{"domain_data":{{{{"environment":{{{{"terrain_and_landform":"' || n_name || '"}}}}}}}}}}}}' from {nation}
union all select 'c', 'item:' || cast(p_partkey as string), '{{{{"domain_data":{{{{"profile":{{{{"item_kind":"' || p_type || '","instance_mode":null,"primary_functions":["' || p_brand || '",' || cast(p_size as string) || ',{{{{"deep":[true]}}}}]' ||
    case when p_partkey % 4 = 0 then '' else ',"materials":[]' end || ',"form_description":"f"}}}},"quantity":{{{{"amount":' || case when p_partkey % 3 = 0 then '"many"' else cast(p_size as string) end || ',"unit":" kg "}}}},"placement":{{{{"target_key":"' ||
    case p_partkey % 3 when 0 then 'location:' || cast(p_partkey % 25 as string) when 1 then 'character:' || cast(p_partkey % 50 + 1 as string) else 'item:' || cast(p_partkey as string) end || '","role":"' || case when p_partkey % 2 = 0 then 'placed' else 'worn' end || '"}}}}}}}}}}}}' from {part}
union all select 'c', 'organization:' || cast(s_suppkey as string), '{{{{"domain_data":{{{{"structure":{{{{"governance_model":"' || case when s_suppkey % 3 = 0 then '' else 'vote' end || '","roles":[{{{{"role_key":"head_' || cast(s_suppkey % 4 as string) ||
    '","name":"H","description":"d"}}}},{{{{"role_key":"Head","name":"H","description":"d"}}}},7]}}}},"states":[{{{{"kind":"k","description":"' || s_name || '","status":"' || case when s_suppkey % 2 = 0 then 'active' else 'asleep' end || '"}}}}]}}}}}}}}' from {supplier}"""

_ID = "replace(key, ':', '_0K') || 'X'"


def _local(kind: str, *parts: str) -> str:
    """The digest of an entry's id, in SQL of the oracle."""
    return f"'{kind}_0' || upper(left(sha256(concat_ws(':', '{kind}', 'c', {', '.join(parts)})), 25))"


_EXPECTED = f"""with c as (select c_custkey as k, 'character:' || c_custkey as key, * from customer), p as (select p_partkey as k, 'item:' || p_partkey as key, * from part), s as (select s_suppkey as k, 'organization:' || s_suppkey as key, * from supplier),
  n as (select 'location:' || n_nationkey as key, * from nation),
  e as (
  select key, 'identity' as component, '{{"aliases":["' || c_mktsegment || '"],"primary_name":"' || c_name || '"}}' as data from c
  union all select key, 'identity', '{{"aliases":[],"primary_name":"' || split_part(key, ':', 2) || '"}}' from (select key from p union all select key from s union all select key from n)
  union all select key, 'character_profile', '{{"age_description":"' || c_nationkey || '","background":"' || c_mktsegment || '","species":"human"}}' from c where k % 5 <> 0
  union all select key, 'character_behavior_profile', '{{"motivations":[],"personality":{{"summary":"s","traits":["a","' || k % 3 || '"]}},"preferences":[' ||
    case when k % 3 = 0 then '' else '{{"attitude":"like","preference_id":"' || {_local("preference", "key", "'like'", "'tea'")} || '","subject":"tea"}}' end || ']}}' from c
  union all select key, 'current_location_reference', '{{"location_ref":{{"id":"location_0K' || c_nationkey || 'X","type":"location"}}}}' from c where k % 7 <> 0
  union all select key, 'environment_profile', '{{"terrain_and_landform":"' || n_name || '"}}' from n
  union all select key, 'item_profile', '{{"form_description":"f","instance_mode":null,"item_kind":"' || p_type || '","materials":[],"primary_functions":["' || p_brand || '",' || p_size || ',{{"deep":[true]}}]}}' from p where k % 4 <> 0
  union all select key, 'item_state', '{{"quantity":{{"amount":' || p_size || ',"unit":"kg"}},"states":[]}}' from p where k % 3 <> 0
  union all select key, 'current_placement_reference', '{{"placement_ref":{{"id":"' || case k % 3 when 0 then 'location_0K' || k % 25 || 'X","type":"location' else 'character_0K' || (k % 50 + 1) || 'X","type":"character' end || '"}},"placement_role":"' || case when k % 2 = 0 then 'placed' else 'worn' end || '"}}'
    from p where (k % 3 = 0 and k % 2 = 0) or (k % 3 = 1 and k % 2 = 1)
  union all select key, 'organization_structure', '{{"governance_model":"vote","roles":[{{"description":"d","name":"H","organization_role_id":"' || {_local("organization_role", "key", "'head_' || k % 4")} || '","role_key":"head_' || k % 4 || '"}}]}}' from s where k % 3 <> 0
  union all select key, 'organization_state', '{{"states":[{{"description":"' || s_name || '","kind":"k","organization_state_id":"' || {_local("organization_state", "key", "'k:' || s_name")} || '","status":"active"}}]}}' from s where k % 2 = 0)
select {_ID} as entity_id, component, '0.1.0' as schema_version, data from e"""


def typed_components(spark, d):
    rows = t.load(spark, d, CANDIDATES.replace("{{{{", "{{").replace("}}}}", "}}"))
    known = rows.selectExpr("chat_id", "substring_index(key, ':', 1) as type", "key", f"{_ID} as id")
    none = lambda names: spark.createDataFrame([], f"chat_id string, {names} body string").withColumn("body", F.parse_json("body"))
    _, made, _ = components.project(rows.withColumn("body", F.parse_json("json")), none("event_id string,"), none(""), none("memory_id string,"), known)
    return made.filter("component <> 'entity_management'").select("entity_id", "component", "schema_version", F.to_json("data").alias("data"))


#: order, and the fields of its current, former and new document.
_SIDES = """select cast(o_orderkey as string) as entity_id, o_orderkey as k, o_orderpriority as a, o_orderstatus as b from {orders}"""


def overlaid_documents(spark, d):
    rows = t.load(spark, d, _SIDES)
    tags = lambda *c: F.to_json(F.array(*map(F.lit, c)))
    one = lambda text, *cols: F.format_string(text, *cols).alias("data")
    k = F.col("k")
    now = rows.select("entity_id", one('{"entity_management":{"revision":%d},"profile":{"note":"by hand","tags":%s,"form":"%s"}}', k % 9, tags("x", "y", "z"), "a"))
    old = rows.select("entity_id", one('{"entity_management":{"revision":1},"profile":{"tags":["x"],"form":"short","gone":1}}'))
    form = F.when(k % 2 == 0, F.lit("short")).otherwise(F.col("b"))
    new = rows.select("entity_id", one('{"entity_management":{"revision":2},"profile":{"tags":%s,"form":"%s"%s}}', F.when(k % 3 == 0, tags("q")).otherwise(tags("x")), form, F.when(k % 5 == 0, ',"more":{"n":[1,{"z":null}]}').otherwise("")))
    return nesting.overlay_documents(now.filter("entity_id % 11 <> 0"), old, new.filter("entity_id % 13 <> 0"))


_OVERLAID = """with o as (select o_orderkey as k, o_orderpriority as a, o_orderstatus as b, o_orderkey % 11 <> 0 as now, o_orderkey % 13 <> 0 as fresh from orders),
  f as (select *, case when now and not (fresh and k % 2 = 1) then a when k % 2 = 0 then 'short' else b end as form,
    case when now and not (fresh and k % 3 = 0) then '["x","y","z"]' when k % 3 = 0 then '["q"]' else '["x"]' end as tags from o where now or fresh)
select cast(k as varchar) as entity_id, '{"entity_management":{"revision":' || case when now then k % 9 else 2 end || '},"profile":{"form":"' || form || '",' || case when fresh and k % 5 = 0 then '"more":{"n":[1,{"z":null}]},' else '' end ||
  case when now then '"note":"by hand",' else '' end || '"tags":' || tags || '}}' as data from f"""

_PAGES = """select cast(p_partkey as string) as entity_id, '{{"name":"' || p_brand || '","list":[{{"Item_Ref":{{"id":' || cast(p_partkey as string) || '}},"w":[1,' || cast(p_size as string) || ']}},' || cast(p_size as string) || '],"deep":{{"owner_key":"' || p_type || '"' ||
  case when p_partkey % 2 = 0 then ',"size":{{}}' else '' end || '}},"Aliases ":["' || p_name || '"]}}' as data from {part}"""


def safe_documents(spark, d):
    return nesting.quarantine(t.load(spark, d, _PAGES))[0]


def blocked_values(spark, d):
    return nesting.quarantine(t.load(spark, d, _PAGES))[1]


#: A schema for the documents of ``_PAGES``.
_SCHEMA = {
    "type": "object", "required": ["name", "list"], "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "pattern": "#[0-4]"}, "deep": {"type": "object", "required": ["size"], "properties": {"owner_key": {"type": "string", "maxLength": 20}}},
        "list": {"type": "array", "minItems": 2, "items": {"type": ["object", "integer"], "maximum": 40, "properties": {"Item_Ref": {"type": "object", "properties": {"id": {"type": "string"}}}, "w": {"type": "array", "uniqueItems": True, "items": {"type": "integer", "minimum": 1}}}}},
    },
}


def audit_documents(spark, d):
    docs = t.load(spark, d, _PAGES).withColumn("component", F.lit("page"))
    return shapes.document_violations(docs, shapes.rules_of(spark, {"page": _SCHEMA})).select("entity_id", "component", "path", "code")


QUERIES = {"audit_documents": audit_documents, "typed_components": typed_components, "overlaid_documents": overlaid_documents, "safe_documents": safe_documents, "blocked_values": blocked_values}
SQL = {
    "typed_components": _EXPECTED, "overlaid_documents": _OVERLAID,
    "safe_documents": """select cast(p_partkey as varchar) as entity_id, '{"deep":{' || case when p_partkey % 2 = 0 then '"size":{}' else '' end || '},"list":[{"w":[1,' || p_size || ']},' || p_size || '],"name":"' || p_brand || '"}' as data from part""",
    "audit_documents": """with p as (select cast(p_partkey as varchar) as entity_id, * from part), v as (
      select entity_id, '/Aliases ' as path, 'UNKNOWN_FIELD' as code from p
      union all select entity_id, '/deep/size', 'MISSING_REQUIRED_FIELD' from p where p_partkey % 2 <> 0
      union all select entity_id, '/list/#0/Item_Ref/id', 'INVALID_TYPE' from p
      union all select entity_id, '/name', 'INVALID_VALUE' from p where not regexp_matches(p_brand, '#[0-4]')
      union all select entity_id, '/deep/owner_key', 'INVALID_VALUE' from p where length(p_type) > 20
      union all select entity_id, '/list/#1', 'INVALID_VALUE' from p where p_size > 40
      union all select entity_id, '/list/#0/w/#1', 'INVALID_VALUE' from p where p_size < 1
      union all select entity_id, '/list/#0/w', 'INVALID_VALUE' from p where p_size = 1)
      select entity_id, 'page' as component, path, code from v""",
    "blocked_values": """select cast(p_partkey as varchar) as entity_id, unnest(['/list/#0/Item_Ref', '/deep/owner_key', '/Aliases ']) as path, unnest(['{"id":' || p_partkey || '}', '"' || p_type || '"', '["' || p_name || '"]']) as data from part""",
}
