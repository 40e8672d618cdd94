"""Queries over the parts of plans and projections: merges, players, links, references, guidance, shells, lists and component ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from storynet.operators import audit, network, projection, recall, resolve, segments, store
from storynet.plans.event_queries import _EV, _ST, _STAGE, _contexts, _frameworks, _starts
from storynet.plans.network_queries import WITH, net
from storynet.plans.store_queries import messages
from storynet.sources import tables as t

_V = ["entity_id", "component", "path", "code"]
IN = {
    "plan": """select cast(o_custkey % 60 as string) as chat_id, o_orderkey as k, case o_orderkey % 5 when 0 then 'character:user' when 1 then 'character: You' when 2 then 'character:{{{{user}}}}' when 3 then 'item:user' else 'character:' || o_orderpriority end as owner,
      case o_orderkey % 3 when 0 then 'User' when 1 then ' you' else o_orderstatus end as alias from {orders}""",
    "links": """select 'c' as chat_id, cast(l_partkey as string) as entity, 'skills' as list, 's' || cast(l_suppkey % 20 as string) as link, l_orderkey * 100 + seq as ord, case when l_orderkey % 3 <> 0 then 'v' || cast(l_orderkey % 7 as string) end as value from {lines}""",
    "views": """select 'c' as chat_id, 'k' || cast(o_custkey % 30 as string) as src, 'k' || cast(o_orderkey % 30 as string) as dst, o_orderkey as ord, o_orderpriority as value from {orders}""",
    "keyed": """select 'c' as chat_id, 'k' || cast(o_custkey as string) as owner, case when o_orderkey % 4 = 0 then ' ' else 'p' || cast(o_orderkey % 50 as string) end as place, 'a' || cast(o_orderkey % 9 as string) || ',k' || cast(o_custkey + 1 as string) as others from {orders}""",
    "claims": """select cast(c_custkey % 10 as string) as chat_id, 'k' || cast(c_custkey as string) as entity, case c_custkey % 4 when 0 then 'location' when 1 then 'organization' when 2 then 'concept' else 'character' end as type, 'k' || cast(case when c_custkey % 9 = 0 then c_custkey else (c_custkey + 10 * (c_custkey % 7)) % 150 end as string) as other from {customer}""",
    "heads": """select cast(o_custkey as string) as chat_id, cast(o_orderkey as string) as ref, case o_orderkey % 4 when 0 then 'Rome · year 12 · noon' when 1 then 'noon' when 2 then '12:300 · dusk' else ' ' end as header from {orders}""",
    "groups": """select c_custkey - c_custkey % 3 as group_id, cast(c_custkey as string) as id, case when c_custkey % 17 = 0 then 'item' else 'character' end as type from {customer} where c_custkey % 11 <> 0""",
    "skills": """select cast(c_custkey as string) as entity_id, 0 as ord, case when c_custkey % 8 <> 0 then 's' || cast(c_custkey % 20 as string) end as skill_id, case when c_custkey % 3 = 0 then 's' || cast(c_custkey % 20 as string) when c_custkey % 3 = 1 then 's' || cast(c_custkey % 21 as string) else 'c1' end as framework_id, case when c_custkey % 5 = 0 then 'calm' end as stage from {customer}
      union all select cast(c_custkey as string), 1, 's' || cast(c_custkey % 7 as string), case when c_custkey % 2 = 0 then 'c2' end, 'warm' from {customer} where c_custkey % 4 = 1""",
    "json": """select p_partkey as pos, case p_partkey % 6 when 0 then '[1]' when 1 then '{{"id":"i' || cast(p_partkey as string) || '"}}' when 2 then '{{"id":"i' || cast(p_partkey as string) || '","components":[]}}'
      when 3 then '{{"id":"i' || cast(p_partkey as string) || '","components":{{"a":{{"x":1}},"b":"{{","c":null}}}}' when 4 then 'broken {{' else '{{"id":"i' || cast(p_partkey as string) || '","components":{{"a":{{}}}}}}' end as entity_json from {part}""",
    "fields": """select cast(p_partkey as string) as entity_id, 'item_quantity' as component, '/data/mode' as path, case p_partkey % 3 when 0 then 'stack' when 1 then 'pile' else 'single' end as value from {part}
      union all select cast(p_partkey as string), 'item_quantity', '/data/unit', case p_partkey % 4 when 0 then 'kg' when 1 then 'stone' else 'piece' end from {part} where p_partkey % 5 <> 0""",
    "present": """select cast(c_custkey as string) as relation, case k when 0 then 'entity_management' when 1 then 'relation_endpoint_reference' when 2 then 'character_relation_aspects' when 3 then 'character_relation_state' else 'relation_memory_index' end as component
      from {customer}, (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4) n where (c_custkey + k) % 6 <> 0""",
    "entries": """select cast(o_custkey % 40 as string) as entity_id, case when o_custkey % 2 = 0 then 'character' else 'organization' end as type, case o_orderkey % 4 when 0 then 'objectives' when 1 then 'traits' when 2 then 'roles' else 'motivations' end as section, o_orderkey as ord,
      case when o_orderkey % 7 <> 0 then '"' || o_orderpriority || cast(o_orderkey as string) || '"' end as value from {orders}""",
    "roles": """select cast(o_custkey as string) as entity_id, o_orderkey as ord, case o_orderkey % 4 when 0 then ' Head of-State ' when 1 then o_orderpriority when 2 then '!!' else 'head of state' end as name from {orders}""",
    "stages": """select cast(l_orderkey as string) as entity_id, case when seq % 2 = 0 then 'stage' else 'binding' end as kind, seq as ord, case l_partkey % 3 when 0 then 'Calm Mind' when 1 then 'calm-mind!' else 'B ' || cast(l_partkey % 4 as string) end as name from {lines}""",
    "concepts": """select cast(l_partkey as string) as entity_id, case when l_partkey % 5 = 0 then 'character' else 'item' end as type, case when seq % 6 <> 0 then cast(l_suppkey as string) end as concept_id from {lines}""",
    "loose": """select cast(o_custkey as string) as entity_id, 'f' || cast(o_orderkey % 6 as string) as field, o_orderkey as ord, o_orderpriority as value, o_orderkey % 4 as part from {orders}""",
    "proposed": f"""select chat_id, floor as ord, floor = 0 and cast(chat_id as bigint) % 2 = 0 as continuing, case floor % 4 when 0 then left(content, 20) when 1 then substring(content, 12, 30) when 2 then substring(content, 3, 25) else 'not said anywhere' end as quote from ({t.MESSAGES}) m""",
}
_RULES: dict = {}


def _in(spark, d, name):
    return t.load(spark, d, IN[name])


def _sql(text: str) -> str:
    for name in IN:
        text = text.replace(f"<{name}>", f"({IN[name]})")
    return t.oracle(text)


def rule(name: str, sql: str | None):
    def keep(query):
        _RULES[name] = (query, sql)
        return query

    return keep


@rule("rebound_memories", f"""with {_ST}, x as (select *, sum(case when starts_with(slot, 'new_') then 1 else 0 end) over (partition by chat_id order by batch_ix, seg_ix) as raw from sl),
  m as (select distinct chat_id, raw - case when starts_with(slot, 'new_') then 1 else 0 end as raw from x where disposition = 'merge_into_pending' and seg_ix = 0),
  e as (select distinct x.chat_id, raw, greatest((select count(distinct y.raw) from x y where y.chat_id = x.chat_id and y.raw <= x.raw and not exists (select 1 from m where m.chat_id = y.chat_id and m.raw = y.raw)), 1) as event_no from x)
  select distinct v.chat_id, 'm' || cast(v.event_no % 4 as varchar) as memory_id, e.event_no from (select chat_id, event_no from ({_EV})) v join e on e.chat_id = v.chat_id and e.raw = v.event_no""")
def rebound_memories(spark, d):
    ev, starts = _starts(spark, d)
    events = segments.merged_events(segments.raw_events(segments.build_segments(starts)))
    memories = ev.selectExpr("chat_id", "concat('m', event_no % 4) as memory_id", "event_no as raw")
    return segments.rebind_memories(memories, events).withColumn("event_no", F.col("event_no").cast("long"))


@rule("placed_quotes", t.oracle(f"""with b as (select chat_id, floor as ix, 'b' || cast(floor as varchar) as k, regexp_replace(content, '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g') as t, regexp_replace(substring(content, 12), '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g') as u from ({t.MESSAGES}) m),
  p as (select *, regexp_replace(quote, '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g') as q from ({IN["proposed"]}) x),
  j as (select p.chat_id, p.ord, any_value(continuing) as continuing, min_by(k, ix) filter (starts_with(t, q)) as bk, min_by('i' || k, ix) filter (ix % 2 = 1 and starts_with(u, q)) as ik, min_by(k, ix) filter (contains(t, q)) as held
    from p left join b on b.chat_id = p.chat_id and q <> '' group by p.chat_id, p.ord),
  o as (select *, case when ord = 0 and continuing then 'old_tail' else coalesce(bk, ik, 'start_in_' || held || '_' || cast(ord as varchar)) end as own from j)
  select chat_id, ord, coalesce(last_value(own ignore nulls) over (partition by chat_id order by ord), 'old_tail') as key, own is null as lost from o"""))
def placed_quotes(spark, d):
    rows = messages(spark, d)
    blocks = rows.selectExpr("chat_id", "0 as batch_ix", "floor as ix", "concat('b', floor) as block_key", "content as text")
    clues = rows.filter("floor % 2 = 1").selectExpr("chat_id", "0 as batch_ix", "floor as ix", "concat('ib', floor) as inner_key", "substring(content, 12) as text")
    asked = _in(spark, d, "proposed").withColumn("batch_ix", F.lit(0))
    return segments.place_starts(segments.place_quotes(asked, blocks, clues)).select("chat_id", "ord", "key", "lost")


@rule("rewritten_players", _sql("""select chat_id, k, case when cast(chat_id as bigint) < 50 and k % 5 < 3 then 'character:P' || chat_id else owner end as owner, case when cast(chat_id as bigint) < 50 and k % 3 < 2 then '' else alias end as aliases from <plan>"""))
def rewritten_players(spark, d):
    plan = _in(spark, d, "plan").withColumn("aliases", F.array("alias")).drop("alias")
    players = plan.filter("cast(chat_id as bigint) < 50").select("chat_id", F.concat(F.lit("P"), "chat_id").alias("player")).distinct()
    return resolve.rewrite_player(plan, players, ["owner"]).withColumn("aliases", F.array_join("aliases", "|"))


@rule("united_evidence", _sql("""with e as (select entity, link, min(ord) as f from <links> group by all) select 'c' as chat_id, entity as key, string_agg(link, ',' order by f) as evidence from e group by entity"""))
def united_evidence(spark, d):
    rows = _in(spark, d, "links").selectExpr("chat_id", "entity as key", "ord", "value as description", "array(value) as aliases", "array(struct(link as ref, 'q' as quote)) as evidence")
    return resolve.upsert_candidates(rows).select("chat_id", "key", F.array_join(F.transform("evidence", lambda x: x["ref"]), ",").alias("evidence"))


@rule("merged_links", _sql("""with g as (select entity, link, min(ord) as f, max_by(value, ord) filter (value is not null) as value from <links> group by all) select 'c' as chat_id, entity as key, 'skills' as list, link, value, row_number() over (partition by entity order by f, link) - 1 as place from g"""))
def merged_links(spark, d):
    return resolve.upsert_links(_in(spark, d, "links").withColumnRenamed("entity", "key"))


@rule("relation_views", _sql("select chat_id, least(src, dst) as low, greatest(src, dst) as high, src, dst, max_by(value, ord) as value from <views> where src <> dst group by all"))
def relation_views(spark, d):
    return resolve.upsert_directions(_in(spark, d, "views"))


@rule("roster_evidence", t.oracle("""select 'c' as chat_id, cast(p_partkey as varchar) as key, case when p_partkey % 5 < 4 then 'plan,' else '' end || 'roster' as evidence from {part} where p_partkey % 5 > 0 union all select 'c', cast(p_partkey as varchar), 'plan' from {part} where p_partkey % 5 = 0"""))
def roster_evidence(spark, d):
    rows = t.load(spark, d, "select 'c' as chat_id, cast(p_partkey as string) as key, p_name as name, p_type as description, array(p_brand) as aliases, p_partkey % 5 as s from {part}")
    one = lambda who: F.array(F.struct(F.lit(who).alias("ref"), F.lit("q").alias("quote")))
    out = resolve.roster_fallback(rows.filter("s < 4").withColumn("evidence", one("plan")).drop("s"), rows.filter("s > 0").withColumn("evidence", one("roster")).drop("s"))
    return out.select("chat_id", "key", F.array_join(F.transform("evidence", lambda x: x["ref"]), ",").alias("evidence"))


@rule("named_keys", _sql("""select distinct 'c' as chat_id, key from (select owner as key from <keyed> union all select place from <keyed> union all select unnest(string_split(others, ',')) from <keyed>) where trim(key) <> '' and not (starts_with(key, 'k') and cast(substring(key, 2) as bigint) % 4 = 0)"""))
def named_keys(spark, d):
    rows = _in(spark, d, "keyed").withColumn("others", F.split("others", ","))
    known = rows.selectExpr("chat_id", "owner as key").unionByName(rows.selectExpr("chat_id", "others[1] as key")).filter("cast(substring(key, 2) as bigint) % 4 = 0")
    return resolve.stub_nodes(resolve.referenced_keys([(rows, ["owner", "others"]), (rows, ["place"])]), known)


_KNOWN = "(select distinct chat_id, entity, type from <claims>)"


@rule("dropped_locations", _sql(f"""select c.chat_id, c.entity as key, c.other as location, case when coalesce(k.type, '') <> 'location' then 'unknown_location' else 'not_in_batch' end as reason from <claims> c left join {_KNOWN} k on k.chat_id = c.chat_id and k.entity = c.other
  where coalesce(k.type, '') <> 'location' or cast(substring(c.other, 2) as bigint) % 8 <> 0"""))
def dropped_locations(spark, d):
    rows = _in(spark, d, "claims")
    known = rows.selectExpr("chat_id", "entity as key", "type").distinct()
    return resolve.filter_locations(rows.selectExpr("chat_id", "entity as key", "other as location"), known, known.filter("cast(substring(key, 2) as bigint) % 8 = 0"))[1]


@rule("dropped_parents", _sql(f"""select * from (select c.chat_id, c.entity as key, c.type, c.other as parent, case when c.other = c.entity then 'self' when k.type is null then 'unknown_parent' when k.type <> c.type then 'type_mismatch' end as reason
  from <claims> c left join {_KNOWN} k on k.chat_id = c.chat_id and k.entity = c.other) where reason is not null"""))
def dropped_parents(spark, d):
    rows = _in(spark, d, "claims")
    return resolve.filter_parents(rows.selectExpr("chat_id", "entity as key", "type", "other as parent"), rows.selectExpr("chat_id", "entity as key", "type").distinct())[1]


@rule("kept_concepts", _sql(f"select c.chat_id, c.entity as key, c.other as concept from <claims> c where exists (select 1 from {_KNOWN} k where k.chat_id = c.chat_id and k.entity = c.other and k.type = 'concept')"))
def kept_concepts(spark, d):
    rows = _in(spark, d, "claims")
    return resolve.filter_concepts(rows.selectExpr("chat_id", "entity as key", "other as concept"), rows.selectExpr("chat_id", "entity as key", "type").distinct())


@rule("placeless_headers", _sql("select chat_id, ref, 'header_without_place' as warning from <heads> where header in ('noon', '12:300 · dusk')"))
def placeless_headers(spark, d):
    return resolve.headers_without_place(_in(spark, d, "heads"))


@rule("merge_blockers", _sql("""with m as (select * from <groups>), s as (select group_id, count(distinct id) as n, count(distinct type) as k from m group by group_id)
  select group_id, 'fewer_than_two' as reason from s where n < 2 union all select group_id, 'several_types' from s where k > 1 union select group_id, 'other_components' from m where cast(id as bigint) % 10 = 0
  union select group_id, 'edges' from m where cast(id as bigint) % 13 = 0 or cast(id as bigint) % 13 = 5 union select group_id, 'extraction_state' from m where cast(id as bigint) % 29 = 1"""))
def merge_blockers(spark, d):
    rows = _in(spark, d, "groups").withColumn("n", F.col("id").cast("long"))
    parts = rows.selectExpr("id", "if(n % 10 = 0, 'item_profile', 'identity') as component")
    edges = rows.filter("n % 13 = 0").selectExpr("id as src_id", "'far' as tgt_id").unionByName(rows.filter("n % 13 = 5").selectExpr("'far' as src_id", "id as tgt_id"))
    return store.merge_blockers(rows.drop("n"), parts, edges, rows.filter("n % 29 = 1").select("id"))


@rule("restored_diagnostics", t.oracle("""select cast(user_id as varchar) as chat_id, event_id as batch_ix, event_type as message from {events} where event_id % 3 <> 0"""))
def restored_diagnostics(spark, d):
    rows = t.load(spark, d, "select cast(user_id as string) as chat_id, event_id as batch_ix, event_type as message from {events}")
    return store.restore_diagnostics(rows.selectExpr("chat_id", "batch_ix", "batch_ix % 3 <> 0 as committed"), rows)


@rule("stage_guidance", f"""with {_STAGE}, q as (select framework as id, mode, framework % 50 as value, case when framework % 3 <> 1 then 1 end as stage from fw where framework % 4 = 0 and framework not in (select framework from i)),
  d as (select q.id, case when count(distinct r.stage) = 1 then min(r.stage) end as derived from q join r on r.framework = q.id and q.value >= r.low and q.value < r.high group by q.id),
  c as (select q.*, case when mode = 'numeric_derived' then derived else stage end as now from q left join d on d.id = q.id)
  select distinct c.id, cast(r.stage as varchar) as stage, 'in' || cast(r.stage as varchar) as entry, 'out' as exit from c join r on r.framework = c.id where now is not null and (r.stage = now or (c.mode = 'hybrid' and c.value >= r.low and c.value < r.high))""")
def stage_guidance(spark, d):
    frames = _frameworks(spark, d)  # once for contexts and guidance
    fw, _, stages, _, _ = frames
    ask = fw.selectExpr("framework as id", "framework", "case framework % 4 when 0 then 'transition_check' when 1 then 'framework_overview' else 'current_stage' end as recall_mode")
    guidance = stages.selectExpr("framework", "stage", "concat('in', stage) as entry", "'out' as exit")
    return recall.transition_guidance(_contexts(*frames, asked="recall_mode = 'transition_check'"), ask, guidance)


@rule("framework_links", _sql("""select entity_id || '-' || cast(ord as varchar) as id, case when starts_with(framework_id, 's') and framework_id is distinct from skill_id then 'SKILL_STAGE_FRAMEWORK_MISMATCH' else 'STAGE_FRAMEWORK_COMPONENT_MISSING' end as code from <skills>
  where skill_id is not null and (starts_with(framework_id, 's') and framework_id <> skill_id or framework_id = 'c2' or (framework_id = skill_id and cast(substring(framework_id, 2) as int) % 4 = 0))"""))
def framework_links(spark, d):
    hosts = _in(spark, d, "skills").filter("skill_id is not null").selectExpr("concat(entity_id, '-', ord) as id", "skill_id as skill", "framework_id as framework")
    known = hosts.select("framework").filter("framework is not null").distinct()
    known = known.selectExpr("framework", "if(framework like 's%', 'skill', 'concept') as type", "if(framework like 's%', cast(substring(framework, 2) as int) % 4 <> 0, framework = 'c1') as has_component")
    return recall.framework_links(hosts, known)


@rule("duplicate_values", t.oracle("""select event_id as id, k as ord, 'DUPLICATE_SKILL_NUMERIC_VALUE' as code from {events}, range(0, 4) r(k) where (k = 2 and event_id % 3 = 0) or (k = 3 and event_id % 2 = 0)"""))
def duplicate_values(spark, d):
    rows = t.load(spark, d, "select event_id as id from {events}").selectExpr("id", "inline(array(struct(0L as ord, 'a' as binding), struct(1L as ord, 'b' as binding), struct(2L as ord, if(id % 3 = 0, 'a', null) as binding), struct(3L as ord, if(id % 2 = 0, 'b', 'd') as binding)))")
    return recall.duplicate_numeric_values(rows)


@rule("audit_json_shell", _sql("""select case when k in (0, 4) then null else 'i' || cast(pos as varchar) end as entity_id, case when k in (0, 4) then 'network' when k = 3 then c else 'entity' end as component, '/' || cast(pos as varchar) as path,
  case when k in (0, 4) then 'INVALID_NETWORK_ENTITY' when k = 3 then 'INVALID_COMPONENT_INSTANCE' else 'INVALID_COMPONENTS' end as code from (select pos, pos % 6 as k, unnest(case when pos % 6 = 3 then ['b', 'c'] else [null] end) as c from <json>) where k <> 5"""))
def audit_json_shell(spark, d):
    return audit.json_shell(_in(spark, d, "json")).select(*_V)


@rule("audit_conditions", t.oracle("""select cast(p_partkey as varchar) as entity_id, 'item_quantity' as component, '/data/unit' as path, case when p_partkey % 5 = 0 then 'MISSING_REQUIRED_FIELD' else 'INVALID_VALUE' end as code from {part}
  where (p_partkey % 3 in (0, 1) and p_partkey % 5 = 0) or (p_partkey % 3 in (0, 1) and p_partkey % 4 = 1)"""))
def audit_conditions(spark, d):
    rules = spark.createDataFrame([("item_quantity", "/data/mode", ["stack", "pile"], "/data/unit", ["kg", "piece"])], "component string, if_path string, if_values array<string>, then_path string, allowed array<string>")
    return audit.conditional_rules(_in(spark, d, "fields"), rules).select(*_V)


@rule("audit_relation_components", _sql("""with r as (select distinct relation, cast(relation as bigint) as n from <present>), k as (select *, unnest([0, 1, 2, 3, 4]) as k from r)
  select relation as entity_id, ['entity_management', 'relation_endpoint_reference', 'character_relation_aspects', 'character_relation_state', 'relation_memory_index'][k + 1] as component, '/' as path,
    case when k = 4 then 'RELATION_MEMORY_INDEX_REQUIRED' else 'MISSING_RELATION_COMPONENT' end as code from k where (n + k) % 6 = 0 and (k < 4 or n % 4 = 0)"""))
def audit_relation_components(spark, d):
    rows = _in(spark, d, "present")
    return audit.relation_components(rows, rows.filter("cast(relation as bigint) % 4 = 0").select("relation")).select(*_V)


@rule("list_components", _sql("""with l as (select * from (values ('character', 'traits', 'character_behavior_profile', 'personality_traits', 24), ('character', 'motivations', 'character_behavior_profile', 'motivations', 32), ('character', 'objectives', 'character_objective', 'objectives', 24),
    ('organization', 'objectives', 'organization_objective', 'objectives', 24), ('organization', 'roles', 'organization_structure', 'roles', 64)) as r(type, section, component, field, most)),
  n as (select e.*, component, field, most, row_number() over (partition by entity_id, e.type, component, field order by ord, value) as n from <entries> e join l on l.type = e.type and l.section = e.section where value is not null),
  f as (select entity_id, type, component, field, '"' || field || '":[' || string_agg(value, ',' order by ord) || ']' as x from n where n <= most group by entity_id, type, component, field)
  select entity_id, type, component, '{{' || string_agg(x, ',' order by x) || '}}' as data from f group by all"""))
def list_components(spark, d):
    rules = spark.createDataFrame(list(projection.LISTS), "type string, section string, component string, field string, most int")
    return projection.project_lists(_in(spark, d, "entries"), rules)


@rule("parent_components", t.oracle(f"""{WITH}, p as (select src_id as id, src_type as type, min(tgt_id) as parent from refs where component in ('parent_location_reference', 'parent_organization_reference') and src_id <> tgt_id and right(src_id, 1) <> '4' group by all)
  select id as entity_id, type, 'parent_' || type || '_reference' as component, '{{{{"parent_' || type || '_ref":{{{{"id":"' || parent || '","type":"' || type || '"}}}}}}}}' as data from p"""))
def parent_components(spark, d):
    refs, _ = net(spark, d)
    claims = refs.filter("component in ('parent_location_reference', 'parent_organization_reference')").selectExpr("src_id as entity_id", "src_type as type", "tgt_id as parent_id", "if(right(src_id, 1) = '4', 'item', tgt_type) as parent_type")
    return projection.project_parents(claims)


@rule("role_keys", _sql("""with k as (select entity_id, ord, name, case ord % 4 when 2 then 'role' when 1 then trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') else 'head_of_state' end as base from <roles>),
  n as (select *, row_number() over (partition by entity_id, base order by ord) as n from k) select entity_id, ord, name, case when n = 1 then base else base || '_' || cast(n as varchar) end as role_key from n"""))
def role_keys(spark, d):
    return projection.role_keys(_in(spark, d, "roles"))


@rule("skill_references", _sql("""with g as (select entity_id, skill_id, bool_or(stage is not null and framework_id is not null) as s from <skills> where skill_id is not null group by all)
  select entity_id, 'skill_reference' as component, case when bool_or(s) then '0.2.0' else '0.1.0' end as schema_version, count(*) as n_skills, count(*) filter (s) as n_staged from g group by entity_id"""))
def skill_references(spark, d):
    return projection.skill_references(_in(spark, d, "skills"))


@rule("stage_ids", _sql("""with k as (select entity_id, kind, ord, kind || '_' || case when name in ('Calm Mind', 'calm-mind!') then 'calm_mind' else replace(lower(name), ' ', '_') end as base from <stages>),
  n as (select *, row_number() over (partition by entity_id, kind, base order by ord) as n from k) select entity_id, kind, ord, case when n = 1 then base else base || '_' || cast(n as varchar) end as id from n"""))
def stage_ids(spark, d):
    return projection.stage_ids(_in(spark, d, "stages"))


@rule("related_concepts", _sql("select entity_id, type, 'related_concept_reference' as component, string_agg(distinct concept_id, ',' order by concept_id) as ids from <concepts> where type <> 'character' and concept_id is not null and concept_id <> entity_id group by all"))
def related_concepts(spark, d):
    return projection.related_concepts(_in(spark, d, "concepts")).withColumn("ids", F.array_join("ids", ","))


@rule("maintenance_records", _sql("""select entity_id, 'entity_field_maintenance' as component, count(*) filter (part = 0) as n_unclassified, count(*) filter (part = 1) as n_revisions, string_agg(distinct field, ',' order by field) as fields from <loose> where part < 2 group by entity_id"""))
def maintenance_records(spark, d):
    rows = _in(spark, d, "loose")
    return projection.maintenance_records(rows.filter("part = 0"), rows.filter("part = 1")).withColumn("fields", F.array_join("fields", ","))


QUERIES = {name: query for name, (query, _) in _RULES.items()}
SQL = {name: sql for name, (_, sql) in _RULES.items() if sql}
