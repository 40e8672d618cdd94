"""Queries over the single rules: quotes, plans, memories, keys, permissions, resumption and stored streams.

``IN`` holds their inputs as SQL that Spark and the oracle both run; defects are injected there by key.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storynet.functions import text as tx
from storynet.functions.shared import shared_dir
from storynet.operators import anchors, audit, network, projection, recall, repair, resolve, segments, store
from storynet.plans.network_queries import WITH, net
from storynet.plans.store_queries import messages
from storynet.sources import chats
from storynet.sources import tables as t
from storynet.streaming import events as streaming
from storynet.streaming import ledger

_V = ["entity_id", "component", "path", "code"]
_MSG = t.MESSAGES

IN = {
    "told": """select o_orderkey as k, case o_orderkey % 6 when 0 then 'They said "wait until dawn" and left at 7:30 again' when 1 then 'At noon it rained. *midnight* was far.'
      when 2 then 'Nothing of the kind, ' || o_orderpriority when 3 then '“10 pm” was a lie; dusk fell' when 4 then 'at 11 am' else '' end as body,
      case o_orderkey % 5 when 0 then 'She remembered how they reached Rome. They reached Paris.' when 1 then 'If they arrived at Lyon, fine. Nothing else.' when 2 then 'They came to Basel! They reached Bern.'
      when 3 then 'plain words' else 'Yes. They arrived in Turin and slept.' end as trip from {orders}""",
    "units": """select cast(l_orderkey as string) as ref, cast(seq as string) as unit, seq as ord, case l_partkey % 7 when 0 then 'next morning they arrived at Rome' when 1 then 'he left Paris and started to run' when 2 then 'they slept'
      when 3 then 'days later' when 4 then 'she began digging' when 5 then 'they reached Bern' else 'nothing' end as text from {lines}""",
    "blocks": """select cast(o_custkey as string) as chat_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ix, o_orderkey % 2 = 0 as place_changed,
      case o_orderkey % 7 when 0 then 'next morning' when 1 then 'they left Rome' when 2 then 'they slept' when 3 then 'she began digging' else 'nothing' end as text from {orders}""",
    "quotes": f"""select chat_id, 'm' || cast(floor as string) as ref, floor, case when floor % 3 = 0 then upper(substring(content, 3, 30)) when floor % 3 = 1 then replace(substring(content, 5, 40), ' ', ' . ') else substring(content, 2, 25) end as quote from ({_MSG}) m""",
    "lost": """select o_custkey % 40 as batch, o_orderkey as ord, o_orderkey % 11 as cursor, 'nothing like it at all; order number ' || cast(o_orderkey as string) || ' was here!short' as quote from {orders}""",
    "bodies": """select o_custkey % 40 as batch, 'aboutfifteenmore' || 'ordernumber' || cast(max(o_orderkey) as string) || 'washerexordernumber' || cast(min(o_orderkey) as string) || 'washereordernumber' || cast(min(o_orderkey) as string) || 'washere' as body from {orders} group by o_custkey % 40""",
    "components": """select cast(p_partkey as string) as entity_id, case when p_partkey % 7 = 0 then 'skill' else 'item' end as entity_type, case p_partkey % 5 when 0 then 'ghost' when 1 then 'item_profile' else 'container_profile' end as component,
      case p_partkey % 6 when 0 then cast(null as string) when 1 then '9.9.9' else '0.1.0' end as schema_version from {part}""",
    "items": """select cast(l_orderkey as string) as entity_id, 'event_content' as component, '/data/key_details' as array_path, seq as ord, case when l_partkey % 5 <> 0 then 'd' || cast(l_partkey % 9 as string) end as item_id from {lines}""",
    "goods": """select cast(p_partkey as string) as entity_id, case p_partkey % 3 when 0 then 'stack' else 'single' end as mode, case when p_size % 4 <> 0 then p_size end as quantity from {part}""",
    "changes": """select cast(event_id as string) as change_id, case event_id % 3 when 0 then 'profile' else 'state' end as component, case event_id % 4 when 0 then '/data/a' when 1 then '/data/a/b' when 2 then '/data/c/b' else '/data' end as path,
      case event_id % 5 when 0 then 'erase' when 1 then 'add' else 'set' end as operation, case event_id % 2 when 0 then 'host' else 'model' end as role from {events}""",
    "memories": f"""select '1' as chat_id, 'k' || right(id, 12) as "key", 'c' || cast(o_custkey as string) as owner_key, 'e' || cast(l_orderkey as string) as event_key from {{memories}} m""",
    "lists": """select cast(o_custkey as string) as entity_id, case o_orderkey % 4 when 0 then 'motivations' when 1 then 'current_emotions' when 2 then 'objectives' else 'free' end as field, o_orderkey as ord, o_orderpriority as value from {orders}
      union all select '0', 'current_emotions', o_orderkey, o_orderstatus from {orders} where o_orderkey < 40""",
    "stated": """select cast(p_partkey as string) as item, case when p_partkey % 6 = 5 then cast(p_partkey as string) else cast(p_partkey % 100 as string) end as target,
      case p_partkey % 3 when 0 then 'character' when 1 then 'item' else 'location' end as target_type, case p_partkey % 4 when 0 then 'carried' when 1 then 'contained' when 2 then 'placed' else 'stored' end as role, p_partkey % 2 as rank from {part} where p_partkey % 5 <> 0
      union all select cast(p_partkey as string), 'h', 'character', 'worn', 1 from {part} where p_partkey % 3 = 0""",
    "open": """select cast(p_partkey as string) as entity_id, 'item' as type, 'c' || cast(p_partkey % 3 as string) as component, case when p_partkey % 4 = 0 then '0.2.0' else '0.1.0' end as schema_version, p_name as data from {part}""",
    "hosts": """select event_id as id, 'f' || cast(event_id % 3 as string) as framework, case when event_id % 11 = 0 then 'semantic' else m end as host_mode, m as mode, case when event_id % 13 = 0 then 'x' else 'b' end as binding,
      case when event_id % 7 <> 0 then value end as value, case event_id % 5 when 0 then cast(null as string) when 1 then 'calm' when 2 then 'warm' when 3 then 'hot' else 'odd' end as stage
      from (select *, case event_id % 3 when 0 then 'semantic' when 1 then 'numeric_derived' else 'hybrid' end as m from {events}) e""",
    "values": """select cast(p_partkey as string) as entity_id, case p_partkey % 3 when 0 then '/data/kind' when 1 then '/data/title' else '/data/mode' end as path, case p_size % 4 when 0 then 'sgl' when 1 then 'mult' else p_brand end as value from {part}""",
    "plan": """select o_orderkey as k, case o_orderkey % 4 when 0 then 'new' when 1 then 'upd' else 'create' end as action, case o_orderkey % 3 when 0 then 'stmt' else 'action' end as kind, case when o_orderkey % 5 <> 0 then o_orderpriority end as tags from {orders}""",
    "named": """select 'item' as type, p_partkey as k, case p_partkey % 4 when 0 then p_name || ' ' || cast(p_partkey as string) when 1 then upper(p_name) || '_' || cast(p_partkey as string) when 2 then p_name || '（' || cast(p_partkey as string) || '）' else p_name || '!' end as name from {part}""",
    "flat": """select cast(event_id as string) as entity_id, case event_id % 6 when 0 then '/data/id' when 1 then '/data/items/0/entity_ref' when 2 then '/data/schema_version/x' when 3 then '/data/reference' when 4 then '/data/owner_keys/1' else '/data/name' end as path, event_type as value from {events}""",
    "roster": """select 'c' as chat_id, cast(p_partkey as string) as "key", case when p_partkey % 4 = 0 then ' ' else p_name end as name, case when p_partkey % 3 = 0 then p_type end as description, p_brand as alias, p_partkey % 5 as s from {part}""",
    "actors": """select cast(o_custkey % 50 as string) as chat_id, cast(o_orderkey as string) as event_id, 'k' || cast(o_custkey % 7 as string) as "key", o_orderkey % 3 as part from {orders}""",
    "slices": f"""select chat_id, 'e' || cast(e as string) as event_id, 'm' || cast(floor as string) as ref, case when e % 2 = 0 then content else left(content, 40) end as text
      from (select *, cast(floor(floor / 2) as bigint) as e from ({_MSG}) a union select *, cast(floor((floor + 1) / 2) as bigint) as e from ({_MSG}) b) m""",
    "candidates": """select cast(o_custkey as string) as chat_id, o_custkey % 3 as batch_ix, row_number() over (partition by o_custkey order by o_orderkey) - 1 as block_ix, o_orderkey % 4 = 0 as selected,
      case o_orderkey % 3 when 0 then 'new_event' when 1 then 'continue' else 'unresolved' end as decision, o_orderkey % 7 = 0 as hard from {orders}""",
    "starts": """select cast(o_custkey as string) as chat_id, o_custkey % 2 as batch_ix, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ord, o_custkey % 3 = 0 as continuing,
      case when o_orderkey % 5 = 0 then 'b' || cast(o_orderkey as string) end as block_key, case when o_orderkey % 4 = 0 then 'i' || cast(o_orderkey as string) end as inner_key, case when o_orderkey % 3 = 0 then 'n' || cast(o_orderkey as string) end as new_key from {orders}""",
    "texts": """select p_partkey as k, case p_partkey % 4 when 0 then p_name when 1 then p_name || ' and ' || p_type when 2 then '' else p_type end as a, case p_partkey % 3 when 0 then upper(p_brand) || '.' when 1 then p_name || ', and ' || p_type || '!' else p_name end as b from {part}""",
    "copies": """select cast(o_custkey % 20 as string) as chat_id, cast(o_orderkey as string) as update_id, cast(o_orderkey as string) as event_id, o_orderstatus as title, 'd' || cast(o_orderkey % 3 as string) as description, case when o_orderkey % 10 = 0 then ' ' else 's' || cast(o_orderkey % 30 as string) end as summary from {orders} where o_orderkey % 2 = 0""",
    "targets": """select cast(o_custkey % 20 as string) as chat_id, cast(o_orderkey as string) as event_id, o_orderpriority as title, 'd' || cast((o_orderkey + k) % 3 as string) as description, 's' || cast((o_orderkey + k) % 30 as string) as summary from (select *, case when o_orderkey % 8 = 0 then 0 else 5 end as k from {orders}) o where o_orderkey % 4 < 3""",
    "noops": """select cast(o_custkey as string) as chat_id, o_orderstatus as segment, case o_orderkey % 3 when 0 then ' ' when 1 then o_orderpriority end as delta, o_orderkey % 4 - 2 as n_details, o_orderkey as k from {orders}""",
    "details": """select l_orderkey as event_id, seq as ord, 'r' || cast(seq % 3 as string) as ref, 'action' as kind, case l_partkey % 4 when 0 then 'line number ' || cast(l_partkey as string) when 1 then 'LINE' when 2 then 'none of that' else 'part, ' || cast(l_suppkey as string) end as content from {lines}""",
    "held": """select distinct l_orderkey as event_id, 'r' || cast(seq % 4 as string) as ref, 'the line-number ' || cast(l_partkey as string) || ' of part ' || cast(l_suppkey as string) as text from {lines}""",
    "when": """select o_orderkey as event_id, part, case when o_orderkey % 3 = 0 then 'May 12, noon' when o_orderkey % 3 = 1 then 'dusk' else 'x.1' end as expression from {orders}, (select 'start' as part union all select 'end') p where o_orderkey % 5 <> 4 or part = 'start'""",
    "said": """select o_orderkey as event_id, case o_orderkey % 4 when 0 then 'on May the 12 about noon' when 1 then 'at dusk' when 2 then 'noon of May 12' else 'x.1 it was' end as line from {orders}""",
    "spans": """select o_orderkey as event_id, case when o_orderkey % 4 = 0 then 'forming' else 'finalized' end as status, case when o_orderkey % 7 <> 0 then 'dusk' end as start, 'noon' as "end", case when o_orderkey % 6 = 0 then 'dawn' end as old_start, case when o_orderkey % 8 = 1 then 'noon' end as old_end from {orders}""",
    "replies": """select cast(o_custkey as string) as chat_id, cast(o_orderkey as string) as "key", o_orderpriority as summary_add, o_orderstatus as description, cast(o_orderkey % 6 as bigint) as n_details, o_orderkey from {orders}""",
    "requests": """select cast(event_id as string) as context, event_type as request, 'c' || cast(event_id % 3 as string) as credential, event_id from {events}""",
    "runs": """select cast(user_id as string) as chat_id, cast(event_id % 8 as bigint) as batch_ix, event_type in ('view', 'click') as committed, event_type = 'error' as failed from {events}""",
    "problems": """select cast(user_id as string) as chat_id, event_id as batch_ix, event_type as task, case when event_id % 3 = 0 then 'e1,e' || cast(event_id % 5 as string) end as errors, case when event_id % 2 = 0 then 'w' || event_type end as warnings from {events}""",
    "ends": """select cast(c_custkey as string) as relation, 0 as ord, 'c' || lpad(cast(c_custkey % 90 as string), 3, '0') as who from {customer} union all select cast(c_custkey as string), 1, 'c' || lpad(cast((c_custkey * 7 + 5) % 90 as string), 3, '0') from {customer}""",
    "plans": """select cast(c_custkey as string) as chat_id, 0 as batch_ix, c_custkey as c, case c_custkey % 5 when 1 then 'keep_distinct' when 2 then 'merge_into_pending' when 3 then 'odd' else 'absent' end as disposition,
      c_custkey % 3 <> 0 as has_events, c_custkey % 7 < 4 as has_pending, c_custkey % 4 <> 1 as has_forming from {customer}""",
    "slots": """select cast(c_custkey as string) as chat_id, 0 as batch_ix, 0 as seg_ix, case c_custkey % 6 when 0 then 'pending_tail' when 1 then 'forming_existing' when 2 then 'new_1' when 3 then 'new_2' else 'odd' end as slot from {customer} where c_custkey % 6 <> 5
      union all select cast(c_custkey as string), 0, 1, case c_custkey % 8 when 0 then 'forming_existing' when 1 then 'pending_tail' when 2 then 'new_1' else 'new_2' end from {customer} where c_custkey % 6 <> 5 and c_custkey % 9 <> 0""",
    "edits": f"""select chat_id, floor, source_id, md5(content || case when floor % 5 = 0 then '!' else '' end) as version from ({_MSG}) m where floor % 4 <> 3""",
}


#: upper() of the inputs has one letter for each; Spark's has several for some letters, as SS for ß.
_SINGLE = "array_join(transform(split({0}, ''), c -> case when length(upper(c)) = 1 then upper(c) when length(initcap(c)) = 1 then initcap(c) else translate(c, 'ß', 'ẞ') end), '')"


def _in(spark, d, name):
    return _ins(spark, d, name)[0]


def _ins(spark, d, *names):
    """Several inputs; what they are made of is built once for all."""
    plain = (IN[name].replace('"key"', "`key`").replace('"end"', "`end`") for name in names)
    return t.load_all(spark, d, *(re.sub(r"\bupper\((substring\(content, \d+, \d+\))\)", lambda m: _SINGLE.format(m[1]), sql) for sql in plain))


def _sql(text: str, **names: str) -> str:
    """SQL for the oracle with <name> for the inputs."""
    for name in IN:
        text = text.replace(f"<{name}>", f"({IN[name]})")
    return t.oracle(text)


_RULES: dict = {}


def rule(name: str, sql: str | None):
    def keep(query):
        _RULES[name] = (query, sql)
        return query

    return keep


_TIME = tx.TIMES.replace("'", "''")


@rule("body_times", _sql(f"""select k, nullif(regexp_extract(regexp_replace(body, '(?s)"[^"]*"|“[^”]*”|「[^」]*」|\\*[^*]*\\*', ' ', 'g'), '{_TIME.replace("{", "{{").replace("}", "}}")}', 0), '') as at from <told>"""))
def body_times(spark, d):
    return _in(spark, d, "told").select("k", tx.body_time(F.col("body")).alias("at"))


@rule("body_places", _sql("select k, case k % 5 when 0 then 'Paris' when 2 then 'Basel' when 4 then 'Turin' end as place from <told>"))
def body_places(spark, d):
    return _in(spark, d, "told").select("k", tx.body_place(F.col("trip")).alias("place"))


_KINDS = "[" + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in tx.CLUES) + "]"


@rule("start_clues", _sql(f"""select ref, unit, array_to_string(list_sort(x), ',') as kinds, (list_contains(x, 'arrival') and list_contains(x, 'reset')) or (list_contains(x, 'exit') and list_contains(x, 'activity')) as hard
  from (select ref, unit, list_filter({_KINDS}, lambda y: y is not null) as x from <units> where ord > 1) where len(x) > 0"""))
def start_clues(spark, d):
    rows = tx.internal_start_clues(_in(spark, d, "units"))
    return rows.select("ref", "unit", F.array_join("kinds", ",").alias("kinds"), "hard")


@rule("hard_boundaries", _sql("""select chat_id, ix from <blocks> where (text in ('next morning', 'they slept') or (place_changed and text in ('they left Rome', 'she began digging'))) and (ix > 0 or cast(chat_id as bigint) % 3 = 0)"""))
def hard_boundaries(spark, d):
    blocks = _in(spark, d, "blocks")
    return tx.hard_round_boundaries(blocks, blocks.filter("cast(chat_id as bigint) % 3 = 0").select("chat_id"))


@rule("quote_contained", _sql(f"""select q.chat_id, q.floor from <quotes> q join ({_MSG}) m on m.chat_id = q.chat_id and m.floor = q.floor
  where regexp_replace(quote, '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g') <> '' and contains(regexp_replace(content, '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g'), regexp_replace(quote, '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g'))"""))
def quote_contained(spark, d):
    sources = messages(spark, d).selectExpr("chat_id", "concat('m', floor) as ref", "content")
    return anchors.quote_contains(_in(spark, d, "quotes"), sources).select("chat_id", "floor")


@rule("recovered", _sql("""with p as (select l.batch, ord, cursor, 'ordernumber' || cast(ord as varchar) || 'washere' as part, body from <lost> l join <bodies> b on b.batch = l.batch where ord > 0),
  q as (select *, substring(body, cursor + 2) as rest from p), r as (select *, strpos(rest, part) as i from q),
  n as (select batch, ord, cursor, i, strpos(substring(rest, i + 1), part) as again, 'nothinglikeitatall' as other, rest from r)
  select batch, ord, cast(cursor + i as bigint) as pos from n where i > 0 and again = 0"""))
def recovered(spark, d):
    return anchors.recover_fragments(_in(spark, d, "lost"), _in(spark, d, "bodies"))


_ALLOWED = [("item_profile", "item"), ("container_profile", "item")]


@rule("audit_components", _sql("""select entity_id, component, '/' as path, 'UNKNOWN_COMPONENT' as code from <components> where component = 'ghost'
  union all select entity_id, component, '/', 'COMPONENT_NOT_ALLOWED_ON_ENTITY' from <components> where component <> 'ghost' and entity_type = 'skill'
  union all select entity_id, component, '/schema_version', 'MISSING_REQUIRED_FIELD' from <components> where component <> 'ghost' and schema_version is null
  union all select entity_id, component, '/schema_version', 'UNSUPPORTED_VERSION' from <components> where component <> 'ghost' and schema_version = '9.9.9'"""))
def audit_components(spark, d):
    allowed = spark.createDataFrame(_ALLOWED, "component string, entity_type string")
    versions = spark.createDataFrame([(c, "0.1.0") for c, _ in _ALLOWED], "component string, schema_version string")
    return audit.component_rules(_in(spark, d, "components"), allowed, versions).select(*_V)


@rule("audit_duplicate_item", _sql("""select entity_id, component, array_path || '/' || cast(ord as varchar) as path, 'DUPLICATE_ITEM_ID' as code from <items> i
  where item_id is not null and exists (select 1 from <items> j where j.entity_id = i.entity_id and j.item_id = i.item_id and j.ord < i.ord)"""))
def audit_duplicate_item(spark, d):
    return audit.duplicate_items(_in(spark, d, "items")).select(*_V)


@rule("audit_relation_memory_owner", t.oracle(f"""{WITH}, l as (select distinct tgt_id as relation, src_id as memory, num as aspect from refs where component = 'relation_context_reference' and role = 'formation_basis')
  select relation as entity_id, 'relation_memory_index' as component, '/' || memory || '/' || cast(aspect as varchar) as path, 'RELATION_MEMORY_OWNER_MISMATCH' as code
  from l left join (select src_id, min(tgt_id) as owner from refs where component = 'memory_owner_reference' group by src_id) o on o.src_id = memory
  where owner is distinct from case when aspect = 1 then 'character_0C' || lpad('7', 24, '0') else owner end"""))
def audit_relation_memory_owner(spark, d):
    refs, _ = net(spark, d)
    links = refs.filter("component = 'relation_context_reference'").selectExpr("tgt_id as relation", "src_id as memory", "num as aspect", "role")
    owners = refs.filter("component = 'memory_owner_reference'").selectExpr("src_id as memory", "tgt_id as owner")
    seen = links.join(owners, "memory").selectExpr("relation", "aspect", f"case when aspect = 1 then {t.CHARACTER('7')} else owner end as owner").distinct()
    return audit.relation_memory_owners(links, seen, refs).select(*_V)


@rule("audit_quantity", _sql("""select entity_id, 'item_quantity' as component, '/data/quantity' as path, case when mode = 'stack' then 'STACK_ITEM_QUANTITY_REQUIRED' else 'NON_STACK_ITEM_HAS_QUANTITY' end as code
  from <goods> where (mode = 'stack') = (quantity is null)"""))
def audit_quantity(spark, d):
    return audit.quantities(_in(spark, d, "goods")).select(*_V)


_PERMISSIONS = [
    ("profile", None, "set", ["host"]), ("profile", "/data/*", "set", ["model"]), ("state", None, "set", ["model"]), ("state", "/data/*/b", "set", ["host"]),
    ("state", "/data/a/b", "set", ["model"]), ("state", None, "add", ["host", "model"]), ("profile", None, "add", ["model"]),
]


@rule("audit_permission", _sql("""select change_id as entity_id, component, path, 'INVALID_PERMISSION_OPERATION' as code from <changes> where operation = 'erase'
  union all select change_id, component, path, 'PERMISSION_DENIED' from <changes> where operation <> 'erase' and not case
    when operation = 'add' then component = 'state' or role = 'model' when component = 'profile' then role = case when path = '/data/a' then 'model' else 'host' end
    when path = '/data/c/b' then role = 'host' else role = 'model' end"""))
def audit_permission(spark, d):
    rules = spark.createDataFrame(_PERMISSIONS, "component string, pattern string, operation string, roles array<string>")
    return audit.permissions(_in(spark, d, "changes"), rules).select(*_V)


@rule("audit_relation", _sql("""with e as (select relation, min(who) filter (ord = 0) as a, min(who) filter (ord = 1) as b from <ends> group by relation), n as (select *, cast(relation as bigint) as r from e)
  select relation as entity_id, 'relation_endpoint_reference' as component, '/' as path, 'NON_CANONICAL_RELATION_ENDPOINT_ORDER' as code from n where a > b
  union all select relation, 'character_relation_aspects', '/0', 'RELATION_ASPECT_PARTICIPANT_MISMATCH' from n where r % 5 = 0
  union all select relation, 'character_relation_aspects', '/0', 'RELATION_PERSPECTIVE_OWNER_MISMATCH' from n where r % 7 = 0
  union all select relation, 'character_relation_aspects', '/0', 'RELATION_DISCLOSURE_TARGET_MISMATCH' from n where r % 11 = 0
  union all select relation, 'character_relation_state', '/0', 'RELATION_STATE_ENDPOINT_MISMATCH' from n where a = b
  union all select relation, 'character_relation_state', '/1', 'RELATION_STATE_ENDPOINT_MISMATCH' from n where r % 13 = 0 or a = b
  union all select relation, 'character_relation_state', '/2', 'RELATION_STATE_ENDPOINT_MISMATCH' from n where r % 3 = 0 and a = b
  union all select relation, 'character_relation_state', '/2', 'DUPLICATE_RELATION_DIRECTION' from n where r % 3 = 0
  union all select relation, 'character_relation_state', '/1', 'DUPLICATE_RELATION_DIRECTION' from n where a = b and r % 13 <> 0
  union all select relation, 'relation_memory_index', '/1', 'DUPLICATE_RELATION_MEMORY' from n where r % 17 = 0
  union all select relation, 'relation_memory_index', '/2', 'UNKNOWN_RELATION_ASPECT_REFERENCE' from n where r % 19 = 0
  union all select relation, 'relation_memory_index', '/0', 'RELATION_ASPECT_WITHOUT_MEMORY_BASIS' from n where r % 4 = 0 and r % 17 <> 0"""))
def audit_relation(spark, d):
    ends = _in(spark, d, "ends").withColumnRenamed("who", "character").withColumn("r", F.col("relation").cast("long"))
    pair = ends.groupBy("relation", "r").agg(F.min(F.when(F.col("ord") == 0, F.col("character"))).alias("a"), F.min(F.when(F.col("ord") == 1, F.col("character"))).alias("b"))
    who = F.when(F.col("r") % 5 == 0, F.array(F.col("a"), F.lit("zz"))).otherwise(F.array("a", "b"))
    roles = pair.select("relation", F.lit(0).alias("aspect"), F.explode(who).alias("character"), F.when(F.col("r") % 7 == 0, F.lit("yy")).otherwise(F.col("a")).alias("owner"), F.when(F.col("r") % 11 == 0, F.lit("xx")).alias("concealed"))
    states = pair.selectExpr("relation", "r", "inline(array(struct(0 as ord, a as src, b as dst), struct(1 as ord, if(r % 13 = 0, 'ww', b) as src, a as dst), struct(2 as ord, a as src, b as dst)))").filter("ord < 2 or r % 3 = 0")
    kept = pair.selectExpr("relation", "r", "inline(array(struct(0 as ord, 'm' as memory, 0 as aspect), struct(1 as ord, 'm' as memory, 0 as aspect), struct(2 as ord, 'n' as memory, 9 as aspect)))")
    kept = kept.filter("ord = 0 and (r % 4 <> 0 or r % 17 = 0) or ord = 1 and r % 17 = 0 or ord = 2 and r % 19 = 0")
    return audit.relations(ends.select("relation", "ord", "character"), roles, states.drop("r"), kept.drop("r")).select(*_V)


_PARENT = "component = 'parent_location_reference'"


def _nested(spark, d):
    """Nations that lie in the next one, in rings of five with tails of five."""
    return t.load(spark, d, f"select {t.LOCATION('n_nationkey')} as src_id, 'parent_location_reference' as component, {t.LOCATION('case when n_nationkey % 10 = 4 then n_nationkey - 4 else n_nationkey + 1 end')} as tgt_id, 'location' as tgt_type, cast(0 as bigint) as ord from {{nation}} where n_nationkey % 10 <> 9")


@rule("audit_location_cycle", t.oracle(f"select {t.LOCATION('n_nationkey')} as entity_id, 'parent_location_reference' as component, '/' as path, 'LOCATION_PARENT_CYCLE' as code from {{nation}} where n_nationkey % 10 = 0 and n_nationkey + 4 < 25"))
def audit_location_cycle(spark, d):
    return audit.parent_cycles(_nested(spark, d), "parent_location_reference", "LOCATION_PARENT_CYCLE").select(*_V)


@rule("net_memories", _sql("""select distinct 'memory_' || "key" as src_id, 'memory_owner_reference' as component, 'character_' || owner_key as tgt_id from <memories> where right("key", 1) <> '7' and cast(substring(owner_key, 2) as bigint) % 9 <> 0 and cast(substring(event_key, 2) as bigint) % 5 <> 0
  union all select distinct 'memory_' || "key", 'source_event_reference', 'event_' || event_key from <memories> where right("key", 1) <> '7' and cast(substring(owner_key, 2) as bigint) % 9 <> 0 and cast(substring(event_key, 2) as bigint) % 5 <> 0"""))
def net_memories(spark, d):
    rows = _in(spark, d, "memories")
    ids = lambda kind, c, keep: rows.filter(keep).selectExpr(f"'{kind}' as type", f"`{c}` as key", f"concat('{kind}_', `{c}`) as id").distinct()
    known = ids("memory", "key", "right(`key`, 1) <> '7'").unionByName(ids("character", "owner_key", "cast(substring(owner_key, 2) as bigint) % 9 <> 0")).unionByName(ids("event", "event_key", "cast(substring(event_key, 2) as bigint) % 5 <> 0"))
    return network.materialise_memories(rows.groupBy("key", "owner_key").agg(F.collect_set("event_key").alias("event_keys")), known)


@rule("capped_lists", _sql("""select entity_id, field, string_agg(value, '|' order by ord) as values from (select *, row_number() over (partition by entity_id, field order by ord, value) as n,
  case field when 'motivations' then 32 when 'current_emotions' then 16 when 'objectives' then 24 else 1000000 end as most from <lists>) where n <= most group by all"""))
def capped_lists(spark, d):
    return projection.cap_lists(_in(spark, d, "lists")).select("entity_id", "field", F.array_join("values", "|").alias("values"))


@rule("projected_placements", _sql("""select item, target, target_type, role from (select *, row_number() over (partition by item order by rank, target, target_type, role) as n from <stated>) where n = 1 and item <> target
  and case target_type when 'character' then role in ('carried', 'equipped', 'worn') when 'item' then role in ('contained', 'stored') else role in ('placed', 'stored') end"""))
def projected_placements(spark, d):
    rows = _in(spark, d, "stated")
    return projection.project_placements(rows.filter("rank = 0").drop("rank"), rows.filter("rank = 1").drop("rank"))


@rule("open_components", _sql("""select entity_id, type, component, case when cast(entity_id as bigint) % 2 = 0 and schema_version < '0.2.0' then '0.1.5' else schema_version end as schema_version,
  case when cast(entity_id as bigint) % 2 = 0 and schema_version < '0.2.0' then upper(data) else data end as data from <open>"""))
def open_components(spark, d):
    own = _in(spark, d, "open")
    late = own.filter("cast(entity_id as bigint) % 2 = 0").withColumn("schema_version", F.lit("0.1.5")).withColumn("data", F.upper("data"))
    return projection.overlay_open_fields(own, late)


@rule("proposals", t.oracle(f"select chat_id, cast(floor as bigint) as batch_ix, 'item:' || left(content, 4) as key from ({_MSG}) m where length(content) > 50"))
def proposals(spark, d):
    def extractor(frames):
        for f in frames:
            own = f[f["content"].str.len() > 50]
            yield pd.DataFrame({"chat_id": own["chat_id"], "batch_ix": own["floor"], "key": "item:" + own["content"].str[:4]})

    return projection.extract_proposals(messages(spark, d), extractor, "chat_id string, batch_ix long, key string")


@rule("normalised_plan", _sql("""select k, case action when 'new' then 'create' when 'upd' then 'update' else action end as action, case kind when 'stmt' then 'statement' else kind end as kind, coalesce(tags, '') as tags from <plan> where k % 10 <> 9"""))
def normalised_plan(spark, d):
    plan = _in(spark, d, "plan").withColumn("tags", F.when(F.col("tags").isNotNull(), F.array("tags")))
    steps = (lambda p: repair.normalise_enums(p, {"action": {"new": "create", "upd": "update"}, "kind": {"stmt": "statement"}}, ("tags",)), lambda p: p.filter("k % 10 <> 9"))
    return projection.normalise_plan(plan, steps).withColumn("tags", F.array_join("tags", ","))


_STAGES = "(values ('calm', 0.0, 5.0), ('warm', 5.0, 15.0), ('hot', 15.0, 40.0))"


@rule("host_stages", _sql(f"""with d as (select h.*, (select min(s) from {_STAGES} as r(s, low, high) where value >= low and value < high) as derived from <hosts> h)
  select * from (select id, case when host_mode <> mode then 'STAGE_EVALUATION_MODE_MISMATCH' when mode <> 'numeric_derived' and stage is null then 'EXPLICIT_SKILL_STAGE_REQUIRED'
    when mode = 'semantic' and value is not null then 'SEMANTIC_SKILL_STAGE_HAS_NUMERIC_VALUE' when stage = 'odd' then 'UNKNOWN_HOST_STAGE'
    when mode = 'numeric_derived' and value is null then 'NUMERIC_SKILL_STAGE_VALUE_REQUIRED' when binding = 'x' then 'UNKNOWN_HOST_NUMERIC_BINDING'
    when mode = 'numeric_derived' and derived is null then 'NUMERIC_STAGE_UNRESOLVED' when mode = 'numeric_derived' and stage <> derived then 'STALE_NUMERIC_STAGE_CACHE' end as code from d) where code is not null"""))
def host_stages(spark, d):
    stages = spark.sql(f"select f as framework, s as stage, 'b' as binding, cast(low as double) as low, cast(high as double) as high from {_STAGES} as r(s, low, high) lateral view explode(array('f0', 'f1', 'f2')) as f")
    return recall.host_stage_issues(_in(spark, d, "hosts"), stages.select("framework", "stage"), stages)


@rule("repaired_values", _sql("""select entity_id, path, case when path = '/data/title' then value when path = '/data/mode' and value = 'sgl' then 'single' when path = '/data/kind' and value = 'mult' then 'multiple' else value end as value,
  (path = '/data/mode' and value = 'sgl') or (path = '/data/kind' and value = 'mult') or (path = '/data/title' and value = 'sgl') as matched from <values>"""))
def repaired_values(spark, d):
    aliases = spark.createDataFrame([("/data/mode", "sgl", "single"), ("/data/kind", "mult", "multiple"), ("/data/title", "sgl", "single")], "path string, alias string, canonical string")
    return repair.repair_values(_in(spark, d, "values"), aliases)


_SIG = "lower(regexp_replace(name, '[\\s·・,，。．、:：;；''\"“”‘’「」『』()（）\\[\\]【】<>《》!！?？_\\-—…~]', '', 'g'))"


@rule("name_signatures", _sql(f"select k, {_SIG} as sig from <named>"))
def name_signatures(spark, d):
    return _in(spark, d, "named").select("k", tx.name_signature(F.col("name")).alias("sig"))


@rule("canonical_keys", _sql(f"""with s as (select k, {_SIG} as sig from <named>), h as (select a.k, min(b.k) as b, count(distinct b.k) as n from s a join s b on a.sig = b.sig and b.k % 2 = 0 where a.k % 3 = 0 group by a.k)
  select '1' as chat_id, 'p' || cast(k as varchar) as key, 'k' || cast(b as varchar) as known_key from h where n = 1"""))
def canonical_keys(spark, d):
    rows = _in(spark, d, "named").selectExpr("'1' as chat_id", "type", "k", "array(name) as names")
    known = rows.filter("k % 2 = 0").selectExpr("chat_id", "type", "concat('k', k) as key", "names")
    return resolve.canonical_keys(rows.filter("k % 3 = 0").selectExpr("chat_id", "type", "concat('p', k) as key", "names"), known, tx.name_signature)


@rule("rewritten_keys", _sql("""select cast(o_orderkey as varchar) as chat_id, case when o_custkey % 3 = 0 then 'K' else 'c' end || cast(o_custkey as varchar) as owner, case when o_custkey % 5 = 0 then 'c7' else 'x' || cast(o_custkey as varchar) end as target, o_orderstatus as other from {orders}"""))
def rewritten_keys(spark, d):
    plan = t.load(spark, d, "select cast(o_orderkey as string) as chat_id, 'c' || cast(o_custkey as string) as owner, case when o_custkey % 5 = 0 then 'c7' else 'x' || cast(o_custkey as string) end as target, o_orderstatus as other from {orders}")
    mapping = plan.filter("cast(substring(owner, 2) as bigint) % 3 = 0").selectExpr("chat_id", "owner as key", "concat('K', substring(owner, 2)) as known_key").distinct()
    return resolve.rewrite_keys(plan, mapping, ["owner", "target"])


@rule("quarantined", _sql("select entity_id, path, cast(entity_id as bigint) % 6 not in (3, 5) as guarded from <flat>"))
def quarantined(spark, d):
    kept, held = resolve.quarantine(_in(spark, d, "flat"))
    return kept.withColumn("guarded", F.lit(False)).unionByName(held.withColumn("guarded", F.lit(True))).drop("value")


@rule("roster_fallback", _sql("""select chat_id, "key", case when s < 4 and trim(name) <> '' then name when s > 0 then 'roster ' || alias end as name, case when s < 4 and description is not null then description when s > 0 then 'r' end as description,
  case when s = 4 then 'r' || alias when s = 0 then alias else alias || '|r' || alias end as aliases from <roster>"""))
def roster_fallback(spark, d):
    rows = _in(spark, d, "roster")
    plan = rows.filter("s < 4").selectExpr("chat_id", "key", "name", "description", "array(alias) as aliases")
    roster = rows.filter("s > 0").selectExpr("chat_id", "key", "concat('roster ', alias) as name", "'r' as description", "array(concat('r', alias)) as aliases")
    return resolve.roster_fallback(plan, roster).withColumn("aliases", F.array_join("aliases", "|"))


@rule("linked_actors", _sql("""select distinct chat_id, event_id, "key" from <actors> a where part < 2 and not exists (select 1 from <actors> p where p.chat_id = a.chat_id and p.event_id = a.event_id and p."key" = a."key" and cast(a.event_id as bigint) % 5 = 0)"""))
def linked_actors(spark, d):
    rows = _in(spark, d, "actors")
    return resolve.link_actors(rows.filter("part = 0"), rows.filter("part = 1"), rows.filter("cast(event_id as bigint) % 5 = 0"))


_E = "[\\s\"''“”‘’「」『』]"


@rule("bound_memories", _sql(f"""with e as (select chat_id, chat_id || '-' || cast(floor as varchar) as memory_id, 'o' || cast(floor % 3 as varchar) as owner, ref, regexp_replace(quote, '{_E}', '', 'g') as q from <quotes> where length(quote) > 20),
  s as (select *, regexp_replace(text, '{_E}', '', 'g') as body from <slices>),
  m as (select e.chat_id, memory_id, owner, event_id, q <> '' and contains(body, q) as holds from e join s on s.chat_id = e.chat_id and s.ref = e.ref)
  select chat_id, memory_id, owner, string_agg(distinct event_id, ',' order by event_id) as events from (select *, bool_or(holds) over (partition by chat_id, memory_id) as sure from m) where holds or not sure group by all"""))
def bound_memories(spark, d):
    rows = _in(spark, d, "quotes").filter("length(quote) > 20").selectExpr("chat_id", "concat(chat_id, '-', floor) as memory_id", "concat('o', floor % 3) as owner", "ref", "quote")
    out = resolve.bind_memories(rows.selectExpr("chat_id", "memory_id", "owner", "memory_id as description"), rows.select("memory_id", "ref", "quote"), _in(spark, d, "slices"))
    return out.withColumn("events", F.array_join("events", ","))


@rule("seeded_players", t.oracle("""select cast(c_custkey % 30 as varchar) as chat_id, 'character:' || c_name as key, c_name as names, c_custkey % 4 = 0 as stub from {customer} where c_custkey >= 30
  union all select cast(c_custkey as varchar), 'character:' || c_name, c_name, true from {customer} where c_custkey < 30"""))
def seeded_players(spark, d):
    rows = t.load(spark, d, "select cast(c_custkey % 30 as string) as chat_id, 'character:' || c_name as key, array(c_name) as names, c_custkey % 4 = 0 as stub, c_custkey from {customer}")
    players = rows.filter("c_custkey < 30").selectExpr("chat_id", "names[0] as player")
    return resolve.seed_player(rows, players).withColumn("names", F.array_join("names", "|"))


@rule("candidate_segments", _sql("""select chat_id, block_ix, cast(sum(case when block_ix > 0 and (hard or (selected and decision = 'new_event')) then 1 else 0 end) over (partition by chat_id order by block_ix) as bigint) as seg_ix from <candidates>"""))
def candidate_segments(spark, d):
    return segments.segments_from_candidates(_in(spark, d, "candidates")).select("chat_id", "block_ix", F.col("seg_ix").cast("long").alias("seg_ix"))


@rule("placed_starts", _sql("""with k as (select *, case when ord = 0 and continuing then 'old_tail' else coalesce(block_key, inner_key, new_key) end as own from <starts>)
  select chat_id, ord, coalesce(last_value(own ignore nulls) over (partition by chat_id order by ord), 'old_tail') as key, own is null as lost from k"""))
def placed_starts(spark, d):
    return segments.place_starts(_in(spark, d, "starts")).select("chat_id", "ord", "key", "lost")


def _anchored(spark, d):
    """Pairs of messages as segments; every third begins on the message that the one before ended on."""
    rows = messages(spark, d).withColumn("seg_ix", F.expr("floor div 2"))
    refs = rows.groupBy("chat_id", "seg_ix").agg(F.array_sort(F.collect_list(F.concat(F.lit("m"), F.col("floor").cast("string")))).alias("own"), F.min_by("content", F.col("floor")).alias("first"))
    shared = F.when((F.col("seg_ix") % 3 == 2), F.concat(F.array(F.concat(F.lit("m"), (2 * F.col("seg_ix") - 1).cast("string"))), F.col("own"))).otherwise(F.col("own"))
    return refs.select("chat_id", F.lit(0).alias("batch_ix"), "seg_ix", shared.alias("refs"), F.lit("m0").alias("anchor_ref"), F.expr("substring(first, 3, 30)").alias("anchor"))


@rule("repaired_anchors", t.oracle(f"""with m as (select chat_id, floor, 'm' || cast(floor as varchar) as ref, content, regexp_replace(content, '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g') as body from ({_MSG}) x),
  g as (select chat_id, floor // 2 as seg_ix, min(floor) as f, min_by(content, floor) as first from m group by all),
  h as (select g.*, regexp_replace(substring(first, 3, 30), '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g') as q, exists (select 1 from m where m.chat_id = g.chat_id and m.floor = 2 * seg_ix - 1) and seg_ix % 3 = 2 as shared from g),
  n as (select h.chat_id, seg_ix, count(*) as n, min(m.ref) as hit from h join m on m.chat_id = h.chat_id and (m.floor // 2 = seg_ix or (seg_ix % 3 = 2 and m.floor = 2 * seg_ix - 1)) and q <> '' and contains(body, q) group by all)
  select h.chat_id, h.seg_ix, case when not shared then case when seg_ix % 3 = 2 then null else 'm' || cast(f as varchar) end when n.n = 1 then hit else 'm0' end as anchor_ref,
    case when not shared then case when seg_ix % 3 = 2 then null else left(first, 32) end else substring(first, 3, 30) end as anchor from h left join n using (chat_id, seg_ix)
  where seg_ix % 3 <> 2 or shared"""))
def repaired_anchors(spark, d):
    sources = messages(spark, d).selectExpr("chat_id", "concat('m', floor) as ref", "content")
    rows = _anchored(spark, d)
    there = rows.withColumn("head", F.col("refs")[0]).join(sources.select("chat_id", F.col("ref").alias("head")), ["chat_id", "head"], "left_semi").drop("head")
    return segments.repair_anchors(there, sources).select("chat_id", "seg_ix", "anchor_ref", "anchor")


@rule("block_partitions", t.oracle("""with b as (select distinct cast(user_id as varchar) as chat_id, event_id // 40 as block, event_id % 200 as ref from {events}), s as (select distinct cast(user_id as varchar) as chat_id, event_id % 3 as segment, event_id % 200 as ref from {events} where event_id % 7 <> 0),
  j as (select b.chat_id, block, b.ref, segment from b left join s on s.chat_id = b.chat_id and s.ref = b.ref)
  select chat_id, block, min(segment) as segment from j group by all having count(*) = count(segment) and count(distinct segment) = 1 and count(*) = count(distinct ref) and not bool_or(ref % 50 = 1)"""))
def block_partitions(spark, d):
    rows = t.load(spark, d, "select cast(user_id as string) as chat_id, event_id div 40 as block, event_id % 200 as ref, event_id % 3 as segment, event_id % 7 <> 0 as there from {events}")
    return segments.block_partition_map(rows.select("chat_id", "block", "ref").distinct(), rows.filter("there").select("chat_id", "segment", "ref").distinct(), rows.filter("ref % 50 = 1").select("chat_id", "ref").distinct())


_C = "regexp_replace({}, '[\\s\\p{{{{Z}}}}\\p{{{{P}}}}*_`~]', '', 'g')"


@rule("merged_texts", _sql(f"select k, case when contains({_C.format('a')}, {_C.format('b')}) then a when contains({_C.format('b')}, {_C.format('a')}) then b else a || chr(10) || b end as text from <texts>"))
def merged_texts(spark, d):
    return _in(spark, d, "texts").select("k", segments.merge_texts(F.col("a"), F.col("b")).alias("text"))


@rule("summary_increments", _sql("""with x as (select k, a, trim(b) as b, regexp_replace(a, '[^\\p{{L}}\\p{{N}}]+', '', 'g') as la, regexp_replace(b, '[^\\p{{L}}\\p{{N}}]+', '', 'g') as lb from <texts>),
  s as (select *, case when b = '' then 'missing' when la <> '' and lb <> '' and contains(la, lb) then 'contained' when la <> '' and contains(lb, la) then 'replaced' else 'appended' end as status from x)
  select k, status, case when status in ('missing', 'contained') then a when status = 'replaced' or a = '' then b else a || chr(10) || b end as summary from s"""))
def summary_increments(spark, d):
    summary, status = segments.summary_increment(F.col("a"), F.col("b"))
    return _in(spark, d, "texts").select("k", summary.alias("summary"), status.alias("status"))


@rule("stale_copies", _sql("""with g as (select o.event_id as copied, u.*, o.title as ot, o.description as od, x.title as xt, x.description as xd, x.summary as xs from <copies> u join <targets> x on x.chat_id = u.chat_id and x.event_id = u.event_id join <targets> o on o.chat_id = u.chat_id and o.summary = u.summary and o.event_id <> u.event_id)
  select chat_id, update_id, min(copied) as copied from g where trim(summary) <> '' and 1 + cast(title = ot as int) + cast(description = od as int) >= greatest(2, 1 + cast(title = xt as int) + cast(description = xd as int) + cast(summary = xs as int)) group by all"""))
def stale_copies(spark, d):
    return segments.drop_stale_copies(_in(spark, d, "copies"), _in(spark, d, "targets"))[1]


@rule("effective_updates", _sql("select chat_id, segment, k from <noops> where (segment = 'F' and cast(chat_id as bigint) % 2 = 0) or trim(coalesce(delta, '')) <> '' or n_details > 0"))
def effective_updates(spark, d):
    rows = _in(spark, d, "noops")
    return segments.drop_noop_updates(rows, rows.filter("segment = 'F' and cast(chat_id as bigint) % 2 = 0")).select("chat_id", "segment", "k")


@rule("canonical_details", _sql(f"""with m as (select d.event_id, d.ord, d.ref, h.ref as there, contains({_C.format('text')}, {_C.format('content')}) as c from <details> d join <held> h on h.event_id = d.event_id),
  f as (select event_id, ord, (max({{{{'o': there = ref, 'a': there}}}}) filter (c)).a as held, max(there) filter (there = ref) as own from m group by all)
  select d.event_id, d.ord, coalesce(held, own) as ref, case when held is not null then 'verbatim' else 'paraphrase' end as fidelity from <details> d join f using (event_id, ord) where coalesce(held, own) is not null"""))
def canonical_details(spark, d):
    return segments.canonical_details(*_ins(spark, d, "details", "held"))[0].select("event_id", "ord", "ref", "fidelity")


@rule("supported_times", _sql("""select w.event_id, part, expression from <when> w join <said> s on s.event_id = w.event_id
  where (expression = 'May 12, noon' and line = 'on May the 12 about noon') or (expression = 'dusk' and line = 'at dusk') or (expression = 'x.1' and line = 'x.1 it was')"""))
def supported_times(spark, d):
    return segments.supported_times(_in(spark, d, "when"), _in(spark, d, "said"))


@rule("sanitized_times", _sql("""with x as (select *, case when event_id % 2 = 0 or start = old_start or start = old_end then start end as s, case when status <> 'forming' and (event_id % 3 = 0 or "end" = old_start or "end" = old_end) then "end" end as e from <spans>)
  select event_id, case when s is not null then coalesce(old_start, s) end as start, case when s is not null then e end as "end" from x"""))
def sanitized_times(spark, d):
    rows = _in(spark, d, "spans")
    ok = rows.filter("event_id % 2 = 0").selectExpr("event_id", "'start' as part").unionByName(rows.filter("event_id % 3 = 0").selectExpr("event_id", "'end' as part"))
    return segments.sanitize_times(rows, ok)


@rule("locked_boundaries", _sql("""select chat_id, "key", o_orderkey % 4 as start, case when o_orderkey % 3 <> 0 then summary_add end as summary_add, case when o_orderkey % 3 <> 0 then description end as description from <replies> where o_orderkey % 5 <> 0"""))
def locked_boundaries(spark, d):
    rows = _in(spark, d, "replies").withColumn("details", F.lit(""))
    locked = rows.filter("o_orderkey % 5 <> 0").selectExpr("chat_id", "key", "o_orderkey % 4 as start")
    return segments.lock_boundaries(rows.filter("o_orderkey % 3 <> 0").withColumn("start", F.lit(99)), locked).select("chat_id", "key", "start", "summary_add", "description")


@rule("plan_audit", _sql("""with r as (select *, o_orderkey as k from <replies>)
  select severity, code, count(*) as n from (
    select 'error' as severity, 'MISSING_SLOT' as code from r where k % 3 = 0 and k % 5 <> 0 union all select 'error', 'EXTRA_SLOT' from r where k % 5 = 0 and k % 3 <> 0 union all select 'error', 'EXTRA_SLOT' from r where k % 5 = 0 and k % 21 = 1
    union all select 'error', 'DUPLICATE_SLOT' from r where k % 21 = 1 union all select 'error', 'INVALID_DETAIL_KIND' from r where k % 6 <> 1 and k % 6 <> 2 union all select 'error', 'DETAIL_REF_OUTSIDE_BATCH' from r where k % 4 = 3
    union all select 'error', 'TOO_MANY_MEMORIES' from r where k % 6 > 3 union all select 'warning', 'LONG_SUMMARY' from r, range(1, 3) c(i) where k % 3 <> 0 and k % 7 = 0 and (i = 1 or k % 21 = 1)
    union all select 'warning', 'LONG_DESCRIPTION' from r, range(1, 3) c(i) where k % 3 <> 0 and k % 8 = 0 and (i = 1 or k % 21 = 1)) group by all"""))
def plan_audit(spark, d):
    r = _in(spark, d, "replies").withColumnRenamed("o_orderkey", "k")
    up = r.filter("k % 3 <> 0").selectExpr("chat_id", "key", "if(k % 7 = 0, repeat('s', 501), '') as summary", "if(k % 8 = 0, repeat('d', 161), '') as description", "n_details", "k")
    up = up.unionByName(up.filter("k % 21 = 1")).drop("k")
    details = r.selectExpr("chat_id", "key", "case k % 6 when 1 then 'statement' when 2 then 'action' when 3 then 'other' end as kind", "concat('r', k % 4) as ref")
    sources = r.selectExpr("chat_id", "explode(array('r0', 'r1', 'r2')) as ref").distinct()
    rows = segments.plan_violations(up, r.filter("k % 5 <> 0").select("chat_id", "key"), details, r.selectExpr("chat_id", "key", "k % 6 as n"), sources)
    return rows.groupBy("severity", "code").agg(F.count("*").alias("n"))


@rule("pending_requests", _sql("select event_id, event_id % 4 <> 1 or event_id % 12 = 1 as pending from <requests>"))
def pending_requests(spark, d):
    rows = _in(spark, d, "requests")
    digest = F.sha2(F.to_json(F.struct("context", "request", F.sha2("credential", 256).alias("credential"))), 256)
    cache = rows.filter("event_id % 4 = 1").select(digest.alias("hash"), F.when(F.col("event_id") % 12 == 1, "failed").otherwise("ok").alias("status"), F.lit("r").alias("result"))
    todo, hits = store.pending_requests(rows, cache)
    return todo.select("event_id", F.lit(True).alias("pending")).unionByName(hits.select("event_id", F.lit(False).alias("pending")))


@rule("batch_resume", _sql("""select chat_id, coalesce(max(batch_ix) filter (committed) + 1, 0) as next_batch, min(batch_ix) filter (failed and not committed) as first_failed,
  coalesce(min(batch_ix) filter (failed and not committed) <= coalesce(max(batch_ix) filter (committed) + 1, 0), false) as stopped from <runs> group by chat_id"""))
def batch_resume(spark, d):
    return store.batch_resume(_in(spark, d, "runs"))


@rule("diagnostics", _sql("""select chat_id, batch_ix, task, 'error' as severity, unnest(string_split(errors, ',')) as message from <problems> where errors is not null union all select chat_id, batch_ix, task, 'warning', warnings from <problems> where warnings is not null"""))
def diagnostics(spark, d):
    split = lambda c: F.coalesce(F.split(c, ","), F.array().cast("array<string>")).alias(c)
    return store.diagnostics(_in(spark, d, "problems").select("chat_id", "batch_ix", "task", split("errors"), split("warnings")))


@rule("read_entities", t.oracle("""select '1' as chat_id, cast(p_partkey as varchar) as entity_id, 'item' as entity_type, unnest(['item_profile', 'item_quantity']) as component, '0.1.0' as schema_version,
  unnest(['{{"kind":"' || p_type || '"}}', '{{"quantity":' || cast(p_size as varchar) || '}}']) as data from {part}"""))
def read_entities(spark, d):
    body = t.load(spark, d, "select * from {part}").selectExpr("'1' as chat_id", """to_json(named_struct('id', cast(p_partkey as string), 'type', 'item', 'description', p_name, 'components',
      named_struct('item_profile', named_struct('schema_version', '0.1.0', 'data', named_struct('kind', p_type)), 'item_quantity', named_struct('schema_version', '0.1.0', 'data', named_struct('quantity', p_size))))) as entity_json""")
    return chats.read_entities(body)[1]


def _folder(spark):
    return f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"


@rule("audit_log", t.oracle("select cast(user_id as varchar) as chat_id, count(*) as n, count(distinct event_type) as kinds from {events} group by all"))
def audit_log(spark, d):
    folder = _folder(spark)
    rows = t.load(spark, d, "select cast(user_id as string) as chat_id, event_type as category, 'seen' as action, props as detail, event_id from {events}")
    for k in (0, 1):  # two writers, one after the other
        chats.append_audit(spark, folder, rows.filter(F.col("event_id") % 2 == k).drop("event_id"))
    return chats.read_audit(spark, folder).groupBy("chat_id").agg(F.count("*").alias("n"), F.countDistinct("category").alias("kinds"))


@rule("commits", t.oracle("select event_type, count(*) as n from {events} where event_id % 4 <> 3 group by all"))
def commits(spark, d):
    """Batches by event_id % 4; the last is never committed, the second comes twice, and the first again with other rows."""
    folder = _folder(spark)
    rows = t.load(spark, d, "select event_id, event_type from {events}")
    part = lambda k: {"state": rows.filter(F.col("event_id") % 4 == k), "receipts": rows.filter(F.col("event_id") % 4 == k).select("event_id")}
    for key, k in (("a", 0), ("b", 1), ("b", 1), ("a", 3), ("c", 2)):
        chats.write_commit(part(k), folder, key)
    return chats.read_committed(spark, folder, "state").groupBy("event_type").agg(F.count("*").alias("n"))


@rule("chat_files", t.oracle(f"select chat_id, floor, role, 'floor-' || cast(floor + 1 as varchar) as source_id, sha256(content) as version from ({_MSG}) m"))
def chat_files(spark, d):
    """Messages written as one JSONL file for each chat, with a header line, and read again."""
    folder = _folder(spark)
    rows = messages(spark, d)
    line = F.to_json(F.struct(F.col("content").alias("mes"), F.col("role").alias("name"), (F.col("role") == "user").alias("is_user"), (F.col("role") == "system").alias("is_system")))
    body = F.concat(F.lit('{"user_name":"u"}\n'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("floor", line.alias("j")))), lambda x: x["j"]), "\n"))
    rows.groupBy("chat_id").agg(body.alias("value")).repartition("chat_id").write.partitionBy("chat_id").option("maxRecordsPerFile", 1).text(folder)
    back = chats.read_chat_messages(spark, f"{folder}/*/*").drop("chat_id")
    keyed = rows.select("chat_id", F.sha2("content", 256).alias("version"), "role", F.concat(F.lit("floor-"), (F.col("floor") + 1).cast("string")).alias("source_id"), "floor")
    # which messages were read again, each once: equal ones of many chats must not meet in pairs
    read = back.select("role", "source_id", "version").distinct()
    return keyed.join(read, ["role", "source_id", "version"], "left_semi").select("chat_id", "floor", "role", "source_id", "version").distinct()


@rule("stream_sources", t.oracle("""with s as (select cast(user_id as varchar) as chat_id, 'r' || cast(event_id % 50 as varchar) as ref, md5(event_type) as sha, event_id % 3 <> 0 as early from {events}),
  k as (select chat_id, ref, coalesce(min(sha) filter (early), min(sha)) as kept from s group by all)
  select chat_id, ref, kept as sha, false as conflict from k union all select distinct chat_id, ref, sha, true from s join k using (chat_id, ref) where sha <> kept"""))
def stream_sources(spark, d):
    """Events as sources with refs that repeat: some by one stream, then all by a stream with a new checkpoint, of which only new refs are added."""
    folder = _folder(spark)
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    for k, some in enumerate(("event_id % 3 <> 0", "true")):
        rows = stream.filter(some).selectExpr("cast(user_id as string) as chat_id", "concat('r', event_id % 50) as ref", "md5(event_type) as sha")
        ledger.append_sources(rows, f"{folder}/store", f"{folder}/at-{k}").start().awaitTermination()
    kept = ledger.read_sources(spark, f"{folder}/store").select("chat_id", "ref", "sha", F.lit(False).alias("conflict"))
    return kept.unionByName(ledger.read_conflicts(spark, f"{folder}/store").select("chat_id", "ref", F.col("new_sha").alias("sha"), F.lit(True).alias("conflict")))


@rule("stream_commits", t.oracle("select event_type, count(*) as n from {events} group by all"))
def stream_commits(spark, d):
    """Rows that a first stream commits in part, and a second one with a new checkpoint delivers again with all others: each counts once."""
    folder = _folder(spark)
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]").select("event_id", "event_type")
    for k, some in enumerate(("event_id % 2 = 0", "true")):
        ledger.append_rows(stream.filter(some), f"{folder}/store", "events", ["event_id"], f"{folder}/at-{k}").start().awaitTermination()
    return ledger.read_rows(spark, f"{folder}/store", "events").groupBy("event_type").agg(F.count("*").alias("n"))


@rule("split_edits", _sql(f"""select m.chat_id, m.floor, e.floor is not null as edited from ({_MSG}) m left join <edits> e on e.chat_id = m.chat_id and e.floor = m.floor where e.floor is null or e.version <> md5(m.content)"""))
def split_edits(spark, d):
    own = messages(spark, d).withColumn("version", F.md5("content"))
    new, edits = streaming.split_edits(own, _in(spark, d, "edits"))
    return new.select("chat_id", "floor", F.lit(False).alias("edited")).unionByName(edits.select("chat_id", "floor", F.lit(True).alias("edited")))


@rule("plan_dispositions", _sql("""with k as (select *, case slot when 'pending_tail' then 0 when 'forming_existing' then 1 when 'new_1' then 3 when 'new_2' then 4 end as r from <slots>),
  g as (select p.*, count(k.slot) as n, coalesce(bool_or(r = 0), false) as pend, coalesce(bool_or(r = 1), false) as form, count(distinct r) filter (r > 1) as new, coalesce(max(r) filter (seg_ix = 0) > max(r) filter (seg_ix = 1), false) as back,
    case when c % 4 = 0 then 2 when c % 2 = 0 then 1 else 0 end as b from <plans> p left join k on k.chat_id = p.chat_id group by all)
  select chat_id, unnest(list_filter([case when disposition = 'odd' then 'INVALID_DISPOSITION' end, case when not has_events and disposition <> 'absent' then 'FIRST_PLAN_NOT_ABSENT' end, case when has_events and disposition = 'absent' then 'ABSENT_WITH_EVENTS' end,
    case when disposition = 'merge_into_pending' and not (has_pending and has_forming) then 'MERGE_WITHOUT_BOTH_EVENTS' end, case when disposition = 'keep_distinct' and not has_forming then 'DISTINCT_WITHOUT_FORMING' end, case when n = 0 then 'NO_SEGMENTS' end,
    case when back then 'SLOT_ORDER' end, case when disposition = 'merge_into_pending' and form then 'MERGE_WITH_FORMING_SLOT' end, case when disposition = 'merge_into_pending' and new = 0 then 'MERGE_WITHOUT_NEW_EVENT' end,
    case when disposition = 'keep_distinct' and pend then 'DISTINCT_WITH_PENDING_SLOT' end, case when disposition = 'absent' and (pend or form) then 'ABSENT_WITH_OLD_SLOT' end,
    case when b <> case when disposition = 'absent' then greatest(new - 1, 0) else new end then 'BOUNDARY_COUNT' end], lambda x: x is not null)) as code from g"""))
def plan_dispositions(spark, d):
    plans = _in(spark, d, "plans")
    given = plans.filter("c % 2 = 0").selectExpr("chat_id", "batch_ix", "explode(sequence(0, if(c % 4 = 0, 1, 0))) as ix")
    state = plans.select("chat_id", "batch_ix", "has_events", "has_pending", "has_forming")
    return segments.disposition_violations(plans.select("chat_id", "batch_ix", "disposition"), _in(spark, d, "slots"), state, given).select("chat_id", "code")


def _pairs(spark, d):
    """Pairs of messages as segments new_1, new_2, ... of a first plan; every third segment shares a message with the one before. Anchors quote the messages."""
    rows = messages(spark, d).withColumn("seg_ix", F.expr("floor div 2"))
    one = rows.groupBy("chat_id", "seg_ix").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("m"), F.col("floor").cast("string")).alias("ref"), F.expr("substring(content, 3, 20)").alias("quote")))).alias("own"))
    back = F.concat(F.lit("m"), (2 * F.col("seg_ix") - 1).cast("string"))
    refs = F.transform("own", lambda x: x["ref"])
    one = one.withColumn("refs", F.when(F.col("seg_ix") % 3 == 2, F.concat(F.array(back), refs)).otherwise(refs)).withColumn("batch_ix", F.lit(0)).withColumn("k", (F.col("seg_ix") + F.col("chat_id").cast("long")) % 7)
    starts = F.expr("case k when 0 then slice(own, 1, 0) when 1 then concat(own, own) when 2 then transform(own, x -> struct('m99' as ref, x.quote as quote)) when 3 then transform(own, x -> struct(x.ref as ref, 'nowhere' as quote)) else own end")
    return rows, one.withColumn("starts", starts).withColumn("ends", F.expr("if(k = 4, transform(own, x -> struct(x.ref as ref, 'nowhere' as quote)), slice(own, 1, 0))")).withColumn("slot", F.concat(F.lit("new_"), (F.col("seg_ix") + 1).cast("string")))


@rule("plan_anchors", None)
def plan_anchors(spark, d):
    rows, one = _pairs(spark, d)
    given = one.filter("seg_ix > 0").selectExpr("chat_id", "batch_ix", "seg_ix - 1 as ix", "if(k = 5, 'new_9', slot) as slot", "if(k = 6, reverse(starts), starts) as anchors")
    plans = one.select("chat_id", "batch_ix", F.lit("absent").alias("disposition")).distinct()
    texts = rows.select("chat_id", F.lit(0).alias("batch_ix"), F.concat(F.lit("m"), F.col("floor").cast("string")).alias("ref"), "content")
    found = segments.anchor_violations(plans, one.select("chat_id", "batch_ix", "seg_ix", "slot", "refs", "starts", "ends"), given, texts)
    return found.groupBy("code").agg(F.count("*").alias("n"))


@rule("plan_contents", _sql("""with r as (select *, o_orderkey as k, coalesce(nullif(o_orderkey % 6, 0), 0) as n from <replies>),
  d as (select k, i, k % 6 as n from r, range(0, 6) t(i) where i < k % 6)
  select severity, code, count(*) as n from (
    select 'error' as severity, 'EMPTY_STORY_SUMMARY' as code from r where k % 7 = 0 union all select 'error', 'MISSING_LIST_LOCATIONS_ADD' from r where k % 8 = 0 union all select 'warning', 'LONG_SUMMARY' from r where k % 7 = 1
    union all select 'error', 'FOREIGN_DETAIL_KEPT' from r where k % 5 = 0 union all select 'warning', 'MANY_DETAILS' from r where 1 + k % 6 > 5
    union all select 'error', 'INVALID_DETAIL_KIND' from d where (k + i) % 9 = 0 union all select 'error', 'EMPTY_DETAIL' from d where (k + i) % 10 = 0 union all select 'error', 'DETAIL_WITHOUT_SOURCE' from d where (k + i) % 11 = 0
    union all select 'error', 'DETAIL_SOURCE_OUTSIDE_SLOT' from d where (k + i) % 11 <> 0 and (k + i) % 13 = 0
    union all select 'warning', 'DETAIL_NOT_VERBATIM' from d where (k + i) % 11 <> 0 and (k + i) % 13 <> 0 and (k + i) % 10 <> 0 and (k + i) % 4 <> 1 and (k + i) % 3 = 0) group by all"""))
def plan_contents(spark, d):
    r = _in(spark, d, "replies").withColumnRenamed("o_orderkey", "k")
    none = "array_remove(array(''), '')"
    lists = [f"{none} as {c}" for c in segments.CONTENT_LISTS if c not in ("locations_add", "key_details_keep")]
    updates = r.selectExpr("chat_id", "key", "'d' as description", "case k % 7 when 0 then ' ' when 1 then repeat('s', 501) else 's' end as story_summary", f"if(k % 8 = 0, null, {none}) as locations_add",
                           "array(if(k % 5 = 0, 'other', 'x')) as key_details_keep", *lists)
    each = r.filter("k % 6 > 0").selectExpr("chat_id", "key", "explode(sequence(0L, k % 6 - 1)) as ord", "k").withColumn("j", F.expr("k + ord"))
    details = each.selectExpr("chat_id", "key", "ord", "if(j % 9 = 0, 'odd', 'action') as kind", "case when j % 10 = 0 then ' ' when j % 3 = 0 then 'not there' else 'the text' end as content",
                              "case when j % 11 = 0 then array_remove(array(''), '') when j % 13 = 0 then array('r9') else array('r1', 'r2') end as refs", "if(j % 4 = 1, 'paraphrase', 'verbatim') as fidelity")
    refs = r.selectExpr("chat_id", "key", "explode(array('r1', 'r2')) as ref")
    slices = refs.withColumn("text", F.when(F.col("ref") == "r2", "of the, text of it").otherwise("other words"))
    return segments.content_violations(updates, refs, r.selectExpr("chat_id", "key", "'x' as id"), details, slices).groupBy("severity", "code").agg(F.count("*").alias("n"))


@rule("event_plan", _sql("""with e as (select *, (event_no - 1) // 8 as batch_ix, (event_no - 1) % 8 as source_ix from (select cast(user_id as varchar) as chat_id, event_id, row_number() over (partition by user_id order by ts, event_id) as event_no, event_type from {events})),
  s as (select distinct chat_id, batch_ix, case when event_type = 'error' then source_ix else 0 end as source_ix from e where event_type = 'error' or source_ix = 0),
  g as (select *, lead(source_ix) over (partition by chat_id, batch_ix order by source_ix) as nxt, batch_ix > 0 and source_ix = 0 as old from s),
  n as (select *, case when old then 'forming_existing' else 'new_' || cast(sum(case when old then 0 else 1 end) over (partition by chat_id, batch_ix order by source_ix) as varchar) end as slot,
    sum(case when old then 0 else 1 end) over (partition by chat_id order by batch_ix, source_ix) as event_no from g)
  select n.chat_id, n.batch_ix, slot, cast(greatest(n.event_no, 1) as bigint) as event_no, count(e.event_id) as n_texts, max(case when slot = 'new_1' then 'told' end) as note
  from n join e on e.chat_id = n.chat_id and e.batch_ix = n.batch_ix and e.source_ix >= n.source_ix and (nxt is null or e.source_ix < nxt) group by all"""))
def event_plan(spark, d):
    """Errors start events at the start of a message; a forming event goes on into the next batch."""
    ev = t.load(spark, d, t.CHAT_EVENTS).withColumn("batch_ix", F.expr("(event_no - 1) div 8")).withColumn("source_ix", (F.col("event_no") - 1) % 8)
    state = ev.select("chat_id", "batch_ix").distinct().selectExpr("chat_id", "batch_ix", "false as has_pending", "batch_ix > 0 as has_forming", "false as starts_anew")
    found = ev.filter("event_type = 'error'").selectExpr("chat_id", "batch_ix", "source_ix", "0L as offset", "false as in_old")
    updates = state.selectExpr("chat_id", "batch_ix", "'new_1' as slot", "'told' as note")
    roster = ev.selectExpr("chat_id", "batch_ix", "concat('k', event_id) as key", "source_ix", "0L as offset", "array(event_type) as aliases")
    plan = segments.event_plan(found, state, ev.selectExpr("chat_id", "batch_ix", "source_ix", "event_type as content"), roster, updates)
    keys = ["chat_id", "batch_ix", "slot"]
    listed = plan["roster"].groupBy(*keys).agg(F.count("*").alias("n_texts"))
    same = plan["texts"].groupBy(*keys).agg(F.count("*").alias("n_own"))
    rows = plan["updates"].join(listed, keys).join(same, keys).filter("n_own = n_texts")
    return rows.select(*keys, F.col("event_no").cast("long").alias("event_no"), "n_texts", "note")


@rule("updated_events", _sql("""select event_id, case when event_id % 3 = 0 then description else 'old' end as description, case when event_id % 4 = 0 then 's' else 'was' end as summary,
  case event_id % 2 when 0 then 'b|c' else 'a|b' end as participants, case when event_id % 6 = 0 then 'n' else 'l' end as locations, case when event_id % 7 = 0 then 'q|w' else 'q' end as unresolved, case event_id % 5 when 0 then 'x' when 1 then 'x|y' else 'x|y|z' end as details from (select o_orderkey as event_id, o_orderpriority as description from {orders})"""))
def updated_events(spark, d):
    rows = t.load(spark, d, "select o_orderkey as event_id, o_orderpriority from {orders}")
    detail = lambda *names: "array(" + ", ".join(f"named_struct('id', '{n}', 'content', '{n}', 'ref', 'r')" for n in names) + ")"
    events = rows.selectExpr("event_id", "'old' as description", "'was' as summary", "array('a', 'b') as participants", "array('l') as locations", "array('q') as unresolved", f"{detail('x', 'y')} as details")
    updates = rows.selectExpr("event_id", "case when event_id % 3 = 0 then o_orderpriority else ' ' end as description", "case when event_id % 4 = 0 then 's' end as summary",
                              "case when event_id % 2 = 0 then array('c', 'b') end as participants_add", "case when event_id % 2 = 0 then array('a') end as participants_remove",
                              "case when event_id % 6 = 0 then array('n') end as locations_add", "case when event_id % 6 = 0 then array('l') end as locations_remove",
                              "case when event_id % 7 = 0 then array('w') end as unresolved_add", "cast(null as array<string>) as unresolved_remove",
                              "case when event_id % 5 = 0 then array('x') end as kept", f"case when event_id % 5 > 1 then {detail('x', 'z')} end as new_details")
    out = segments.apply_event_updates(events, updates)
    out = out.withColumns({c: F.array_join(c, "|") for c in ("participants", "locations", "unresolved")})
    return out.withColumn("details", F.array_join(F.transform("details", lambda x: x["id"]), "|"))


QUERIES = {name: query for name, (query, _) in _RULES.items()}
SQL = {name: sql for name, (_, sql) in _RULES.items() if sql}
