"""Queries over anchoring, clues and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from storynet.functions import text as tx
from storynet.operators import anchors, resolve
from storynet.plans.network_queries import WITH, net
from storynet.plans.store_queries import messages
from storynet.sources import chats
from storynet.sources import tables as t

_DROP_SQL = r"[\s\p{Z}\p{P}*_`~]"


def docs(spark, d):
    return t.load(spark, d, "select cast(doc_id as string) as ref, text as content from {documents}")


def anchor_text(spark, d):
    return docs(spark, d).select("ref", F.sha2(tx.anchor_text(F.coalesce("content", F.lit(""))), 256).alias("sha"))


def quote_matches(spark, d):
    return anchors.quote_search(t.load(spark, d, "select item_id as quote_id, text as quote from {benchmark}"), docs(spark, d))


def quote_places(spark, d):
    """Places of the last words of each message in its own text."""
    rows = messages(spark, d).selectExpr("floor as quote_id", "concat(chat_id, '.', floor) as ref", "right(content, 20) as quote", "content")
    return anchors.quote_spans(rows)


def evidence_relocate(spark, d):
    """Quotes taken from the message after their stated one."""
    rows = messages(spark, d).withColumn("ref", F.concat(F.lit("m"), F.col("floor").cast("string")))
    quotes = rows.filter("length(content) > 80 and floor > 0").selectExpr("chat_id", "concat(chat_id, '-', floor) as evidence_id", "concat('m', floor - 1) as ref", "substring(content, 21, 40) as quote")
    return anchors.relocate_evidence(quotes, rows.select("chat_id", "ref", "content")).select("chat_id", "evidence_id", "ref", "found_ref")


def located(spark, d):
    rows = t.load(spark, d, t.CHAT_EVENTS).selectExpr("chat_id as batch", "cast(floor(event_no / 2) as bigint) as ord", "event_id % 97 as pos")
    return anchors.locate_in_order(rows)


def fuzzy_units(spark, d):
    rows = messages(spark, d)
    return anchors.fuzzy_locate(rows.selectExpr("chat_id as batch", "floor as quote_id", "substring(content, 3, 60) as quote"), rows.selectExpr("chat_id as batch", "floor as unit", "content as text"))


def clean_pages(spark, d):
    page = t.load(spark, d, "select page_id, coalesce(html, '') as html from {pages}")
    return page.select("page_id", F.sha2(F.regexp_replace(tx.strip_markup(F.col("html"), scene=False), r"\s+", " "), 256).alias("sha"))


def clean_chats(spark, d):
    return tx.clean_messages(messages(spark, d)).select("chat_id", "floor", F.sha2("content", 256).alias("sha"))


def scene_parts(spark, d):
    rows = t.load(spark, d, "select o_orderkey, o_orderpriority || ' · ' || case when o_orderkey % 3 = 0 then 'dusk' else cast(o_orderdate as string) end || ' · noon' as head from {orders}")
    place, time = tx.scene_header_parts(F.col("head"))
    return rows.select("o_orderkey", place.alias("place"), time.alias("time"))


def _names(spark, d):
    """Known parts, suppliers, customers and nations, and mentions of them with case, space and punctuation noise; nations also as organizations."""
    known = t.load(spark, d, """select '1' as chat_id, 'item' as type, 'item:' || p_name || ' ' || cast(p_partkey as string) as key, array(p_name || ' ' || cast(p_partkey % 1500 as string)) as names from {part}
      union all select '1', 'organization', 'organization:' || s_name, array(s_name) from {supplier}
      union all select '1', 'character', 'character:' || c_name, array(c_name) from {customer}
      union all select '1', 'location', 'location:' || n_name, array(n_name) from {nation}
      union all select '1', 'organization', 'organization:' || n_name, array(n_name) from {nation}""")  # fmt: skip
    mentions = t.load(spark, d, """select '1' as chat_id, 'p' || cast(p_partkey as string) as mention_id, 'item' as type, 'item:m' || cast(p_partkey as string) as key, array(upper(p_name) || '、 ' || cast(p_partkey as string)) as names from {part}
      union all select '1', 'c' || cast(c_custkey as string), 'character', 'character:' || c_name, array(lower(c_name)) from {customer}
      union all select '1', 'n' || cast(n_nationkey as string), 'location', 'location:x' || cast(n_nationkey as string), array(n_name) from {nation}
      union all select '1', 's' || cast(s_suppkey as string), 'organization', 'group:' || s_name, array(s_name) from {supplier}""")  # fmt: skip
    return mentions, known


def resolved_directory(spark, d):
    return resolve.resolve_directory(*_names(spark, d))


def resolved_roster(spark, d):
    mentions, known = _names(spark, d)
    return resolve.resolve_roster(mentions.withColumnRenamed("mention_id", "item_id"), known)


def _mentioned(spark, d):
    words = t.load(spark, d, "select cast(conv_id as string) as chat_id, turn, text from {conversations} where text is not null")
    names = words.select("chat_id", F.col("turn").alias("ord"), F.concat(F.lit("item:"), F.col("turn").cast("string")).alias("key"), F.array(F.substring("text", 1, 6)).alias("names"), (F.col("turn") % 3 == 0).alias("stub"))
    return names, words.selectExpr("chat_id", "turn as batch_ix", "text")


def related_topk(spark, d):
    names, texts = _mentioned(spark, d)
    return resolve.related_entities(names, texts, names.filter("ord % 4 = 1"), 3)


def stub_nodes(spark, d):
    refs, ents = net(spark, d)
    return resolve.stub_nodes(refs.selectExpr("'1' as chat_id", "tgt_id as key"), ents.selectExpr("'1' as chat_id", "id as key"))


def _orders(spark, d):
    return t.load(spark, d, "select 'c' as chat_id, cast(o_custkey as string) as key, o_orderkey as ord, case when o_orderkey % 4 = 0 then ' ' else o_orderpriority || cast(o_orderkey % 7 as string) end as description, array(o_orderpriority) as aliases, o_orderstatus from {orders}")


def upsert_candidates(spark, d):
    return resolve.upsert_candidates(_orders(spark, d)).withColumn("aliases", F.array_join("aliases", "|"))


def upsert_relations(spark, d):
    return resolve.upsert_relations(_orders(spark, d).selectExpr("chat_id", "cast(ord % 20 as string) as a", "cast(ord % 7 as string) as b", "ord", "o_orderstatus as kind", "description as value"))


def field_updates(spark, d):
    rows = _orders(spark, d).selectExpr("key as entity_id", "o_orderstatus as field", "ord", "case when ord % 3 = 0 then 'revise' else 'supplement' end as relationship", "to_json(named_struct('note', trim(description), 'n', ord % 5)) as value")
    return resolve.field_updates(rows)


def canonical_fields(spark, d):
    fields = t.load(spark, d, "select distinct 'item' as type, p_type as field from {part}")
    rows = t.load(spark, d, "select distinct 'item' as type, case p_size % 3 when 0 then p_type when 1 then upper(replace(p_type, ' ', '_')) else 'kind ' || cast(p_size as string) end as name from {part}")
    aliases = rows.filter("name like 'kind 1%'").selectExpr("type", "name as alias", "'STANDARD' as field")
    return resolve.canonical_fields(rows, fields, aliases)


def placement_hints(spark, d):
    refs, _ = net(spark, d)
    claims = refs.filter("component = 'event_related_entity_reference' and ord > 0").selectExpr("'1' as chat_id", "tgt_id as item", "concat('h', case when right(tgt_id, 1) in ('0', '5') then 0 else cast(right(src_id, 24) as bigint) % 3 end) as holder", "element_at(array('carried', 'worn', 'equipped'), cast(ord % 3 + 1 as int)) as role")
    return resolve.placement_hints(claims)[0]


def reply_triage(spark, d):
    rows = t.load(spark, d, "select event_id, props from {events}").selectExpr("""case event_id % 8 when 0 then props when 1 then 'Sure: ' || props || ' done' when 2 then '[' || props || ']'
      when 3 then replace(props, '}', ',}') when 4 then 'none' when 5 then left(props, length(props) - 1) when 6 then props || props else '{broken: "' end as reply""")
    return chats.triage_replies(rows).groupBy("status").agg(F.count("*").alias("n"))


def fuzzy_keys(spark, d):
    """Type names with a letter lost, matched to the registered ones."""
    from storynet.operators import repair

    keys = t.load(spark, d, "select distinct 'item' as component, '/data' as path, substring(lower(p_brand), 2) || cast(p_size % 3 as string) as key from {part}")
    rules = t.load(spark, d, "select distinct 'item' as component, '/data' as path, lower(p_brand) || '1' as field from {part}")
    aliases = keys.filter("key like '%2'").selectExpr("component", "'/*' as path", "1 as ord", "upper(key) as alias", "'brand#31' as field")
    return repair.repair_keys(keys, rules, aliases, 0.8, 0.02)


QUERIES = {
    "anchor_text": anchor_text,
    "quote_matches": quote_matches,
    "quote_places": quote_places,
    "evidence_relocate": evidence_relocate,
    "locate_in_order": located,
    "fuzzy_units": fuzzy_units,
    "clean_pages": clean_pages,
    "clean_chats": clean_chats,
    "scene_parts": scene_parts,
    "resolve_directory": resolved_directory,
    "resolve_roster": resolved_roster,
    "related_topk": related_topk,
    "stub_nodes": stub_nodes,
    "upsert_candidates": upsert_candidates,
    "upsert_relations": upsert_relations,
    "field_updates": field_updates,
    "canonical_fields": canonical_fields,
    "placement_hints": placement_hints,
    "reply_triage": reply_triage,
    "fuzzy_keys": fuzzy_keys,
}

_MSG = t.oracle(t.MESSAGES)
_Q = r"""'[\s"''“”‘’「」『』]'"""
SQL = {
    "anchor_text": rf"select cast(doc_id as varchar) as ref, sha256(regexp_replace(coalesce(text, ''), '{_DROP_SQL}', '', 'g')) as sha from documents",
    "quote_matches": rf"""select item_id as quote_id, cast(doc_id as varchar) as ref from (select item_id, regexp_replace(text, '{_DROP_SQL}', '', 'g') as q from benchmark) b,
      (select doc_id, regexp_replace(text, '{_DROP_SQL}', '', 'g') as s from documents) d where q <> '' and contains(s, q)""",
    "evidence_relocate": f"""with m as (select chat_id, floor, 'm' || cast(floor as varchar) as ref, content, regexp_replace(content, {_Q}, '', 'g') as s from ({_MSG})),
      e as (select chat_id, chat_id || '-' || cast(floor as varchar) as evidence_id, 'm' || cast(floor - 1 as varchar) as ref, regexp_replace(substring(content, 21, 40), {_Q}, '', 'g') as q from m where length(content) > 80 and floor > 0),
      h as (select e.chat_id, evidence_id, max(m.ref) filter (m.ref = e.ref) as same, count(*) as n, min(m.ref) as only_ref from e join m on m.chat_id = e.chat_id and contains(s, q) where q <> '' group by all)
      select e.chat_id, e.evidence_id, e.ref, coalesce(same, case when n = 1 then only_ref end) as found_ref from e left join h on h.chat_id = e.chat_id and h.evidence_id = e.evidence_id""",
    "scene_parts": """select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderpriority else '' end as place,
      case when o_orderkey % 3 <> 0 then case when date_trunc('second', o_orderdate) = o_orderdate then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end || '·noon' else '' end as time from orders""",
    "stub_nodes": t.oracle(f"{WITH} select distinct '1' as chat_id, tgt_id as key from refs where tgt_id not in (select id from entities)"),
    "upsert_candidates": """with o as (select o_custkey, o_orderkey, o_orderpriority as p, case when o_orderkey % 4 = 0 then ' ' else o_orderpriority || cast(o_orderkey % 7 as varchar) end as x from orders),
      a as (select o_custkey, p, min(o_orderkey) as k from o group by all), l as (select o_custkey, string_agg(p, '|' order by k) as aliases from a group by all)
      select 'c' as chat_id, cast(o.o_custkey as varchar) as key, max_by(x, o_orderkey) filter (trim(x) <> '') as description, any_value(aliases) as aliases from o join l on l.o_custkey = o.o_custkey group by o.o_custkey""",
    "upsert_relations": """select 'c' as chat_id, least(a, b) as low, greatest(a, b) as high, kind, max_by(x, o_orderkey) as value from (select cast(o_orderkey % 20 as varchar) as a, cast(o_orderkey % 7 as varchar) as b, o_orderstatus as kind, o_orderkey,
      case when o_orderkey % 4 = 0 then ' ' else o_orderpriority || cast(o_orderkey % 7 as varchar) end as x from orders) where a <> b group by all""",
    "related_topk": """with m as (select cast(conv_id as varchar) as chat_id, turn, text, substring(text, 1, 6) as name from conversations where text is not null),
      s as (select t.chat_id, t.turn as batch_ix, c.turn as ord, 'item:' || cast(c.turn as varchar) as key, 10 * cast(trim(c.name) <> '' and contains(t.text, trim(c.name)) as int) + 6 * cast(c.turn % 4 = 1 as int) - cast(c.turn % 3 = 0 as int) as score
        from m c join m t on t.chat_id = c.chat_id)
      select chat_id, batch_ix, key, cast(score as bigint) as score, rank from (select *, row_number() over (partition by chat_id, batch_ix order by score desc, ord desc) as rank from s) where rank <= 3""",
    "placement_hints": t.oracle(f"""{WITH}, c as (select tgt_id as item, 'h' || cast(case when right(tgt_id, 1) in ('0', '5') then 0 else cast(right(src_id, 24) as bigint) % 3 end as varchar) as holder, ord % 3 as s from refs where component = 'event_related_entity_reference' and ord > 0)
      select '1' as chat_id, item, min(holder) as holder, ['carried', 'worn', 'equipped'][cast(max(s) + 1 as int)] as role from c group by item having count(distinct holder) = 1"""),
    "reply_triage": """select case event_id % 8 when 0 then 'ok' when 1 then 'ok' when 2 then 'array_reply' when 3 then 'ok_after_trailing_comma' when 4 then 'no_object' when 5 then 'truncated' when 6 then 'multiple_objects' else 'truncated' end as status,
      count(*) as n from events group by all""",
    "resolve_roster": r"""with sig as (select x, lower(regexp_replace(x, '[\s·・,，。．、:：;；]', '', 'g')) as s from (select p_name || ' ' || cast(p_partkey % 1500 as varchar) as x from part union select upper(p_name) || '、 ' || cast(p_partkey as varchar) from part
        union select c_name from customer union select lower(c_name) from customer union select n_name from nation union select s_name from supplier)),
      k as (select type, key, s from (select 'item' as type, 'item:' || p_name || ' ' || cast(p_partkey as varchar) as key, p_name || ' ' || cast(p_partkey % 1500 as varchar) as x from part union all select 'organization', 'organization:' || s_name, s_name from supplier
        union all select 'character', 'character:' || c_name, c_name from customer union all select 'location', 'location:' || n_name, n_name from nation union all select 'organization', 'organization:' || n_name, n_name from nation) join sig using (x)),
      m as (select id, type, s from (select 'p' || cast(p_partkey as varchar) as id, 'item' as type, upper(p_name) || '、 ' || cast(p_partkey as varchar) as x from part union all select 'c' || cast(c_custkey as varchar), 'character', lower(c_name) from customer
        union all select 'n' || cast(n_nationkey as varchar), 'location', n_name from nation union all select 's' || cast(s_suppkey as varchar), 'organization', s_name from supplier) join sig using (x))
      select '1' as chat_id, m.id as item_id, m.type, case count(distinct key) when 0 then 'create' when 1 then 'update' else 'unresolved' end as action, case when count(distinct key) = 1 then min(key) end as target_key
      from m left join k on k.type = m.type and k.s = m.s group by m.id, m.type""",
}

_BARE = rf"regexp_replace(right(content, 20), '{_DROP_SQL}', '', 'g')"
SQL |= {
    "quote_places": rf"""with m as (select chat_id || '.' || cast(floor as varchar) as ref, floor as quote_id, content, {_BARE} as q from ({_MSG})),
      c as (select ref, quote_id, q, i, substring(content, cast(i as int), 1) as ch from (select *, unnest(range(1, length(content) + 1)) as i from m)),
      k as (select ref, quote_id, any_value(q) as q, string_agg(ch, '' order by i) as body, list(i order by i) as pos from c where not regexp_matches(ch, '{_DROP_SQL}') group by all)
      select quote_id, ref, pos[s] - 1 as start, pos[s + length(q) - 1] as "end" from (select *, unnest(range(1, length(body) - length(q) + 2)) as s from k where q <> '') where substring(body, cast(s as int), length(q)) = q""",
    "locate_in_order": f"""with recursive e as (select chat_id as batch, event_no // 2 as ord, event_id % 97 as pos from ({t.oracle(t.CHAT_EVENTS)})), n as (select batch, ord, row_number() over (partition by batch order by ord) as k from (select distinct batch, ord from e)),
      f as (select n.batch, n.k, n.ord, list(pos) as places from n join e on e.batch = n.batch and e.ord = n.ord group by all),
      r as (select distinct batch, cast(0 as bigint) as k, cast(-1 as bigint) as ord, cast(-1 as bigint) as cursor, cast(null as bigint) as pos from f
        union all select f.batch, f.k, f.ord, coalesce(list_min(list_filter(places, lambda p: p > cursor)), cursor), list_min(list_filter(places, lambda p: p > cursor)) from r join f on f.batch = r.batch and f.k = r.k + 1)
      select batch, ord, pos from r where k > 0""",
    "clean_pages": r"""select page_id, sha256(regexp_replace(regexp_replace(regexp_replace(case when regexp_matches(html, '(?is)<content\b[^>]*>.*?</content\s*>') then regexp_extract(html, '(?is)<content\b[^>]*>(.*?)</content\s*>', 1) else html end,
      '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]+>', '', 'g'), '\s+', ' ', 'g')) as sha from (select page_id, coalesce(html, '') as html from pages)""",
    "clean_chats": rf"""select chat_id, floor, sha256(regexp_replace(regexp_replace(regexp_replace(case when role = 'assistant' then replace(replace(replace(replace(replace(regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]+>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') else regexp_replace(content, '(?s)<!--.*?-->', '', 'g') end, '[ \t\r]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as sha from ({_MSG})""",
    "canonical_fields": r"""with f as (select distinct p_type as field from part), g as (select lower(regexp_replace(field, '[\s_\-./\\:：]', '', 'g')) as sig, min(field) as folded, count(*) as n from f group by 1),
      r as (select distinct case p_size % 3 when 0 then p_type when 1 then upper(replace(p_type, ' ', '_')) else 'kind ' || cast(p_size as varchar) end as name from part)
      select 'item' as type, name, coalesce(f.field, case when n = 1 then folded end, case when name like 'kind 1%' then 'STANDARD' end) as field,
        case when f.field is not null then 'exact' when n = 1 then 'folded' when name like 'kind 1%' then 'alias' else 'unclassified' end as how
      from r left join f on f.field = name left join g on g.sig = lower(regexp_replace(name, '[\s_\-./\\:：]', '', 'g'))""",
    "resolve_directory": rf"""with s as (select *, lower(regexp_replace(x, '[\s·・,，。．、:：;；]', '', 'g')) as sig from (
        select 'p' || cast(p_partkey as varchar) as id, 'item' as type, 'item:m' || cast(p_partkey as varchar) as key, upper(p_name) || '、 ' || cast(p_partkey as varchar) as x, 1 as m from part
        union all select 'c' || cast(c_custkey as varchar), 'character', 'character:' || c_name, lower(c_name), 1 from customer union all select 'n' || cast(n_nationkey as varchar), 'location', 'location:x' || cast(n_nationkey as varchar), n_name, 1 from nation
        union all select 's' || cast(s_suppkey as varchar), 'organization', 'group:' || s_name, s_name, 1 from supplier
        union all select null, 'item', 'item:' || p_name || ' ' || cast(p_partkey as varchar), p_name || ' ' || cast(p_partkey % 1500 as varchar), 0 from part union all select null, 'organization', 'organization:' || s_name, s_name, 0 from supplier
        union all select null, 'character', 'character:' || c_name, c_name, 0 from customer union all select null, 'location', 'location:' || n_name, n_name, 0 from nation union all select null, 'organization', 'organization:' || n_name, n_name, 0 from nation)),
      h as (select a.id, a.type, a.key, count(distinct b.key) filter (b.type = a.type) as n, min(b.key) filter (b.type = a.type) as one, count(b.key) filter (b.type <> a.type) as other from s a left join s b on b.m = 0 and b.sig = a.sig where a.m = 1 group by all),
      d as (select h.*, exists (select 1 from s where m = 0 and s.type = h.type and s.key = h.key) as direct from h),
      r as (select *, case when split_part(key, ':', 1) <> type then 'invalid_type_or_key' when other > 0 then 'cross_type_name_conflict' when not direct and n > 1 then 'multiple_same_type_matches' end as reason from d)
      select '1' as chat_id, id as mention_id, case when reason is not null then 'unresolved' when direct or n = 1 then 'update' else 'create' end as action, reason,
        case when reason is null then case when direct then key when n = 1 then one else key end end as target_key from r""",
}
SQL["field_updates"] = """with o as (select cast(o_custkey as varchar) as entity_id, o_orderstatus as field, o_orderkey as ord, o_orderkey % 3 = 0 as rev,
    '"' || trim(case when o_orderkey % 4 = 0 then ' ' else o_orderpriority || cast(o_orderkey % 7 as varchar) end) || '"' as note, cast(o_orderkey % 5 as varchar) as n from orders),
  s as (select *, sum(case when rev and ord > first then 1 else 0 end) over (partition by entity_id, field order by ord) as seg from (select *, min(ord) over (partition by entity_id, field) as first from o)),
  u as (select entity_id, field, seg, x.k as k, x.v as v, min(ord) as place from (select *, unnest([{'k': 'n', 'v': n}, {'k': 'note', 'v': note}]) as x from s) group by all),
  v as (select entity_id, field, seg, k, case when count(*) = 1 then min(v) else '[' || string_agg(v, ', ' order by place) || ']' end as v from u group by all),
  w as (select entity_id, field, seg, '{"n": ' || min(v) filter (k = 'n') || ', "note": ' || min(v) filter (k = 'note') || '}' as v from v group by entity_id, field, seg)
  select entity_id, field, max_by(v, seg) as value, cast(max(seg) as bigint) as n_revisions, '[' || coalesce(string_agg(v, ', ' order by seg) filter (seg < last), '') || ']' as revisions from (select *, max(seg) over (partition by entity_id, field) as last from w) group by entity_id, field"""
