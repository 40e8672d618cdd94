"""Queries over segments, event state, recall, stages, evaluation and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storynet.functions.shared import shared_dir
from storynet.operators import evaluate, event_state, recall, rounds, segments
from storynet.plans.store_queries import messages
from storynet.sources import tables as t
from storynet.streaming import events as streaming
from storynet.streaming import state


def _starts(spark, d):
    """Batches of eight events of a user; errors start events, every other event is a source."""
    ev = t.load(spark, d, t.CHAT_EVENTS).withColumn("batch_ix", F.expr("cast(floor((event_no - 1) / 8) as bigint)")).withColumn("source_ix", (F.col("event_no") - 1) % 8)
    state = ev.select("chat_id", "batch_ix").distinct().selectExpr("chat_id", "batch_ix", "batch_ix > 1 as has_pending", "batch_ix > 0 as has_forming", "batch_ix % 3 = 0 as starts_anew")
    found = ev.filter("event_type = 'error'").selectExpr("chat_id", "batch_ix", "source_ix", "event_id % 5 as offset", "event_id % 4 = 0 as in_old")
    return ev, segments.event_starts(found, state)


def roster_asof(spark, d):
    ev, starts = _starts(spark, d)
    roster = ev.filter("event_type = 'view'").selectExpr("chat_id", "batch_ix", "concat('k', event_id % 3) as key", "source_ix", "cast(2 as bigint) as offset", "array(event_type) as aliases")
    rows = segments.assign_roster(roster, starts)
    return rows.select("chat_id", "batch_ix", F.col("start.source_ix").alias("source_ix"), F.col("start.offset").alias("offset"), "key")


def segment_table(spark, d):
    rows = segments.close_segments(segments.build_segments(_starts(spark, d)[1]))
    return rows.select("chat_id", "batch_ix", F.col("seg_ix").cast("long").alias("seg_ix"), "slot", "first_source", "offset", "last_source", "end_offset", "boundary", "disposition")


def clipped(spark, d):
    ev, starts = _starts(spark, d)
    sources = ev.selectExpr("chat_id", "batch_ix", "source_ix", "concat(event_type, ' ', event_id) as content")
    rows = segments.clip_messages(segments.close_segments(segments.build_segments(starts)), sources)
    return rows.groupBy("chat_id", "batch_ix", "source_ix").agg(F.array_join(F.sort_array(F.collect_list("text")), "|").alias("parts"))


def event_numbers(spark, d):
    rows = segments.build_segments(_starts(spark, d)[1])
    return segments.apply_boundaries(rows).select("chat_id", "batch_ix", F.col("seg_ix").cast("long").alias("seg_ix"), "slot", "event_no")


def decided(spark, d):
    ev = t.load(spark, d, t.CHAT_EVENTS)
    given = ev.filter("event_id % 3 <> 0").selectExpr("chat_id", "event_id as id", "case event_id % 5 when 0 then 'maybe' when 1 then 'continue' else 'new_event' end as decision")
    return segments.decode_decisions(given, ev.selectExpr("chat_id", "event_id as id"))[0]


def update_slots(spark, d):
    """Slots by batches of eight events; in some batches the second event's update has a key that is not known."""
    ev = t.load(spark, d, t.CHAT_EVENTS).selectExpr("concat(chat_id, '-', (event_no - 1) div 8) as chat_id", "(event_no - 1) % 8 as n", "event_id")
    slots = ev.selectExpr("chat_id", "concat('k', n) as key", "concat('new_', n) as slot")
    updates = ev.selectExpr("chat_id", "case when n = 1 and event_id % 2 = 0 then 'typo' else concat('k', n) end as key")
    return segments.assign_update_slots(updates, slots)


def times(spark, d):
    rows = t.load(spark, d, "select l_orderkey as event_id, l_linenumber as pos, cast(l_shipdate as date) as day, l_partkey from {lineitem}")
    found = rows.selectExpr("event_id", "cast(pos as bigint) * 1000000000 + l_partkey as pos", "cast(day as string) as expression", "l_partkey % 2 = 0 as from_header").distinct()
    events = t.load(spark, d, "select o_orderkey as event_id, case when o_orderkey % 5 = 0 then 'forming' else 'finalized' end as status from {orders}")
    return segments.event_times(found, events)


def coalesced(spark, d):
    rows = t.load(spark, d, "select cast(o_custkey as string) as chat_id, o_orderstatus as segment, o_orderkey as ord, o_orderpriority as description, case when o_orderkey % 3 = 0 then cast(o_orderkey as string) end as summary, array(o_orderpriority) as members, case when o_orderkey % 2 = 0 then o_orderkey end as start, case when o_orderkey % 2 = 1 then o_orderkey end as end from {orders}")
    return segments.coalesce_updates(rows).withColumn("members", F.array_join("members", "|"))


def boundary_audit(spark, d):
    ev, starts = _starts(spark, d)
    rows = segments.build_segments(starts).withColumn("slot", F.expr("case when seg_ix = 2 then 'new_9' else slot end"))
    rows = rows.withColumn("refs", F.array(F.concat(F.lit("r"), F.col("first_source").cast("string"))))
    state = starts.select("chat_id", "batch_ix").distinct().selectExpr("chat_id", "batch_ix", "batch_ix > 1 as has_pending", "batch_ix > 0 as has_forming")
    refs = ev.filter("source_ix < 6").selectExpr("chat_id", "batch_ix", "concat('r', source_ix) as ref")
    return segments.boundary_violations(rows, refs, state).groupBy("code").agg(F.count("*").alias("n"))


_RANGES = "select 'f' as framework, 'b' as binding, stage, low, high from (values ('calm', 0.0, 5.0), ('warm', 5.0, 15.0), ('hot', 15.0, 40.0), ('wild', 40.0, 1e300)) as r(stage, low, high)"


def stage_lookup(spark, d):
    values = t.load(spark, d, "select event_id as id, 'f' as framework, 'b' as binding, value from {events}")
    ranges = spark.sql(_RANGES).selectExpr("framework", "binding", "stage", "cast(low as double) as low", "cast(high as double) as high")
    return recall.stage_lookup(values, ranges)


def _frameworks(spark, d):
    """A framework for each order: lines are stages, with ranges by quantity that overlap or leave gaps."""
    lines = t.load(spark, d, "select * from {lines}")
    fw = lines.select("l_orderkey").distinct().selectExpr("l_orderkey as framework", "case l_orderkey % 3 when 0 then 'semantic' when 1 then 'numeric_derived' else 'hybrid' end as mode")
    bindings = fw.filter("framework % 7 <> 0").selectExpr("framework", "'b' as binding").unionByName(fw.filter("framework % 40 = 0").selectExpr("framework", "'c' as binding"))
    stages = lines.selectExpr("l_orderkey as framework", "seq as stage")
    ranges = lines.selectExpr("l_orderkey as framework", "seq as stage", "'b' as binding", "cast(seq * 10 as double) as low", "cast(seq * 10 + l_quantity % 3 * 5 + 5 as double) as high")
    blocks = lines.selectExpr("l_orderkey as framework", "seq as ord", "concat('x', l_partkey % 5) as block")
    return fw, bindings, stages, ranges, blocks


def stage_audit(spark, d):
    return recall.framework_issues(*_frameworks(spark, d))


def stage_contexts(spark, d):
    return _contexts(*_frameworks(spark, d))


def _contexts(fw, bindings, stages, ranges, blocks, asked="true"):
    """The contexts of the requests that ``asked`` names."""
    issues = recall.framework_issues(fw, bindings, stages, ranges, blocks)
    ask = fw.selectExpr("framework as id", "framework", "mode", "case framework % 4 when 0 then 'transition_check' when 1 then 'framework_overview' else 'current_stage' end as recall_mode", "'use' as purpose",
                        "'b' as binding", "cast(framework % 50 as double) as value", "case when framework % 3 <> 1 then 1 end as stage").filter(asked)
    told = blocks.selectExpr("framework", "ord as stage", "'use' as purpose", "block as content")
    return recall.stage_context(ask, stages, told, ranges, issues)


def recall_pack(spark, d):
    ev = rounds.event_status(t.load(spark, d, t.CHAT_EVENTS))
    body = """to_json(named_struct('id', cast(event_id as string), 'status', status, 'description', repeat(event_type, 20), 'story_summary', repeat(concat(event_type, ' '), cast(event_id % 90 as int)),
      'key_details', array(named_struct('id', concat('d', event_id), 'kind', 'action', 'content', event_type), named_struct('id', concat('x', event_id), 'kind', 'statement', 'content', repeat('word ', cast(event_id % 40 as int)))),
      'related_entity_keys', array(concat('u', chat_id)))) as body"""
    ask = ev.selectExpr("chat_id as request_id", "event_no as rank", "event_id", "case when event_id % 5 = 0 then array(concat('x', event_id)) end as details")
    return recall.recall_packs(ask, ev.selectExpr("event_id", body), max_chars=1500)


def boundary_score(spark, d):
    own = messages(spark, d).filter("role = 'user' and length(content) > 30").selectExpr("chat_id", "floor as ix", "concat('s', floor % 4) as status", "concat('m', floor) as ref", "left(content, 30) as quote")
    gold = own.filter("ix % 5 <> 4").selectExpr("chat_id", "ix", "case when ix % 7 = 3 then 'other' else status end as status", "ref", "case when ix % 6 = 2 then 'nothing' else left(quote, 12) end as quote")
    processed = own.select("chat_id").distinct().selectExpr("chat_id", "cast(chat_id as bigint) % 9 as rounds", "2 as required")
    return evaluate.score_boundaries(own.filter("ix % 11 <> 10"), gold, processed)


def gold_scope(spark, d):
    text = messages(spark, d).groupBy("chat_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("floor", "content"))), lambda x: x["content"]), "\n"), 256).alias("sha256"))
    gold = text.selectExpr("chat_id", "case when cast(chat_id as bigint) % 4 = 0 then 'old' else sha256 end as sha256", "cast(chat_id as bigint) % 3 + 7 as rounds", "2 as batches")
    return evaluate.gold_scope(gold, text.filter("cast(chat_id as bigint) % 5 <> 0"), 4)


def stream_event_state(spark, d):
    """Final events from a stream over the events table; the batch query event_status must agree."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    t.load(spark, d, "select 1 as one from {events} limit 1")
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    rows = stream.select(F.col("user_id").cast("string").alias("chat_id"), "event_id", F.col("ts").alias("at"))
    return streaming.run_to_table(streaming.rolling_events(rows))


def stream_due(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    rows = stream.select(F.col("user_id").cast("string").alias("chat_id"), F.col("event_id").alias("floor"))
    return streaming.run_to_table(streaming.due_chats(rows, 10, 4))


def _plan(spark, d):
    """The segments of all batches with their messages as refs, and a text for some."""
    _, starts = _starts(spark, d)
    rows = segments.build_segments(starts)
    refs = F.transform(F.sequence("first_source", F.coalesce("last_source", F.lit(7))), lambda i: F.concat(F.lit("m"), F.col("batch_ix").cast("string"), F.lit("."), i.cast("string")))
    text = F.when(F.col("slot") != "pending_tail", F.concat(F.col("batch_ix").cast("string"), F.lit("/"), F.col("seg_ix").cast("string")))
    none = F.lit(None).cast("string")
    return rows.select("chat_id", F.col("batch_ix").cast("int").alias("batch_ix"), F.col("seg_ix").cast("int").alias("seg_ix"), "slot", "disposition", refs.alias("source_refs"), none.alias("start_anchors"), none.alias("end_anchors"), text.alias("description"), text.alias("story_summary"))


def _flat(events):
    return events.select("chat_id", "event_no", "status", F.array_join("source_refs", ",").alias("refs"), F.size("source_slices").cast("long").alias("n_slices"))


def event_state_table(spark, d):
    return _flat(event_state.event_state(_plan(spark, d)))


def stream_final_events(spark, d):
    """The same events from a stream over the plan, once they are final."""
    plan = _plan(spark, d)
    folder = f"{shared_dir(spark)}/plan-{uuid.uuid4().hex}"
    plan.write.parquet(folder)
    return _flat(streaming.run_to_table(state.final_events(spark.readStream.schema(plan.schema).parquet(folder))))


QUERIES = {
    "event_state": event_state_table,
    "stream_final_events": stream_final_events,
    "roster_asof": roster_asof,
    "segments": segment_table,
    "clipped_messages": clipped,
    "event_numbers": event_numbers,
    "decode_decisions": decided,
    "update_slots": update_slots,
    "event_times": times,
    "coalesce_updates": coalesced,
    "boundary_audit": boundary_audit,
    "stage_lookup": stage_lookup,
    "stage_audit": stage_audit,
    "stage_context": stage_contexts,
    "recall_pack": recall_pack,
    "boundary_score": boundary_score,
    "gold_scope": gold_scope,
    "stream_event_state": stream_event_state,
    "stream_due": stream_due,
}

_EV = t.oracle(t.CHAT_EVENTS)
_ST = f"""ev as (select *, (event_no - 1) // 8 as batch_ix, (event_no - 1) % 8 as source_ix from ({_EV})),
  b as (select distinct chat_id, batch_ix, batch_ix > 1 as p, batch_ix > 0 as f, batch_ix % 3 = 0 as a from ev),
  s as (select chat_id, batch_ix, source_ix, event_id % 5 as offs from ev where event_type = 'error' and (event_id % 4 <> 0 or event_id % 5 = 0) union select chat_id, batch_ix, 0, 0 from b),
  st as (select s.*, case when not p and not f then 'absent' when p and f and not a then 'merge_into_pending' else 'keep_distinct' end as disposition, f and not a as continues from s join b using (chat_id, batch_ix)),
  sg as (select *, row_number() over w - 1 as seg_ix, lead(source_ix) over w as last_source, lead(offs) over w as end_offset from st window w as (partition by chat_id, batch_ix order by source_ix, offs)),
  sl as (select *, case when seg_ix = 0 and continues and disposition = 'merge_into_pending' then 'pending_tail' when seg_ix = 0 and continues then 'forming_existing'
    else 'new_' || cast(sum(case when seg_ix = 0 and continues then 0 else 1 end) over (partition by chat_id, batch_ix order by seg_ix) as varchar) end as slot from sg)"""
_STATE = f"""with {_ST}, x as (select *, sum(case when starts_with(slot, 'new_') then 1 else 0 end) over (partition by chat_id order by batch_ix, seg_ix) as raw, bool_or(starts_with(slot, 'new_')) over (partition by chat_id, batch_ix) as opens from sl),
  j as (select chat_id, raw - case when starts_with(slot, 'new_') then 1 else 0 end as raw, batch_ix as joined_at from x where seg_ix = 0 and opens and disposition = 'merge_into_pending' and raw - case when starts_with(slot, 'new_') then 1 else 0 end > 1),
  e as (select chat_id, raw, joined_at, last_value(case when joined_at is null then raw end ignore nulls) over (partition by chat_id order by raw) as own from (select distinct chat_id, raw from x where raw > 0) left join j using (chat_id, raw)),
  r as (select x.*, own, greatest(joined_at, batch_ix) as since, joined_at is null or joined_at <= batch_ix as late, unnest(range(source_ix, coalesce(last_source, 7) + 1)) as i from x join e using (chat_id, raw)),
  o as (select chat_id, own, batch_ix, i, row_number() over (partition by chat_id, own order by since, late, batch_ix, seg_ix, i) as n, batch_ix * 1000 + seg_ix as slice from r),
  f as (select chat_id, own, 'm' || batch_ix || '.' || i as ref, min(n) as n from o group by all),
  g as (select chat_id, own, string_agg(ref, ',' order by n) as refs from f group by all),
  k as (select chat_id, own, count(distinct slice) as n_slices from o group by all),
  ranked as (select chat_id, own, row_number() over (partition by chat_id order by own desc) as p from g)
  select chat_id, cast(own as bigint) as event_no, case p when 1 then 'forming' when 2 then 'pending_finalization' else 'finalized' end as status, refs, n_slices from g join k using (chat_id, own) join ranked using (chat_id, own)"""
_M = t.oracle(t.MESSAGES)
SQL = {
    "event_state": _STATE,
    "stream_final_events": f"select * from ({_STATE}) where status = 'finalized'",
    "roster_asof": f"""with {_ST}, r as (select chat_id, batch_ix, 'k' || cast(event_id % 3 as varchar) as key, source_ix, 2 as offs from ev where event_type = 'view')
      select distinct chat_id, batch_ix, m.s as source_ix, m.o as offset, key from (select r.chat_id, r.batch_ix, key, (select max({{'s': st.source_ix, 'o': st.offs}}) from st where st.chat_id = r.chat_id and st.batch_ix = r.batch_ix
        and (st.source_ix, st.offs) <= (r.source_ix, r.offs)) as m from r) where m is not null""",
    "segments": f"""with {_ST} select chat_id, batch_ix, seg_ix, slot, source_ix as first_source, offs as offset, last_source, end_offset, not (disposition = 'absent' and seg_ix = 0) and starts_with(slot, 'new_') as boundary, disposition from sl""",
    "clipped_messages": f"""with {_ST}, c as (select sl.chat_id, sl.batch_ix, ev.source_ix, event_type || ' ' || cast(event_id as varchar) as x, case when ev.source_ix = sl.source_ix then offs else 0 end as a,
        case when ev.source_ix = last_source then end_offset else 1000 end as z from sl join ev on ev.chat_id = sl.chat_id and ev.batch_ix = sl.batch_ix and ev.source_ix >= sl.source_ix and (last_source is null or ev.source_ix <= last_source)),
      p as (select chat_id, batch_ix, source_ix, substring(x, a + 1, greatest(z - a, 0)) as t from c)
      select chat_id, batch_ix, source_ix, string_agg(t, '|' order by t) as parts from p where trim(t) <> '' group by all""",
    "decode_decisions": f"select chat_id, event_id as id, case when event_id % 3 = 0 or event_id % 5 = 0 then 'unresolved' when event_id % 5 = 1 then 'continue' else 'new_event' end as decision from ({_EV})",
    "update_slots": f"""with e as (select chat_id || '-' || cast((event_no - 1) // 8 as varchar) as chat_id, (event_no - 1) % 8 as n, event_id from ({_EV}))
      select chat_id, case when n = 1 and event_id % 2 = 0 then 'typo' else 'k' || cast(n as varchar) end as key, 'new_' || cast(n as varchar) as slot, n = 1 and event_id % 2 = 0 as repaired from e""",
    "event_times": """with f as (select distinct l_orderkey as id, cast(l_linenumber as bigint) * 1000000000 + l_partkey as pos, cast(cast(l_shipdate as date) as varchar) as x, l_partkey % 2 = 0 as h from lineitem),
      g as (select * from (select *, max(h) over (partition by id) as b from f) where h = b),
      m as (select id, min({'p': pos, 'x': x}).x as start, max({'p': pos, 'x': x}).x as last, bool_or(h) as h from g group by id)
      select id as event_id, start, case when last <> start and id % 5 <> 0 then last end as "end", case when h then 'exact' else 'approximate' end as precision from m join orders on o_orderkey = id""",
    "coalesce_updates": """with o as (select cast(o_custkey as varchar) as chat_id, o_orderstatus as segment, o_orderkey as k, o_orderpriority as p from orders), m as (select chat_id, segment, p, min(k) as k from o group by all)
      select o.chat_id, o.segment, max_by(p, k) as description, coalesce(string_agg(cast(k as varchar), chr(10) order by k) filter (k % 3 = 0), '') as summary,
        (select string_agg(m.p, '|' order by m.k) from m where m.chat_id = o.chat_id and m.segment = o.segment) as members, min(k) filter (k % 2 = 0) as start, max(k) filter (k % 2 = 1) as "end" from o group by o.chat_id, o.segment""",
    "stage_lookup": "select event_id as id, case when value >= 0 and value < 5 then 'calm' when value >= 5 and value < 15 then 'warm' when value >= 15 and value < 40 then 'hot' when value >= 40 then 'wild' end as stage, case when value is null or value < 0 then 'NUMERIC_STAGE_UNRESOLVED' end as code from events",
    "boundary_score": f"""with o as (select chat_id, floor as ix, 's' || cast(floor % 4 as varchar) as status, floor % 11 <> 10 as found, floor % 5 <> 4 as gold, floor from ({_M}) where role = 'user' and length(content) > 30)
      select chat_id, ix, case when cast(chat_id as bigint) % 9 < 2 then 'not_due' when not found then 'missing' when not gold then 'extra' when ix % 7 = 3 then 'status_differs' when ix % 6 = 2 then 'start_differs' else 'match' end as outcome from o where found or gold""",
    "gold_scope": f"""select distinct chat_id, case when cast(chat_id as bigint) % 5 = 0 then 'CHAT_MISSING' when cast(chat_id as bigint) % 4 = 0 then 'SOURCE_CHANGED' when cast(chat_id as bigint) % 3 + 7 <> 8 then 'ROUNDS_DIFFER' end as code from ({_M})""",
    "stream_event_state": f"select chat_id, event_id from (select *, row_number() over (partition by chat_id order by event_no desc) as r from ({_EV})) where r > 2",
}

_LINES = t.oracle("select * from {lines}")
_STAGE = f"""l as ({_LINES}), fw as (select distinct l_orderkey as framework, case l_orderkey % 3 when 0 then 'semantic' when 1 then 'numeric_derived' else 'hybrid' end as mode from l),
  n as (select framework, mode, case when framework % 7 <> 0 then 1 else 0 end + case when framework % 40 = 0 then 1 else 0 end as n, framework % 7 <> 0 as b from fw),
  r as (select l_orderkey as framework, seq as stage, seq * 10 as low, seq * 10 + cast(l_quantity as bigint) % 3 * 5 + 5 as high, l_partkey % 5 as x, mode, n, b from l join n on n.framework = l_orderkey),
  w as (select *, lag(high) over (partition by framework order by low, high, stage) as before from r where b and mode = 'numeric_derived' and n = 1),
  i as (select framework, 'SEMANTIC_STAGE_HAS_NUMERIC_BINDING' as code, mode as at from n where mode = 'semantic' and n > 0
    union all select framework, 'NUMERIC_STAGE_BINDING_REQUIRED', mode from n where mode <> 'semantic' and n = 0
    union all select framework, 'NUMERIC_STAGE_SINGLE_BINDING_REQUIRED', mode from n where mode = 'numeric_derived' and n <> 1
    union all select framework, 'UNKNOWN_NUMERIC_BINDING', cast(stage as varchar) from r where not b
    union all select framework, 'DUPLICATE_STAGE_CONTEXT_ID', 'x' || cast(x as varchar) from (select *, row_number() over (partition by framework, x order by stage) as k from r) where k > 1
    union all select framework, 'SEMANTIC_STAGE_HAS_NUMERIC_GUIDANCE', cast(stage as varchar) from r where mode = 'semantic'
    union all select framework, 'NUMERIC_STAGE_RANGE_REQUIRED', cast(count(*) as varchar) from r where mode = 'numeric_derived' and n = 1 group by framework having count(*) <> count(*) filter (b)
    union all select framework, 'OVERLAPPING_STAGE_RANGE', cast(stage as varchar) from w where low < before union all select framework, 'GAPPED_STAGE_RANGE', cast(stage as varchar) from w where low > before)"""
SQL |= {
    "event_numbers": f"""with {_ST}, x as (select *, sum(case when starts_with(slot, 'new_') then 1 else 0 end) over (partition by chat_id order by batch_ix, seg_ix) as raw from sl),
      m as (select distinct chat_id, raw - case when starts_with(slot, 'new_') then 1 else 0 end as raw from x where disposition = 'merge_into_pending' and seg_ix = 0),
      o as (select x.chat_id, x.batch_ix, seg_ix, slot, raw, (select count(distinct y.raw) from x y where y.chat_id = x.chat_id and y.raw <= x.raw and not exists (select 1 from m where m.chat_id = y.chat_id and m.raw = y.raw)) as k from x)
      select chat_id, batch_ix, seg_ix, slot, greatest(k, 1) as event_no from o""",
    "boundary_audit": f"""with {_ST}, x as (select chat_id, batch_ix, seg_ix, case when seg_ix = 2 then 'new_9' else slot end as slot, disposition, 'r' || cast(source_ix as varchar) as ref from sl),
      y as (select x.*, p, f, case when starts_with(slot, 'new_') then cast(substring(slot, 5) as int) end as k, sum(case when starts_with(slot, 'new_') then 1 else 0 end) over (partition by x.chat_id, x.batch_ix order by seg_ix) as want,
        count(*) over (partition by x.chat_id, x.batch_ix, slot) as uses from x join b on b.chat_id = x.chat_id and b.batch_ix = x.batch_ix),
      g as (select chat_id, batch_ix, 'r' || cast(source_ix as varchar) as ref from ev where source_ix < 6),
      c as (select 'DUPLICATE_SLOT' as code from y where uses > 1 union all select 'SLOT_SEQUENCE' from y where k <> want union all select 'SLOT_WITHOUT_FORMING' from y where slot = 'forming_existing' and not f
        union all select 'SLOT_WITHOUT_PENDING' from y where slot = 'pending_tail' and not p union all select 'DISPOSITION_STATE_MISMATCH' from y where disposition = 'absent' and (p or f)
        union all select 'UNKNOWN_SOURCE_REF' from y where not exists (select 1 from g where g.chat_id = y.chat_id and g.batch_ix = y.batch_ix and g.ref = y.ref)
        union all select 'UNASSIGNED_MESSAGE' from g where not exists (select 1 from y where y.chat_id = g.chat_id and y.batch_ix = g.batch_ix and y.ref = g.ref))
      select code, count(*) as n from c group by code""",
    "stage_audit": f"with {_STAGE} select * from i",
    "stage_context": f"""with {_STAGE}, q as (select framework as id, mode, case framework % 4 when 0 then 'transition_check' when 1 then 'framework_overview' else 'current_stage' end as ask, framework % 50 as value, case when framework % 3 <> 1 then 1 end as stage from fw),
      d as (select q.id, case when count(distinct r.stage) = 1 then min(r.stage) end as derived from q join r on r.framework = q.id and q.value >= r.low and q.value < r.high group by q.id),
      c as (select q.*, case when mode = 'numeric_derived' then derived else stage end as now from q left join d on d.id = q.id),
      e as (select *, case when id in (select framework from i) then 'FRAMEWORK_INVALID' when mode = 'numeric_derived' and now is null then 'NUMERIC_STAGE_UNRESOLVED' when ask <> 'framework_overview' and now is null then 'EXPLICIT_STAGE_REQUIRED' end as code from c),
      f as (select distinct e.id, r.stage, r.x from e join r on r.framework = e.id where code is null and (r.stage = now or ask = 'framework_overview' or (ask = 'transition_check' and e.mode = 'hybrid' and value >= r.low and value < r.high))),
      g as (select id, string_agg('{{"stage":' || cast(stage as varchar) || ',"blocks":["x' || cast(x as varchar) || '"]}}', ',' order by stage) as s from f group by id)
      select e.id, code, '[' || s || ']' as stages from e left join g on g.id = e.id""",
    "stream_due": "select cast(user_id as varchar) as chat_id, max(event_id) - 4 as through from events group by user_id having max(event_id) > 13",
}
