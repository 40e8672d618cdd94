"""Queries over the normalised event plan: segments that are derived from starts of two kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from storynet.functions.shared import saved
from storynet.operators import plan
from storynet.sources import tables as t

_EV = """select chat_id, event_id, event_type, cast(floor((event_no - 1) / 8) as int) as batch_ix, cast((event_no - 1) % 8 as bigint) as source_ix from ({events_}) e""".replace("{events_}", t.CHAT_EVENTS)


def derived_segments(spark, d):
    """Batches of eight events, two to a block; some blocks start events, and so do some places inside messages."""
    ev = saved(t.load(spark, d, _EV).withColumns({"ref": F.concat(F.lit("m"), F.col("source_ix").cast("string")), "block_ix": F.expr("cast(source_ix div 2 as int)")}))
    content = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"), F.lit("tail"))
    messages = ev.select(*plan.BATCH, F.col("source_ix").alias("message_ix"), "ref", content.alias("content"))
    blocks = ev.groupBy(*plan.BATCH, "block_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_ix", "ref"))), lambda x: x["ref"]).alias("refs"), F.min_by("event_id", "source_ix").alias("first"))
    blocks = blocks.withColumns({"block_key": F.concat(F.lit("b"), F.col("block_ix").cast("string")), "hard": F.col("first") % 7 == 0, "opening_ref": F.lit(None).cast("string"), "opening": F.lit(None).cast("string")})
    inner = ev.filter("event_id % 3 = 0").select(*plan.BATCH, F.concat(F.lit("s"), F.col("source_ix").cast("string")).alias("start_key"), "ref", F.when(F.col("event_id") % 4 != 2, "tail").otherwise("nowhere").alias("quote"), F.lit(False).alias("hard"), "event_id")
    chosen = blocks.filter("first % 5 = 0").select(*plan.BATCH, F.col("block_key").alias("key")).unionByName(inner.filter("event_id % 2 = 0").select(*plan.BATCH, F.col("start_key").alias("key")))
    disposition = F.when(F.col("batch_ix") % 2 == 0, "keep_distinct").otherwise("merge_into_pending")
    state = ev.select(*plan.BATCH).distinct().withColumns({"has_forming": F.col("batch_ix") > 0, "disposition": disposition})
    decisions, _ = plan.starts_of(blocks, inner, chosen, chosen.limit(0), state)
    cut, _ = plan.derive_segments(blocks, inner, saved(decisions), messages, state)
    return cut.select(*plan.BATCH, F.col("seg_ix").cast("long").alias("seg_ix"), "key", "slot", F.array_join("refs", ",").alias("refs"), "first_source", "offset")


QUERIES = {"derived_segments": derived_segments}
SQL = {
    "derived_segments": f"""with e as ({t.oracle(_EV)}), b as (select chat_id, batch_ix, source_ix // 2 as block, min_by(event_id, source_ix) as f from e group by all),
  n as (select *, batch_ix > 0 and block = 0 and f % 7 <> 0 and f % 5 <> 0 as goes_on from b where block = 0 or f % 7 = 0 or f % 5 = 0),
  s as (select chat_id, batch_ix, 2 * block as pos, 0 as "offset", case when goes_on then 'old_tail' else 'b' || block end as key, goes_on, false as inside from n
    union all select chat_id, batch_ix, source_ix, length(event_type || ' ' || event_id || ' '), 's' || source_ix, false, true from e where event_id % 6 = 0 and event_id % 4 <> 2),
  g as (select *, row_number() over w - 1 as seg_ix, lead(pos) over w as nxt, lead(inside) over w as shared, sum(case when goes_on then 0 else 1 end) over w as number from s window w as (partition by chat_id, batch_ix order by pos, "offset")),
  m as (select chat_id, batch_ix, max(source_ix) as top from e group by all)
  select chat_id, batch_ix, cast(seg_ix as bigint) as seg_ix, key, case when goes_on then case when batch_ix % 2 = 0 then 'forming_existing' else 'pending_tail' end else 'new_' || cast(number as int) end as slot,
    array_to_string(list_transform(range(pos, coalesce(case when shared then nxt else nxt - 1 end, top) + 1), lambda i: 'm' || i), ',') as refs, cast(pos as bigint) as first_source, cast("offset" as bigint) as "offset" from g join m using (chat_id, batch_ix)""",
}
