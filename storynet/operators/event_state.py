"""The state of events after batches: what each event holds once all boundary plans and their texts are applied.

``plan``(chat_id, batch_ix, seg_ix, slot, disposition, source_refs array<string>, start_anchors, end_anchors, description,
story_summary): the segments of each batch in order, anchors as text, texts null where a batch says none. In each batch
first the forming event joins the pending one where the disposition is merge_into_pending, then new_N slots open events in
order, each segment adds its refs and its slice to the event of its slot, and at last texts that are said replace the
event's own. A batch's first segment has slot pending_tail or forming_existing if it goes on with an older event; where there is
none it is left out. As in every plan that passes its checks, two events are joined only in a batch that opens a new one.

Events are numbered in the order in which they open; a merged event keeps its older number. Here all batches are there at
once: numbers are running sums, and only the texts of merged events are folded, event by event, over what was said.
``storynet.streaming.state`` gives the same rows as batches come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.functions import text as tx

TEXTS = ("description", "story_summary")
#: What stands between two texts that are joined, and what the first of a one-line text loses at its end before.
SEPARATORS = {"description": "；", "story_summary": "\n"}
LOOSE_ENDS = "；。\n "
SLICE = "struct<batch_ix:bigint,seg_ix:bigint,source_refs:array<string>,start_anchors:string,end_anchors:string>"


def join_texts(left: Column, right: Column, separator: str) -> Column:
    """Both texts, or the one that contains the other by letters and digits only."""
    a, b = (F.coalesce(tx.stripped(c), F.lit("")) for c in (left, right))
    ca, cb = tx.letters(a), tx.letters(b)
    ends = r"\s+$" if separator == "\n" else f"[{LOOSE_ENDS}]+$"
    both = F.concat(F.regexp_replace(a, ends, ""), F.lit(separator), b)
    return F.when(a == "", b).when(b == "", a).when((cb != "") & ca.contains(cb), a).when((ca != "") & cb.contains(ca), b).otherwise(both)


def _opened(plan: DataFrame) -> DataFrame:
    """Adds raw, the number of the event that a segment belongs to before any merge, and merges, whether its batch joins two events."""
    upto = W.partitionBy("chat_id").orderBy("batch_ix", "seg_ix").rowsBetween(W.unboundedPreceding, 0)
    new = F.col("slot").startswith("new_")
    batch = W.partitionBy("chat_id", "batch_ix")
    first = F.row_number().over(batch.orderBy("seg_ix")) == 1
    rows = plan.withColumn("raw", F.sum(new.cast("int")).over(upto)).withColumn("first", first).withColumn("opens", F.max(new).over(batch))
    before = F.col("raw") - new.cast("int")  # the newest event before the batch, told by its first segment
    merges = F.col("first") & F.col("opens") & (F.col("disposition") == "merge_into_pending") & (before > 1)
    return rows.withColumn("joined", F.when(merges, before)).filter("raw > 0 or joined is not null")


def _survivors(rows: DataFrame) -> DataFrame:
    """chat_id, raw, own (the first raw number of the event it ends up in), joined_at (the batch in which it joined that event, or null)."""
    joined = rows.filter("joined is not null").groupBy("chat_id", F.col("joined").alias("raw")).agg(F.min("batch_ix").alias("joined_at"))
    events = rows.select("chat_id", "raw").distinct().join(joined, ["chat_id", "raw"], "left")
    opens = F.when(F.col("joined_at").isNull(), F.col("raw"))
    own = F.coalesce(F.last(opens, ignorenulls=True).over(W.partitionBy("chat_id").orderBy("raw").rowsBetween(W.unboundedPreceding, 0)), F.col("raw"))
    return events.withColumn("own", own)


def _folded(name: str) -> Column:
    """A text of an event over its sorted ``ops``(batch_ix, step, raw, text): step 0 joins the event ``raw`` to the one before it, step 1 says a text."""
    zero = F.struct(F.lit("").alias("left"), F.lit("").alias("right"), F.lit(-1).cast("bigint").alias("upto"))
    sep = SEPARATORS[name]

    def step(acc: Column, op: Column) -> Column:
        said = F.coalesce(tx.stripped(op[name]), F.lit(""))
        at = F.when(acc["upto"] < 0, op["raw"]).otherwise(acc["upto"])  # the newest raw event that is part of the left text
        joins = op["step"] == 0
        newer = op["raw"] > at
        left = F.when(joins, join_texts(acc["left"], acc["right"], sep)).when(~newer & (said != ""), said).otherwise(acc["left"])
        right = F.when(joins, F.lit("")).when(newer & (said != ""), said).otherwise(acc["right"])
        return F.struct(left.alias("left"), right.alias("right"), F.when(joins, op["raw"]).otherwise(at).alias("upto"))

    return F.aggregate("ops", zero, step, lambda acc: acc["left"])


def event_state(plan: DataFrame) -> DataFrame:
    """chat_id, event_no, status, description, story_summary, source_refs, source_slices of every event after all batches."""
    rows = _opened(plan)
    events = _survivors(rows)
    placed = rows.join(events.select("chat_id", "raw", "own", "joined_at"), ["chat_id", "raw"])
    keys = ["chat_id", F.col("own")]
    entry = F.struct(F.col("batch_ix").cast("bigint").alias("batch_ix"), F.col("seg_ix").cast("bigint").alias("seg_ix"), "source_refs", "start_anchors", "end_anchors")
    said = placed.select("chat_id", "own", "batch_ix", F.lit(1).alias("step"), F.col("raw").cast("bigint").alias("raw"), "seg_ix", *TEXTS)
    joins = events.filter("joined_at is not null").select("chat_id", "own", F.col("joined_at").alias("batch_ix"), F.lit(0).alias("step"), F.col("raw").cast("bigint").alias("raw"), F.lit(-1).alias("seg_ix"), *[F.lit(None).cast("string").alias(c) for c in TEXTS])
    op = F.struct("batch_ix", "step", "seg_ix", "raw", *TEXTS)
    texts = said.unionByName(joins).groupBy("chat_id", "own").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    # slices stand in the order in which their event got them: those of a joined event come after what the older one had by then
    since = F.struct(F.coalesce(F.greatest("joined_at", "batch_ix"), F.col("batch_ix")).alias("since"), (F.col("joined_at").isNull() | (F.col("joined_at") <= F.col("batch_ix"))).alias("own"))
    listed = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(since.alias("at"), entry.alias("slice")))).alias("all"))
    listed = listed.withColumn("source_slices", F.transform("all", lambda x: x["slice"]).cast(f"array<{SLICE}>"))
    listed = listed.withColumn("source_refs", F.array_distinct(F.flatten(F.transform("source_slices", lambda x: F.coalesce(x["source_refs"], F.array().cast("array<string>"))))))
    newest = F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("own")))
    status = F.when(newest == 1, "forming").when(newest == 2, "pending_finalization").otherwise("finalized")
    out = listed.join(texts, ["chat_id", "own"]).withColumn("status", status)
    return out.select("chat_id", F.col("own").cast("bigint").alias("event_no"), "status", *[_folded(c).alias(c) for c in TEXTS], "source_refs", "source_slices")
