"""Cutting batches into events and applying what is said about them.

A segment is a slot of a batch: forming_existing, pending_tail or new_N. Positions are (source_ix, offset).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.functions import text as tx
from storynet.functions.shared import saved
from storynet.operators import anchors

DISPOSITIONS = ("absent", "keep_distinct", "merge_into_pending")


def _batch():
    return W.partitionBy("chat_id", "batch_ix")


def event_starts(found: DataFrame, state: DataFrame) -> DataFrame:
    """``found``(chat_id, batch_ix, source_ix, offset, in_old): located starts; ``state``(chat_id, batch_ix, has_pending, has_forming, starts_anew).

    Starts inside older events go unless at offset 0, equal positions once, and (0, 0) is always a start. disposition: absent without events,
    merge_into_pending if a pending and a forming event exist and the text does not start anew, else keep_distinct.
    """
    own = found.filter("not in_old or offset = 0").select("chat_id", "batch_ix", "source_ix", "offset")
    forced = state.select("chat_id", "batch_ix", F.lit(0).cast("long").alias("source_ix"), F.lit(0).cast("long").alias("offset"))
    starts = own.unionByName(forced).distinct().join(state, ["chat_id", "batch_ix"])
    disposition = (
        F.when(~F.col("has_pending") & ~F.col("has_forming"), "absent")
        .when(F.col("has_pending") & F.col("has_forming") & ~F.col("starts_anew"), "merge_into_pending")
        .otherwise("keep_distinct")
    )
    opening = F.col("has_forming") & ~F.col("starts_anew")
    return starts.select("chat_id", "batch_ix", "source_ix", "offset", disposition.alias("disposition"), opening.alias("continues"))


def assign_roster(roster: DataFrame, starts: DataFrame) -> DataFrame:
    """``roster``(chat_id, batch_ix, key, source_ix, offset, aliases): each item to the last start at or before it: chat_id, batch_ix, start (source_ix, offset), key, aliases.

    An as-of join by a union and one window; items of a key in one segment become one.
    """
    place = F.struct("source_ix", "offset")
    a = starts.select("chat_id", "batch_ix", "source_ix", "offset", F.lit(0).alias("side"), place.alias("start"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<string>").alias("aliases"))
    b = roster.select("chat_id", "batch_ix", "source_ix", "offset", F.lit(1).alias("side"), F.lit(None).cast(a.schema["start"].dataType).alias("start"), "key", "aliases")
    last = F.last("start", ignorenulls=True).over(_batch().orderBy("source_ix", "offset", "side").rowsBetween(W.unboundedPreceding, 0))
    rows = a.unionByName(b).withColumn("start", last).filter("side = 1 and start is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("source_ix", "offset", "aliases"))), lambda x: F.coalesce(x["aliases"], F.array().cast("array<string>")))
    return rows.groupBy("chat_id", "batch_ix", "start", "key").agg(F.array_distinct(F.flatten(listed)).alias("aliases"))


def build_segments(starts: DataFrame) -> DataFrame:
    """Adds slot, seg_ix, first_source and last_source to the starts: each runs to the source of the next start, that included, since a message can be shared."""
    order = _batch().orderBy("source_ix", "offset")
    nxt, ix = F.lead("source_ix").over(order), F.row_number().over(order) - 1
    rows = starts.withColumn("seg_ix", ix).withColumn("last_source", nxt)
    old = (F.col("seg_ix") == 0) & F.col("continues")
    number = F.sum((~old).cast("int")).over(order)
    slot = F.when(old & (F.col("disposition") == "merge_into_pending"), "pending_tail").when(old, "forming_existing").otherwise(F.concat(F.lit("new_"), number.cast("string")))
    return rows.withColumn("slot", slot).withColumnRenamed("source_ix", "first_source")


def close_segments(segments: DataFrame) -> DataFrame:
    """Adds end_source and end_offset, the next start (exclusive), and boundary: whether an event ends here (not before the first new slot if there was none)."""
    order = _batch().orderBy("seg_ix")
    rows = segments.withColumn("end_source", F.lead("first_source").over(order)).withColumn("end_offset", F.lead("offset").over(order))
    first_new = (F.col("disposition") == "absent") & (F.col("seg_ix") == 0)
    return rows.withColumn("boundary", ~first_new & F.col("slot").startswith("new_"))


def clip_messages(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources``(chat_id, batch_ix, source_ix, content) cut to each segment: chat_id, batch_ix, slot, source_ix, text; blank parts go."""
    rows = segments.join(sources, ["chat_id", "batch_ix"]).filter(
        (F.col("source_ix") >= F.col("first_source")) & (F.col("end_source").isNull() | (F.col("source_ix") <= F.col("end_source")))
    )
    start = F.when(F.col("source_ix") == F.col("first_source"), F.col("offset")).otherwise(0)
    end = F.when(F.col("source_ix") == F.col("end_source"), F.col("end_offset")).otherwise(F.length("content"))
    text = F.substr(F.col("content"), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    return rows.withColumn("text", text).filter("trim(text) <> ''").select("chat_id", "batch_ix", "slot", "source_ix", "text")


def segments_from_candidates(blocks: DataFrame) -> DataFrame:
    """``blocks``(chat_id, batch_ix, block_ix, selected, decision, hard) to seg_ix: a block starts a segment if hard, or chosen as new_event; unresolved ones do not."""
    start = F.col("hard") | (F.col("selected") & (F.col("decision") == "new_event"))
    order = _batch().orderBy("block_ix").rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("seg_ix", F.sum((start & (F.col("block_ix") > 0)).cast("int")).over(order))


def place_starts(proposals: DataFrame) -> DataFrame:
    """``proposals``(chat_id, batch_ix, ord, continuing, block_key, inner_key, new_key): the partition key of each start; one that cannot be placed joins the key before, so nothing is lost."""
    order = _batch().orderBy("ord")
    key = F.when((F.col("ord") == 0) & F.col("continuing"), F.lit("old_tail")).otherwise(F.coalesce("block_key", "inner_key", "new_key"))
    rows = proposals.withColumn("own", key)
    filled = F.last("own", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("chat_id", "batch_ix", "ord", F.coalesce(filled, F.lit("old_tail")).alias("key"), F.col("own").isNull().alias("lost"))


def place_quotes(proposals: DataFrame, blocks: DataFrame, clues: DataFrame) -> DataFrame:
    """``proposals``(chat_id, batch_ix, ord, continuing, quote) with the keys that ``place_starts`` orders: block_key of the first block (chat_id, batch_ix, ix, block_key, text) that opens
    with the quote, inner_key of the first known clue (chat_id, batch_ix, ix, inner_key, text) that does, else new_key in the first block that holds it inside."""
    keys = ["chat_id", "batch_ix"]
    rows = proposals.withColumn("q", tx.anchor_text(F.col("quote")))
    asked = rows.filter("q <> ''").select(*keys, "ord", "q")
    plain = blocks.select(*keys, "ix", "block_key", tx.anchor_text(F.col("text")).alias("t"))
    met = asked.join(plain, keys).filter(F.contains("t", "q"))
    first = lambda c, when: F.min(F.when(when, F.struct("ix", F.col(c).alias("k"))))["k"]
    by_block = met.groupBy(*keys, "ord").agg(first("block_key", F.startswith("t", "q")).alias("block_key"), first("block_key", F.lit(True)).alias("inside"))
    by_clue = asked.join(clues.select(*keys, "ix", "inner_key", tx.anchor_text(F.col("text")).alias("t")), keys).filter(F.startswith("t", "q"))
    by_clue = by_clue.groupBy(*keys, "ord").agg(first("inner_key", F.lit(True)).alias("inner_key"))
    out = rows.join(by_block, [*keys, "ord"], "left").join(by_clue, [*keys, "ord"], "left")
    new = F.concat(F.lit("start_in_"), "inside", F.lit("_"), F.col("ord").cast("string"))
    return out.select(*keys, "ord", "continuing", "block_key", "inner_key", F.when(F.col("inside").isNotNull(), new).alias("new_key"))


def repair_anchors(segments: DataFrame, sources: DataFrame, size: int = 32) -> DataFrame:
    """``segments``(chat_id, batch_ix, seg_ix, refs, anchor_ref, anchor): a segment that opens on a message of its own gets that message's first characters; other anchors move to the only ref of the segment that holds them."""
    order = _batch().orderBy("seg_ix")
    shared = F.arrays_overlap(F.slice("refs", 1, 1), F.coalesce(F.lag("refs").over(order), F.array().cast("array<string>")))
    rows = segments.withColumn("fresh", ~shared)
    head = sources.select("chat_id", F.col("ref").alias("head_ref"), F.left("content", F.lit(size)).alias("head"))
    rows = rows.withColumn("head_ref", F.col("refs")[0]).join(head, ["chat_id", "head_ref"], "left")
    each = rows.select("chat_id", "batch_ix", "seg_ix", "anchor", F.explode("refs").alias("ref")).join(sources.select("chat_id", "ref", "content"), ["chat_id", "ref"])
    q = tx.anchor_text(F.col("anchor"))
    hits = each.filter((q != "") & F.contains(tx.anchor_text(F.col("content")), q)).groupBy("chat_id", "batch_ix", "seg_ix").agg(F.min("ref").alias("hit"), F.count("*").alias("n"))
    rows = rows.join(hits, ["chat_id", "batch_ix", "seg_ix"], "left")
    ref = F.when(F.col("fresh"), F.col("head_ref")).when(F.col("n") == 1, F.col("hit")).otherwise(F.col("anchor_ref"))
    return rows.select("chat_id", "batch_ix", "seg_ix", "refs", ref.alias("anchor_ref"), F.when(F.col("fresh"), F.col("head")).otherwise(F.col("anchor")).alias("anchor"))


def block_partition_map(block_refs: DataFrame, segment_refs: DataFrame, inner: DataFrame) -> DataFrame:
    """``block_refs``(chat_id, block, ref), ``segment_refs``(chat_id, segment, ref), ``inner``(chat_id, ref): blocks all of whose refs lie in one segment and start none inside."""
    n = block_refs.groupBy("chat_id", "block").agg(F.countDistinct("ref").alias("n"))
    met = block_refs.join(segment_refs, ["chat_id", "ref"]).groupBy("chat_id", "block").agg(
        F.countDistinct("ref").alias("met"), F.countDistinct("segment").alias("k"), F.min("segment").alias("segment"), F.count("*").alias("rows")
    )
    cut = block_refs.join(inner, ["chat_id", "ref"]).select("chat_id", "block").distinct()
    return met.join(n, ["chat_id", "block"]).filter("met = n and k = 1 and rows = n").join(cut, ["chat_id", "block"], "left_anti").select("chat_id", "block", "segment")


def decode_decisions(decisions: DataFrame, candidates: DataFrame, legal=("new_event", "continue", "unresolved")) -> tuple[DataFrame, DataFrame]:
    """``decisions``(chat_id, id, decision) on ``candidates``(chat_id, id): a decision for each, unresolved if missing or illegal; and those with unknown ids."""
    keys = ["chat_id", "id"]
    one = decisions.groupBy(*keys).agg(F.min("decision").alias("decision"))
    rows = candidates.select(*keys).distinct().join(one, keys, "left")
    rows = rows.withColumn("decision", F.when(F.col("decision").isin(*legal), F.col("decision")).otherwise("unresolved"))
    return rows, decisions.join(candidates.select(*keys), keys, "left_anti")


def apply_boundaries(slots: DataFrame) -> DataFrame:
    """``slots``(chat_id, batch_ix, seg_ix, slot, disposition): the event number of every slot, with merges resolved: a forming event merged into the pending one takes its number.

    Each new slot opens an event. A merge joins the newest event so far to the one before it; merged ones form islands, numbered again in order.
    """
    rows = raw_events(slots)
    events = merged_events(rows)
    return rows.join(events, ["chat_id", "raw"]).select("chat_id", "batch_ix", "seg_ix", "slot", "event_no")


def raw_events(slots: DataFrame) -> DataFrame:
    """Adds raw: the number of the event that a slot belongs to before any merge."""
    upto = W.partitionBy("chat_id").orderBy("batch_ix", "seg_ix").rowsBetween(W.unboundedPreceding, 0)
    return slots.withColumn("raw", F.sum(F.col("slot").startswith("new_").cast("int")).over(upto))


def merged_events(rows: DataFrame) -> DataFrame:
    """chat_id, raw, event_no: the event in which each raw one of ``raw_events`` ends up."""
    # a merge, told with the first slot of its batch, closes the gap before the event that was newest then
    merged = rows.filter("disposition = 'merge_into_pending' and seg_ix = 0").select("chat_id", (F.col("raw") - F.col("slot").startswith("new_").cast("int")).alias("raw")).distinct()
    events = rows.select("chat_id", "raw").distinct().join(merged.withColumn("joined", F.lit(1)), ["chat_id", "raw"], "left")
    opens = F.when(F.col("joined") == 1, 0).otherwise(1)
    number = F.sum(opens).over(W.partitionBy("chat_id").orderBy("raw").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("event_no", F.greatest(number, F.lit(1))).select("chat_id", "raw", "event_no")


def rebind_memories(memories: DataFrame, events: DataFrame) -> DataFrame:
    """``memories``(chat_id, memory_id, raw) bound to the events (``merged_events``) in which theirs ended up; a memory of two events that became one names it once."""
    return memories.join(events, ["chat_id", "raw"]).select("chat_id", "memory_id", "event_no").distinct()


def merge_texts(a: Column, b: Column, separator: str = "\n") -> Column:
    """The side that contains the other, by compact text, else both."""
    ca, cb = tx.anchor_text(F.coalesce(a, F.lit(""))), tx.anchor_text(F.coalesce(b, F.lit("")))
    return F.when(F.contains(ca, cb), a).when(F.contains(cb, ca), b).otherwise(F.concat(a, F.lit(separator), b))


def apply_event_updates(events: DataFrame, updates: DataFrame) -> DataFrame:
    """``events``(event_id, description, summary, participants, locations, unresolved, details), ``updates``(event_id, description, summary, kept, new_details, and for each list list_add and list_remove), arrays in order.

    Blank texts change nothing; of participants, locations and unresolved things some are added, then some removed; details are the kept ones, then new ones, once for each (content, ref).
    """
    none = F.array().cast("array<string>")
    lists = ("participants", "locations", "unresolved")
    u = updates.select("event_id", *[F.col(c).alias(f"u_{c}") for c in ("description", "summary", "kept", "new_details", *[f"{x}_{y}" for x in lists for y in ("add", "remove")])])
    rows = events.join(u, "event_id", "left")
    text = lambda c: F.coalesce(F.when(F.trim(f"u_{c}") != "", F.col(f"u_{c}")), F.col(c)).alias(c)
    members = lambda c: F.array_except(F.array_union(c, F.coalesce(f"u_{c}_add", none)), F.coalesce(f"u_{c}_remove", none)).alias(c)
    kept = F.when(F.col("u_kept").isNull(), F.col("details")).otherwise(F.filter("details", lambda x: F.array_contains(F.col("u_kept"), x["id"])))
    new = F.coalesce(F.col("u_new_details"), F.array().cast(events.schema["details"].dataType))
    every = F.concat(kept, new)
    seen = F.transform(every, lambda x: F.struct(x["content"].alias("c"), x["ref"].alias("r")))
    details = F.filter(every, lambda x, i: F.array_position(seen, F.struct(x["content"].alias("c"), x["ref"].alias("r"))) == i + 1)
    return rows.select("event_id", text("description"), text("summary"), *map(members, lists), details.alias("details"))


#: Fixed value: what a text loses at its end before another one is put after it.
LOOSE_ENDS = "。；、/／"


def complete_text(left: Column, right: Column, separator: str = "\n") -> Column:
    """Both texts as they are, or the one that contains the other literally."""
    a, b = (F.coalesce(tx.stripped(c), F.lit("")) for c in (left, right))
    both = F.concat(F.regexp_replace(a, f"[{LOOSE_ENDS}]+$", ""), F.lit(separator), b)
    return F.when(a == "", b).when((b == "") | a.contains(b), a).when(b.contains(a), b).otherwise(both)


def summary_increment(base: Column, added: Column) -> tuple[Column, Column]:
    """The new summary and what happened: missing, contained (nothing new), replaced (it has the whole old one) or appended. Containment is by letters and digits only."""
    old, new = F.coalesce(base, F.lit("")), F.coalesce(tx.stripped(added), F.lit(""))
    a, b = tx.letters(old), tx.letters(new)
    status = F.when(new == "", "missing").when((a != "") & (b != "") & a.contains(b), "contained").when((a != "") & b.contains(a), "replaced").otherwise("appended")
    return F.when(status.isin("missing", "contained"), old).when(status == "replaced", new).otherwise(complete_text(old, new)), status


def coalesce_updates(updates: DataFrame) -> DataFrame:
    """``updates``(chat_id, segment, ord, description, summary, members, start, end) of one segment to one: the last description, joined summaries, all members, first start and last end."""
    seq = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    return updates.groupBy("chat_id", "segment").agg(
        F.max(F.when(F.trim("description") != "", F.struct("ord", "description")))["description"].alias("description"),
        F.array_join(F.array_distinct(F.filter(seq("summary"), lambda s: s.isNotNull() & (F.trim(s) != ""))), "\n").alias("summary"),
        F.array_distinct(F.flatten(seq("members"))).alias("members"),
        F.min(F.when(F.col("start").isNotNull(), F.struct("ord", "start")))["start"].alias("start"),
        F.max(F.when(F.col("end").isNotNull(), F.struct("ord", "end")))["end"].alias("end"),
    )


def drop_stale_copies(updates: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``updates``(chat_id, update_id, event_id, title, description, summary): kept, and those (chat_id, update_id, copied) that copy another event: its summary, two of its three texts at
    least, and more of them than of their own target's. Blank texts are equal to nothing; an update whose target is not among ``events`` stays, since nothing tells what it should be."""
    texts = ("title", "description", "summary")
    plain = lambda c: F.nullif(tx.stripped(c), F.lit(""))
    of = lambda df, p: [plain(c).alias(f"{p}{c}") for c in texts]
    other = events.filter("event_id is not null").select("chat_id", F.col("event_id").alias("copied"), *of(events, "")).distinct()
    own = events.select("chat_id", "event_id", *of(events, "t_"))
    same = sum((F.coalesce(F.col(c) == F.col(f"t_{c}"), F.lit(False)).cast("int") for c in texts), F.lit(0))
    asked = updates.select("chat_id", "update_id", "event_id", *of(updates, "")).join(own, ["chat_id", "event_id"]).withColumn("same", same).filter("same < 3")
    found = []
    for least, equal in ((1, ("title", "summary")), (1, ("description", "summary")), (2, texts)):
        key = ["chat_id", *equal]
        rows = asked.filter(F.col("same") <= least).join(_two_least(other, key), key)
        found.append(rows.select("chat_id", "update_id", F.when(F.col("least") != F.col("event_id"), F.col("least")).otherwise(F.col("next")).alias("copied")))
    bad = found[0].unionByName(found[1]).unionByName(found[2]).filter("copied is not null").groupBy("chat_id", "update_id").agg(F.min("copied").alias("copied"))
    return updates.join(bad, ["chat_id", "update_id"], "left_anti"), bad


def _two_least(events: DataFrame, key: list[str]) -> DataFrame:
    """The two least ids (least, next) of the events (copied) of each key: one of them is not an update's own target, so no update meets all events that share its texts."""
    first = events.groupBy(*key).agg(F.min("copied").alias("least"))
    other = events.join(first, key).filter("copied <> least").groupBy(*key).agg(F.min("copied").alias("next"))
    return first.join(other, key, "left")


def drop_noop_updates(updates: DataFrame, segments: DataFrame) -> DataFrame:
    """Updates (chat_id, segment, delta, n_details) of segments that are final (chat_id, segment), of none that is named, or that bring something of this batch."""
    final = segments.select("chat_id", "segment", F.lit(True).alias("final")).distinct()
    rows = updates.join(final, ["chat_id", "segment"], "left")
    unnamed = F.coalesce(tx.stripped("segment"), F.lit("")) == ""
    return rows.filter(F.coalesce("final", F.lit(False)) | unnamed | (F.trim(F.coalesce("delta", F.lit(""))) != "") | (F.col("n_details") > 0)).select(*updates.columns)


def assign_update_slots(updates: DataFrame, slots: DataFrame) -> DataFrame:
    """``updates``(chat_id, key) to ``slots``(chat_id, key, slot): if exactly one slot got no update and exactly one key is unknown, they belong together."""
    known = updates.join(slots, ["chat_id", "key"])
    missing = slots.join(updates, ["chat_id", "key"], "left_anti").groupBy("chat_id").agg(F.count("*").alias("n"), F.min("slot").alias("slot"))
    unknown = updates.join(slots, ["chat_id", "key"], "left_anti").groupBy("chat_id").agg(F.count("*").alias("k"), F.min("key").alias("key"))
    mended = unknown.join(missing, "chat_id").filter("n = 1 and k = 1")
    return known.select("chat_id", "key", "slot", F.lit(False).alias("repaired")).unionByName(mended.select("chat_id", "key", "slot", F.lit(True).alias("repaired")))


def canonical_details(details: DataFrame, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``details``(event_id, ord, ref, kind, content) against ``slices``(event_id, ref, text): with the ref that holds the text (verbatim), else as the part of their own ref's text that they nearly are
    (verbatim, ``nearest_quote``), else under their own ref if the event has it (paraphrase), else dropped."""
    # both sides are normalised before they meet, and only pairs that say something are grouped
    asked = details.select("event_id", "ord", "ref", tx.anchor_text(F.col("content")).alias("q"))
    told = slices.select("event_id", F.col("ref").alias("at"), tx.anchor_text(F.col("text")).alias("t"))
    own, holds = F.col("at") == F.col("ref"), F.contains("t", "q") & (F.col("q") != "")
    met = asked.join(told, "event_id").select("event_id", "ord", "at", own.alias("own"), holds.alias("holds")).filter("own or holds")
    found = met.groupBy("event_id", "ord").agg(F.max(F.when(F.col("holds"), F.struct("own", "at")))["at"].alias("held"), F.max(F.when(F.col("own"), F.col("at"))).alias("own"))
    rows = saved(details.join(found, ["event_id", "ord"], "left"))
    at, name, open_ = F.struct("event_id", "ref").alias("ref"), F.struct("event_id", "ord"), F.col("held").isNull() & F.col("own").isNotNull()
    near = anchors.nearest_quote(rows.filter(open_).select(name.alias("quote_id"), at, F.col("content").alias("quote")), slices.select(at, F.col("text").alias("content")))
    undecided = rows.filter(open_).withColumn("quote_id", name).join(near, "quote_id", "left").drop("quote_id")
    rows = rows.filter(~open_).withColumn("part", F.lit(None).cast("string")).unionByName(undecided)
    fidelity = F.when(F.col("held").isNotNull() | F.col("part").isNotNull(), "verbatim").when(F.col("own").isNotNull(), "paraphrase")
    rows = rows.withColumn("fidelity", fidelity).withColumn("ref", F.coalesce("held", "own", "ref")).withColumn("content", F.coalesce("part", "content"))
    columns = ["event_id", "ord", "ref", "kind", "content"]
    return rows.filter("fidelity is not null").select(*columns, "fidelity"), rows.filter("fidelity is null").select(*columns)


def event_times(found: DataFrame, events: DataFrame) -> DataFrame:
    """``found``(event_id, pos, expression, from_header), ``events``(event_id, status): start and end; header times come before body times (approximate), a forming event has no end."""
    best = F.max(F.col("from_header")).over(W.partitionBy("event_id"))
    rows = found.withColumn("best", best).filter("from_header = best").groupBy("event_id").agg(
        F.min(F.struct("pos", "expression"))["expression"].alias("start"), F.max(F.struct("pos", "expression"))["expression"].alias("last"), F.max("from_header").alias("header")
    )
    rows = rows.join(events.select("event_id", "status"), "event_id")
    end = F.when((F.col("last") != F.col("start")) & (F.col("status") != "forming"), F.col("last"))
    return rows.select("event_id", "start", end.alias("end"), F.when(F.col("header"), "exact").otherwise("approximate").alias("precision"))


def supported_times(times: DataFrame, lines: DataFrame) -> DataFrame:
    """``times``(event_id, part, expression), ``lines``(event_id, line): expressions that the event's text holds, whole but for blanks and punctuation, or in two parts or more, in order on one
    line with anything between. Parts stand between blanks and the marks of dates; they and lines are compared by letters and digits, and a part has two of these at least."""
    parts = F.filter(F.transform(F.split("expression", r"[\s，。；：、·,.;:|/]+"), tx.letters), lambda p: F.length(p) >= 2)
    rows = times.withColumns({"parts": parts, "whole": tx.anchor_text(F.col("expression"))}).join(lines, "event_id")
    # letters and digits only: nothing in them is special in a pattern
    inside = F.exists(F.transform(F.split("line", r"\R"), tx.letters), lambda x: F.rlike(x, F.array_join("parts", ".*")))
    held = ((F.col("whole") != "") & F.contains(tx.anchor_text(F.col("line")), F.col("whole"))) | ((F.size("parts") >= 2) & inside)
    return rows.filter(held).select("event_id", "part", "expression").distinct()


def sanitize_times(events: DataFrame, supported: DataFrame) -> DataFrame:
    """``events``(event_id, status, start, end, old_start, old_end): the time that an update brings. Expressions that are neither supported nor the event's own before go, a forming event has no
    end, and without a start there is no time. What is left cannot move a start that the event had; an update without a time has none here, so the event keeps its own."""
    ok = lambda part, alias: supported.filter(F.col("part") == part).select("event_id", F.lit(True).alias(alias))
    rows = events.join(ok("start", "s_ok"), "event_id", "left").join(ok("end", "e_ok"), "event_id", "left")
    before = lambda c: F.coalesce((F.col(c) == F.col("old_start")) | (F.col(c) == F.col("old_end")), F.col(c) == F.col("old_start"), F.col(c) == F.col("old_end"), F.lit(False))
    good = lambda c, k: F.when(F.coalesce(F.col(k), F.lit(False)) | before(c), F.col(c))
    start, end = good("start", "s_ok"), F.when(F.col("status") != "forming", good("end", "e_ok"))
    return rows.select("event_id", F.when(start.isNotNull(), F.coalesce("old_start", start)).alias("start"), F.when(start.isNotNull(), end).alias("end"))


def lock_boundaries(replies: DataFrame, locked: DataFrame) -> DataFrame:
    """Content of ``replies``(chat_id, key, summary_add, description, details) on the boundaries of ``locked``: what a reply says of boundaries is not read, and slots without a reply stay."""
    content = replies.select("chat_id", "key", "summary_add", "description", "details").dropDuplicates(["chat_id", "key"])
    return locked.join(content, ["chat_id", "key"], "left")


def boundary_violations(segments: DataFrame, messages: DataFrame, state: DataFrame) -> DataFrame:
    """``segments``(chat_id, batch_ix, seg_ix, slot, refs, disposition), ``messages``(chat_id, batch_ix, ref), ``state``(chat_id, batch_ix, has_pending, has_forming): chat_id, batch_ix, seg_ix, code."""
    keys = ["chat_id", "batch_ix"]
    order = _batch().orderBy("seg_ix")
    new = F.regexp_extract("slot", r"^new_([0-9]+)$", 1)
    rows = segments.join(state, keys, "left").withColumn("new", F.when(new != "", new.cast("int")))
    rows = rows.withColumn("expected", F.sum(F.col("new").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("uses", F.count("*").over(W.partitionBy(*keys, "slot")))
    legal = F.col("slot").isin("forming_existing", "pending_tail") | F.col("new").isNotNull()
    codes = F.array(
        F.when(~legal, "ILLEGAL_SLOT"),
        F.when(F.col("uses") > 1, "DUPLICATE_SLOT"),
        F.when(F.col("new").isNotNull() & (F.col("new") != F.col("expected")), "SLOT_SEQUENCE"),
        F.when(~F.col("disposition").isin(*DISPOSITIONS), "INVALID_DISPOSITION"),
        F.when((F.col("slot") == "forming_existing") & ~F.col("has_forming"), "SLOT_WITHOUT_FORMING"),
        F.when((F.col("slot") == "pending_tail") & ~F.col("has_pending"), "SLOT_WITHOUT_PENDING"),
        F.when((F.col("disposition") == "absent") & (F.col("has_pending") | F.col("has_forming")), "DISPOSITION_STATE_MISMATCH"),
        F.when(F.size("refs") == 0, "EMPTY_SEGMENT"),
    )
    own = rows.select(*keys, "seg_ix", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    each = segments.select(*keys, "seg_ix", F.explode("refs").alias("ref"))
    strange = each.join(messages, [*keys, "ref"], "left_anti").select(*keys, "seg_ix", F.lit("UNKNOWN_SOURCE_REF").alias("code"))
    left = messages.join(each, [*keys, "ref"], "left_anti").select(*keys, F.lit(-1).alias("seg_ix"), F.lit("UNASSIGNED_MESSAGE").alias("code"))
    return own.unionByName(strange.distinct()).unionByName(left)


def _rank(slot: str) -> Column:
    """The place of a slot in time: the pending tail, the forming event, then the new ones by number; null if there is no such slot."""
    new = F.regexp_extract(slot, r"^new_([0-9]+)$", 1)
    return F.when(F.col(slot) == "pending_tail", 0).when(F.col(slot) == "forming_existing", 1).when(new != "", 2 + new.cast("int"))


def disposition_violations(plans: DataFrame, slots: DataFrame, state: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Whole boundary plans: chat_id, batch_ix, code.

    ``plans``(chat_id, batch_ix, disposition), ``slots``(chat_id, batch_ix, seg_ix, slot), ``state``(chat_id, batch_ix, has_events, has_pending, has_forming),
    ``boundaries``(chat_id, batch_ix, ix): what the disposition needs of the state and of the slots, their order, and as many boundaries as new events.
    """
    keys = ["chat_id", "batch_ix"]
    ranked = slots.withColumn("rank", _rank("slot"))
    known = ranked.filter("rank is not null").withColumn("back", F.lag("rank").over(_batch().orderBy("seg_ix")) > F.col("rank"))
    used = ranked.groupBy(*keys).agg(F.count("*").alias("n_segments"))
    legal = known.groupBy(*keys).agg(
        F.max("back").alias("back"), F.max(F.col("rank") == 0).alias("pending"), F.max(F.col("rank") == 1).alias("forming"),
        F.countDistinct(F.when(F.col("rank") > 1, F.col("rank"))).alias("n_new"),
    )
    n = boundaries.groupBy(*keys).agg(F.count("*").alias("n_boundaries"))
    rows = plans.join(state, keys, "left").join(used, keys, "left").join(legal, keys, "left").join(n, keys, "left")
    rows = rows.fillna(0, ["n_segments", "n_new", "n_boundaries"]).fillna(False, ["has_events", "has_pending", "has_forming", "back", "pending", "forming"])
    is_ = lambda d: F.coalesce(F.col("disposition") == d, F.lit(False))
    starts = F.when(is_("absent"), F.greatest(F.col("n_new") - 1, F.lit(0))).otherwise(F.col("n_new"))
    codes = F.array(
        F.when(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), "INVALID_DISPOSITION"),
        F.when(~F.col("has_events") & ~is_("absent"), "FIRST_PLAN_NOT_ABSENT"),
        F.when(F.col("has_events") & is_("absent"), "ABSENT_WITH_EVENTS"),
        F.when(is_("merge_into_pending") & ~(F.col("has_pending") & F.col("has_forming")), "MERGE_WITHOUT_BOTH_EVENTS"),
        F.when(is_("keep_distinct") & ~F.col("has_forming"), "DISTINCT_WITHOUT_FORMING"),
        F.when(F.col("n_segments") == 0, "NO_SEGMENTS"),
        F.when(F.col("back"), "SLOT_ORDER"),
        F.when(is_("merge_into_pending") & F.col("forming"), "MERGE_WITH_FORMING_SLOT"),
        F.when(is_("merge_into_pending") & (F.col("n_new") == 0), "MERGE_WITHOUT_NEW_EVENT"),
        F.when(is_("keep_distinct") & F.col("pending"), "DISTINCT_WITH_PENDING_SLOT"),
        F.when(is_("absent") & (F.col("pending") | F.col("forming")), "ABSENT_WITH_OLD_SLOT"),
        F.when(F.col("n_boundaries") != starts, "BOUNDARY_COUNT"),
    )
    return rows.select(*keys, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def anchor_violations(plans: DataFrame, segments: DataFrame, boundaries: DataFrame, messages: DataFrame) -> DataFrame:
    """Anchors of boundary plans: chat_id, batch_ix, ix, code.

    ``plans``(chat_id, batch_ix, disposition), ``segments``(chat_id, batch_ix, seg_ix, slot, refs, starts, ends), ``boundaries``(chat_id, batch_ix, ix, slot, anchors),
    where starts, ends and anchors are arrays of (ref, quote), ``messages``(chat_id, batch_ix, ref, content). Start anchors lie in their segment's messages, once each, the
    first in the first one; a message that two segments share starts the second one by an anchor of its own; boundaries repeat the start anchors of the new events they open.
    """
    keys = ["chat_id", "batch_ix"]
    texts = messages.select(*keys, "ref", tx.anchor_text(F.col("content")).alias("body"))

    def quoted(df: DataFrame, ix: str, column: str, extra: list[str]) -> DataFrame:
        each = df.select(*keys, F.col(ix).alias("ix"), *extra, F.posexplode(column).alias("k", "x")).select(*keys, "ix", "k", *extra, "x.ref", tx.anchor_text(F.trim("x.quote")).alias("q"))
        each = each.join(texts, [*keys, "ref"], "left")
        return each.withColumn("holds", F.coalesce((F.col("q") != "") & F.contains("body", "q"), F.lit(False)))

    coded = lambda df, code: df.select(*keys, "ix", (code if isinstance(code, Column) else F.lit(code)).alias("code"))
    starts, ends = quoted(segments, "seg_ix", "starts", ["refs"]), quoted(segments, "seg_ix", "ends", ["refs"])
    inside = F.array_contains("refs", F.col("ref"))
    seg = segments.withColumn("ix", F.col("seg_ix")).withColumn("at", F.transform("starts", lambda x: x["ref"]))
    before = F.lag("refs").over(_batch().orderBy("seg_ix"))
    shared = seg.withColumn("shared", F.array_except(F.array_intersect("refs", F.coalesce(before, F.array().cast("array<string>"))), F.col("at")))
    first = F.try_element_at("at", F.lit(1)) != F.try_element_at("refs", F.lit(1))
    out = [
        coded(seg.filter(F.size("starts") == 0), "NO_START_ANCHOR"),
        coded(starts.filter(~inside), "START_ANCHOR_OUTSIDE_SEGMENT"),
        coded(starts.filter(inside & ~F.col("holds")), "START_ANCHOR_NOT_FOUND"),
        coded(seg.filter(F.size("at") != F.size(F.array_distinct("at"))), "DUPLICATE_START_ANCHOR"),
        coded(seg.filter(first), "FIRST_ANCHOR_NOT_FIRST_SOURCE"),
        coded(ends.filter(~(inside & F.col("holds"))), "END_ANCHOR_NOT_FOUND"),
        coded(shared.filter(F.size("shared") > 0), "SHARED_MESSAGE_WITHOUT_START"),
    ]
    told = quoted(boundaries, "ix", "anchors", [])
    out.append(coded(told.filter("not holds"), F.when(F.col("body").isNull(), "BOUNDARY_ANCHOR_OUTSIDE_BATCH").otherwise("BOUNDARY_ANCHOR_NOT_FOUND")))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["ref"].alias("ref"), tx.anchor_text(x["quote"]).alias("q")))
    new = segments.withColumn("rank", _rank("slot")).filter("rank > 1").groupBy(*keys, "slot", "rank").agg(F.min(F.struct("seg_ix", "starts"))["starts"].alias("starts"))
    new = new.join(plans, keys).withColumn("ix", F.row_number().over(_batch().orderBy("rank")) - F.when(F.col("disposition") == "absent", 2).otherwise(1)).filter("ix >= 0")
    given = boundaries.select(*keys, "ix", F.col("slot").alias("given"), "anchors")
    counts = new.groupBy(*keys).agg(F.count("*").alias("n")).join(given.groupBy(*keys).agg(F.count("*").alias("m")), keys).filter("n = m")
    both = new.join(given, [*keys, "ix"]).join(counts.select(*keys), keys, "left_semi")
    out.append(coded(both.filter((F.col("slot") != F.col("given")) | (plain("starts") != plain("anchors"))), "BOUNDARY_MISMATCH"))
    return reduce(DataFrame.unionByName, out)


def content_violations(updates: DataFrame, segment_refs: DataFrame, old_details: DataFrame, details: DataFrame, slices: DataFrame) -> DataFrame:
    """Content plans: chat_id, key, severity, code.

    ``updates``(chat_id, key, description, story_summary, participants_add, ..., key_details_keep: arrays, null if missing), ``segment_refs``(chat_id, key, ref), ``old_details``(chat_id, key, id)
    of the event a slot continues, ``details``(chat_id, key, ord, kind, content, refs, fidelity), ``slices``(chat_id, key, ref, text).
    """
    keys = ["chat_id", "key"]
    row = lambda df, severity, code: df.select(*keys, F.lit(severity).alias("severity"), (code if isinstance(code, Column) else F.lit(code)).alias("code"))
    lists = [c for c in CONTENT_LISTS if c in updates.columns]
    empty = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"EMPTY_{c.upper()}")) for c in ("description", "story_summary")]
    missing = [F.when(F.col(c).isNull(), F.lit(f"MISSING_LIST_{c.upper()}")) for c in lists]
    own = updates.select(*keys, F.explode(F.filter(F.array(*empty, *missing), lambda c: c.isNotNull())).alias("code"))
    kept = updates.select(*keys, F.explode("key_details_keep").alias("id"))
    n = updates.select(*keys, F.coalesce(F.size("key_details_keep"), F.lit(0)).alias("k")).join(details.groupBy(*keys).agg(F.count("*").alias("d")), keys, "left").fillna(0, ["d"])
    refs = segment_refs.groupBy(*keys).agg(F.collect_set("ref").alias("own"))
    told = details.join(refs, keys, "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    bare = F.coalesce(F.size("refs") <= 0, F.lit(True))
    outside = F.size(F.array_except("refs", "own")) > 0
    blank = F.coalesce(F.trim("content"), F.lit("")) == ""
    good = told.filter(~bare).filter(~outside & ~blank & ~F.coalesce(F.col("fidelity") == "paraphrase", F.lit(False)))
    met = good.select(*keys, "ord", tx.anchor_text(F.col("content")).alias("q"), F.explode("refs").alias("ref")).join(slices, [*keys, "ref"], "left")
    held = met.groupBy(*keys, "ord").agg(F.max(F.coalesce((F.col("q") != "") & F.contains(tx.anchor_text(F.col("text")), F.col("q")), F.lit(False))).alias("held"))
    return reduce(DataFrame.unionByName, [
        row(own, "error", F.col("code")),
        row(updates.filter(F.length("story_summary") > 500), "warning", "LONG_SUMMARY"),
        row(kept.join(old_details, [*keys, "id"], "left_anti").select(*keys).distinct(), "error", "FOREIGN_DETAIL_KEPT"),
        row(n.filter("k + d > 5"), "warning", "MANY_DETAILS"),
        row(details.filter("kind is null or kind not in ('statement', 'action')"), "error", "INVALID_DETAIL_KIND"),
        row(details.filter(blank), "error", "EMPTY_DETAIL"),
        row(told.filter(bare), "error", "DETAIL_WITHOUT_SOURCE"),
        row(told.filter(~bare).filter(outside), "error", "DETAIL_SOURCE_OUTSIDE_SLOT"),
        row(held.filter("not held"), "warning", "DETAIL_NOT_VERBATIM"),
    ])


#: The lists that a content update must have.
CONTENT_LISTS = ("participants_add", "participants_remove", "locations_add", "locations_remove", "unresolved_add", "unresolved_resolve", "key_details_keep", "new_key_details")


def event_plan(found: DataFrame, state: DataFrame, sources: DataFrame, roster: DataFrame, updates: DataFrame) -> dict[str, DataFrame]:
    """The event plan of all batches, in the fixed order: starts, segments, their ends, clipped texts, roster by segment, event numbers, slots of updates.

    ``found`` and ``state`` as in ``event_starts``, ``sources``(chat_id, batch_ix, source_ix, content), ``roster`` as in ``assign_roster``, ``updates``(chat_id, batch_ix, slot, ...).
    Each step is an input of the next, so a caller reads any of them; nothing runs before one is used.
    """
    starts = event_starts(found, state)
    cut = close_segments(build_segments(starts))
    numbers = apply_boundaries(cut)
    ends = cut.select("chat_id", "batch_ix", "slot", "seg_ix", F.struct(F.col("first_source").alias("source_ix"), "offset").alias("start"))
    listed = assign_roster(roster, starts).join(ends, ["chat_id", "batch_ix", "start"]).select("chat_id", "batch_ix", "slot", "key", "aliases")
    keys = ["chat_id", "batch_ix", "slot"]
    told = numbers.join(updates, keys, "left")
    return {"starts": starts, "segments": cut, "texts": clip_messages(cut, sources), "roster": listed, "events": numbers, "updates": told}


def plan_violations(updates: DataFrame, slots: DataFrame, details: DataFrame, memories: DataFrame, sources: DataFrame) -> DataFrame:
    """Content-plan checks: chat_id, key, severity, code.

    ``updates``(chat_id, key, summary, description, n_details), ``slots``(chat_id, key), ``details``(chat_id, key, kind, ref), ``memories``(chat_id, key, n), ``sources``(chat_id, ref).
    """
    row = lambda df, severity, code: df.select("chat_id", "key", F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    keys = ["chat_id", "key"]
    twice = updates.groupBy(*keys).count().filter("count > 1")
    return (
        row(slots.join(updates, keys, "left_anti"), "error", "MISSING_SLOT")
        .unionByName(row(updates.join(slots, keys, "left_anti"), "error", "EXTRA_SLOT"))
        .unionByName(row(twice, "error", "DUPLICATE_SLOT"))
        .unionByName(row(details.filter("kind is null or kind not in ('statement', 'action')"), "error", "INVALID_DETAIL_KIND"))
        .unionByName(row(details.join(sources, ["chat_id", "ref"], "left_anti"), "error", "DETAIL_REF_OUTSIDE_BATCH"))
        .unionByName(row(memories.filter("n > 3"), "error", "TOO_MANY_MEMORIES"))
        .unionByName(row(updates.filter("length(summary) > 500"), "warning", "LONG_SUMMARY"))
        .unionByName(row(updates.filter("length(description) > 160"), "warning", "LONG_DESCRIPTION"))
        .unionByName(row(updates.filter("n_details > 5"), "warning", "MANY_DETAILS"))
    )
