"""The normalised event plan of a batch: from proposed starts to segments, texts and updates, with what was dropped or repaired on the way.

A batch's messages come in blocks (rounds). An event may start at a block, or inside one where a clue or a proposal points.
``derive_segments`` merges both kinds of starts in the order of the text: a block's start opens a group, starts inside cut
groups, and starts at one place are one. ``normalise_event_plan`` is the chain of all steps; each is a function of
DataFrames, and whatever a step drops or mends is a row of the audit.

Keys of all frames are (chat_id, batch_ix); ``old_tail`` is the key of what goes on with the forming event.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.functions import text as tx
from storynet.functions.shared import saved
from storynet.operators import anchors, segments

BATCH = ["chat_id", "batch_ix"]
OLD_TAIL = "old_tail"
#: Characters of a message that make its opening.
OPENING = 32
AUDIT = [*BATCH, "step", "key", "code"]


def note(rows: DataFrame, step: str, key: str | Column, code: str | Column) -> DataFrame:
    """Audit rows."""
    code = F.lit(code) if isinstance(code, str) else code
    return rows.select(*BATCH, F.lit(step).alias("step"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), code.alias("code"))


def starts_of(blocks: DataFrame, inner: DataFrame, chosen: DataFrame, unresolved: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every candidate start with its decision: chat_id, batch_ix, key, inner, decision; and audit rows.

    ``blocks``(block_ix, block_key, hard), ``inner``(start_key, hard), ``chosen``(key) by the plan's items, ``unresolved``(key)
    that it leaves open, ``state``(has_forming). A hard or chosen start is a new event, else one left open is unresolved, else
    the text goes on. The first block needs no decision if no event is forming: it starts one.
    """
    every = blocks.select(*BATCH, F.col("block_key").alias("key"), F.lit(False).alias("inner"), "hard", (F.col("block_ix") == 0).alias("first"))
    every = every.unionByName(inner.select(*BATCH, F.col("start_key").alias("key"), F.lit(True).alias("inner"), "hard", F.lit(False).alias("first")))
    one = lambda df, name: df.select(*BATCH, "key").distinct().withColumn(name, F.lit(True))
    rows = every.join(one(chosen, "picked"), [*BATCH, "key"], "left").join(one(unresolved, "left_open"), [*BATCH, "key"], "left").join(state.select(*BATCH, "has_forming"), BATCH, "left")
    picked, opened = F.coalesce("picked", F.lit(False)), F.coalesce("left_open", F.lit(False))
    forced = F.coalesce("hard", F.lit(False)) | (F.col("first") & ~F.coalesce("has_forming", F.lit(False)))
    rows = rows.withColumn("decision", F.when(forced | picked, "new_event").when(opened, "unresolved").otherwise("continue"))
    known = every.select(*BATCH, "key").distinct()
    unknown = chosen.filter(F.col("key") != OLD_TAIL).join(known, [*BATCH, "key"], "left_anti").distinct()
    audit = note(unknown, "starts", "key", "UNKNOWN_START").unionByName(note(unresolved.join(known, [*BATCH, "key"], "left_anti").distinct(), "starts", "key", "UNKNOWN_CANDIDATE"))
    audit = audit.unionByName(note(rows.filter(opened & (F.col("decision") == "new_event")), "starts", "key", "OPEN_CANDIDATE_IS_CHOSEN"))
    return rows.select(*BATCH, "key", "inner", "decision"), audit


def derive_segments(blocks: DataFrame, inner: DataFrame, decisions: DataFrame, messages: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments: chat_id, batch_ix, seg_ix, key, slot, refs, anchor_ref, anchor, first_source, offset; and audit rows.

    ``blocks``(block_ix, block_key, refs, opening_ref, opening), ``inner``(start_key, ref, quote), ``decisions`` as ``starts_of``
    gives them, ``messages``(message_ix, ref, content), ``state``(has_forming, disposition). A segment has the refs from its own
    start to the message of the next start in its group, that included, since a message can be shared. The first group goes on
    with the old event if one is forming and the first block does not start anew.
    """
    decided = decisions.select(*BATCH, "key", "decision")
    b = blocks.join(decided.withColumnRenamed("key", "block_key"), [*BATCH, "block_key"]).join(state, BATCH, "left")
    new = (F.col("decision") == "new_event") | (F.col("block_ix") == 0)
    order = W.partitionBy(*BATCH).orderBy("block_ix")
    b = b.withColumn("group", F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("opens", new)
    listed = b.groupBy(*BATCH, "group").agg(F.array_sort(F.collect_list(F.struct("block_ix", "refs"))).alias("all"))
    groups = listed.withColumn("refs", F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["refs"], F.array().cast("array<string>")))))).drop("all").filter(F.size("refs") > 0)
    goes_on = (F.col("block_ix") == 0) & F.coalesce("has_forming", F.lit(False)) & (F.col("decision") != "new_event")
    heads = b.filter("opens").select(*BATCH, "group", F.when(goes_on, OLD_TAIL).otherwise(F.col("block_key")).alias("key"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("offset"), F.col("opening_ref").alias("anchor_ref"), F.col("opening").alias("anchor"), goes_on.alias("goes_on"))
    heads = heads.join(groups.select(*BATCH, "group", F.col("refs")[0].alias("head_ref")), [*BATCH, "group"])
    heads = heads.withColumn("anchor_ref", F.coalesce("anchor_ref", "head_ref")).drop("head_ref")

    wanted = inner.join(decided.withColumnRenamed("key", "start_key").filter("decision = 'new_event'").drop("decision"), [*BATCH, "start_key"])
    wanted = wanted.groupBy(*BATCH, "start_key").agg(F.min(F.struct("ref", "quote")).alias("m")).select(*BATCH, "start_key", "m.*")
    asked = wanted.join(messages.select(*BATCH, "ref", "content"), [*BATCH, "ref"]).withColumn("quote_id", F.to_json(F.struct(*BATCH, "start_key")))
    found = first_places(asked).join(asked.select("quote_id", *BATCH, "start_key", "ref", "quote"), "quote_id")
    places = groups.select(*BATCH, "group", F.posexplode("refs").alias("at", "ref"))
    placed = found.join(places, [*BATCH, "ref"]).select(*BATCH, "group", F.col("start_key").alias("key"), "at", "offset", F.col("ref").alias("anchor_ref"), F.col("quote").alias("anchor"), F.lit(False).alias("goes_on"))
    once = F.row_number().over(W.partitionBy(*BATCH, "group", "at", "offset").orderBy("key"))
    ranked = placed.withColumn("n", F.when((F.col("at") == 0) & (F.col("offset") == 0), 2).otherwise(once))
    audit = note(wanted.join(placed.withColumnRenamed("key", "start_key"), [*BATCH, "start_key"], "left_anti"), "segments", "start_key", "START_NOT_FOUND")
    audit = audit.unionByName(note(ranked.filter("n > 1"), "segments", "key", "COINCIDENT_START"))

    rows = heads.unionByName(ranked.filter("n = 1").drop("n"))
    within, whole = W.partitionBy(*BATCH, "group").orderBy("at", "offset"), W.partitionBy(*BATCH).orderBy("group", "at", "offset")
    rows = rows.withColumn("until", F.lead("at").over(within)).join(groups, [*BATCH, "group"]).join(state.select(*BATCH, "disposition"), BATCH, "left")
    last = F.coalesce(F.col("until"), F.size("refs") - 1)
    old = F.when(F.col("goes_on"), F.when(F.col("disposition") == "keep_distinct", "forming_existing").when(F.col("disposition") == "merge_into_pending", "pending_tail"))
    rows = rows.withColumn("old", old).withColumn("number", F.sum(F.col("old").isNull().cast("int")).over(whole.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("seg_ix", F.row_number().over(whole) - 1).withColumn("own", F.slice("refs", F.col("at") + 1, last - F.col("at") + 1))
    first = messages.select(*BATCH, F.col("ref").alias("from_ref"), F.col("message_ix").alias("first_source"))
    rows = rows.withColumn("from_ref", F.col("own")[0]).join(first, [*BATCH, "from_ref"], "left")
    slot = F.coalesce("old", F.concat(F.lit("new_"), F.col("number").cast("string")))
    return rows.select(*BATCH, "seg_ix", "key", slot.alias("slot"), F.col("own").alias("refs"), "anchor_ref", "anchor", "first_source", "offset"), audit


def first_places(asked: DataFrame) -> DataFrame:
    """``asked``(quote_id, quote, content): quote_id, offset of the first place in the raw text where the quote stands, but for blanks and punctuation."""

    def scan(batches):
        for b in batches:
            spans = [(i, anchors.spans_of(q or "", t or "")) for i, q, t in zip(*(b.column(c).to_pylist() for c in ("quote_id", "quote", "content")), strict=True)]
            hits = [(i, s[0][0]) for i, s in spans if s]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.string(), pa.int64()))], ["quote_id", "offset"])

    return asked.select("quote_id", "quote", "content").mapInArrow(scan, "quote_id string, offset long")


def repair_starts(cut: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with anchors that their messages hold; and audit rows.

    A segment whose first message is not the one before's gets that message's opening. Another anchor that its message does not
    hold moves to the only message of the segment that does, else becomes the part of its own message most like it.
    """
    order = W.partitionBy(*BATCH).orderBy("seg_ix")
    shared = F.array_contains(F.coalesce(F.lag("refs").over(order), F.array().cast("array<string>")), F.col("refs")[0])
    text = lambda name: messages.select(*BATCH, F.col("ref").alias(name), F.col("content").alias(f"{name}_text"))
    rows = cut.withColumn("fresh", ~F.coalesce(shared, F.lit(False))).withColumn("head", F.col("refs")[0])
    rows = rows.join(text("head"), [*BATCH, "head"], "left").join(text("anchor_ref"), [*BATCH, "anchor_ref"], "left")
    opening = F.nullif(F.left(tx.stripped("head_text"), F.lit(OPENING)), F.lit(""))
    quote = tx.anchor_text(F.coalesce("anchor", F.lit("")))
    held = (quote != "") & F.contains(tx.anchor_text(F.coalesce("anchor_ref_text", F.lit(""))), quote)
    rows = rows.withColumn("opening", F.when(F.col("fresh"), opening)).withColumn("held", held)
    lost = rows.filter(F.col("opening").isNull() & ~F.col("held") & (quote != ""))
    each = lost.select(*BATCH, "seg_ix", "anchor", F.explode("refs").alias("at")).join(text("at"), [*BATCH, "at"])
    hits = each.filter(F.contains(tx.anchor_text(F.col("at_text")), tx.anchor_text(F.col("anchor")))).groupBy(*BATCH, "seg_ix").agg(F.min("at").alias("hit"), F.countDistinct("at").alias("n")).filter("n = 1").drop("n")
    name = F.to_json(F.struct(*BATCH, "seg_ix"))
    unmoved = lost.join(hits, [*BATCH, "seg_ix"], "left_anti").filter("anchor_ref_text is not null").withColumn("quote_id", name)
    near = anchors.nearest_quote(unmoved.select("quote_id", F.col("quote_id").alias("ref"), F.col("anchor").alias("quote")), unmoved.select(F.col("quote_id").alias("ref"), F.col("anchor_ref_text").alias("content")))
    rows = rows.join(hits, [*BATCH, "seg_ix"], "left").withColumn("quote_id", name).join(near, "quote_id", "left")
    fits = F.col("opening").isNotNull() & ((F.col("anchor_ref") != F.col("head")) | (quote == "") | ~F.contains(tx.anchor_text(F.col("opening")), quote))
    code = F.when(fits, "OPENING").when(F.col("hit").isNotNull(), "MOVED").when(F.col("part").isNotNull(), "NEAREST")
    audit = note(rows.withColumn("code", code).filter("code is not null"), "anchors", "seg_ix", F.col("code"))
    ref = F.when(F.col("opening").isNotNull(), F.col("head")).otherwise(F.coalesce("hit", "anchor_ref"))
    return rows.select(*[c for c in cut.columns if c not in ("anchor_ref", "anchor")], ref.alias("anchor_ref"), F.coalesce("opening", "part", "anchor").alias("anchor")), audit


def merge_updates(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``updates``(key, ord, title, description, summary, start, end, unresolved, details) of one key to one, in order; and audit rows.

    The last title and description that are said, all summaries joined, all list entries once, the first start and the last end.
    """
    texts = lambda c: F.nullif(tx.stripped(c), F.lit(""))
    entry = F.struct("ord", *[c for c in updates.columns if c not in (*BATCH, "key", "ord")])
    rows = updates.groupBy(*BATCH, "key").agg(F.array_sort(F.collect_list(entry)).alias("all"), F.count("*").alias("n"))
    first = lambda c, at: F.try_element_at(F.filter(F.transform("all", lambda x: x[c]), lambda t: t.isNotNull()), F.lit(at))
    members = lambda c: F.array_distinct(F.flatten(F.filter(F.transform("all", lambda x: x[c]), lambda t: t.isNotNull())))
    summary = F.aggregate(F.transform("all", lambda x: F.coalesce(x["summary"], F.lit(""))), F.lit(""), lambda a, x: segments.complete_text(a, x))
    said = lambda c: F.try_element_at(F.filter(F.transform("all", lambda x: texts(x[c])), lambda t: t.isNotNull()), F.lit(-1))
    out = rows.select(*BATCH, "key", F.col("all")[0]["ord"].alias("ord"), said("title").alias("title"), said("description").alias("description"), summary.alias("summary"), first("start", 1).alias("start"), first("end", -1).alias("end"), members("unresolved").alias("unresolved"), members("details").alias("details"))
    return out, note(rows.filter("n > 1"), "merge", "key", "UPDATES_MERGED")


@dataclass
class PlanInput:
    """What a plan is made from; all frames have chat_id and batch_ix but ``events``."""

    messages: DataFrame  # message_ix, ref, content
    blocks: DataFrame  # block_ix, block_key, refs, opening_ref, opening, hard
    inner: DataFrame  # start_key, ref, quote, hard: clues inside messages
    unresolved: DataFrame  # key
    state: DataFrame  # disposition, forming_id, pending_id
    events: DataFrame  # chat_id, event_id, title, description, summary, start, end
    updates: DataFrame  # ord, continuing, quote, title, description, summary, start, end, unresolved, details array<struct<kind,content,ref>>


def normalise_event_plan(p: PlanInput) -> dict[str, DataFrame]:
    """segments, texts, updates, details and audit of all batches, in the fixed order of steps: proposed starts are placed, segments derived, anchors repaired, texts clipped, keys of blocks
    carried over to segments, stale copies dropped, updates of a segment merged, empty ones dropped, slots assigned, summaries completed, details and times checked against the texts. What several
    later steps read is saved, so that plans stay small and a lost executor repeats one step."""
    audit: list[DataFrame] = []
    state = p.state.withColumn("has_forming", F.col("forming_id").isNotNull())

    # where each item starts
    by_message = p.messages.select(*BATCH, "ref", "message_ix", "content")
    texts = p.blocks.select(*BATCH, "block_ix", "block_key", F.explode("refs").alias("ref")).join(by_message, [*BATCH, "ref"])
    whole = texts.groupBy(*BATCH, F.col("block_ix").alias("ix"), "block_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_ix", "content"))), lambda x: x["content"]), "\n").alias("text"))
    clues = p.inner.join(by_message.select(*BATCH, "ref", "message_ix"), [*BATCH, "ref"]).select(*BATCH, F.col("message_ix").alias("ix"), F.col("start_key").alias("inner_key"), F.col("quote").alias("text"))
    asked = p.updates.select(*BATCH, "ord", "continuing", "quote")
    found = saved(segments.place_quotes(asked, whole, clues))
    placed = saved(segments.place_starts(found))
    audit.append(note(placed.filter("lost"), "placed", "ord", "START_LOST"))
    own = placed.join(found.filter("block_key is null and inner_key is null and new_key is not null").select(*BATCH, "ord", "new_key"), [*BATCH, "ord"]).filter("key = new_key").join(asked, [*BATCH, "ord"])
    held = own.join(texts.select(*BATCH, "ref", "message_ix", "content"), BATCH).filter(F.contains(tx.anchor_text(F.col("content")), tx.anchor_text(F.col("quote"))))
    added = held.groupBy(*BATCH, F.col("key").alias("start_key")).agg(F.min(F.struct("message_ix", "ref", "quote")).alias("m")).select(*BATCH, "start_key", "m.ref", "m.quote", F.lit(False).alias("hard"))
    inner = saved(p.inner.select(*BATCH, "start_key", "ref", "quote", "hard").unionByName(added))

    # segments
    decisions, notes = starts_of(p.blocks, inner, placed.select(*BATCH, "key"), p.unresolved, state)
    audit.append(notes)
    decisions = saved(decisions)
    cut, notes = derive_segments(p.blocks.drop("hard"), inner, decisions, p.messages, state.select(*BATCH, "has_forming", "disposition"))
    audit.append(notes)
    cut, notes = repair_starts(saved(cut), p.messages)
    audit.append(notes)
    cut = saved(cut)
    closed = saved(segments.close_segments(cut.join(state.select(*BATCH, "disposition"), BATCH)))
    clipped = segments.clip_messages(closed, p.messages.select(*BATCH, F.col("message_ix").alias("source_ix"), "content")).join(p.messages.select(*BATCH, F.col("message_ix").alias("source_ix"), "ref"), [*BATCH, "source_ix"])
    clipped = saved(clipped)

    # updates by segment
    tag = lambda *c: F.to_json(F.struct(*c))
    chat = tag(*BATCH).alias("chat_id")
    blocks = p.blocks.select(chat, F.col("block_key").alias("block"), F.explode("refs").alias("ref"))
    starts = inner.join(decisions.filter("inner and decision = 'new_event'").select(*BATCH, F.col("key").alias("start_key")), [*BATCH, "start_key"])
    mapped = segments.block_partition_map(blocks, cut.select(chat, F.col("key").alias("segment"), F.explode("refs").alias("ref")), starts.select(chat, "ref"))
    rows = placed.select(*BATCH, "ord", "key").join(p.updates, [*BATCH, "ord"]).withColumn("tag", tag(*BATCH)).join(mapped.select(F.col("chat_id").alias("tag"), F.col("block").alias("key"), "segment"), ["tag", "key"], "left")
    rows = rows.withColumn("key", F.coalesce("segment", "key")).drop("segment", "tag").join(state.select(*BATCH, "disposition", "forming_id", "pending_id"), BATCH)
    target = F.when(F.col("key") == OLD_TAIL, F.when(F.col("disposition") == "merge_into_pending", F.col("pending_id")).otherwise(F.col("forming_id")))
    rows = saved(rows.withColumn("event_id", target).withColumn("update_id", tag("batch_ix", "ord")))
    kept, stale = segments.drop_stale_copies(rows, p.events)
    audit.append(note(stale.withColumn("batch_ix", F.get_json_object("update_id", "$.batch_ix").cast("int")), "stale", "copied", "COPIED_FROM_ANOTHER_EVENT"))
    merged, notes = merge_updates(kept.select(*BATCH, "key", "ord", "title", "description", "summary", "start", "end", "unresolved", "details"))
    audit.append(notes)
    merged = saved(merged)
    refs = p.messages.select(*BATCH, "ref")
    details = merged.select(*BATCH, "key", F.posexplode("details").alias("n", "d")).select(*BATCH, "key", "n", "d.*")
    current = details.join(refs, [*BATCH, "ref"], "left_semi").groupBy(*BATCH, "key").agg(F.count("*").alias("n_details"))
    final = cut.select(*BATCH, "key", "slot").withColumn("is_final", F.lit(True))
    rows = merged.join(current, [*BATCH, "key"], "left").join(final, [*BATCH, "key"], "left")
    brings = F.col("is_final").isNotNull() | (F.coalesce("n_details", F.lit(0)) > 0) | (F.size("unresolved") > 0)
    audit.append(note(rows.filter(~brings), "noop", "key", "NOT_FINAL_AND_NO_DELTA"))
    rows = saved(rows.filter(brings))
    slots = segments.assign_update_slots(rows.select(chat, "key"), cut.select(chat, "key", "slot")).withColumnRenamed("chat_id", "tag")
    rows = rows.drop("slot", "is_final", "n_details").withColumn("tag", tag(*BATCH)).join(slots, ["tag", "key"], "left").drop("tag")
    audit.append(note(rows.filter("repaired"), "slots", "key", "SLOT_REPAIRED").unionByName(note(rows.filter("slot is null"), "slots", "key", "NO_SLOT")))
    rows = saved(rows.filter("slot is not null").drop("repaired"))

    # texts of the events that go on
    event = lambda p_, name: p_.select("chat_id", F.col("event_id").alias(name), F.col("summary").alias(f"{name}_summary"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))
    rows = rows.join(state.select(*BATCH, "disposition", "forming_id", "pending_id"), BATCH).join(event(p.events, "forming_id"), ["chat_id", "forming_id"], "left").join(event(p.events, "pending_id"), ["chat_id", "pending_id"], "left")
    base = F.when(F.col("slot") == "forming_existing", F.col("forming_id_summary")).when(F.col("slot") == "pending_tail", segments.complete_text(F.col("pending_id_summary"), F.col("forming_id_summary")))
    summary, what = segments.summary_increment(base, F.col("summary"))
    rows = saved(rows.withColumns({"told": summary, "what": what}))
    audit.append(note(rows.filter("what <> 'appended'"), "summary", "slot", F.upper("what")))

    # details and times against the texts
    name = tag(*BATCH, "slot").alias("event_id")
    told = rows.select(name, "slot", *BATCH, F.posexplode("details").alias("n", "d")).select("event_id", *BATCH, "slot", F.col("n").cast("long").alias("ord"), "d.ref", "d.kind", "d.content")
    good, bad = segments.canonical_details(told.filter("kind in ('statement', 'action') and trim(content) <> ''").select("event_id", "ord", "ref", "kind", "content"), clipped.select(name, "ref", "text"))
    by_name = rows.select(name, *BATCH, "slot")
    audit.append(note(told.filter("kind is null or kind not in ('statement', 'action') or content is null or trim(content) = ''"), "details", "slot", "INVALID_DETAIL"))
    audit.append(note(bad.join(by_name, "event_id"), "details", "slot", "DETAIL_OUTSIDE_EVENT"))
    times = rows.select(name, F.explode(F.array(F.struct(F.lit("start").alias("part"), F.col("start").alias("expression")), F.struct(F.lit("end").alias("part"), F.col("end").alias("expression")))).alias("t")).select("event_id", "t.*").filter("trim(expression) <> ''")
    supported = segments.supported_times(times, clipped.select(name, F.col("text").alias("line")))
    newest = F.row_number().over(W.partitionBy(*BATCH).orderBy(F.desc("seg_ix"))) == 1
    forming = cut.withColumn("newest", newest).filter("newest").select(*BATCH, "slot", F.lit("forming").alias("status"))
    old = lambda c: F.when(F.col("slot") == "forming_existing", F.col(f"forming_id_{c}")).when(F.col("slot") == "pending_tail", F.col(f"pending_id_{c}"))
    timed = rows.join(forming, [*BATCH, "slot"], "left").select(name, *BATCH, "slot", F.coalesce("status", F.lit("finalized")).alias("status"), F.nullif(tx.stripped("start"), F.lit("")).alias("start"), F.nullif(tx.stripped("end"), F.lit("")).alias("end"), old("start").alias("old_start"), old("end").alias("old_end"))
    clean = saved(segments.sanitize_times(timed, supported).select("event_id", F.col("start").alias("new_start"), F.col("end").alias("new_end")))
    both = timed.join(clean, "event_id")
    audit.append(note(both.filter("start is not null and not start <=> new_start"), "times", "slot", F.when(F.col("new_start").isNull(), "START_NOT_IN_EVENT").otherwise("START_KEPT")))
    audit.append(note(both.filter("end is not null and new_end is null"), "times", "slot", F.when(F.col("status") == "forming", "FORMING_HAS_NO_END").otherwise("END_NOT_IN_EVENT")))
    out = rows.select(*BATCH, "slot", "key", "title", "description", F.col("told").alias("summary"), "unresolved", name).join(clean, "event_id")
    updates = out.select(*BATCH, "slot", "key", "title", "description", "summary", F.col("new_start").alias("start"), F.col("new_end").alias("end"), "unresolved")
    return {
        "segments": closed.select(*BATCH, "seg_ix", "key", "slot", "refs", "anchor_ref", "anchor", "first_source", "offset", "end_source", "end_offset", "boundary"),
        "texts": clipped.select(*BATCH, "slot", "source_ix", "ref", "text"), "updates": updates,
        "details": good.join(by_name, "event_id").select(*BATCH, "slot", "ord", "ref", "kind", "content", "fidelity"), "audit": reduce(DataFrame.unionByName, audit),
    }
