"""Ordered shaping of chat messages: rounds, batches, blocks, event status, coverage.

Messages have chat_id, floor, role, content. Windows run per chat; the greedy
batch fold works on sizes only and texts are joined back by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.functions.shared import fold_sorted


def _chat():
    return W.partitionBy("chat_id")


def _before():
    """The messages of a chat before this one."""
    return _chat().orderBy("floor").rowsBetween(W.unboundedPreceding, -1)


def assign_rounds(messages: DataFrame) -> DataFrame:
    """Adds round_ix: a non-blank assistant message closes a round; what follows the last close belongs to it; chats without a close give no rows."""
    closes = ((F.col("role") == "assistant") & (F.trim("content") != "")).cast("int")
    rows = messages.withColumn("closes", closes).withColumn("total", F.sum("closes").over(_chat()))
    ix = F.least(F.coalesce(F.sum("closes").over(_before()), F.lit(0)), F.col("total") - 1)
    return rows.filter("total > 0").withColumn("round_ix", ix).drop("closes", "total")


def pair_rounds(messages: DataFrame) -> DataFrame:
    """Each non-user message with the last user message since the one before; without one it is dropped: chat_id, user_floor, assistant_floor."""
    group = F.coalesce(F.sum((F.col("role") != "user").cast("int")).over(_before()), F.lit(0))
    users = F.max(F.when(F.col("role") == "user", F.col("floor")))
    rows = messages.withColumn("group", group).groupBy("chat_id", "group")
    rows = rows.agg(users.alias("user_floor"), F.max(F.when(F.col("role") != "user", F.col("floor"))).alias("assistant_floor"))
    return rows.filter("user_floor is not null and assistant_floor is not null").drop("group")


def budget_batches(rounds: DataFrame, max_rounds: int = 8, max_chars: int = 24000) -> DataFrame:
    """Greedy batches over ``rounds``(chat_id, round_ix, size): chat_id, round_ix, size, batch_ix, oversize.

    A batch closes when it has max_rounds or the next round would exceed max_chars; a round over max_chars alone is oversize.
    The fold restarts on its own running value, so no window gives it; it runs over a chat's sorted rounds in one pass.
    """

    def step(state: tuple[int, int, int], row: tuple) -> tuple:
        (ix, n, chars), (chat, round_ix, size) = state, row
        full = n > 0 and (n >= max_rounds or chars + size > max_chars)
        ix, n, chars = (ix + 1, 1, size) if full else (ix, n + 1, chars + size)
        return (ix, n, chars), (chat, round_ix, size, ix, size > max_chars)

    rows = rounds.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("round_ix").cast("long").alias("round_ix"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    return fold_sorted(rows, "chat_id", "round_ix", lambda: (0, 0, 0), step, "chat_id string, round_ix long, size long, batch_ix long, oversize boolean")


def source_units(sources: DataFrame) -> DataFrame:
    """Texts (ref, content) cut after sentence marks or newlines: ref, unit (ref.u001), text, start, end; blank units are dropped, places count code points."""
    pieces = F.regexp_extract_all("content", F.lit(r"(?s)(.*?(?:[。！？!?][”’」』\"']*|\n+|$))"), F.lit(1))
    rows = sources.select("ref", F.posexplode(F.filter(pieces, lambda p: p != "")).alias("k", "piece"))
    start = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy("ref").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", start).filter(F.trim(F.translate("piece", "\n\t\r", "   ")) != "")
    text = F.regexp_replace("piece", r"^\s+|\s+$", "")
    lead = F.length(F.regexp_extract("piece", r"^(\s*)", 1))
    rows = rows.select("ref", "k", text.alias("text"), (F.col("at") + lead).cast("long").alias("start"))
    n = F.row_number().over(W.partitionBy("ref").orderBy("k"))
    unit = F.concat("ref", F.lit(".u"), F.lpad(n.cast("string"), 3, "0"))
    return rows.select("ref", unit.alias("unit"), "text", "start", (F.col("start") + F.length("text")).cast("long").alias("end"))


#: A scene header at the start of a line: a host's own in brackets, or the line that cleaning makes of one.
SCENE_HEADER = r"(?m)^\[(?:场景时间|时间)[^\n\]]*\]|^\[scene\][^\n]*"


def narrative_text(messages: DataFrame, keys=("chat_id",), header: str = SCENE_HEADER) -> DataFrame:
    """Assistant bodies of a group in order without scene headers and blank ends, the empty ones left out, joined by blank lines."""
    body = F.regexp_replace(F.regexp_replace("content", header, ""), r"^\s+|\s+$", "")
    own = messages.filter("role = 'assistant'").withColumn("content", body).filter("content <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("floor", "content"))), lambda x: x["content"]), "\n\n")
    return own.groupBy(*keys).agg(body.alias("text"))


def round_blocks(rounds: DataFrame) -> DataFrame:
    """Per round: first and last floor, opening quote (48 code points), closing quote (72), number of messages and the assistant text."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    told = (F.col("role") == "assistant") & (F.trim("content") != "")
    body = F.when(told, F.struct("floor", "content"))
    rows = rounds.groupBy("chat_id", "round_ix").agg(
        F.min("floor").alias("first_floor"),
        F.max("floor").alias("last_floor"),
        F.count("*").alias("n_messages"),
        F.min(body)["content"].alias("opening"),
        F.max(body)["content"].alias("closing"),
        F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["content"]), "\n").alias("text"),
    )
    return rows.withColumn("opening", F.left(flat("opening"), F.lit(48))).withColumn("closing", F.right(flat("closing"), F.lit(72)))


def place_changes(blocks: DataFrame) -> DataFrame:
    """``blocks``(chat_id, ix, places): rows whose first place differs from the last place of the block before."""
    before = F.lag(F.try_element_at("places", F.lit(-1))).over(_chat().orderBy("ix"))
    rows = blocks.withColumn("was", before).withColumn("now", F.try_element_at("places", F.lit(1)))
    return rows.filter("was is not null and now is not null and was <> now").select("chat_id", "ix", "was", "now")


def event_status(events: DataFrame) -> DataFrame:
    """Newest event of a chat forming, the one before pending_finalization, the rest finalized."""
    age = F.row_number().over(_chat().orderBy(F.desc("event_no")))
    return events.withColumn("status", F.when(age == 1, "forming").when(age == 2, "pending_finalization").otherwise("finalized"))


def covered_through(receipts: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """Last floor of the gapless prefix from 0 of ``receipts``(chat_id, start_floor, end_floor); -1 if there is none."""
    order = _chat().orderBy("start_floor", "end_floor")
    reach = F.coalesce(F.max("end_floor").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    gap = (F.col("start_floor") > reach + 1).cast("int")
    rows = receipts.withColumn("gap", gap).withColumn("broken", F.max("gap").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy("chat_id").agg(F.coalesce(F.max(F.when(F.col("broken") == 0, F.col("end_floor"))), F.lit(-1)).alias("through"))
    if chats is None:
        return out
    return chats.select("chat_id").distinct().join(out, "chat_id", "left").fillna(-1, ["through"])


def extraction_dashboard(messages: DataFrame, receipts: DataFrame, settings: DataFrame) -> DataFrame:
    """Per chat: messages, unextracted, next_trigger. ``settings``(chat_id, interval, tail): 0 or null means 10 and 4."""
    n = messages.groupBy("chat_id").agg(F.count("*").alias("messages"))
    rows = n.join(covered_through(receipts), "chat_id", "left").join(settings, "chat_id", "left").fillna(-1, ["through"])
    or_else = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(d))
    return rows.select(
        "chat_id",
        "messages",
        F.greatest(F.lit(0), F.col("messages") - or_else("tail", 4) - (F.col("through") + 1)).cast("long").alias("unextracted"),
        (F.col("through") + or_else("interval", 10) + or_else("tail", 4)).cast("long").alias("next_trigger"),
    )


def type_counts(entities: DataFrame, types: list[str]) -> DataFrame:
    """Entities for each type, zero where a type has none."""
    every = entities.sparkSession.createDataFrame([(x,) for x in types], "type string")
    counts = entities.groupBy("type").agg(F.count("*").alias("n"))
    return every.join(counts, "type", "left").fillna(0, ["n"])


def resolve_open_boundaries(candidates: DataFrame) -> DataFrame:
    """``candidates``(chat_id, id, floor, offset, confirmed): each unconfirmed one is closed by the next confirmed one further on, else stays open."""
    beyond = F.first(F.when(F.col("confirmed"), F.col("id")), ignorenulls=True).over(
        _chat().orderBy("place").rangeBetween(1, W.unboundedFollowing)
    )
    rows = candidates.withColumn("place", F.dense_rank().over(_chat().orderBy("floor", "offset"))).withColumn("closed_by", beyond)
    return rows.filter("not confirmed").select("chat_id", "id", "floor", "offset", "closed_by")


def boundary_workspace(candidates: DataFrame, keep: int = 16) -> DataFrame:
    """``candidates``(chat_id, id, batch_ix, confirmed): open ones after the last confirmed batch, the newest ``keep``."""
    last = F.max(F.when(F.col("confirmed"), F.col("batch_ix"))).over(_chat())
    rows = candidates.withColumn("last", last).filter("not confirmed and (last is null or batch_ix > last)")
    rank = F.row_number().over(_chat().orderBy(F.desc("batch_ix"), F.desc("id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= keep).select("chat_id", "id", "batch_ix", "rank")


def continuity_window(texts: DataFrame, tail: int = 700, marker: str = "\n…\n") -> DataFrame:
    """``texts``(chat_id, status, text): what a chat's next batch sees of its forming event (whole up to 2 * tail, else head and tail) and of its pending one."""
    forming = F.max(F.when(F.col("status") == "forming", F.col("text")))
    pending = F.max(F.when(F.col("status") == "pending_finalization", F.col("text")))
    rows = texts.groupBy("chat_id").agg(forming.alias("f"), pending.alias("p")).filter("f is not null")
    whole = F.length("f") <= 2 * tail
    cut = F.concat(F.left("f", F.lit(tail)), F.lit(marker), F.right("f", F.lit(tail)))
    return rows.select("chat_id", F.when(whole, F.col("f")).otherwise(cut).alias("forming"), F.right("p", F.lit(tail)).alias("pending"))


def location_occurrences(places: DataFrame) -> DataFrame:
    """``places``(event_id, ord, location): distinct places in order of first mention with sequence and role primary, start, transit or end."""
    first = places.groupBy("event_id", "location").agg(F.min("ord").alias("ord"))
    own = W.partitionBy("event_id")
    rows = first.withColumn("sequence", F.row_number().over(own.orderBy("ord", "location"))).withColumn("n", F.count("*").over(own))
    role = F.when(F.col("n") == 1, "primary").when(F.col("sequence") == 1, "start").when(F.col("sequence") == F.col("n"), "end").otherwise("transit")
    return rows.select("event_id", "location", "sequence", role.alias("role"))


def event_tail_view(events: DataFrame, preview: int = 120) -> DataFrame:
    """``events``(chat_id, event_no, status, description): description of the last finalised event, previews of pending and forming."""
    of = lambda s: F.max(F.when(F.col("status") == s, F.struct("event_no", "description")))["description"]
    return events.groupBy("chat_id").agg(
        of("finalized").alias("last_final"),
        F.left(of("pending_finalization"), F.lit(preview)).alias("pending"),
        F.left(of("forming"), F.lit(preview)).alias("forming"),
    )
