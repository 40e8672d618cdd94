"""Queries and guarded changes of the entity store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.functions.shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SORTS = ("name", "extracted", "recall", "updated")


def _ascii_lower(c: str | Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def clamp(n: int | None, default: int, most: int) -> int:
    return min(max(1, n or default), most)


def list_entities(entities: DataFrame, types: tuple[str, ...], type: str | None = None, text: str = "", sort: str = "updated", ascending: bool = False, limit: int | None = None) -> DataFrame:
    """Entities by type (ignored if not one of ``types``) and a literal part of name or description, ASCII letters in any case."""
    rows = entities.filter(F.col("type") == type) if type in types else entities
    if text:
        part = text.translate(str.maketrans(UPPER, LOWER))
        rows = rows.filter(_ascii_lower("name").contains(part) | _ascii_lower("description").contains(part))
    key = F.col(sort if sort in SORTS else "updated")
    return rows.orderBy(key.asc_nulls_first() if ascending else key.desc_nulls_last(), "name", "id").limit(clamp(limit, 100, 500))


def neighbours(edges: DataFrame, entities: DataFrame, entity: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of the edges (src_id, component, tgt_id, tgt_type) that leave or reach ``entity``, with total, outgoing, names and resolved."""
    out = edges.filter(F.col("src_id") == entity).withColumn("outgoing", F.lit(True))
    into = edges.filter((F.col("tgt_id") == entity) & (F.col("src_id") != entity)).withColumn("outgoing", F.lit(False))
    both = saved(out.unionByName(into))  # two filters, so that both reach the scan
    ids = both.select(F.explode(F.array("src_id", "tgt_id")).alias("id")).distinct()
    names = entities.select("id", "name").join(ids, "id", "left_semi").groupBy("id").agg(F.min("name").alias("name"))
    rows = both.join(names.select(F.col("id").alias("src_id"), F.col("name").alias("src_name")), "src_id")
    rows = rows.join(names.select(F.col("id").alias("tgt_id"), F.col("name").alias("tgt_name")), "tgt_id", "left")
    resolved = F.when(F.col("outgoing"), F.coalesce(F.col("tgt_name"), F.lit("")) != "").otherwise(True)
    page = rows.withColumn("resolved", resolved).withColumn("total", F.lit(rows.count()).cast("long")).orderBy("src_id", "component", "tgt_id")
    return page.offset(offset).limit(clamp(limit, 100, 200)).select("src_id", "component", "tgt_id", "tgt_type", "outgoing", "src_name", "tgt_name", "resolved", "total")


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """Edges out and in of every entity: entity_id, n_out, n_in."""
    # both ends of an edge from one reading of the edges; an edge to itself counts as one out
    into = (F.col("src_id") != F.col("tgt_id")).cast("int")
    ends = F.array(F.struct(F.col("src_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tgt_id").alias("entity_id"), F.lit(0).alias("o"), into.alias("i")))
    return edges.select(F.inline(ends)).filter("o + i > 0").groupBy("entity_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def manual_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``relations``(source, target, relation_type, created) whose ends both exist, newest first."""
    name = lambda end: entities.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return relations.join(name("source"), "source").join(name("target"), "target").orderBy(F.desc("created"), "source", "target", "relation_type")


def entity_name(fields: DataFrame) -> DataFrame:
    """Adds name: the first non-blank of primary_name, title, name, story_summary, description, id; 240 code points at most."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in ("primary_name", "title", "name", "story_summary", "description")]
    return fields.withColumn("display_name", F.left(F.coalesce(*parts, F.col("id")), F.lit(240)))


def upsert_entities(current: DataFrame, incoming: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``current``(id, type, body, revision), ``incoming``(id, type, body, expected), ``missing``(src_id): entities with a reference that does not hold.

    Returns the new current rows with action (kept, created, updated, unchanged), and the rejected with a reason.
    """
    bad = missing.select(F.col("src_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    new = incoming.select("id", F.col("type").alias("new_type"), F.col("body").alias("new_body"), "expected").withColumn("given", F.lit(True))
    both = current.join(new, "id", "full").join(bad, "id", "left")
    reason = (
        F.when(F.col("type").isNotNull() & (F.col("type") != F.col("new_type")), "type_change")
        .when(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.coalesce("revision", F.lit(0))), "revision_conflict")
        .when(F.col("bad"), "missing_reference")
    )
    rows = both.withColumn("reason", F.when(F.col("given"), reason))
    accept = F.col("given").isNotNull() & F.col("reason").isNull()
    changed = accept & ~F.col("body").eqNullSafe(F.col("new_body"))
    action = F.when(~accept, "kept").when(F.col("revision").isNull(), "created").when(changed, "updated").otherwise("unchanged")
    kept = rows.filter(accept | F.col("revision").isNotNull()).select(
        "id",
        F.coalesce("type", "new_type").alias("type"),
        F.when(accept, F.col("new_body")).otherwise(F.col("body")).alias("body"),
        (F.coalesce("revision", F.lit(0)) + changed.cast("int")).cast("long").alias("revision"),
        action.alias("action"),
    )
    return kept, rows.filter("reason is not null").select("id", "reason")


def fingerprint(entities: DataFrame) -> DataFrame:
    """chat_id, fingerprint: a digest of ids and revisions, whatever the order of rows."""
    part = F.concat_ws(":", "id", F.col("revision").cast("string"))
    return entities.groupBy("chat_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ","), 256).alias("fingerprint"))


def commit_guard(batches: DataFrame, committed: DataFrame, now: DataFrame) -> DataFrame:
    """``batches``(chat_id, batch_key, fingerprint) to decision: reused if committed, rejected if the chat has changed since, else commit."""
    done = committed.select("chat_id", "batch_key", F.lit(True).alias("done")).distinct()
    rows = batches.join(done, ["chat_id", "batch_key"], "left").join(now.withColumnRenamed("fingerprint", "current"), "chat_id", "left")
    decision = F.when(F.col("done"), "reused").when(~F.col("fingerprint").eqNullSafe(F.col("current")), "rejected").otherwise("commit")
    return rows.select("chat_id", "batch_key", decision.alias("decision"))


def delete_guard(ids: DataFrame, edges: DataFrame, mapped: DataFrame) -> DataFrame:
    """``ids``(id) to delete: id, n_blockers (edges from entities that stay), in_map, allowed."""
    ids = ids.select("id").distinct()
    stay = edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_anti").groupBy(F.col("tgt_id").alias("id")).agg(F.count("*").alias("n_blockers"))
    rows = ids.join(stay, "id", "left").join(mapped.select("id", F.lit(True).alias("in_map")).distinct(), "id", "left")
    rows = rows.fillna(0, ["n_blockers"]).fillna(False, ["in_map"])
    return rows.withColumn("allowed", (F.col("n_blockers") == 0) & ~F.col("in_map"))


def merge_blockers(members: DataFrame, components: DataFrame, edges: DataFrame, extracted: DataFrame, allowed: tuple[str, ...] = ("identity", "entity_management")) -> DataFrame:
    """Why groups of ``members``(group_id, id, type) may not be merged: group_id, reason. ``components``(id, component), ``edges``(src_id, tgt_id), ``extracted``(id): known to extraction."""
    ids = members.select("group_id", "id").distinct()
    shape = members.groupBy("group_id").agg(F.countDistinct("id").alias("n"), F.countDistinct("type").alias("kinds"))
    row = lambda df, reason: df.select("group_id", F.lit(reason).alias("reason")).distinct()
    ends = edges.select(F.explode(F.array("src_id", "tgt_id")).alias("id")).distinct()
    return reduce(DataFrame.unionByName, [
        row(shape.filter("n < 2"), "fewer_than_two"),
        row(shape.filter("kinds > 1"), "several_types"),
        row(ids.join(components.filter(~F.col("component").isin(*allowed)).select("id").distinct(), "id", "left_semi"), "other_components"),
        row(ids.join(ends, "id", "left_semi"), "edges"),
        row(ids.join(extracted.select("id").distinct(), "id", "left_semi"), "extraction_state"),
    ])


def merge_entities(members: DataFrame) -> DataFrame:
    """``members``(group_id, id, type, name, aliases, description, created): one entity for each group of two or more of one type.

    The earliest created survives; distinct descriptions are joined by blank lines; aliases are all other names.
    """
    age = F.struct("created", "id")
    rows = members.groupBy("group_id").agg(
        F.count("*").alias("n"), F.countDistinct("type").alias("kinds"), F.min("type").alias("type"), F.min(F.struct("created", "id", "name")).alias("first"),
        F.array_sort(F.collect_list(F.struct("created", "id", "description", "name", "aliases"))).alias("all"),
    ).filter("n >= 2 and kinds = 1")
    del age
    told = F.array_distinct(F.filter(F.transform("all", lambda x: F.trim(x["description"])), lambda d: d.isNotNull() & (d != "")))
    names = F.flatten(F.transform("all", lambda x: F.concat(F.array(x["name"]), F.coalesce(x["aliases"], F.array().cast("array<string>")))))
    aliases = F.array_remove(F.array_distinct(F.filter(names, lambda a: a.isNotNull())), F.col("first.name"))
    return rows.select("group_id", F.col("first.id").alias("id"), "type", F.col("first.name").alias("name"), F.array_join(told, "\n\n").alias("description"), aliases.alias("aliases"))


def redirect_relations(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends mapped to survivors (``mapping``: id, survivor); self-loops and repeats go."""
    end = lambda e: mapping.select(F.col("id").alias(e), F.col("survivor").alias(f"new_{e}"))
    rows = relations.join(end("source"), "source", "left").join(end("target"), "target", "left")
    rows = rows.select(F.coalesce("new_source", "source").alias("source"), F.coalesce("new_target", "target").alias("target"), "relation_type")
    return rows.filter("source <> target").distinct()


def dyadic_blocks(low: Column, high: Column) -> Column:
    """The whole numbers from ``low`` to ``high`` as blocks (level, block) of 2^level aligned numbers: at most two of each level, however long the interval is."""
    kind = "array<struct<level:int,block:bigint>>"
    zero = F.struct(low.cast("bigint").alias("a"), (high.cast("bigint") + 1).alias("b"), F.array().cast(kind).alias("out"))
    odd = lambda x: F.pmod(x, F.lit(2)) == 1

    def step(s: Column, level: Column) -> Column:
        block = lambda x: F.struct(level.cast("int").alias("level"), x.cast("bigint").alias("block"))
        open_ = s["a"] < s["b"]
        left, right = open_ & odd(s["a"]), open_ & odd(s["b"])
        found = F.filter(F.array(F.when(left, block(s["a"])), F.when(right & (s["b"] - 1 >= s["a"] + left.cast("int")), block(s["b"] - 1))), lambda x: x.isNotNull())
        a, b = s["a"] + left.cast("bigint"), s["b"] - right.cast("bigint")
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), F.concat(s["out"], found).cast(kind).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), zero, step, lambda s: s["out"])


def unprocessed_messages(messages: DataFrame, receipts: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Messages with floors from ``first`` to ``last`` that no receipt covers.

    A receipt becomes at most 126 aligned blocks, so one over 10^9 floors costs no more than a short one; a message looks
    for its own block on each level that occurs. Floors of a chat are spread over tasks, whatever a chat's size.
    """
    own = messages.filter(F.col("floor") >= first)
    own = own.filter(F.col("floor") <= last) if last is not None else own
    covered = receipts.filter("start_floor <= end_floor").select("chat_id", F.inline(dyadic_blocks(F.col("start_floor"), F.col("end_floor")))).distinct()
    levels = sorted(r.level for r in covered.select("level").distinct().collect())  # 63 at most
    if not levels:
        return own
    keys = own.select("chat_id", "floor").distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    met = keys.withColumn("block", F.expr("shiftright(cast(floor as bigint), level)")).join(covered, ["chat_id", "level", "block"]).select("chat_id", "floor").distinct()
    return own.join(met, ["chat_id", "floor"], "left_anti")


def stale_sources(receipt_sources: DataFrame, messages: DataFrame) -> DataFrame:
    """``receipt_sources``(chat_id, floor, source_id, version) whose message is gone or differs; new messages do not matter."""
    now = messages.select("chat_id", "floor", F.col("source_id").alias("now_id"), F.col("version").alias("now_version"))
    rows = receipt_sources.join(now, ["chat_id", "floor"], "left")
    same = F.col("source_id").eqNullSafe(F.col("now_id")) & F.col("version").eqNullSafe(F.col("now_version"))
    return rows.filter(~same).select("chat_id", "floor", "source_id", F.col("now_version").isNull().alias("gone"))


def pending_requests(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``requests``(context, request, credential) and ``cache``(hash, status, result): requests to run, and hits; only ok results are reused."""
    rows = requests.withColumn("hash", F.sha2(F.to_json(F.struct("context", "request", F.sha2("credential", 256).alias("credential"))), 256))
    ok = cache.filter("status = 'ok'").dropDuplicates(["hash"]).select("hash", "result")
    return rows.join(ok, "hash", "left_anti"), rows.join(ok, "hash")


def batch_resume(log: DataFrame) -> DataFrame:
    """``log``(chat_id, batch_ix, committed, failed): per chat the next batch, and whether a failure stops it."""
    next_ix = F.coalesce(F.max(F.when(F.col("committed"), F.col("batch_ix"))) + 1, F.lit(0)).cast("long")
    first_bad = F.min(F.when(F.col("failed") & ~F.col("committed"), F.col("batch_ix")))
    rows = log.groupBy("chat_id").agg(next_ix.alias("next_batch"), first_bad.alias("first_failed"))
    return rows.withColumn("stopped", F.coalesce(F.col("first_failed") <= F.col("next_batch"), F.lit(False)))


def restore_diagnostics(log: DataFrame, told: DataFrame) -> DataFrame:
    """``told``(chat_id, batch_ix, ...) of the batches that ``log``(chat_id, batch_ix, committed) has committed, which a resumed run does not repeat."""
    return told.join(log.filter("committed").select("chat_id", "batch_ix").distinct(), ["chat_id", "batch_ix"], "left_semi")


def diagnostics(runs: DataFrame) -> DataFrame:
    """``runs``(chat_id, batch_ix, task, errors, warnings), arrays of text, to rows with a severity."""
    each = lambda c, s: runs.select("chat_id", "batch_ix", "task", F.lit(s).alias("severity"), F.explode(c).alias("message"))
    return each("errors", "error").unionByName(each("warnings", "warning"))
