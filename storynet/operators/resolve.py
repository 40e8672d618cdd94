"""Entity resolution: mentions against what is known, and plans restricted to what resolves."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.functions import text as tx
from storynet.operators.audit import ENTITY_TYPES
from storynet.operators.mentions import found_in

# Type names in use for the same type, keys that no proposal may set, roles a claim may place an item in.
TYPE_ALIASES = {"person": "character", "place": "location", "object": "item", "group": "organization", "ability": "skill"}
PROTECTED = r"^(id|entity_id|entity_key|formal_id|schema_version|primary_name|aliases)$|_(id|ref|refs|key|keys)$"
CLAIM_ROLES = {"placed": ("item", "location"), "carried": ("character",), "equipped": ("character",), "worn": ("character",), "contained": ("item",), "stored": ("item",)}


def signature_index(candidates: DataFrame, signature=tx.plain_signature) -> DataFrame:
    """``candidates``(chat_id, type, key, names) to chat_id, type, key, sig: a row for each distinct signature of a name."""
    rows = candidates.select("chat_id", "type", "key", F.explode("names").alias("name"))
    return rows.select("chat_id", "type", "key", signature(F.col("name")).alias("sig")).filter("sig <> ''").distinct()


def resolve_directory(mentions: DataFrame, known: DataFrame, signature=tx.plain_signature) -> DataFrame:
    """``mentions``(chat_id, mention_id, type, key, names) and ``known``(chat_id, type, key, names) to action, reason and target_key.

    A key that does not start with its type, or a name that an entity of another type has, leaves a mention unresolved; a
    known key of the type is updated, else the only entity of the type that shares a name; several leave it unresolved.
    """
    names = signature_index(mentions.select("chat_id", "type", F.col("mention_id").alias("key"), "names"), signature)
    of = signature_index(known, signature)
    hits = names.withColumnsRenamed({"key": "mention_id", "type": "m_type"}).join(of, ["chat_id", "sig"])
    hits = hits.groupBy("chat_id", "mention_id").agg(
        F.collect_set(F.when(F.col("type") == F.col("m_type"), F.col("key"))).alias("same"), F.count_if(F.col("type") != F.col("m_type")).alias("cross")
    )
    direct = known.select("chat_id", "type", "key", F.lit(True).alias("direct")).distinct()
    rows = mentions.join(hits, ["chat_id", "mention_id"], "left").join(direct, ["chat_id", "type", "key"], "left")
    bad = ~F.coalesce(F.col("type").isin(*ENTITY_TYPES) & (F.substring_index("key", ":", 1) == F.col("type")), F.lit(False))
    n = F.when(F.col("direct"), 1).otherwise(F.coalesce(F.size("same"), F.lit(0)))
    reason = (
        F.when(bad, "invalid_type_or_key").when(F.coalesce("cross", F.lit(0)) > 0, "cross_type_name_conflict").when(n > 1, "multiple_same_type_matches")
    )
    action = F.when(reason.isNotNull(), "unresolved").when(n == 1, "update").otherwise("create")
    target = F.when(action == "update", F.when(F.col("direct"), F.col("key")).otherwise(F.col("same")[0])).when(action == "create", F.col("key"))
    return rows.select("chat_id", "mention_id", action.alias("action"), reason.alias("reason"), target.alias("target_key"))


def resolve_roster(roster: DataFrame, known: DataFrame, signature=tx.plain_signature) -> DataFrame:
    """``roster``(chat_id, item_id, type, names): like ``resolve_directory`` but names of other types do not matter, and type aliases are mapped."""
    kind = F.col("type")
    for alias, real in TYPE_ALIASES.items():
        kind = F.when(F.col("type") == alias, real).otherwise(kind)
    rows = roster.withColumn("type", kind)
    names = signature_index(rows.select("chat_id", "type", F.col("item_id").alias("key"), "names"), signature).withColumnRenamed("key", "item_id")
    hits = names.join(signature_index(known, signature), ["chat_id", "type", "sig"]).groupBy("chat_id", "item_id").agg(F.collect_set("key").alias("keys"))
    rows = rows.join(hits, ["chat_id", "item_id"], "left")
    n = F.coalesce(F.size("keys"), F.lit(0))
    action = F.when(n == 1, "update").when(n > 1, "unresolved").otherwise("create")
    return rows.select("chat_id", "item_id", "type", action.alias("action"), F.when(n == 1, F.col("keys")[0]).alias("target_key"))


def canonical_keys(proposed: DataFrame, known: DataFrame, signature=tx.plain_signature) -> DataFrame:
    """``proposed``(chat_id, type, key, names) to chat_id, key, known_key where the names hit exactly one known key of the type."""
    hits = signature_index(proposed, signature).join(signature_index(known, signature).withColumnRenamed("key", "known_key"), ["chat_id", "type", "sig"])
    one = hits.groupBy("chat_id", "key").agg(F.min("known_key").alias("known_key"), F.countDistinct("known_key").alias("n"))
    return one.filter("n = 1 and key <> known_key").drop("n")


def rewrite_keys(plan: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Every key column of a plan table by the mapping (chat_id, key, known_key)."""
    for c in columns:
        to = mapping.select("chat_id", F.col("key").alias(c), F.col("known_key").alias("_to"))
        plan = plan.join(to, ["chat_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return plan


PLACEHOLDERS = ("user", "you", "{{user}}", "unused", "")


def rewrite_player(plan: DataFrame, players: DataFrame, columns: list[str]) -> DataFrame:
    """``plan``(chat_id, aliases, and key ``columns``): keys that only mean the player of a chat (chat_id, player) become the player's, and names that only mean the player leave the aliases."""
    names = F.array(*map(F.lit, PLACEHOLDERS))
    rows = plan.join(players.select("chat_id", "player"), "chat_id", "left")
    for c in columns:
        vague = F.array_contains(names, F.lower(F.trim(F.expr(f"substring(`{c}`, instr(`{c}`, ':') + 1)"))))
        rows = rows.withColumn(c, F.when(F.col("player").isNotNull() & F.startswith(c, F.lit("character:")) & vague, F.concat(F.lit("character:"), "player")).otherwise(F.col(c)))
    kept = F.filter("aliases", lambda a: ~F.array_contains(names, F.lower(F.trim(a))))
    return rows.withColumn("aliases", F.when(F.col("player").isNotNull(), kept).otherwise(F.col("aliases"))).select(*plan.columns)


def player_identity(lines: DataFrame, first: int = 50) -> DataFrame:
    """``lines``(chat_id, line, persona, user_name, is_user, name) to chat_id, player: persona, else the user's name, else the first user speaker; placeholders do not count."""
    rows = lines.filter(F.col("line") < first)
    named = [(1, F.col("persona")), (2, F.col("user_name")), (3, F.when(F.col("is_user"), F.col("name")))]
    each = rows.select("chat_id", "line", F.explode(F.array(*[F.struct(F.lit(p).alias("rank"), F.trim(c).alias("player")) for p, c in named])).alias("x"))
    each = each.select("chat_id", "line", "x.*").filter(F.col("player").isNotNull() & ~F.lower("player").isin(*PLACEHOLDERS))
    return each.groupBy("chat_id").agg(F.min(F.struct("rank", "line", "player")).alias("m")).select("chat_id", F.col("m.player").alias("player"))


def mention_scan(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """``candidates``(chat_id, key, names), ``texts``(chat_id, batch_ix, text): names that literally occur, by key: chat_id, batch_ix, key, n_names."""
    names = candidates.select("chat_id", "key", F.explode(F.array_distinct("names")).alias("name")).withColumn("needle", F.trim("name")).filter("needle <> ''")
    kind = texts.schema["batch_ix"].dataType
    hits = found_in(names, texts.withColumnRenamed("batch_ix", "ref")).withColumn("batch_ix", F.col("ref").cast(kind))
    return names.join(hits, ["chat_id", "needle"]).groupBy("chat_id", "batch_ix", "key").agg(F.countDistinct("name").alias("n_names"))


def related_entities(candidates: DataFrame, texts: DataFrame, tail: DataFrame, k: int = 24) -> DataFrame:
    """Top k candidates (chat_id, ord, key, names, stub) for each batch: 10 for each name present, 6 if in the last two events (``tail``: chat_id, key), -1 for a stub; later ones first among equals.

    A candidate that a batch does not name ranks in it no higher than it does in its chat, so beside those that are named or in
    the tail only a chat's first k are ranked.
    """
    found, k = mention_scan(candidates, texts), max(1, k)
    last = tail.select("chat_id", "key").distinct().withColumn("bonus", F.lit(6))
    known = candidates.select("chat_id", "ord", "key", "stub").join(last, ["chat_id", "key"], "left")
    plain = F.row_number().over(W.partitionBy("chat_id").orderBy(F.col("stub").cast("int"), F.desc("ord")))
    always = known.withColumn("place", plain).filter((F.col("place") <= k) | F.col("bonus").isNotNull()).select("chat_id", "key")
    pairs = always.join(texts.select("chat_id", "batch_ix").distinct(), "chat_id").select("chat_id", "batch_ix", "key").unionByName(found.select("chat_id", "batch_ix", "key")).distinct()
    rows = pairs.join(known, ["chat_id", "key"]).join(found, ["chat_id", "batch_ix", "key"], "left")
    score = 10 * F.coalesce("n_names", F.lit(0)) + F.coalesce("bonus", F.lit(0)) - F.col("stub").cast("int")
    rank = F.row_number().over(W.partitionBy("chat_id", "batch_ix").orderBy(F.desc("score"), F.desc("ord")))
    return rows.withColumn("score", score.cast("long")).withColumn("rank", rank).filter(F.col("rank") <= k).select("chat_id", "batch_ix", "key", "score", F.col("rank").cast("long").alias("rank"))


def related_relations(relations: DataFrame, chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """``relations``(chat_id, relation, participants) that go with each batch: those with a key of ``chosen``(chat_id, batch_ix, key), and those of which a participant's name, what stands after
    the type in its key, occurs in the batch's ``texts``(chat_id, batch_ix, text): chat_id, batch_ix, relation."""
    each = relations.select("chat_id", "relation", F.explode("participants").alias("key"))
    by_key = each.join(chosen.select("chat_id", "batch_ix", "key"), ["chat_id", "key"])
    name = F.when(F.col("key").contains(":"), F.regexp_extract("key", r"^[^:]*:(?s)(.*)$", 1)).otherwise(F.col("key"))
    named = each.withColumn("needle", name)
    kind = texts.schema["batch_ix"].dataType
    hits = found_in(named, texts.withColumnRenamed("batch_ix", "ref")).withColumn("batch_ix", F.col("ref").cast(kind))
    by_name = named.join(hits, ["chat_id", "needle"])
    cols = ["chat_id", "batch_ix", "relation"]
    return by_key.select(*cols).unionByName(by_name.select(*cols)).distinct()


def split_workloads(roster: DataFrame) -> DataFrame:
    """``roster``(chat_id, segment, action, item_id): items by segment and action, unknown actions as unresolved, empty groups left out."""
    action = F.when(F.col("action").isin("create", "update"), F.col("action")).otherwise("unresolved")
    return roster.groupBy("chat_id", "segment", action.alias("action")).agg(F.array_sort(F.collect_list("item_id")).alias("items"))


def restrict_to_directory(proposals: DataFrame, allowed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``proposals``(chat_id, key, action): kept, and dropped with a reason: outside the allowed keys, create on a known key, update on an unknown one."""
    keys = ["chat_id", "key"]
    rows = proposals.join(allowed.select(*keys, F.lit(True).alias("ok")).distinct(), keys, "left").join(known.select(*keys, F.lit(True).alias("known")).distinct(), keys, "left")
    reason = (
        F.when(F.col("ok").isNull(), "not_in_directory")
        .when((F.col("action") == "create") & F.col("known").isNotNull(), "create_known")
        .when((F.col("action") == "update") & F.col("known").isNull(), "update_unknown")
    )
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select(*proposals.columns), rows.filter("reason is not null").select(*proposals.columns, "reason")


def canonical_fields(proposals: DataFrame, fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """``proposals``(type, name) to field and how: exact, folded (if unique), alias (registered for the type), else unclassified; never by likeness."""
    exact = fields.select("type", F.col("field").alias("name"), F.col("field").alias("exact")).distinct()
    folded = fields.withColumn("sig", tx.field_signature(F.col("field"))).groupBy("type", "sig").agg(F.min("field").alias("folded"), F.countDistinct("field").alias("n")).filter("n = 1").drop("n")
    known = aliases.withColumn("sig", tx.field_signature(F.col("alias"))).groupBy("type", "sig").agg(F.min("field").alias("alias_field"))
    rows = proposals.withColumn("sig", tx.field_signature(F.col("name")))
    rows = rows.join(exact, ["type", "name"], "left").join(folded, ["type", "sig"], "left").join(known, ["type", "sig"], "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("folded").isNotNull(), "folded").when(F.col("alias_field").isNotNull(), "alias").otherwise("unclassified")
    return rows.select(*proposals.columns, F.coalesce("exact", "folded", "alias_field").alias("field"), how.alias("how"))


def quarantine(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``flat``(entity_id, path, value): rows without a protected key at any depth, and those with one."""
    guarded = F.exists(F.split("path", "/"), lambda p: F.rlike(p, F.lit(PROTECTED)))
    return flat.filter(~guarded), flat.filter(guarded)


_FIELDS = "entity_id string, field string, value string, n_revisions long, revisions string"


def _deep(old, new):
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: _deep(old.get(k), v) for k, v in new.items()}
    return new


def _join(old, new):
    """Supplement: objects and lists unite, different scalars stand side by side."""
    if old is None or old == new:
        return new
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: _join(old.get(k), v) for k, v in new.items()}
    a, b = (x if isinstance(x, list) else [x] for x in (old, new))
    return a + [x for x in b if x not in a]


def _fold(steps: list[dict]) -> tuple[str, int, str]:
    """The value after all updates in order, the number of archived ones, and these."""
    value, archive = None, []
    for row in steps:
        new = json.loads(row["value"])
        if row["relationship"] == "revise" and value is not None:
            archive.append(value)
            value = _deep(value, new)
        else:
            value = _join(value, new)
    text = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
    return text(value), len(archive), text(archive)


def field_updates(updates: DataFrame) -> DataFrame:
    """``updates``(entity_id, field, ord, relationship, value as JSON), the stored value first: the folded value and the archived ones.

    revise archives an existing value and patches it deeply (lists are replaced); anything else supplements it.
    """

    def fold(batches):
        for b in batches:
            out = [_fold(x) for x in b.column("steps").to_pylist()]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            types = (pa.string(), pa.int64(), pa.string())
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("entity_id"), b.column("field"), *made], ["entity_id", "field", "value", "n_revisions", "revisions"])

    steps = F.array_sort(F.collect_list(F.struct("ord", "relationship", "value")))
    return updates.groupBy("entity_id", "field").agg(steps.alias("steps")).mapInArrow(fold, _FIELDS)


def _united(rows: DataFrame, column: str, order: str = "ord") -> Column:
    """All entries of an array column of a group, in the order first seen."""
    none = F.array().cast(rows.schema[column].dataType)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: F.coalesce(x[column], none))
    return F.array_distinct(F.flatten(listed)).alias(column)


def upsert_candidates(rows: DataFrame) -> DataFrame:
    """``rows``(chat_id, key, ord, description, aliases, and perhaps evidence), old and new: the last non-blank scalar wins, aliases and evidence unite in the order seen."""
    said = F.max(F.when(F.trim("description") != "", F.struct("ord", "description")))["description"]
    lists = [c for c in ("aliases", "evidence") if c in rows.columns]
    return rows.groupBy("chat_id", "key").agg(said.alias("description"), *[_united(rows, c) for c in lists])


def upsert_links(rows: DataFrame) -> DataFrame:
    """``rows``(chat_id, key, list, link, ord, value), the entries of a candidate's lists by what they link to, old and new: one for each link, the last value that is not null, where it was first seen."""
    first = F.row_number().over(W.partitionBy("chat_id", "key", "list").orderBy("first", "link")) - 1
    one = rows.groupBy("chat_id", "key", "list", "link").agg(
        F.min("ord").alias("first"), F.max(F.when(F.col("value").isNotNull(), F.struct("ord", "value")))["value"].alias("value")
    )
    return one.withColumn("place", first.cast("long")).drop("first")


def upsert_relations(rows: DataFrame) -> DataFrame:
    """``rows``(chat_id, a, b, ord, kind, value): one row for each unordered pair and kind, the last value."""
    pair = F.array_sort(F.array("a", "b"))
    rows = rows.withColumn("low", pair[0]).withColumn("high", pair[1]).filter("low <> high")
    return rows.groupBy("chat_id", "low", "high", "kind").agg(F.max(F.struct("ord", "value"))["value"].alias("value"))


def upsert_directions(rows: DataFrame) -> DataFrame:
    """``rows``(chat_id, src, dst, ord, value): what one side of a relation shows the other, the last value of each direction; none of a side to itself."""
    pair = [F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")]
    return rows.filter("src <> dst").groupBy("chat_id", *pair, "src", "dst").agg(F.max(F.struct("ord", "value"))["value"].alias("value"))


def roster_fallback(plan: DataFrame, roster: DataFrame) -> DataFrame:
    """``plan``(chat_id, key, name, description, aliases, and perhaps evidence) completed by resolved ``roster`` items of the same columns: missing keys are added, others gain aliases and evidence, and what they left blank."""
    both = plan.withColumn("rank", F.lit(0)).unionByName(roster.withColumn("rank", F.lit(1)))
    pick = lambda c: F.min(F.when(F.trim(c) != "", F.struct("rank", F.col(c).alias("x"))))["x"].alias(c)
    lists = [_united(both, c, "rank") for c in ("aliases", "evidence") if c in both.columns]
    return both.groupBy("chat_id", "key").agg(pick("name"), pick("description"), *lists)


def referenced_keys(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """chat_id, key: every key that a column of the tables names, arrays of keys included."""
    every = None
    for rows, columns in tables:
        for c in columns:
            listed = rows.schema[c].dataType.typeName() == "array"
            one = rows.select("chat_id", (F.explode(c) if listed else F.col(c)).alias("key")).filter("key is not null and trim(key) <> ''")
            every = one if every is None else every.unionByName(one)
    return every.distinct()


def stub_nodes(referenced: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keys that are referenced (chat_id, key) but have no candidate."""
    return referenced.select("chat_id", "key").distinct().join(candidates.select("chat_id", "key"), ["chat_id", "key"], "left_anti")


def filter_placements(claims: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claims``(chat_id, item, role, target): kept, and dropped with a reason: unknown target, or a role that does not fit its type (``known``: chat_id, key, type)."""
    rows = claims.join(known.select("chat_id", F.col("key").alias("target"), "type"), ["chat_id", "target"], "left")
    fits = F.lit(False)
    for role, kinds in CLAIM_ROLES.items():
        fits = F.when(F.col("role") == role, F.col("type").isin(*kinds)).otherwise(fits)
    reason = F.when(F.col("type").isNull(), "unknown_target").when(F.col("item") == F.col("target"), "self").when(~fits, "role_mismatch")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select(*claims.columns), rows.filter("reason is not null").select(*claims.columns, "reason")


def filter_locations(claims: DataFrame, known: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claims``(chat_id, key, location): kept, and dropped with a reason: not a known location (``known``: chat_id, key, type), or not where the batch plays (``actual``: chat_id, key)."""
    kinds = known.select("chat_id", F.col("key").alias("location"), "type")
    there = actual.select("chat_id", F.col("key").alias("location"), F.lit(True).alias("there")).distinct()
    rows = claims.join(kinds, ["chat_id", "location"], "left").join(there, ["chat_id", "location"], "left")
    reason = F.when(~F.coalesce(F.col("type") == "location", F.lit(False)), "unknown_location").when(F.col("there").isNull(), "not_in_batch")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select(*claims.columns), rows.filter("reason is not null").select(*claims.columns, "reason")


def filter_parents(claims: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claims``(chat_id, key, type, parent): kept, and dropped with a reason: parent unknown (``known``: chat_id, key, type), of another type, or the entity itself."""
    rows = claims.join(known.select("chat_id", F.col("key").alias("parent"), F.col("type").alias("parent_type")), ["chat_id", "parent"], "left")
    reason = F.when(F.col("parent") == F.col("key"), "self").when(F.col("parent_type").isNull(), "unknown_parent").when(F.col("parent_type") != F.col("type"), "type_mismatch")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select(*claims.columns), rows.filter("reason is not null").select(*claims.columns, "reason")


def filter_concepts(claims: DataFrame, known: DataFrame) -> DataFrame:
    """``claims``(chat_id, key, concept) of known concepts."""
    return claims.join(known.filter("type = 'concept'").select("chat_id", F.col("key").alias("concept")).distinct(), ["chat_id", "concept"], "left_semi")


def filter_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs``(chat_id, a, b) of two distinct known characters."""
    own = known.filter("type = 'character'").select("chat_id", "key").distinct()
    rows = pairs.filter("a <> b")
    for c in ("a", "b"):
        rows = rows.join(own.withColumnRenamed("key", c), ["chat_id", c], "left_semi")
    return rows.select(*pairs.columns)


def placement_hints(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claims``(chat_id, item, holder, role) to hints for items with one holder, the strongest role (equipped, worn, carried), and warnings for the rest."""
    strength = F.when(F.col("role") == "equipped", 3).when(F.col("role") == "worn", 2).otherwise(1)
    rows = claims.groupBy("chat_id", "item").agg(F.countDistinct("holder").alias("n"), F.min("holder").alias("holder"), F.max(F.struct(strength.alias("s"), "role"))["role"].alias("role"))
    return rows.filter("n = 1").drop("n"), rows.filter("n > 1").select("chat_id", "item", F.lit("several_holders").alias("warning"))


def link_to_events(evidence: DataFrame, slices: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``evidence``(chat_id, evidence_id, kind, key, ref, quote), ``slices``(chat_id, event_id, ref, text), ``messages``(chat_id, ref, content): links (chat_id, evidence_id, kind, key, ref, event_id), and the unresolved with a reason.

    A quote must lie in its whole message. The only event that owns the message then gets the link; of several owners the only one
    whose slice of the message holds the quote. Evidence of a message that is not there is unknown_ref, quote_not_found without the quote, else not_unique.
    """
    q = tx.evidence_text(F.col("quote"))
    held = messages.select("chat_id", "ref", tx.evidence_text(F.col("content")).alias("body"))
    rows = evidence.withColumn("q", q).join(held, ["chat_id", "ref"], "left")
    rows = rows.withColumn("found", F.coalesce((F.col("q") != "") & F.contains("body", "q"), F.lit(False)))
    keys = ["chat_id", "evidence_id"]
    met = rows.filter("found").select(*keys, "ref", "q").join(slices, ["chat_id", "ref"])
    holds = F.when(F.contains(tx.evidence_text(F.col("text")), F.col("q")), F.col("event_id"))
    by = met.groupBy(*keys).agg(
        F.countDistinct("event_id").alias("n"), F.min("event_id").alias("only"), F.countDistinct(holds).alias("k"), F.min(holds).alias("held")
    )
    out = rows.join(by, keys, "left")
    event = F.when(F.col("n") == 1, F.col("only")).when(F.col("k") == 1, F.col("held"))
    reason = F.when(F.col("body").isNull(), "unknown_ref").when(~F.col("found"), "quote_not_found").otherwise("not_unique")
    columns = ["chat_id", "evidence_id", "kind", "key", "ref"]
    out = out.select(*columns, event.alias("event_id"), reason.alias("reason"))
    return out.filter("event_id is not null").drop("reason"), out.filter("event_id is null").drop("event_id")


def event_members(links: DataFrame) -> DataFrame:
    """What ``links`` of ``link_to_events`` give an event: chat_id, event_id, list, key, refs. Entities and locations are related, locations also places with the refs they are named in; relations are pairs."""
    lists = F.when(F.col("kind") == "relation", F.array(F.lit("related_pairs"))).when(F.col("kind") == "location", F.array(F.lit("related_entities"), F.lit("locations"))).otherwise(F.array(F.lit("related_entities")))
    rows = links.select("chat_id", "event_id", F.explode(lists).alias("list"), "key", "ref")
    refs = F.array_sort(F.collect_set(F.when(F.col("list") == "locations", F.col("ref"))))
    return rows.groupBy("chat_id", "event_id", "list", "key").agg(refs.alias("refs"))


def pair_key(a: str, b: str) -> Column:
    """The key of a relation: its two participants in order."""
    return F.concat(F.least(a, b), F.lit(" / "), F.greatest(a, b))


def headers_without_place(headers: DataFrame) -> DataFrame:
    """``headers``(chat_id, ref, header): scene headers that name no place, with a warning."""
    place, _ = tx.scene_header_parts(F.col("header"))
    return headers.filter((F.trim("header") != "") & (place == "")).select("chat_id", "ref", F.lit("header_without_place").alias("warning"))


def link_actors(details: DataFrame, speakers: DataFrame, participants: DataFrame) -> DataFrame:
    """Actors of details and named user speakers (chat_id, event_id, key) that an event does not list yet."""
    new = details.select("chat_id", "event_id", "key").unionByName(speakers.select("chat_id", "event_id", "key")).distinct()
    return new.join(participants.select("chat_id", "event_id", "key"), ["chat_id", "event_id", "key"], "left_anti")


def bind_memories(memories: DataFrame, evidence: DataFrame, slices: DataFrame) -> DataFrame:
    """``memories``(chat_id, memory_id, owner, description), ``evidence``(memory_id, ref, quote): distinct memories with their events, those whose slice holds a quote, else those that own its ref; others are dropped."""
    quotes = evidence.groupBy("memory_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("ref", "quote")))).alias("proof"))
    own = memories.join(quotes, "memory_id")
    own = own.groupBy("chat_id", "owner", "description", "proof").agg(F.min("memory_id").alias("memory_id")).drop("proof")
    q, s = tx.evidence_text(F.col("quote")), tx.evidence_text(F.col("text"))
    met = own.join(evidence, "memory_id").join(slices, ["chat_id", "ref"]).withColumn("holds", F.contains(s, q) & (q != ""))
    by = met.groupBy("chat_id", "memory_id", "owner").agg(F.collect_set(F.when(F.col("holds"), F.col("event_id"))).alias("exact"), F.collect_set("event_id").alias("near"))
    return by.select("chat_id", "memory_id", "owner", F.array_sort(F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("near"))).alias("events"))


def infer_evidence(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """``candidates``(chat_id, key, names) without evidence: refs of messages that contain a name, or that a user of that name wrote."""
    names = candidates.select("chat_id", "key", F.explode("names").alias("needle")).filter("trim(needle) <> ''")
    said = found_in(names, messages.withColumnRenamed("content", "text"))
    wrote = messages.filter("role = 'user'").select("chat_id", F.col("speaker").alias("needle"), "ref")
    rows = names.join(said.unionByName(wrote.join(names.select("chat_id", "needle").distinct(), ["chat_id", "needle"])).distinct(), ["chat_id", "needle"])
    return rows.select("chat_id", "key", "ref").distinct()


def seed_player(candidates: DataFrame, players: DataFrame) -> DataFrame:
    """The player of each chat (chat_id, player) as a stub candidate, which replaces one of that key."""
    seeds = players.select("chat_id", F.concat(F.lit("character:"), "player").alias("key"), F.array("player").alias("names"), F.lit(True).alias("stub"))
    rest = candidates.select("chat_id", "key", "names", "stub").join(seeds.select("chat_id", "key"), ["chat_id", "key"], "left_anti")
    return rest.unionByName(seeds)


