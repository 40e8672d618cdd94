"""Bounded recall packs and stage contexts."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The fields of a card and of a detail, in order.
CARD = ("id", "status", "description", "event_time", "locations", "related_entity_keys", "related_entity_refs")
DETAIL = ("kind", "content", "fidelity", "id", "actor")


def chars(value) -> int:
    """Characters of a value as compact JSON."""
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _full(row: dict, fields: tuple[str, ...]) -> dict:
    return {k: row[k] for k in fields if row.get(k) not in (None, "", [])}


class Pack:
    """One request's recall pack while it is filled and, if need be, emptied again."""

    def __init__(self, max_events: int, max_details: int, max_chars: int):
        self.limits = {"max_events": max_events, "max_key_details": max_details, "max_chars": max_chars}
        self.cards: list[dict] = []
        self.out: dict = {"event_ids": [], "summary_event_ids": [], "key_detail_ids": []}
        self.left = max_details

    def fits(self, card: dict) -> bool:
        return chars({"events": [*self.cards, card]}) <= self.limits["max_chars"]

    def omit(self, what: str, name) -> None:
        if name and name not in self.out[what]:
            self.out[what].append(name)

    def add(self, event: dict, wanted: list[str] | None) -> None:
        """An event's card, then its summary, then its details, each if it fits whole; a later, smaller event still may."""
        card = _full(event, CARD)
        if not self.fits(card):
            return self.omit("event_ids", event.get("id"))
        summary = (event.get("story_summary") or "").strip()
        if summary and self.fits(told := card | {"story_summary": summary}):
            card = told
        elif summary:
            self.omit("summary_event_ids", event.get("id"))
        details = [d for d in event.get("key_details") or [] if (d.get("content") or "").strip()]
        if wanted is not None:
            named = {d.get("id"): d for d in details}
            details = [named[i] for i in wanted if i in named]
        for d in details:
            more = card | {"key_details": [*card.get("key_details", []), _full(d, DETAIL)]}
            if self.left > 0 and self.fits(more):
                card, self.left = more, self.left - 1
            else:
                self.omit("key_detail_ids", d.get("id"))
        self.cards.append(card)
        return None

    def written(self) -> dict:
        """The whole pack, with its own size."""
        pack = {"mode": "normal_event_recall", "events": self.cards, "omitted": self.out, "budget": self.limits | {"used_chars": 0}}
        for _ in range(4):
            pack["budget"]["used_chars"] = chars(pack)
        return pack

    def shrunk(self) -> dict:
        """The pack within its budget: details go from the end, one by one, then summaries, then events, then the lists of what was left out become counts."""
        steps = [("key_detail_ids", c, "key_details") for c in reversed(self.cards) for _ in c.get("key_details", [])]
        steps += [("summary_event_ids", c, "story_summary") for c in reversed(self.cards) if "story_summary" in c]
        steps += [("event_ids", c, None) for c in reversed(self.cards)]
        for what, card, field in steps:
            if chars(self.written()) <= self.limits["max_chars"]:
                return self.written()
            if field == "key_details":
                self.omit(what, card[field].pop().get("id"))
                card.update({} if card[field] else {field: None})
                if card[field] is None:
                    del card[field]
                continue
            if field:
                del card[field]
            else:
                self.cards.remove(card)
            self.omit(what, card.get("id"))
        if chars(self.written()) > self.limits["max_chars"] and any(self.out.values()):
            names = {"event_ids": "event_count", "summary_event_ids": "summary_count", "key_detail_ids": "key_detail_count"}
            self.out = {names[k]: len(v) for k, v in self.out.items()}
        pack = self.written()
        return pack if chars(pack) <= self.limits["max_chars"] else {"mode": "normal_event_recall", "events": [], "truncated_by_budget": True}


def pack_events(events: list[dict], max_events: int = 5, max_details: int = 5, max_chars: int = 4000, details: dict[str, list[str]] | None = None) -> dict:
    """The recall pack of ``events`` in the order given; ``details`` names the details wanted of an event, in order. Budgets that make no sense are refused; texts are never cut."""
    if max_events < 1 or max_details < 0 or max_chars < 200:
        raise ValueError("a recall pack needs at least 1 event, 0 details and 200 characters")
    pack = Pack(max_events, max_details, max_chars)
    for e in events[:max_events]:
        pack.add(e, (details or {}).get(e.get("id")))
    return pack.shrunk()


def recall_packs(requests: DataFrame, events: DataFrame, max_events: int = 5, max_chars: int = 4000, max_details: int = 5) -> DataFrame:
    """``requests``(request_id, rank, event_id, details), ``events``(event_id, body): request_id, n_events, used_chars, pack (JSON).

    ``body`` is an event's JSON, ``details`` the ids of the details wanted (null for all). The best max_events of a request
    that exist are chosen on ids before any body is joined; one request's pack is a small fold.
    """
    if max_events < 1 or max_details < 0 or max_chars < 200:
        raise ValueError("a recall pack needs at least 1 event, 0 details and 200 characters")
    rank = F.row_number().over(W.partitionBy("request_id").orderBy("rank", "event_id"))
    known = requests.join(events.select("event_id"), "event_id", "left_semi")
    chosen = known.withColumn("rank", rank).filter(F.col("rank") <= max_events)

    def fold(batches):
        for b in batches:
            out = []
            for rows in b.column("rows").to_pylist():
                listed = [json.loads(r["body"]) for r in rows]
                wanted = {e.get("id"): r["details"] for e, r in zip(listed, rows, strict=True) if r["details"] is not None}
                pack = pack_events(listed, max_events, max_details, max_chars, wanted)
                text = json.dumps(pack, ensure_ascii=False, separators=(",", ":"))
                out.append((len(pack["events"]), len(text), text))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("request_id"), *made], ["request_id", "n_events", "used_chars", "pack"])

    keep = chosen.join(events.select("event_id", "body"), "event_id")
    rows = keep.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "details", "body"))).alias("rows"))
    return rows.mapInArrow(fold, "request_id string, n_events long, used_chars long, pack string")


def stage_lookup(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """``values``(id, framework, binding, value) to stage by the half-open ``ranges``(framework, binding, stage, low, high): stage if exactly one fits, else code NUMERIC_STAGE_UNRESOLVED."""
    met = values.join(ranges, ["framework", "binding"]).filter("value >= low and value < high")
    one = met.groupBy("id").agg(F.countDistinct("stage").alias("n"), F.min("stage").alias("stage"))
    rows = values.join(one, "id", "left")
    stage = F.when(F.col("n") == 1, F.col("stage"))
    return rows.select("id", stage.alias("stage"), F.when(stage.isNull(), "NUMERIC_STAGE_UNRESOLVED").alias("code"))


def _by_framework(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each framework with the rows of each part as a sorted array of structs, by one shuffle of all parts together."""
    kinds = {name: [c for c in df.columns if c != "framework"] for name, df in parts.items()}
    each = []
    for name, df in parts.items():
        own = F.struct(*kinds[name])
        nulls = [F.lit(None).cast(parts[n].select(F.struct(*kinds[n]).alias("x")).schema["x"].dataType).alias(n) for n in parts if n != name]
        each.append(df.select("framework", own.alias(name), *nulls))
    rows = reduce(DataFrame.unionByName, each)
    return rows.groupBy("framework").agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in parts])


def framework_issues(frameworks: DataFrame, bindings: DataFrame, stages: DataFrame, ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Shape of stage frameworks: framework, code, at.

    ``frameworks``(framework, mode), ``bindings``(framework, binding), ``stages``(framework, stage), ``ranges``(framework, stage, binding, low, high), ``blocks``(framework, ord, block).
    All that belongs to a framework meets once, and every rule looks at its sorted arrays.
    """
    rows = _by_framework({
        "own": frameworks.select("framework", "mode"), "bound": bindings.select("framework", "binding"), "named": stages.select("framework", "stage"),
        "held": ranges.select("framework", "low", "high", "stage", "binding"), "told": blocks.select("framework", "block", "ord"),
    })
    rows = rows.withColumns({"mode": F.try_element_at("own", F.lit(1))["mode"], "n": F.size("bound"), "keys": F.transform("bound", lambda x: x["binding"])})
    mode, n, held, told = (F.col(c) for c in ("mode", "n", "held", "told"))
    issue = lambda code, at: F.struct(F.lit(code).alias("code"), at.cast("string").alias("at"))
    one = lambda when, code, at: F.when(F.coalesce(when, F.lit(False)), F.array(issue(code, at)))
    each = lambda array, code, at: F.transform(array, lambda x: issue(code, at(x)))
    known = lambda r: F.coalesce(F.array_contains(F.col("keys"), r["binding"]), F.lit(False))
    numeric, derived = mode.isin("numeric_derived", "hybrid"), (mode == "numeric_derived") & (n == 1)
    rows = rows.withColumn("steps", F.filter("held", lambda r: known(r) & (r["low"] < r["high"]) & F.coalesce(derived, F.lit(False))))
    steps = F.col("steps")
    beside = lambda test: F.filter("steps", lambda r, i: (i > 0) & test(r["low"], F.get(steps, i - 1)["high"]))
    stage = lambda r: r["stage"]
    repeated = F.filter("told", lambda b, i: (i > 0) & b["block"].eqNullSafe(F.get(told, i - 1)["block"]))
    issues = [
        one((mode == "semantic") & (n > 0), "SEMANTIC_STAGE_HAS_NUMERIC_BINDING", mode),
        one(numeric & (n == 0), "NUMERIC_STAGE_BINDING_REQUIRED", mode),
        one((mode == "numeric_derived") & (n != 1), "NUMERIC_STAGE_SINGLE_BINDING_REQUIRED", mode),
        each(F.filter("held", lambda r: ~known(r)), "UNKNOWN_NUMERIC_BINDING", stage),
        each(F.filter("held", lambda r: known(r) & (r["low"] >= r["high"]) & mode.isNotNull()), "INVALID_STAGE_RANGE", stage),
        each(repeated, "DUPLICATE_STAGE_CONTEXT_ID", lambda b: b["block"]),
        each(F.when(mode == "semantic", held), "SEMANTIC_STAGE_HAS_NUMERIC_GUIDANCE", stage),
        one(derived & (F.size("named") != F.size("steps")), "NUMERIC_STAGE_RANGE_REQUIRED", F.size("named")),
        each(beside(lambda low, before: low < before), "OVERLAPPING_STAGE_RANGE", stage),
        each(beside(lambda low, before: low > before), "GAPPED_STAGE_RANGE", stage),
    ]
    none = F.array().cast("array<struct<code:string,at:string>>")
    return rows.select("framework", F.inline(F.concat(*[F.coalesce(x, none) for x in issues])))


def framework_links(hosts: DataFrame, frameworks: DataFrame) -> DataFrame:
    """``hosts``(id, skill, framework) against ``frameworks``(framework, type, has_component): a skill's own stages are those of the skill that the host has, and a framework has the component that
    holds them: id, code. Frameworks that do not exist are no matter of this rule."""
    rows = hosts.join(frameworks, "framework")
    code = F.when((F.col("type") == "skill") & (F.col("framework") != F.col("skill")), "SKILL_STAGE_FRAMEWORK_MISMATCH").when(~F.col("has_component"), "STAGE_FRAMEWORK_COMPONENT_MISSING")
    return rows.select("id", code.alias("code")).filter("code is not null")


def duplicate_numeric_values(values: DataFrame) -> DataFrame:
    """``values``(id, ord, binding): the second and later value of one binding: id, ord, code."""
    n = F.row_number().over(W.partitionBy("id", "binding").orderBy("ord"))
    return values.filter("binding is not null").withColumn("n", n).filter("n > 1").select("id", "ord", F.lit("DUPLICATE_SKILL_NUMERIC_VALUE").alias("code"))


def host_stage_issues(hosts: DataFrame, stages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``hosts``(id, framework, host_mode, mode, binding, value, stage): one code for each host, the first that holds. Hosts with ``framework_links`` are left out before."""
    known = stages.select("framework", "stage", F.lit(True).alias("known")).distinct()
    bound = ranges.select("framework", "binding", F.lit(True).alias("bound")).distinct()
    derived = stage_lookup(hosts.filter("value is not null").select("id", "framework", "binding", "value"), ranges.select("framework", "binding", "stage", "low", "high"))
    rows = hosts.join(known, ["framework", "stage"], "left").join(bound, ["framework", "binding"], "left")
    rows = rows.join(derived.withColumnsRenamed({"stage": "derived", "code": "unresolved"}), "id", "left")
    numeric = F.col("mode") == "numeric_derived"
    code = (
        F.when(F.col("host_mode") != F.col("mode"), "STAGE_EVALUATION_MODE_MISMATCH")
        .when((F.col("mode") != "numeric_derived") & F.col("stage").isNull(), "EXPLICIT_SKILL_STAGE_REQUIRED")
        .when((F.col("mode") == "semantic") & F.col("value").isNotNull(), "SEMANTIC_SKILL_STAGE_HAS_NUMERIC_VALUE")
        .when(F.col("stage").isNotNull() & F.col("known").isNull(), "UNKNOWN_HOST_STAGE")
        .when(numeric & F.col("value").isNull(), "NUMERIC_SKILL_STAGE_VALUE_REQUIRED")
        .when(F.col("binding").isNotNull() & F.col("bound").isNull(), "UNKNOWN_HOST_NUMERIC_BINDING")
        .when(numeric & F.col("unresolved").isNotNull(), "NUMERIC_STAGE_UNRESOLVED")
        .when(numeric & (F.col("stage") != F.col("derived")), "STALE_NUMERIC_STAGE_CACHE")
    )
    return rows.select("id", code.alias("code")).filter("code is not null")


MODES = ("current_stage", "transition_check", "framework_overview")


def transition_guidance(packages: DataFrame, requests: DataFrame, guidance: DataFrame) -> DataFrame:
    """Entry and exit guidance (framework, stage, entry, exit) of the stages that ``stage_context`` gives a request which asks for a transition_check: id, stage, entry, exit."""
    given = packages.filter("stages is not null").select("id", F.explode(F.from_json("stages", "array<struct<stage:string>>")).alias("s")).select("id", F.col("s.stage").alias("stage"))
    asked = requests.filter("recall_mode = 'transition_check'").select("id", "framework")
    return given.join(asked, "id").join(guidance.withColumn("stage", F.col("stage").cast("string")), ["framework", "stage"]).select("id", "stage", "entry", "exit")


def stage_context(requests: DataFrame, stages: DataFrame, blocks: DataFrame, ranges: DataFrame, issues: DataFrame) -> DataFrame:
    """``requests``(id, framework, mode, recall_mode, purpose, binding, value, stage): id, stages (JSON list of those given with their blocks), code.

    Only the current stage, or with transition_check also those whose range holds the value (hybrid), or all with framework_overview; blocks of the
    asked purpose. An issue of the framework blocks all.
    """
    bad = issues.select("framework", F.lit(True).alias("bad")).distinct()
    frames = _by_framework({
        "known": stages.select("framework", "stage"), "held": ranges.select("framework", "stage", "binding", "low", "high"), "told": blocks.select("framework", "stage", "purpose", "content"),
    })
    frames = frames.withColumn("known", F.array_distinct("known"))  # here and not before, which would shuffle every stage once more
    rows = requests.join(bad, "framework", "left").join(frames, "framework", "left")
    purpose, binding, value, asked, mode = (F.col(c) for c in ("purpose", "binding", "value", "recall_mode", "mode"))
    inside = lambda h: F.coalesce((h["binding"] == binding) & (value >= h["low"]) & (value < h["high"]), F.lit(False))
    fits = F.array_distinct(F.filter(F.transform(F.filter("held", inside), lambda h: h["stage"]), lambda s: s.isNotNull()))
    rows = rows.withColumn("within", fits)
    derived = F.when(F.size("within") == 1, F.get("within", F.lit(0)))
    rows = rows.withColumn("current", F.when(mode == "numeric_derived", derived).otherwise(F.col("stage")))
    code = (
        F.when(F.col("bad"), "FRAMEWORK_INVALID")
        .when(~asked.isin(*MODES), "INVALID_RECALL_MODE")
        .when((mode == "numeric_derived") & F.col("current").isNull(), "NUMERIC_STAGE_UNRESOLVED")
        .when((asked != "framework_overview") & F.col("current").isNull(), "EXPLICIT_STAGE_REQUIRED")
    )
    rows = rows.withColumn("code", code)
    near = (asked == "transition_check") & (mode == "hybrid")

    def take(x: Column) -> Column:
        own = F.coalesce(x["stage"] == F.col("current"), F.lit(False)) | F.coalesce(asked == "framework_overview", F.lit(False))
        return own | (F.coalesce(near, F.lit(False)) & F.coalesce(F.array_contains(F.col("within"), x["stage"]), F.lit(False)))

    def package(x: Column) -> Column:
        mine = F.filter("told", lambda b: F.coalesce((b["stage"] == x["stage"]) & (b["purpose"] == purpose), F.lit(False)) & b["content"].isNotNull())
        return F.struct(x["stage"].alias("stage"), F.array_sort(F.transform(mine, lambda b: b["content"])).alias("blocks"))

    given = F.transform(F.filter("known", take), package)
    listed = F.when(F.col("code").isNull() & (F.size(given) > 0), F.to_json(F.array_sort(given)))
    return rows.select("id", "code", listed.alias("stages"))
