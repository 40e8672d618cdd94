"""The normalised event plan: segments against a plain loop, anchors, updates, and the whole chain on one plan."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from storynet.operators import plan, segments

MESSAGES = "chat_id string, batch_ix int, message_ix long, ref string, content string"
BLOCKS = "chat_id string, batch_ix int, block_ix int, block_key string, refs array<string>, opening_ref string, opening string, hard boolean"
INNER = "chat_id string, batch_ix int, start_key string, ref string, quote string, hard boolean"
KEY = "chat_id string, batch_ix int, key string"


def batches(seed, n=40):
    rng, out = random.Random(seed), []
    for b in range(n):
        messages = [(f"m{i}", " ".join(f"w{b}.{i}.{k}" for k in range(6))) for i in range(rng.randint(1, 6))]
        cuts = sorted(rng.sample(range(1, len(messages)), rng.randint(0, len(messages) - 1))) if len(messages) > 1 else []
        edges = [0, *cuts, len(messages)]
        blocks = [(f"b{k}", [r for r, _ in messages[a:z]], rng.random() < 0.2) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
        inner = []
        for k in range(rng.randint(0, 5)):
            i = rng.randrange(len(messages))
            quote = rng.choice([f"w{b}.{i}.{rng.randint(0, 5)}", f"W{b} nowhere", ""])
            inner.append((f"s{k}", f"m{i}", quote, rng.random() < 0.3))
        keys = [x[0] for x in blocks] + [x[0] for x in inner] + ["ghost", "old_tail"]
        chosen, opened = rng.sample(keys, rng.randint(0, len(keys))), rng.sample(keys[:-1], rng.randint(0, 2))
        out.append((f"c{b % 3}", b, messages, blocks, inner, chosen, opened, rng.random() < 0.5, rng.choice(["absent", "keep_distinct", "merge_into_pending"])))
    return out


def plain(batch):
    """One batch, start after start."""
    _, _, messages, blocks, inner, chosen, opened, forming, disposition = batch
    text, hard = dict(messages), {k for k, _, h in blocks if h} | {k for k, _, _, h in inner if h}
    new = lambda k: k in chosen or k in hard
    groups = []
    for i, (key, refs, _) in enumerate(blocks):
        if i == 0:
            groups.append(["old_tail" if forming and not new(key) else key, list(refs)])
        elif new(key):
            groups.append([key, list(refs)])
        else:
            groups[-1][1] += refs
    chunks, notes = [], set()
    for key, _ref, quote, _h in inner:
        if new(key) and text[_ref].find(quote if quote else "\0") < 0:
            notes.add((key, "START_NOT_FOUND"))
    for key, refs in groups:
        at, offset = 0, 0
        starts = sorted((refs.index(r), text[r].find(q), k, r, q) for k, r, q, _ in inner if new(k) and q and r in refs and text[r].find(q) >= 0)
        anchor = (refs[0], text[refs[0]][:10])
        for i, o, k, r, q in starts:
            if (i, o) <= (at, offset):
                notes.add((k, "COINCIDENT_START"))
                continue
            chunks.append((key, refs[at : i + 1], anchor, offset))
            key, at, offset, anchor = k, i, o, (r, q)
        chunks.append((key, refs[at:], anchor, offset))
    out, number = [], 0
    old = {"keep_distinct": "forming_existing", "merge_into_pending": "pending_tail"}.get(disposition)
    for key, refs, anchor, offset in chunks:
        if key == "old_tail" and old:
            slot = old
        else:
            number += 1
            slot = f"new_{number}"
        out.append((key, slot, refs, *anchor, offset))
    known = {k for k, _, _ in blocks} | {k for k, *_ in inner}
    notes |= {(k, "UNKNOWN_START") for k in chosen if k not in known and k != "old_tail"} | {(k, "UNKNOWN_CANDIDATE") for k in opened if k not in known}
    starts_anew = lambda k: new(k) or (k == blocks[0][0] and not forming)
    notes |= {(k, "OPEN_CANDIDATE_IS_CHOSEN") for k in opened if k in known and starts_anew(k)}
    return out, notes


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_equal_a_plain_loop(spark, seed):
    data = batches(seed)
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    messages = make([(c, b, i, r, t) for c, b, m, *_ in data for i, (r, t) in enumerate(m)], MESSAGES)
    blocks = make([(c, b, i, k, refs, None, dict(m)[refs[0]][:10], h) for c, b, m, bl, *_ in data for i, (k, refs, h) in enumerate(bl)], BLOCKS)
    inner = make([(c, b, *x) for c, b, _, _, inn, *_ in data for x in inn], INNER)
    chosen, opened = (make([(x[0], x[1], k) for x in data for k in x[n]], KEY) for n in (5, 6))
    state = make([(x[0], x[1], x[7], x[8]) for x in data], "chat_id string, batch_ix int, has_forming boolean, disposition string")
    decisions, notes = plan.starts_of(blocks, inner, chosen, opened, state)
    cut, more = plan.derive_segments(blocks, inner, decisions, messages, state)
    got, audit = {}, {}
    for r in cut.orderBy("batch_ix", "seg_ix").collect():
        got.setdefault(r.batch_ix, []).append((r.key, r.slot, r.refs, r.anchor_ref, r.anchor, r.offset))
    for r in notes.unionByName(more).collect():
        audit.setdefault(r.batch_ix, set()).add((r.key, r.code))
    for x in data:
        want, told = plain(x)
        assert got[x[1]] == want and audit.get(x[1], set()) == told


def test_anchors_are_opened_moved_or_mended(spark):
    long = "The quick brown fox jumps over the lazy dog near the river bank"
    messages = spark.createDataFrame([("c", 0, 0, "m0", f"  {long}"), ("c", 0, 1, "m1", "Then it rained all day long, and nobody came."), ("c", 0, 2, "m2", "At night the stars came out again.")], MESSAGES)
    cut = spark.createDataFrame(
        [(0, ["m0"], "m0", "The quick"), (1, ["m0", "m1"], "m1", "jumps over the lazy dog"), (2, ["m1", "m2"], "m1", "it rained al day lomg, and nobody"), (3, ["m2"], "m2", "At night"), (4, ["m2"], "m2", "words that nobody wrote here")],
        "seg_ix int, refs array<string>, anchor_ref string, anchor string",
    ).select(F.lit("c").alias("chat_id"), F.lit(0).alias("batch_ix"), "*")
    rows, audit = plan.repair_starts(cut, messages)
    got = {r.seg_ix: (r.anchor_ref, r.anchor) for r in rows.collect()}
    assert got == {0: ("m0", long[:32]), 1: ("m0", "jumps over the lazy dog"), 2: ("m1", "it rained all day long, and nobody"), 3: ("m2", "At night"), 4: ("m2", "words that nobody wrote here")}
    assert {(r.key, r.code) for r in audit.collect()} == {("1", "MOVED"), ("2", "NEAREST")}
    other = plan.repair_starts(cut.filter("seg_ix = 3").withColumn("anchor", F.lit("came out again")), messages)
    assert other[0].first().anchor == "At night the stars came out agai" and other[1].first().code == "OPENING"


def test_summaries_and_times_by_letters_and_digits(spark):
    rows = spark.createDataFrame([("They met, at noon.", "They met at noon"), ("They met", "They met. Then they left!"), ("A。", "B"), ("", " x "), ("a", None), ("x.", "!"), (None, "n")], "a string, b string")
    text, status = segments.summary_increment(F.col("a"), F.col("b"))
    assert [tuple(r) for r in rows.select(text, status).collect()] == [
        ("They met, at noon.", "contained"), ("They met. Then they left!", "replaced"), ("A\nB", "appended"), ("x", "appended"), ("a", "missing"), ("x.\n!", "appended"), ("n", "appended")
    ]
    times = spark.createDataFrame([(1, "start", "May 12; noon"), (2, "start", "May.12/noon"), (3, "start", "12 May"), (4, "start", "a\\E noon"), (5, "start", "mid-day"), (6, "start", "June 3")], "event_id int, part string, expression string")
    lines = spark.createDataFrame([(i, "on May 12 at noon\nthe mid day") for i in range(1, 6)] + [(6, "June"), (6, "the 3rd")], "event_id int, line string")
    assert sorted(r.event_id for r in segments.supported_times(times, lines).collect()) == [1, 2, 5]


def test_stale_copies_and_empty_updates(spark):
    kind = "chat_id string, {}event_id string, title string, description string, summary string"
    events = spark.createDataFrame([("c", "e1", "T1", "D1", "S1"), ("c", "e2", "T2", "D2", "S2"), ("c", "e3", None, None, "S3")], kind.format(""))
    rows = [
        ("c", "copy", "e2", " T1 ", "other", "S1 "), ("c", "one", "e2", None, None, "S1"), ("c", "own", "e2", "T2", "D2", "S2"), ("c", "lost", "e9", "T1", "D1", "S1"),
        ("c", "blank", "e2", None, None, "S3"), ("c", "tie", "e2", "T2", "D2", "S1"),
    ]
    kept, bad = segments.drop_stale_copies(spark.createDataFrame(rows, kind.format("update_id string, ")), events)
    assert [tuple(r) for r in bad.collect()] == [("c", "copy", "e1")] and kept.count() == 5
    updates = spark.createDataFrame([("c", "a", None, 0), ("c", "b", None, 0), ("c", "b", "x", 0), ("c", "b", None, 1), ("c", " ", None, 0), ("c", None, None, 0)], "chat_id string, segment string, delta string, n_details int")
    assert segments.drop_noop_updates(updates, spark.createDataFrame([("c", "a")], "chat_id string, segment string")).count() == 5


def test_stale_copies_equal_all_pairs(spark):
    rng, pick = random.Random(3), lambda rng, c: rng.choice([None, " ", f"{c}1", f"{c}2", f" {c}2 "])
    events = [("c", f"e{rng.randint(0, 30)}", *(pick(rng, c) for c in "TDS")) for _ in range(40)]
    updates = [("c", f"u{i % 150}", f"e{rng.randint(0, 35)}", *(pick(rng, c) for c in "TDS")) for i in range(200)]
    kind = "chat_id string, {}event_id string, title string, description string, summary string"
    same = lambda a, b: sum(x is not None and x.strip() != "" and y is not None and x.strip() == y.strip() for x, y in zip(a, b, strict=True))
    want = {}
    for _, u, e, *texts in updates:
        for own in (r[2:] for r in events if r[1] == e):
            for _, o, *other in events:
                if o != e and same(texts[2:], other[2:]) and same(texts, other) >= max(2, same(texts, own) + 1):
                    want[u] = min(want.get(u, o), o)
    bad = segments.drop_stale_copies(spark.createDataFrame(updates, kind.format("update_id string, ")), spark.createDataFrame(events, kind.format("")))[1]
    assert {r.update_id: r.copied for r in bad.collect()} == want and want


def test_stale_copies_of_one_summary_are_not_paired(spark):
    rows = spark.range(100_000).selectExpr("'c' as chat_id", "cast(id as string) as event_id", "concat('t', id % 50000) as title", "concat('d', id) as description", "'s' as summary")
    updates = rows.selectExpr("chat_id", "concat('u', event_id) as update_id", "cast((event_id + 1) % 100000 as string) as event_id", "title", "description", "summary")
    began = time.monotonic()
    assert segments.drop_stale_copies(updates, rows)[1].count() == 100_000 and time.monotonic() - began < 100


def test_sanitized_times_keep_what_an_event_had(spark):
    rows = [
        (1, "finalized", "dusk", None, "dawn", None), (2, "finalized", None, "noon", "dawn", None), (3, "finalized", "noon", "noon", None, "noon"), (4, "forming", "dusk", "noon", None, None), (5, "finalized", "odd", "noon", "dawn", None),
        (6, "finalized", None, None, "dawn", "noon"),
    ]
    events = spark.createDataFrame(rows, "event_id int, status string, start string, end string, old_start string, old_end string")
    ok = spark.createDataFrame([(1, "start"), (2, "end"), (4, "start"), (4, "end"), (5, "end")], "event_id int, part string")
    got = {r.event_id: (r.start, r.end) for r in segments.sanitize_times(events, ok).collect()}
    assert got == {1: ("dawn", None), 2: (None, None), 3: ("noon", "noon"), 4: ("dusk", None), 5: (None, None), 6: (None, None)}


def test_the_chain_on_one_plan(spark):
    batch = lambda rows, kind: spark.createDataFrame([("c", 0, *r) for r in rows], f"chat_id string, batch_ix int, {kind}")
    texts = [
        "Morning came to the quiet town, and the smith opened the shop.", "At noon the rider arrived at the gate with a letter.", "The smith read the letter aloud. Later that evening they left for the coast together.", "By May 12 about noon they saw the sea.",
    ]
    p = plan.PlanInput(
        messages=batch([(i, f"m{i}", t) for i, t in enumerate(texts)], "message_ix long, ref string, content string"),
        blocks=batch([(0, "b0", ["m0"], "m0", texts[0][:20], False), (1, "b1", ["m1"], "m1", texts[1][:20], False), (2, "b2", ["m2"], "m2", texts[2][:20], False), (3, "b3", ["m3"], "m3", texts[3][:20], False)], "block_ix int, block_key string, refs array<string>, opening_ref string, opening string, hard boolean"),
        inner=batch([], "start_key string, ref string, quote string, hard boolean"), unresolved=batch([("b1",), ("nope",)], "key string"),
        state=batch([("keep_distinct", "e2", "e1")], "disposition string, forming_id string, pending_id string"),
        events=spark.createDataFrame([("c", "e1", "T", "D", "an old tale", "spring", None), ("c", "e2", "F", "G", "The town wakes.", "dawn", None)], "chat_id string, event_id string, title string, description string, summary string, start string, end string"),
        updates=batch([
            (0, True, None, "F", "the town", "The town wakes. The smith opens.", "dusk", None, ["who rides?"], [("statement", "the smith opened the shop", "m0"), ("thought", "x", "m0"), ("action", "the smith read the letter aloud", "m2")]),
            (1, False, "At noon the rider arrived", "R", "", "A rider comes.", "At noon", "By May 12; noon", [], []),
            (2, False, "Later that evening they left", "L", "leaving", "They leave", None, None, None, None),
            (3, False, "words nobody said at all", "X", "lost", "and see the sea", "May 12, noon", None, ["sea"], None),
            (4, True, None, "T", "D", "an old tale", None, None, None, None),
        ], "ord int, continuing boolean, quote string, title string, description string, summary string, start string, end string, unresolved array<string>, details array<struct<kind:string,content:string,ref:string>>"),
    )
    out = plan.normalise_event_plan(p)
    cut = [(r.key, r.slot, r.refs, r.offset) for r in out["segments"].orderBy("seg_ix").collect()]
    new = next(k for k, *_ in cut if k.startswith("start_in_b2"))
    assert cut == [("old_tail", "forming_existing", ["m0"], 0), ("b1", "new_1", ["m1", "m2"], 0), (new, "new_2", ["m2", "m3"], texts[2].index("Later"))]
    clipped = {(r.slot, r.ref): r.text for r in out["texts"].collect()}
    assert clipped[("new_1", "m2")] == "The smith read the letter aloud. " and clipped[("new_2", "m2")].startswith("Later that")
    updates = {r.slot: r for r in out["updates"].collect()}
    assert set(updates) == {"forming_existing", "new_1", "new_2"}
    assert updates["forming_existing"].summary == "The town wakes. The smith opens." and updates["forming_existing"].start is None and updates["forming_existing"].unresolved == ["who rides?"]
    assert (updates["new_1"].start, updates["new_1"].end) == ("At noon", None)
    assert updates["new_2"].title == "T" and updates["new_2"].description == "D" and updates["new_2"].summary == "They leave\nand see the sea\nan old tale" and updates["new_2"].start == "May 12, noon" and updates["new_2"].unresolved == ["sea"]
    details = {(r.slot, r.ref): (r.content, r.fidelity) for r in out["details"].collect()}
    assert details == {("forming_existing", "m0"): ("the smith opened the shop", "verbatim")}
    audit = {(r.step, r.code) for r in out["audit"].collect()}
    assert audit == {("placed", "START_LOST"), ("starts", "UNKNOWN_CANDIDATE"), ("starts", "OPEN_CANDIDATE_IS_CHOSEN"), ("merge", "UPDATES_MERGED"), ("summary", "REPLACED"), ("details", "INVALID_DETAIL"), ("details", "DETAIL_OUTSIDE_EVENT"),
        ("times", "START_NOT_IN_EVENT"), ("times", "END_NOT_IN_EVENT")}


def test_dyadic_blocks_cover_exactly(spark):
    from storynet.operators import store

    rng = random.Random(3)
    spans = [(rng.randint(-40, 60), rng.randint(-40, 90)) for _ in range(120)] + [(0, 0), (5, 4), (0, 10**9), (7, 2**61), (-3, -3)]
    df = spark.createDataFrame(list(enumerate(spans)), "k int, s struct<a:bigint,b:bigint>").select("k", "s.*")
    for r in df.select("k", "a", "b", store.dyadic_blocks(F.col("a"), F.col("b")).alias("blocks")).collect():
        ends = sorted((x.block << x.level, (x.block + 1 << x.level) - 1) for x in r.blocks)
        if r.a > r.b:
            assert not ends
        else:
            assert ends[0][0] == r.a and ends[-1][1] == r.b and all(y[0] == x[1] + 1 for x, y in zip(ends, ends[1:], strict=False)) and len(ends) <= 126


def test_unprocessed_messages_with_endless_receipts(spark):
    from storynet.operators import store

    messages = spark.createDataFrame([("a", i) for i in range(-2, 30)] + [("b", 10**9 + 5), ("b", 10**9 + 6), ("c", 1)], "chat_id string, floor long")
    receipts = spark.createDataFrame([("a", 3, 9), ("a", 8, 20), ("a", 25, 24), ("b", 0, 10**9 + 5)], "chat_id string, start_floor long, end_floor long")
    got = sorted(tuple(r) for r in store.unprocessed_messages(messages, receipts).select("chat_id", "floor").collect())
    assert got == [("a", i) for i in range(30) if not 3 <= i <= 20] + [("b", 10**9 + 6), ("c", 1)]
    assert store.unprocessed_messages(messages, receipts.limit(0), 0, 1).count() == 3


def test_long_folds_are_linear(spark):
    import time

    from storynet.operators import anchors, rounds

    def took(n):
        began = time.time()
        rows = spark.range(n).select(F.lit("c").alias("chat_id"), F.col("id").alias("round_ix"), (F.col("id") % 700).alias("size"))
        assert rounds.budget_batches(rows, 8, 2000).agg(F.max("batch_ix")).first()[0] > n // 9
        return time.time() - began

    took(1000)
    assert took(200_000) < 60  # a fold that copies its output at each step would take hours
    spans = spark.range(60_000).select(F.lit(1).alias("batch"), F.col("id").alias("ord"), (F.col("id") * 2 % 50_001).alias("pos"))
    assert anchors.locate_in_order(spans).filter("pos is not null").count() > 20_000
