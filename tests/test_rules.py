"""Rules that SQL does not express, against plain Python, hand-made cases and properties."""

from __future__ import annotations

import json
import random
import re
import threading
import unicodedata
from difflib import SequenceMatcher

import pytest

from storynet.operators import anchors, audit, recall, repair, resolve, segments, store
from storynet.plans import rule_queries
from storynet.sources import chats


def event(n, **more):
    detail = {"id": f"d{n}", "kind": "action", "content": f"did {n}", "source_refs": ["m1"], "fidelity": "verbatim"}
    return {"id": f"event_{n}", "status": "finalized", "description": f"about {n}", "story_summary": f"story {n}", "key_details": [detail], "locations": [], "secret": "x"} | more


def size(x):
    return len(json.dumps(x, ensure_ascii=False, separators=(",", ":")))


def test_recall_pack_caps_and_fields():
    pack = recall.pack_events([event(n) for n in range(1, 7)], 3, 2, 2000)
    assert [e["id"] for e in pack["events"]] == ["event_1", "event_2", "event_3"]
    assert [len(e.get("key_details", [])) for e in pack["events"]] == [1, 1, 0] and pack["omitted"]["key_detail_ids"] == ["d3"]
    card = pack["events"][0]
    assert list(card) == ["id", "status", "description", "story_summary", "key_details"]
    assert card["key_details"] == [{"kind": "action", "content": "did 1", "fidelity": "verbatim", "id": "d1"}]
    assert pack["mode"] == "normal_event_recall" and pack["budget"] == {"max_events": 3, "max_key_details": 2, "max_chars": 2000, "used_chars": size(pack)}


def test_recall_pack_omits_the_summary_before_it_cuts_a_text():
    pack = recall.pack_events([event(1, story_summary="whole sentence. " * 200)], max_chars=400)
    assert pack["omitted"]["summary_event_ids"] == ["event_1"] and "story_summary" not in pack["events"][0]


def test_recall_pack_admits_a_smaller_event_after_one_that_does_not_fit():
    pack = recall.pack_events([event(1), event(2, description="long " * 400), event(3)], max_chars=900)
    assert [e["id"] for e in pack["events"]] == ["event_1", "event_3"] and pack["omitted"]["event_ids"] == ["event_2"]


def test_recall_pack_takes_asked_details_in_order():
    details = [{"id": x, "content": x} for x in "abcd"] + [{"id": "blank", "content": " "}]
    pack = recall.pack_events([event(1, key_details=details)], details={"event_1": ["c", "nope", "a", "blank"]})
    assert [d["id"] for d in pack["events"][0]["key_details"]] == ["c", "a"]


def test_recall_pack_refuses_senseless_budgets():
    for bad in ({"max_events": 0}, {"max_details": -1}, {"max_chars": 199}):
        with pytest.raises(ValueError):
            recall.pack_events([event(1)], **bad)


def test_recall_pack_always_stays_in_budget_and_accounts_for_all():
    rng = random.Random(3)
    for _ in range(300):
        made = [event(n, description="d" * rng.randint(0, 80), story_summary="s" * rng.choice([0, 30, 600]), key_details=[{"id": f"{n}-{k}", "content": "k" * rng.randint(1, 60)} for k in range(rng.randint(0, 4))]) for n in range(rng.randint(1, 7))]
        most = rng.randint(200, 2500)
        pack = recall.pack_events(made, 5, 5, most)
        assert size(pack) <= most
        if "budget" not in pack:
            continue
        assert pack["budget"]["used_chars"] == size(pack)
        if "event_ids" in pack["omitted"]:
            shown = {e["id"]: e for e in pack["events"]}
            assert set(shown) | set(pack["omitted"]["event_ids"]) == {e["id"] for e in made[:5]}
            for e in made[:5]:
                if e["id"] in shown:
                    kept = {d["id"] for d in shown[e["id"]].get("key_details", [])}
                    assert kept | set(pack["omitted"]["key_detail_ids"]) >= {d["id"] for d in e["key_details"]}
                    assert not e["story_summary"] or "story_summary" in shown[e["id"]] or e["id"] in pack["omitted"]["summary_event_ids"]


def test_recall_packs_choose_existing_events_by_rank(spark):
    events = spark.createDataFrame([(n, json.dumps(event(n))) for n in range(8)], "event_id long, body string")
    asked = [("r", 9 - n, n, None) for n in range(8)] + [("r", 0, 99, None), ("q", 1, 2, ["d2"])]
    got = {r.request_id: json.loads(r.pack) for r in recall.recall_packs(spark.createDataFrame(asked, "request_id string, rank long, event_id long, details array<string>"), events, 3).collect()}
    assert [e["id"] for e in got["r"]["events"]] == ["event_7", "event_6", "event_5"] and [e["id"] for e in got["q"]["events"]] == ["event_2"]


def test_links_need_the_quote_in_the_message_and_slices_only_among_several_owners(spark):
    messages = spark.createDataFrame([("c", "m1", "the whole first message"), ("c", "m2", "shared by two"), ("c", "m3", "in both, in both")], "chat_id string, ref string, content string")
    slices = spark.createDataFrame([("c", "e1", "m1", "the whole"), ("c", "e1", "m2", "shared"), ("c", "e2", "m2", "by two"), ("c", "e1", "m3", "in both"), ("c", "e2", "m3", "in both")], "chat_id string, event_id string, ref string, text string")
    rows = [
        ("c", 1, "entity", "a", "m1", "first message"), ("c", 2, "entity", "b", "m2", "by two"), ("c", 3, "entity", "c", "m3", "in both"), ("c", 4, "entity", "d", "m1", "invented"),
        ("c", 5, "location", "p", "m1", "\"whole first\""), ("c", 6, "entity", "e", "m9", "x"), ("c", 7, "entity", "f", "m1", " "), ("c", 8, "entity", "g", "m2", "shared by"),
    ]
    good, bad = resolve.link_to_events(spark.createDataFrame(rows, "chat_id string, evidence_id long, kind string, key string, ref string, quote string"), slices, messages)
    assert {(r.key, r.event_id) for r in good.collect()} == {("a", "e1"), ("b", "e2"), ("p", "e1")}
    assert {(r.key, r.reason) for r in bad.collect()} == {("c", "not_unique"), ("d", "quote_not_found"), ("e", "unknown_ref"), ("f", "quote_not_found"), ("g", "not_unique")}
    assert {(r.list, r.key, tuple(r.refs)) for r in resolve.event_members(good).collect() if r.key == "p"} == {("related_entities", "p", ()), ("locations", "p", ("m1",))}


def signature(text):
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", unicodedata.normalize("NFKC", text).strip())
    return re.sub(r"_+", "_", re.sub(r"[-\s]+", "_", text)).lower()


def test_repair_keys_equals_plain_matching(spark):
    rng = random.Random(5)
    fields = ["displayName", "display_name2", "max_weight", "maxWidth", "colour", "Size", "side", "kind of"]
    keys = sorted({"".join(c for c in rng.choice(fields) if rng.random() > 0.12) + rng.choice(["", "", "s", "_", " X"]) for _ in range(150)} | {"ＳＩＺＥ", "Max-Width", "max__weight", " colour ", "pet name", "petName"})
    aliases = [("/a/*", 1, "Pet  Name", "kind of"), ("/a/*/b", 0, "petName", "Size"), ("/a/b", 2, "pet_name", "colour")]
    at = "component string, path string, "
    rows = repair.repair_keys(
        spark.createDataFrame([("c", "/a/b", k) for k in keys], at + "key string"), spark.createDataFrame([("c", "/a/b", f) for f in fields], at + "field string"),
        spark.createDataFrame([("c", *a) for a in aliases], at + "ord int, alias string, field string"), 0.8, 0.05,
    ).collect()
    got = {r.key: (r.correction, r.code) for r in rows}
    want = {}
    for k in keys:
        if k in fields:
            continue
        same = [f for f in fields if signature(f) == signature(k)]
        named = [f for p, o, a, f in sorted(aliases, key=lambda x: x[1]) if p in ("/a/*", "/a/b") and signature(a) == signature(k)]
        scored = sorted((SequenceMatcher(None, signature(k), signature(f)).ratio(), f) for f in fields)
        found = same[0] if len(same) == 1 else named[0] if named else scored[-1][1] if scored[-1][0] >= 0.8 and scored[-1][0] - scored[-2][0] >= 0.05 else None
        code = "CORRECTED" if found else "AMBIGUOUS_FIELD" if scored[-2][0] >= 0.8 else "UNKNOWN_FIELD"
        want[k] = (None, "CORRECTION_COLLISION") if found in keys else (found, code)
    assert got == want and len({c for _, c in want.values()}) >= 3


def test_short_and_long_quotes_are_found_as_by_brute_force(spark):
    rng = random.Random(6)
    texts = [(f"t{i}", " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [("null", None), ("", "")]
    plain = lambda t: "".join(c for c in t or "" if not (c.isspace() or c in "*_`~" or unicodedata.category(c)[0] in "PZ"))
    quotes = []
    for i in range(200):
        t = rng.choice(texts)[1] or "zz"
        a = rng.randrange(max(1, len(t)))
        quotes.append((i, t[a : a + rng.choice([1, 2, 3, 5, 8, 12, 24, 40])].upper() if i % 9 == 0 else t[a : a + rng.choice([1, 2, 3, 5, 8, 12, 24, 40])]))
    got = {(r.quote_id, r.ref) for r in anchors.quote_search(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(texts, "ref string, content string")).collect()}
    assert got == {(i, ref) for i, q in quotes for ref, t in texts if plain(q) and plain(q) in plain(t)}
    assert anchors.quote_search(spark.createDataFrame([(1, " *")], "quote_id long, quote string"), spark.createDataFrame(texts, "ref string, content string")).count() == 0


def test_nearest_quote_equals_all_windows(spark):
    rng = random.Random(7)
    texts = {f"m{i}": " ".join(rng.choice(["stone", "river", "walked", "old", "light", "house"]) for _ in range(15)) for i in range(12)}
    quotes = []
    for i, (ref, t) in enumerate(texts.items()):
        a = rng.randrange(len(t) - 30)
        quotes.append((i, ref, "".join(c for k, c in enumerate(t[a : a + 28]) if k != i % 28)))
    quotes.append((99, "m0", "short"))
    got = {r.quote_id: r.part for r in anchors.nearest_quote(spark.createDataFrame(quotes, "quote_id long, ref string, quote string"), spark.createDataFrame(list(texts.items()), "ref string, content string")).collect()}
    want = {}
    for i, ref, q in quotes:
        t, found = texts[ref], []
        for d in range(-2, 3):
            for at in range(max(1, len(t) - len(q) - d + 1)):
                part = t[at : at + len(q) + d]
                if part and len(q) >= 8:
                    found.append((SequenceMatcher(None, q, part, autojunk=False).ratio(), at, part))
        top = [x for x in found if x[0] == max(found)[0] >= 0.88] if found else []
        if top and max(x[1] for x in top) - min(x[1] for x in top) <= 2:
            want[i] = min((x[1], x[2]) for x in top)[1]
    assert got == want and len(want) > 5


_ANCHOR = "array<struct<ref:string,quote:string>>"


def _anchor_codes(spark, segs, bounds=(), disposition="absent"):
    plans = spark.createDataFrame([("c", 0, disposition)], "chat_id string, batch_ix int, disposition string")
    seg = spark.createDataFrame([("c", 0, i, *x) for i, x in enumerate(segs)], f"chat_id string, batch_ix int, seg_ix int, slot string, refs array<string>, starts {_ANCHOR}, ends {_ANCHOR}")
    given = spark.createDataFrame([("c", 0, i, *x) for i, x in enumerate(bounds)], f"chat_id string, batch_ix int, ix int, slot string, anchors {_ANCHOR}")
    texts = spark.createDataFrame([("c", 0, "a", "One, two. Three!"), ("c", 0, "b", "four five"), ("c", 0, "z", "six")], "chat_id string, batch_ix int, ref string, content string")
    return sorted((r.ix, r.code) for r in segments.anchor_violations(plans, seg, given, texts).collect())


def test_boundary_anchor_rules_one_by_one(spark):
    good = [("new_1", ["a"], [("a", "One two")], []), ("new_2", ["b"], [("b", "four")], [("b", "five")])]
    edge = [("new_2", [("b", "four")])]
    assert _anchor_codes(spark, good, edge) == []
    second = lambda starts, refs=("b",), ends=(): [good[0], ("new_2", list(refs), starts, list(ends))]
    cases = {
        "NO_START_ANCHOR": (second([]), [("new_2", [])]), "START_ANCHOR_OUTSIDE_SEGMENT": (second([("b", "four"), ("a", "three")]), [("new_2", [("b", "four"), ("a", "three")])]),
        "START_ANCHOR_NOT_FOUND": (second([("b", "nine")]), None), "DUPLICATE_START_ANCHOR": (second([("b", "four"), ("b", "five")]), [("new_2", [("b", "four"), ("b", "five")])]),
        "FIRST_ANCHOR_NOT_FIRST_SOURCE": (second([("z", "six")], ("b", "z")), [("new_2", [("z", "six")])]), "END_ANCHOR_NOT_FOUND": (second([("b", "four")], ends=[("b", "nine")]), edge),
        "SHARED_MESSAGE_WITHOUT_START": ([good[0], ("new_2", ["b", "a"], [("b", "four")], [])], edge), "BOUNDARY_ANCHOR_OUTSIDE_BATCH": (good, [("new_2", [("q", "four")])]),
        "BOUNDARY_ANCHOR_NOT_FOUND": (good, [("new_2", [("b", "nine")])]), "BOUNDARY_MISMATCH": (good, [("new_2", [("b", "five")])]),
    }
    for code, (segs, bounds) in cases.items():
        assert code in {c for _, c in _anchor_codes(spark, segs, edge if bounds is None else bounds)}, code


def test_one_of_several_writers_commits(spark, tmp_path):
    rows, won = spark.createDataFrame([(1,), (2,)], "x long"), []
    writers = [threading.Thread(target=lambda: won.append(chats.write_commit({"state": rows, "receipts": rows}, str(tmp_path), "k"))) for _ in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(won) == [False, False, False, True]
    assert sorted(r.x for r in chats.read_committed(spark, str(tmp_path), "state").collect()) == [1, 2]


def test_versions_change_with_every_edit(spark):
    base = (1, "user", "text", "s1", "Ann", 0)
    edits = [base, (1, "user", "text!", "s1", "Ann", 0), (1, "assistant", "text", "s1", "Ann", 0), (1, "user", "text", "s2", "Ann", 0), (1, "user", "text", "s1", "Bea", 0), (1, "user", "text", "s1", "Ann", 1), (1, "user", "text", "s1", "Ann", None)]
    rows = spark.createDataFrame(edits, "floor long, role string, content string, source_id string, speaker string, swipe_id long")
    assert len({r.version for r in chats.stamp_versions(rows).collect()}) == len(edits)
    unnamed = chats.stamp_versions(rows.limit(1).withColumn("speaker", chats.F.lit(""))).first().version
    assert unnamed == chats.stamp_versions(rows.limit(1).withColumn("speaker", chats.F.lit("user"))).first().version


def test_audit_log_of_one_chat(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i % 5}", "k", "a", str(i)) for i in range(20)], "chat_id string, category string, action string, detail string")
    chats.append_audit(spark, str(tmp_path / "log"), rows)
    chats.append_audit(spark, str(tmp_path / "log"), rows.limit(0))
    assert chats.read_audit(spark, str(tmp_path / "log"), "c3").count() == 4 and chats.read_audit(spark, str(tmp_path / "log")).count() == 20


def test_cycles_of_long_chains(spark):
    up = {i: i + 1 for i in range(300)} | {300: 290} | {1000 + i: 1000 + (i + 1) % 37 for i in range(37)}
    got = {r.node: (r.on_cycle, r.cycle) for r in audit.reaches_cycle(spark.createDataFrame(list(up.items()), "node long, parent long")).collect()}
    assert got == {i: (i >= 290, 290) for i in range(301)} | {1000 + i: (True, 1000) for i in range(37)}
    assert audit.reaches_cycle(spark.createDataFrame([(1, 2), (2, 3)], "node long, parent long")).count() == 0


def test_history_is_compared_in_order(spark):
    kind = "entity_id string, component string, ids array<string>"
    stored = spark.createDataFrame([("a", "history_index", ["2", "1"]), ("a", "memory_index", ["2", "1"])], kind)
    built = spark.createDataFrame([("a", "history_index", ["1", "2"]), ("a", "memory_index", ["1", "2"]), ("b", "memory_index", ["1"])], kind)
    assert {(r.entity_id, r.component, r.code) for r in audit.stale_indexes(stored, built).collect()} == {("a", "history_index", "STALE_DERIVED_INDEX"), ("b", "memory_index", "MISSING_DERIVED_INDEX")}


def test_neighbours_without_edges(spark):
    edges = spark.createDataFrame([], "src_id string, component string, tgt_id string, tgt_type string")
    assert store.neighbours(edges, spark.createDataFrame([("a", "A")], "id string, name string"), "a").count() == 0


def test_inputs_in_upper_case_keep_their_length(spark, tmp_path):
    said = "abEin langer Satz mit"
    for text in (said + " ß", said + "ßß und mehr", "abßŉᾀ" + said):
        spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(r.quote for r in rule_queries._in(spark, str(tmp_path), "quotes").collect())
    assert got == sorted(["EIN LANGER SATZ MIT ẞ", "EIN LANGER SATZ MITẞẞ UND MEHR", "ẞŉᾈABEIN LANGER SATZ MIT"])
