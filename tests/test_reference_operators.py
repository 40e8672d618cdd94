"""Folds, graph rules, scanners and streams against plain Python, injected defects and properties."""

from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

import duckdb
import pytest

from storynet.operators import anchors, audit, network, recall, repair, resolve, rounds, segments, store
from storynet.plans import catalog
from storynet.sources import chats

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ("net_history_index", "net_refs", "audit_type_mismatch", "audit_org_cycle", "msg_rounds", "msg_batches", "covered_through", "resolve_roster", "segments", "stream_event_state", "upsert_entities", "stale_sources", "linked_events", "event_members", "msg_versions", "narrative_text", "audit_stale_index", "stage_context", "stream_sources", "event_plan", "plan_dispositions", "plan_contents")


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    got = df.select(*want.columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_batches_are_greedy_and_never_split_a_round(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", i, rng.choice([10, 90, 300, 700, 1500])) for c in range(30) for i in range(rng.randint(1, 20))]
    got = {(r.chat_id, r.round_ix): (r.batch_ix, r.oversize) for r in rounds.budget_batches(spark.createDataFrame(rows, "chat_id string, round_ix long, size long"), 3, 1000).collect()}
    want, state = {}, {}
    for c, i, size in rows:
        ix, n, chars = state.get(c, (0, 0, 0))
        if n and (n >= 3 or chars + size > 1000):
            ix, n, chars = ix + 1, 0, 0
        state[c] = ix, n + 1, chars + size
        want[c, i] = ix, size > 1000
    assert got == want


def test_cycles_equal_a_walk(spark):
    rng = random.Random(2)
    up = {i: rng.randrange(60) for i in range(50)}
    got = {r.node: (r.on_cycle, r.cycle) for r in audit.reaches_cycle(spark.createDataFrame(list(up.items()), "node long, parent long")).collect()}
    want = {}
    for i in up:
        seen, at = [], i
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        if at in seen:
            ring = seen[seen.index(at) :]
            want[i] = (i in ring, min(ring))
    assert got == want


REPLIES = {
    '{"a": "}"} tail': "ok", 'x {"a": [1, 2,],}': "ok_after_trailing_comma", " [1]": "array_reply", "none": "no_object", '{"a": 1': "truncated",
    '{"a":1}{"b":2}': "multiple_objects", "{a}": "not_object", '{"a": "\\"}"}': "ok", '{"a": "x,}"}': "ok",
}


def test_reply_triage(spark):
    rows = chats.triage_replies(spark.createDataFrame([(k, r) for k, r in enumerate(REPLIES)], "plan_no long, reply string")).collect()
    assert {r.reply: r.status for r in rows} == REPLIES
    assert all((r.plan is not None) == r.status.startswith("ok") for r in rows)


def test_locate_in_order_moves_forward_only(spark):
    rows = [("b", 0, 5), ("b", 0, 9), ("b", 1, 5), ("b", 2, 4), ("b", 2, 12), ("b", 3, 11)]
    got = anchors.locate_in_order(spark.createDataFrame(rows, "batch string, ord long, pos long")).collect()
    assert sorted((r.ord, r.pos) for r in got) == [(0, 5), (1, None), (2, 12), (3, None)]


def test_quote_spans_overlap_and_skip_marks():
    assert anchors.spans_of("aa", "a*a a") == [(0, 3), (2, 5)]
    assert anchors.spans_of("…", "a") == []


def test_extract_refs_follows_nested_paths(spark):
    data = {"aspects": [{"participant_roles": [{"character_ref": {"id": "c1", "type": "character"}}], "disclosure": {"concealed_from_refs": [{"id": "c2", "type": "character"}]}}, {}]}
    rows = spark.createDataFrame([("r", "character_relation", "character_relation_aspects", json.dumps(data)), ("r", "x", "unknown", "{}")], "entity_id string, entity_type string, component string, data string")
    got = {(r.path, r.tgt_id) for r in network.extract_refs(rows).collect()}
    assert got == {("/data/aspects/0/participant_roles/0/character_ref", "c1"), ("/data/aspects/0/disclosure/concealed_from_refs/0", "c2")}


def test_minted_ids_have_the_shape_and_stay(spark):
    keys = spark.createDataFrame([("1", "item", "a"), ("1", "item", "b"), ("2", "item", "a")], "chat_id string, type string, key string")
    known = spark.createDataFrame([("1", "item", "a", "old")], "chat_id string, type string, key string, id string")
    rows = {(r.chat_id, r.key): r.id for r in network.mint_ids(keys, known).collect()}
    assert rows["1", "a"] == "old" and len(set(rows.values())) == 3
    again = network.mint_ids(keys, known)
    shape = audit.shell(again.filter("id <> 'old'").selectExpr("id", "type", "'d' as description"))
    assert shape.count() == 0


def test_overlay_of_nothing_new_is_identity(spark):
    rows = spark.createDataFrame([("e", "/a", "1"), ("e", "/b", "2")], "entity_id string, path string, value string")
    assert {tuple(r) for r in network.overlay(rows, rows, rows).collect()} == {tuple(r) for r in rows.collect()}


def test_field_updates_archive_and_patch(spark):
    rows = [("e", "f", 0, "supplement", '{"a": 1, "l": [1]}'), ("e", "f", 1, "revise", '{"l": [2], "b": 3}'), ("e", "f", 2, "supplement", '{"a": 9}'), ("e", "g", 0, "revise", '"x"')]
    got = {r.field: (json.loads(r.value), r.n_revisions) for r in resolve.field_updates(spark.createDataFrame(rows, "entity_id string, field string, ord long, relationship string, value string")).collect()}
    assert got == {"f": ({"a": [1, 9], "l": [2], "b": 3}, 1), "g": ("x", 0)}


def test_repair_keys(spark):
    at = "component string, path string, "
    keys = spark.createDataFrame([("c", "/", k) for k in ("displayName", "colour", "weigth", "wight", "size", "zzz", "nick")], at + "key string")
    rules = spark.createDataFrame([("c", "/", f) for f in ("display_name", "color", "weight", "width", "size")], at + "field string")
    aliases = spark.createDataFrame([("c", "/", 1, "nick", "display_name")], at + "ord int, alias string, field string")
    got = {r.key: (r.correction, r.code) for r in repair.repair_keys(keys, rules, aliases, 0.8, 0.05).collect()}
    assert got["displayName"] == ("display_name", "CORRECTED") and got["colour"] == ("color", "CORRECTED") and got["nick"] == ("display_name", "CORRECTED")
    assert got["zzz"] == (None, "UNKNOWN_FIELD") and "size" not in got and got["wight"][1] in ("AMBIGUOUS_FIELD", "CORRECTED")


def test_commits_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "x long")
    assert chats.write_commit({"facts": rows}, str(tmp_path), "b1") and not chats.write_commit({"facts": rows}, str(tmp_path), "b1")
    rows.write.parquet(f"{tmp_path}/facts/commit_id=lost")  # written but never committed
    assert sorted(r.x for r in chats.read_committed(spark, str(tmp_path), "facts").collect()) == [1, 2]


def test_read_chats(spark, tmp_path):
    lines = [json.dumps({"user_name": "U"}), json.dumps({"mes": "hi\0", "is_user": True, "name": "U"}), "", json.dumps({"mes": "yo", "name": "A", "extra": {"source_floor": 9, "source_id": "s"}})]
    (tmp_path / "one.jsonl").write_text("\n".join(lines))
    rows = sorted((r.chat_id, r.floor, r.role, r.content, r.source_id) for r in chats.read_chat_messages(spark, str(tmp_path)).collect())
    assert rows == [("one", 1, "user", "hi", "floor-1"), ("one", 9, "assistant", "yo", "s")]
    (tmp_path / "bad.jsonl").write_text("{oops")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        chats.read_chat_messages(spark, str(tmp_path)).collect()


def test_relation_rules_find_each_injected_defect(spark):
    ends = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("q", 0, "b"), ("q", 1, "a")], "relation string, ord long, character string")
    roles = spark.createDataFrame([("r", 1, "a", "z", None), ("r", 1, "b", "z", None), ("r", 2, "a", None, "y")], "relation string, aspect long, character string, owner string, concealed string")
    states = spark.createDataFrame([("r", 0, "a", "b"), ("r", 1, "a", "b"), ("r", 2, "a", "c")], "relation string, ord long, src string, dst string")
    memories = spark.createDataFrame([("r", 0, "m", 1), ("r", 1, "m", 1), ("r", 2, "m", 7)], "relation string, ord long, memory string, aspect long")
    codes = sorted(r.code for r in audit.relations(ends, roles, states, memories).collect())
    assert codes == sorted(["NON_CANONICAL_RELATION_ENDPOINT_ORDER", "RELATION_PERSPECTIVE_OWNER_MISMATCH", "RELATION_ASPECT_PARTICIPANT_MISMATCH", "RELATION_DISCLOSURE_TARGET_MISMATCH",
                            "DUPLICATE_RELATION_DIRECTION", "RELATION_STATE_ENDPOINT_MISMATCH", "DUPLICATE_RELATION_MEMORY", "UNKNOWN_RELATION_ASPECT_REFERENCE", "RELATION_ASPECT_WITHOUT_MEMORY_BASIS"])


def test_event_updates_and_summaries(spark):
    detail = "array<struct<id:string,content:string,ref:string>>"
    lists = lambda *names: ", ".join(f"{n} array<string>" for n in names)
    events = spark.createDataFrame([("e", "old", "sum", ["a", "b"], ["l"], ["q"], [("1", "x", "m1"), ("2", "y", "m1")])], f"event_id string, description string, summary string, {lists('participants', 'locations', 'unresolved')}, details {detail}")
    adds = [f"{c}_{x}" for c in ("participants", "locations", "unresolved") for x in ("add", "remove")]
    ups = spark.createDataFrame([("e", " ", "new", ["c"], ["a"], ["n"], None, None, ["q"], ["2"], [("3", "y", "m1"), ("4", "z", "m2")])], f"event_id string, description string, summary string, {lists(*adds, 'kept')}, new_details {detail}")
    r = segments.apply_event_updates(events, ups).first()
    assert (r.description, r.summary, r.participants, r.locations, r.unresolved, [d.id for d in r.details]) == ("old", "new", ["b", "c"], ["l", "n"], [], ["2", "4"])


def test_neighbour_pages_cover_all(spark):
    edges = spark.createDataFrame([("a", "c", f"n{i:03d}", "item") for i in range(250)] + [("z", "c", "a", "item")], "src_id string, component string, tgt_id string, tgt_type string")
    ents = spark.createDataFrame([("a", "A"), ("z", "Z")], "id string, name string")
    pages = [store.neighbours(edges, ents, "a", k, 200).collect() for k in (0, 200)]
    assert [len(p) for p in pages] == [200, 51] and pages[0][0].total == 251 and not pages[0][0].resolved and pages[1][-1].resolved


def test_stage_queries_read_every_order(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    orders = {r[0] for r in con.sql("select distinct l_orderkey from lineitem").fetchall()}
    again = {(k, b): n - 1 for k, b, n in con.sql("select l_orderkey, 'x' || cast(l_partkey % 5 as varchar), count(*) from lineitem group by all having count(*) > 1").fetchall()}
    got = {}
    for r in catalog.QUERIES["stage_audit"](spark, sf).filter("code = 'DUPLICATE_STAGE_CONTEXT_ID'").collect():
        got[r.framework, r.at] = got.get((r.framework, r.at), 0) + 1
    assert got == again
    assert sorted(r.id for r in catalog.QUERIES["stage_context"](spark, sf).select("id").collect()) == sorted(orders)


def test_stage_ranges_are_not_broadcast(spark):
    ranges = spark.createDataFrame([("f", "s", "b", 0.0, 1.0)], "framework string, stage string, binding string, low double, high double")
    asked = spark.createDataFrame([("h", "f", "numeric_derived", "numeric_derived", "b", 0.5, "s", "current_stage", "use")], "id string, framework string, host_mode string, mode string, binding string, value double, stage string, recall_mode string, purpose string")
    blocks = spark.createDataFrame([("f", "s", "use", "text")], "framework string, stage string, purpose string, content string")
    issues = spark.createDataFrame([], "framework string, code string, at string")
    hosts = recall.host_stage_issues(asked, ranges.select("framework", "stage"), ranges)
    told = recall.stage_context(asked, ranges.select("framework", "stage"), blocks, ranges, issues)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (hosts, told)]
        assert not any("Broadcast" in p for p in plans)
        assert hosts.count() == 0 and json.loads(told.first().stages) == [{"stage": "s", "blocks": ["text"]}]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _most_similar(rows, texts, least=0.62, shortest=6):
    want = {}
    for b, i, q in rows:
        found = [(SequenceMatcher(None, q, t, autojunk=False).ratio(), u) for c, u, t in texts if c == b] if len(q or "") >= shortest else []
        if found and max(found)[0] >= least:
            want[b, i] = max(found)[1], round(max(found)[0], 6)
    return want


def test_fuzzy_locate_equals_all_pairs(spark):
    rng = random.Random(4)
    words = "the a river stone walked under old light house and of morning".split()
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts = [("hot", u, say(rng.randint(1, 14))) for u in range(150)] + [(f"b{k}", u, say(rng.randint(1, 60))) for k in range(6) for u in range(5)]
    texts += [("hot", 900 + u, texts[u][2]) for u in range(20)]
    rows = [(b, u, "".join(c for c in t[2:62] if rng.random() > 0.1)) for b, u, t in texts]
    got = anchors.fuzzy_locate(spark.createDataFrame(rows, "batch string, quote_id long, quote string"), spark.createDataFrame(texts, "batch string, unit long, text string"))
    assert {(r.batch, r.quote_id): (r.unit, r.ratio) for r in got.collect()} == _most_similar(rows, texts)


def test_fuzzy_units_searches_every_message(spark, sf):
    texts = duckdb.sql(f"select cast(conv_id as varchar), turn, coalesce(text, '') from '{sf}/conversations.parquet'").fetchall()
    got = {(r.batch, r.quote_id): (r.unit, r.ratio) for r in catalog.QUERIES["fuzzy_units"](spark, sf).collect()}
    assert got == _most_similar([(b, u, t[2:62]) for b, u, t in texts], texts)


def test_repair_keys_bounds_the_signature(spark):
    at = "component string, path string, "
    keys = spark.createDataFrame([("c", "/", "aBcDe")], at + "key string")
    rules = spark.createDataFrame([("c", "/", "a_bc_de_x")], at + "field string")
    aliases = spark.createDataFrame([], at + "ord int, alias string, field string")
    r = repair.repair_keys(keys, rules, aliases, 0.8, 0.05).first()
    assert (r.correction, r.code) == ("a_bc_de_x", "CORRECTED")
