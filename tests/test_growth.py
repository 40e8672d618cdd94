"""What the steps of the larger queries cost: inputs built once, rows that cannot count left out early."""

import json
import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from storynet.operators import anchors, audit, network, projection, recall, store
from storynet.plans import catalog, store_queries
from storynet.sources import tables


def _built(monkeypatch):
    """The inputs that are written, as they are written."""
    made, plain = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda df: made.append(df.columns) or plain(df))
    return made


def test_hopeless_texts_are_not_scanned(monkeypatch):
    def scanned(_):
        raise AssertionError("windows are compared")

    monkeypatch.setattr(anchors, "Counter", scanned)
    assert anchors.nearest_part("none of that", "the line-number 123 of part 45", 0.88) is None


def test_details_build_their_lines_once(spark, sf, monkeypatch):
    made = _built(monkeypatch)
    assert catalog.QUERIES["canonical_details"](spark, sf).count() > 0
    assert len(made) == 1


def test_memories_are_audited_over_their_own_references(spark, sf, monkeypatch):
    made = _built(monkeypatch)
    found = catalog.QUERIES["audit_memory_incomplete"](spark, sf)
    assert len(made) == 2  # lines and memories
    assert "event_related_entity_reference" not in found._jdf.queryExecution().optimizedPlan().toString()
    refs = spark.createDataFrame([("a", "memory_owner_reference"), ("b", "source_event_reference"), ("c", "memory_owner_reference"), ("c", "source_event_reference"), ("c", "other")], "src_id string, component string")
    entities = spark.createDataFrame([(i, "memory") for i in "abcd"] + [("e", "item")], "id string, type string")
    got = sorted((r.entity_id, r.component) for r in audit.incomplete_memories(entities, refs).collect())
    assert got == [("a", "source_event_reference"), ("b", "memory_owner_reference"), ("d", "memory_owner_reference"), ("d", "source_event_reference")]


def test_changes_are_judged_without_meeting(spark):
    rules = spark.createDataFrame([("a", None, "set", ["x"]), ("a", "/p/*", "set", ["y"]), ("a", "/p/q", "set", ["x"])], "component string, pattern string, operation string, roles array<string>")
    rows = [("1", "a", "/p/q", "set", "x"), ("2", "a", "/p/r", "set", "x"), ("3", "a", "/z", "set", "y"), ("4", "a", "/z", "cut", "x"), ("5", "a", "/p/q", "set", "y"), ("5", "a", "/p/r", "set", "y")]
    found = audit.permissions(spark.createDataFrame(rows, "change_id string, component string, path string, operation string, role string"), rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert sorted((r.entity_id, r.path, r.code) for r in found.collect()) == [("2", "/p/r", "PERMISSION_DENIED"), ("3", "/z", "PERMISSION_DENIED"), ("4", "/z", "INVALID_PERMISSION_OPERATION"), ("5", "/p/q", "PERMISSION_DENIED")]


def test_missing_targets_are_sought_once(spark):
    refs = spark.createDataFrame([("a", "c", 0, "b"), ("a", "c", 1, "z")], "src_id string, component string, ord long, tgt_id string")
    parts = refs.unionByName(refs.withColumn("component", F.concat("component", "src_id"))).unionByName(refs)
    found = audit.missing_targets(parts, spark.createDataFrame([("a",), ("b",), ("b",)], "id string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted((r.component, r.path) for r in found.collect()) == [("c", "/1"), ("c", "/1"), ("ca", "/1")]


def test_edges_are_read_once_for_both_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "c"), ("a", "c")], "src_id string, tgt_id string").distinct()
    found = store.neighbour_counts(edges)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.collect()) == [("a", 3, 0), ("b", 1, 1), ("c", 0, 2)]


def test_quotes_meet_only_texts_with_a_piece_of_theirs(spark):
    quotes = [(1, "the quick brown fox jumps"), (2, "über alles 𝒳𝒴"), (3, "zz")]
    texts = [("a", "so The slow, brown fox jumps here"), ("b", "nothing of it"), ("c", "gar über\nalles 𝒳𝒴!"), ("d", None), ("e", "pizza: zz")]
    found = anchors.quote_search(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(texts, "ref string, content string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and plan.count("Generate explode") <= 1 + 3  # texts are cut once, quotes once for each level
    assert sorted(found.collect()) == [(2, "c"), (3, "e")]


def test_no_piece_is_empty(spark, monkeypatch):
    seen = []
    explode = F.explode
    monkeypatch.setattr(anchors.F, "explode", lambda c: seen.append(c) or explode(c))
    quotes, texts = spark.createDataFrame([(1, "the quick brown fox jumps")], "quote_id long, quote string"), spark.createDataFrame([("a", "the quick brown fox jumps")], "ref string, content string")
    assert anchors.quote_search(quotes, texts).collect() == [(1, "a")]
    cut = spark.createDataFrame([("thequickbrownfoxjumps",)], "q string").select(explode(seen[0]).alias("g"))
    assert {len(r.g) for r in cut.collect()} == {6}


def test_guidance_builds_its_lines_once(spark, sf, monkeypatch):
    made = _built(monkeypatch)
    assert catalog.QUERIES["stage_guidance"](spark, sf).count() >= 0
    assert len(made) == 1


def test_references_are_collected_once_and_paths_made_if_asked_for(spark):
    edges = [("e", "event", "event_related_entity_reference", 1, "b", "item"), ("e", "event", "event_related_entity_reference", 0, "z", "item"), ("m", "memory", "memory_owner_reference", 0, "c", "character")]
    made = network.as_components(spark.createDataFrame(edges, "src_id string, src_type string, component string, ord long, tgt_id string, tgt_type string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_collect_list") < plan.index("Exchange")  # the shuffle is below both steps
    found = network.extract_refs(made)
    assert "/data" not in found.drop("path", "derived")._jdf.queryExecution().optimizedPlan().toString()
    want = [("e", "/data/related_entity_refs/0", 0, "z", False), ("e", "/data/related_entity_refs/1", 1, "b", False), ("m", "/data/owner_ref", 0, "c", False)]
    assert sorted(tuple(r) for r in found.select("src_id", "path", "ord", "tgt_id", "derived").collect()) == want


def test_references_of_every_depth_keep_their_places(spark):
    data = {"aspects": [None, {"participant_roles": [{}, {"character_ref": {"id": "c1", "type": "character"}}], "perspective": {"owner_ref": {"id": "c3"}}}, {"disclosure": {"concealed_from_refs": [{"type": "character"}, {"id": "c2"}]}}]}
    rows = [("r", "character_relation", "character_relation_aspects", json.dumps(data)), ("r", "x", "memory_index", '{"memory_refs":[null,{"id":"m"}]}'), ("r", "x", "memory_index", "{"), ("r", "x", "memory_index", None)]
    got = sorted((r.path, r.ord, r.tgt_id, r.derived) for r in network.extract_refs(spark.createDataFrame(rows, "entity_id string, entity_type string, component string, data string")).collect())
    aspects = "/data/aspects"
    assert got == [(f"{aspects}/1/participant_roles/1/character_ref", 1, "c1", False), (f"{aspects}/1/perspective/owner_ref", 1, "c3", False), (f"{aspects}/2/disclosure/concealed_from_refs/1", 1, "c2", False), ("/data/memory_refs/1", 1, "m", True)]
    flat = network.extract_refs(spark.createDataFrame([("a", "b", "c", '{"x":{"id":"i"}}')], "entity_id string, entity_type string, component string, data string"), rules=(("c", "x", "any", True),))
    assert flat.first()[:6] == ("a", "b", "c", "/data/x", 0, "i")


def test_leaves_are_walked_by_what_holds_them(monkeypatch):
    calls, plain = [], projection._leaves
    monkeypatch.setattr(projection, "_leaves", lambda *a: calls.append(1) or plain(*a))
    texts = ['{"a":[1,"x",true],"b~/":{"c":null,"d":{}},"e":[]}', "{", None, "[]", '"s"', "1.5", "null"]
    batch = pa.RecordBatch.from_pydict({"entity_id": [f"e{i}" for i in range(len(texts))], "component": ["k"] * len(texts), "data": texts})

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, scan, _):
            return scan(iter([batch, batch.slice(0, 0)]))

    out, empty = projection.flatten_json(Rows())
    assert len(calls) == 3 and empty.num_rows == 0
    want = [("/a/0", "integer", "1"), ("/a/1", "string", "x"), ("/a/2", "boolean", "true"), ("/b~0~1/c", "null", "null"), ("/b~0~1/d", "object", "{}"), ("/e", "array", "[]")]
    rest = [("", "invalid", "null"), ("", "invalid", "null"), ("", "array", "[]"), ("", "string", "s"), ("", "number", "1.5"), ("", "null", "null")]
    assert [tuple(r.values()) for r in out.to_pylist()] == [("e0", "k", *r) for r in want] + [(f"e{i}", "k", *r) for i, r in enumerate(rest, 1)]


def test_stages_of_a_context_are_shuffled_with_all_else(spark):
    stages = spark.createDataFrame([("f", "s"), ("f", "s"), ("f", "t"), ("f", None)], "framework string, stage string")
    asked = spark.createDataFrame([("q", "f", "semantic", "framework_overview", "use", "b", 0.5, None)], "id string, framework string, mode string, recall_mode string, purpose string, binding string, value double, stage string")
    blocks = spark.createDataFrame([("f", "s", "use", "text")], "framework string, stage string, purpose string, content string")
    ranges = spark.createDataFrame([], "framework string, stage string, binding string, low double, high double")
    told = recall.stage_context(asked, stages, blocks, ranges, spark.createDataFrame([], "framework string, code string, at string"))
    assert "hashpartitioning(framework#" in (plan := told._jdf.queryExecution().executedPlan().toString())
    assert not [line for line in plan.splitlines() if "hashpartitioning(framework#" in line and ", stage#" in line]
    assert json.loads(told.first().stages) == [{"blocks": []}, {"stage": "s", "blocks": ["text"]}, {"stage": "t", "blocks": []}]


def test_indexes_are_compared_by_digests(spark, sf, monkeypatch):
    made, plain = [], store_queries.saved
    monkeypatch.setattr(store_queries, "saved", lambda df: made.append(df) or plain(df))
    assert catalog.QUERIES["audit_stale_index"](spark, sf).count() > 0
    assert [df.columns for df in made] == [["entity_id", "component", "rebuilt", "stored", "has"]]
    kind = "entity_id string, component string, ids array<string>"
    stored = spark.createDataFrame([("a", "history_index", ["2", "1"]), ("a", "memory_index", ["2", "1"]), ("b", "memory_index", []), ("c", "memory_index", ["1"]), ("d", "memory_index", None)], kind)
    built = spark.createDataFrame([("a", "history_index", ["1", "2"]), ("a", "memory_index", ["1", "2"]), ("b", "memory_index", ["1"]), ("d", "memory_index", ["1"]), ("e", "memory_index", ["1"])], kind)
    found = audit.stale_indexes(stored, built)
    assert found._jdf.queryExecution().executedPlan().toString().count("md5") == 2
    stale, missing = "STALE_DERIVED_INDEX", "MISSING_DERIVED_INDEX"
    assert sorted((r.entity_id, r.component, r.code) for r in found.collect()) == [("a", "history_index", stale), ("b", "memory_index", stale), ("c", "memory_index", stale), ("d", "memory_index", missing), ("e", "memory_index", missing)]


def test_memories_of_a_relation_are_collected_once(spark):
    rows = [("m2", 1, "x", "r"), ("m1", 10, "y", "r"), ("m1", 2, "x", "r"), ("m1", 2, "y", "r"), ("m3", None, None, "r"), ("m3", None, "x", "r"), ("m1", 5, "x", "s"), ("m1", 5, "x", "gone")]
    refs = spark.createDataFrame(rows, "src_id string, num long, role string, tgt_id string").withColumn("component", F.lit("relation_context_reference"))
    found = network.relation_memory_index(refs, spark.createDataFrame([("r", "character_relation"), ("s", "character_relation"), ("gone", "item")], "id string, type string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("partial_collect_set") == 1
    assert {r.entity_id: r.ids for r in found.collect()} == {"r": ["m1:10+2:x+y", "m2:1:x", "m3::x"], "s": ["m1:5:x"]}


def test_ids_of_an_entity_are_not_collected_for_the_audit(spark, sf, monkeypatch):
    made, plain = [], store_queries.saved
    monkeypatch.setattr(store_queries, "saved", lambda df: made.append(df) or plain(df))
    catalog.QUERIES["audit_stale_index"](spark, sf)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"collect_(?:set|list)\((\w+)", plan)) == {"num", "role"}  # of one memory


def test_entries_of_indexes_equal_their_lists(spark):
    rng = random.Random(4)
    ids, types = ["a", "a!", "b", "b:", "c", None], ["character", "item", "location", "organization", "event", "character_relation"]
    components = sorted({c for c, _, _, derived in network.REF_RULES if not derived})
    roles = ["carried", "worn", "stored", "placed", None]
    one = lambda: (rng.choice(ids), rng.choice(components), rng.choice(roles), rng.choice([None, 1, 2, 10]), rng.choice([*types, None]), rng.choice(types))
    refs = spark.createDataFrame([one() for _ in range(4000)], "src_id string, component string, role string, num long, tgt_id string, tgt_type string")
    entities = spark.createDataFrame([(t, t) for t in types] + [("item", "item"), ("event", "item")], "id string, type string")
    listed = {(r.entity_id, r.component): r.ids for r in network.rebuild_indexes(refs, entities).collect()}
    entries = network.rebuild_indexes(refs, entities, lambda rows: rows.groupBy("entity_id", "component").agg(F.sort_array(F.collect_list(F.struct("place", "n", "id"))).alias("all"))).collect()
    assert len({c for _, c in listed}) == len(network.INDEXES)
    found = {(r.entity_id, r.component): [tuple(x) for x in r.all if x.id is not None] for r in entries}
    assert all(len({x.id for x in r.all}) == len(r.all) for r in entries)
    assert found == {k: [(i, len(v), x) for i, x in enumerate(v, 1)] for k, v in listed.items()}


def test_digests_of_entries_equal_those_of_lists(spark):
    rng = random.Random(5)
    lists = [[], ["a"], ["a", "a"], ["b"], ["a", "b"], ["b", "a"], ["a", "a", "a", "b"]] + [[rng.choice("abcd") for _ in range(rng.randrange(2, 5))] for _ in range(60)]
    rows = [(f"{k:03d}", c, at, x) for k, own in enumerate(lists) for c in ("history_index", "memory_index") for at, x in [*enumerate(own, 1), (None, "z"), (7, None)]]
    entries = spark.createDataFrame(rows, "entity_id string, component string, place long, id string").repartition(5)
    digest = {(r.entity_id, r.component): tuple(r.digest) for r in entries.groupBy("entity_id", "component").agg(audit.entries_digest().alias("digest")).collect()}
    for k, a in enumerate(lists):
        for m, b in enumerate(lists):
            if len(set(b)) == len(b):  # a rebuilt list
                of = lambda c: digest[f"{k:03d}", c] == digest[f"{m:03d}", c]  # noqa: E731, B023
                assert of("history_index") == (a == b) and of("memory_index") == (sorted(a) == sorted(b))
    assert {digest["000", "history_index"]} == {(0, None, None)}
    both = spark.createDataFrame([("e", "history_index")], "entity_id string, component string").withColumn("digest", F.expr("named_struct('n', 0L, 'bits0', cast(null as long), 'bits1', cast(null as long))"))
    assert audit.stale_digests(both, both).count() == 0 and audit.stale_digests(both.limit(0), both).first().code == "MISSING_DERIVED_INDEX"


def test_shuffle_files_of_built_inputs_are_freed(spark, sf, monkeypatch):
    made, plain, freed = [], tables.saved, lambda: spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    monkeypatch.setattr(tables, "saved", lambda df: made.append(freed()) or plain(df))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in str(manager.getAllFiles().mkString("|")).split("|") if "/shuffle_" in x}
    before = files()
    refs, _ = tables.load_all(spark, sf, tables.REFS, tables.ENTITIES)
    until = time.monotonic() + 20
    while (left := files() - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left and made == ["true", "true"] and freed() == "false"  # left alone may be empty by chance
    assert refs.count() > 0
