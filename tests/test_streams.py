"""Streams over stores and state: new checkpoints, retries, and the event state against a plain loop."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from storynet.operators import event_state
from storynet.streaming import ledger, state
from storynet.streaming.events import run_to_table


def put(folder, name, rows, columns):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(columns, r, strict=True))) for r in rows))


def test_a_new_checkpoint_adds_only_what_is_new(spark, tmp_path):
    columns, store = ("chat_id", "ref", "sha"), str(tmp_path / "store")
    source, schema = tmp_path / "in", "chat_id string, ref string, sha string"

    def run(at):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        ledger.append_sources(stream, store, str(tmp_path / at)).start().awaitTermination()
        kept = sorted(tuple(r) for r in ledger.read_sources(spark, store).select(*columns).collect())
        return kept, sorted(tuple(r) for r in ledger.read_conflicts(spark, store).select("chat_id", "ref", "kept_sha", "new_sha").collect())

    put(source, "0", [("c", "m1", "A"), ("c", "m2", "B"), ("c", "m2", "A2")], columns)
    first = [("c", "m1", "A"), ("c", "m2", "A2")], [("c", "m2", "A2", "B")]
    assert run("one") == first and run("one") == first
    put(source, "1", [("c", "m1", "CHANGED"), ("c", "m3", "C"), ("d", "m1", "D")], columns)
    both = [("c", "m1", "A"), ("c", "m2", "A2"), ("c", "m3", "C"), ("d", "m1", "D")], [("c", "m1", "A", "CHANGED"), ("c", "m2", "A2", "B")]
    assert run("one") == both
    assert run("two") == both  # all of it again, from batch 0
    put(source, "2", [("d", "m9", "N"), ("d", "m1", "E")], columns)
    assert run("three") == (sorted([*both[0], ("d", "m9", "N")]), sorted([*both[1], ("d", "m1", "D", "E")]))


def test_rows_are_committed_once_by_key(spark, tmp_path):
    columns, store, source = ("k", "v"), str(tmp_path / "store"), tmp_path / "in"

    def run(at, per_batch):
        stream = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", per_batch).json(str(source))
        ledger.append_rows(stream, store, "facts", ["k"], str(tmp_path / at)).start().awaitTermination()
        return sorted(tuple(r) for r in ledger.read_rows(spark, store, "facts").select(*columns).collect())

    put(source, "0", [(1, "a"), (2, "b")], columns)
    put(source, "1", [(3, "c"), (1, "z")], columns)
    assert run("one", 1) in ([(1, "a"), (2, "b"), (3, "c")], [(1, "z"), (2, "b"), (3, "c")])  # files of one moment come in either order
    put(source, "2", [(4, "d")], columns)
    assert [k for k, _ in run("two", 10)] == [1, 2, 3, 4]  # other batches of the same input
    assert [k for k, _ in run("one", 1)] == [1, 2, 3, 4]


def test_what_a_crash_left_without_a_manifest_is_not_read(spark, tmp_path):
    store = str(tmp_path / "store")
    spark.createDataFrame([(1, "lost")], "k long, v string").withColumn("part", ledger.part_of("k")).write.partitionBy("part").parquet(f"{store}/facts/commit_id=dead")
    put(tmp_path / "in", "0", [(1, "kept")], ("k", "v"))
    ledger.append_rows(spark.readStream.schema("k long, v string").json(str(tmp_path / "in")), store, "facts", ["k"], str(tmp_path / "at")).start().awaitTermination()
    assert [tuple(r) for r in ledger.read_rows(spark, store, "facts").select("k", "v").collect()] == [(1, "kept")]


# --- the event state

PLAN = "chat_id string, batch_ix int, seg_ix int, slot string, disposition string, source_refs array<string>, start_anchors string, end_anchors string, description string, story_summary string"


def plans(seed, chats=25):
    rng, rows = random.Random(seed), []
    for chat in range(chats):
        opened = 0
        for batch in range(rng.randint(1, 9)):
            slots, disposition = [], "absent" if opened == 0 else "keep_distinct"
            new = rng.randint(0 if opened else 1, 3)
            if opened > 1 and new and rng.random() < 0.4:
                disposition, slots = "merge_into_pending", ["pending_tail"] if rng.random() < 0.8 else []
            elif opened and (not new or rng.random() < 0.6):
                slots = ["forming_existing"]
            opened += new
            slots += [f"new_{n + 1}" for n in range(new)]
            for seg, slot in enumerate(slots):
                text = lambda: rng.choice([None, " ", f"T{rng.randint(0, 30)}, x。", f" t{rng.randint(0, 3)}!"])
                rows.append((f"c{chat}", batch, seg, slot, disposition, [f"m{batch}.{rng.randint(0, 3)}" for _ in range(rng.randint(0, 3))], "s", None, text(), text()))
    return rows


def joined(left, right, separator):
    left, right = (left or "").strip(), (right or "").strip()
    if not left or not right:
        return left or right
    a, b = (re.sub(r"[\W_]+", "", x) for x in (left, right))
    if b and b in a:
        return left
    if a and a in b:
        return right
    return (left.rstrip() if separator == "\n" else left.rstrip("；。\n ")) + separator + right


def loop(rows):
    """Batch after batch, event by event."""
    out = {}
    for chat in sorted({r[0] for r in rows}):
        events, opened = [], 0
        own = [r for r in rows if r[0] == chat]
        for batch in sorted({r[1] for r in own}):
            segments = sorted((r for r in own if r[1] == batch), key=lambda r: r[2])
            if segments[0][4] == "merge_into_pending" and len(events) > 1 and any(r[3].startswith("new_") for r in segments):
                forming = events.pop()
                pending = events[-1]
                pending["d"], pending["s"] = joined(pending["d"], forming["d"], "；"), joined(pending["s"], forming["s"], "\n")
                pending["slices"] += forming["slices"]
            for _, _, seg, slot, _, refs, start, end, description, summary in segments:
                if slot.startswith("new_"):
                    opened += 1
                    events.append({"no": opened, "d": "", "s": "", "slices": []})
                event = events[-1]
                event["slices"].append((batch, seg, refs, start, end))
                event["d"], event["s"] = (description or "").strip() or event["d"], (summary or "").strip() or event["s"]
        for i, e in enumerate(reversed(events)):
            refs = list(dict.fromkeys(r for s in e["slices"] for r in s[2]))
            out[chat, e["no"]] = (["forming", "pending_finalization"][i] if i < 2 else "finalized", e["d"], e["s"], refs, e["slices"])
    return out


def rows_of(df):
    return {(r.chat_id, r.event_no): (r.status, r.description, r.story_summary, list(r.source_refs), [tuple(s) for s in r.source_slices]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_event_state_equals_a_plain_loop(spark, seed):
    rows = plans(seed)
    assert rows_of(event_state.event_state(spark.createDataFrame(rows, PLAN).repartition(5))) == loop(rows)


def test_event_state_of_nothing_and_of_old_slots_without_events(spark):
    assert event_state.event_state(spark.createDataFrame([], PLAN)).count() == 0
    rows = [("c", 0, 0, "forming_existing", "keep_distinct", ["m"], None, None, "x", "y"), ("c", 1, 0, "new_1", "absent", None, None, None, None, None)]
    assert rows_of(event_state.event_state(spark.createDataFrame(rows, PLAN))) == {("c", 1): ("forming", "", "", [], [(1, 0, None, None, None)])}


def test_event_state_as_a_stream(spark, tmp_path):
    rows, columns = plans(3, 12), [c.split()[0] for c in PLAN.split(", ")]
    for batch in range(0, 9, 2):  # two batches of a chat in a micro-batch, the second of them delivered twice
        some = [r for r in rows if batch - 1 <= r[1] < batch + 2]
        put(tmp_path / "in", f"{batch}", some, columns)
        import os

        os.utime(tmp_path / "in" / f"{batch}.json", (1_000_000 + batch, 1_000_000 + batch))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        stream = spark.readStream.schema(PLAN).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        got = rows_of(run_to_table(state.final_events(stream)))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = {k: v for k, v in loop(rows).items() if v[0] == "finalized"}
    assert {k: (*v[:4], [(*s[:2], s[2], s[3], s[4]) for s in v[4]]) for k, v in got.items()} == want


def test_join_texts_alike(spark):
    pairs = [("a b", "ab"), ("ab", "a-b c"), ("x。", "y"), ("x \n", " y"), ("", "y"), (None, None), ("!", "?"), ("漢字", "漢"), ("é", "É")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for separator in ("；", "\n"):
        got = [r[0] for r in df.select(event_state.join_texts(F.col("a"), F.col("b"), separator)).collect()]
        assert got == [joined(a, b, separator) for a, b in pairs] == [state.join_texts((a or "").strip(), (b or "").strip(), separator) for a, b in pairs]


class _Held:
    """A value or list of a state store."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def put(self, rows):
        self.held = rows

    update = put


def test_batches_of_a_chat_are_applied_without_a_frame_for_each(monkeypatch):
    import pandas as pd

    from storynet.streaming import state

    def framed(*_, **__):
        raise AssertionError("a frame for each batch")

    one = state.OpenEvents()
    one.seen, one.events, one.slices = _Held(), _Held(), _Held()
    rows = [{"chat_id": "c", "batch_ix": b, "seg_ix": 0, "slot": "new_1", "disposition": "keep_distinct", "source_refs": [f"m{b}"], "start_anchors": None, "end_anchors": None, "description": f" d{b} ", "story_summary": None} for b in (3, 1, 0, 2)]
    monkeypatch.setattr(pd.DataFrame, "groupby", framed)
    out = pd.concat(list(one.handleInputRows(("c",), iter([pd.DataFrame(rows[:2]), pd.DataFrame(rows[2:])]), None)))
    assert list(out["event_no"]) == [1, 2] and list(out["description"]) == ["d0", "d1"] and list(out["source_refs"]) == [["m0"], ["m1"]]
    assert list(one.handleInputRows(("c",), iter([pd.DataFrame(rows)]), None)) == [] and one.seen.get() == (4, 3)
