"""Who is named where, against a plain loop, also when a chat is cut into parts and blocks."""

from __future__ import annotations

import random

import pytest

from storynet.operators import mentions, resolve


@pytest.mark.parametrize(("chars", "needles"), [(4_000_000, 20_000), (200, 20_000), (4_000_000, 3), (100, 2)])
def test_found_in_equals_a_plain_loop(spark, monkeypatch, chars, needles):
    monkeypatch.setattr(mentions, "PART_CHARS", chars)
    monkeypatch.setattr(mentions, "BLOCK_NEEDLES", needles)
    rng = random.Random(2)
    words = ["ab", "a", "bab", "éa", "漢字", "字", "", None, "a b", "\\Q", "abab"]
    asked = [(f"c{rng.randint(0, 2)}", rng.choice(words)) for _ in range(40)] + [(None, "a")]
    texts = [(f"c{rng.choice([0, 0, 0, 1, 3])}", f"r{i}", rng.choice([None, "", "".join(rng.choice(["ab", "a", "é", "漢字", " ", "b", "\\Q"]) for _ in range(rng.randint(0, 30)))])) for i in range(60)]
    texts.append(texts[4])
    got = mentions.found_in(spark.createDataFrame(asked, "chat_id string, needle string"), spark.createDataFrame(texts, "chat_id string, ref string, text string")).collect()
    want = {(c, w, r) for c, w in asked for d, r, t in texts if c == d and w and t and w in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_found_in_nothing(spark):
    none, text = spark.createDataFrame([], "chat_id string, needle string"), spark.createDataFrame([("c", "r", "x")], "chat_id string, ref string, text string")
    assert mentions.found_in(none, text).count() == 0
    assert mentions.found_in(spark.createDataFrame([("c", "x")], "chat_id string, needle string"), text.limit(0)).count() == 0


def test_related_entities_equal_a_plain_ranking(spark):
    rng = random.Random(6)
    people = [(f"c{i % 2}", i, f"character:n{i}", [f"n{i} ", rng.choice([f"alias{i}", "", f"n{i} "])], rng.random() < 0.3) for i in range(30)]
    texts = [(f"c{b % 2}", b, " ".join(f"n{rng.randint(0, 40)} alias{rng.randint(0, 30)}" for _ in range(rng.randint(0, 4)))) for b in range(12)]
    tail = [("c0", "character:n4"), ("c1", "character:n9"), ("c0", "character:n4")]
    rows = spark.createDataFrame(people, "chat_id string, ord int, key string, names array<string>, stub boolean")
    said = spark.createDataFrame(texts, "chat_id string, batch_ix int, text string")
    got = sorted(tuple(r) for r in resolve.related_entities(rows, said, spark.createDataFrame(tail, "chat_id string, key string"), 5).collect())
    want = []
    for chat, batch, text in texts:
        ranked = sorted(((10 * sum(bool(n.strip()) and n.strip() in text for n in dict.fromkeys(names)) + 6 * ((chat, key) in tail) - stub, ord_, key) for c, ord_, key, names, stub in people if c == chat), reverse=True)[:5]
        want += [(chat, batch, key, score, i) for i, (score, _, key) in enumerate(ranked, 1)]
    assert got == sorted(want)


def test_related_relations(spark):
    relations = spark.createDataFrame([("c", "r1", ["character:Ann", "character:Bob"]), ("c", "r2", ["character:Cy", "character:Di"]), ("c", "r3", ["character:Ed", "character:Flo"])], "chat_id string, relation string, participants array<string>")
    chosen = spark.createDataFrame([("c", 0, "character:Bob"), ("d", 0, "character:Ed")], "chat_id string, batch_ix int, key string")
    texts = spark.createDataFrame([("c", 0, "Di went"), ("c", 1, "then Ann came"), ("d", 0, "Ed")], "chat_id string, batch_ix int, text string")
    assert sorted(tuple(r) for r in resolve.related_relations(relations, chosen, texts).collect()) == [("c", 0, "r1"), ("c", 0, "r2"), ("c", 1, "r1")]
