"""Cases that a corpus brings along: repeated ids, hot keys, odd vectors, rare scripts, short benchmark items, planted personal data."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_operators import brute_components, brute_dedup, words

from storynet.llm import chat_format, common, decontaminate, jaccard_join, language, mixing, pii, quality, suffix_dedup, top_k, url_filter

TEXTS = "doc_id long, text string"


def test_jaccard_keeps_texts_of_a_repeated_id(spark):
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    rows = [(1, a, "first"), (1, b, "second"), (2, a, "third"), (3, b, "fourth"), (1, a, "again"), (None, a, "none"), (4, None, "null"), (4, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect())
    assert got == Counter([(1, 6, 1), (1, 6, 1), (1, 6, 1), (2, 6, 1), (3, 6, 1), (None, 6, None), (4, 0, 4), (4, 0, 4)])
    kept = sorted((r.text or "", r.component) for r in jaccard_join.keep_first(docs).collect())
    assert kept == sorted([(a, "again"), (b, "second"), (a, "none"), ("", "null"), ("", "empty")])
    assert sorted(r.text for r in jaccard_join.keep_first(docs.filter("doc_id in (2, 3)")).collect()) == [a, b]


@pytest.mark.parametrize("hot", [100_000, 2])
def test_jaccard_with_one_group_of_half_of_all_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot)
    rng = random.Random(9)
    base, rows = words(rng, 60).split(), []
    for i in range(120):
        w = list(base) if i % 2 else words(rng, 30).split() + base[:30]
        w[rng.randrange(len(w))] = f"z{i}"
        rows.append((500 - i, " ".join(w)))
    rows += [(1000 + i, rows[1][1]) for i in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, TEXTS).repartition(5)).collect()}
    assert got == brute_components(rows)


def test_jaccard_names_classes_by_digest_when_hashes_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join.F, "xxhash64", lambda *c: jaccard_join.F.lit(7).cast("long"))
    rows = [(i, t) for i, t in enumerate(["a b c d e f", "a b c d e f", "g h i j k l", "a b c d e f", "q"])]
    with monkeypatch.context() as m:
        m.setattr(jaccard_join, "components", lambda edges: edges.select(jaccard_join.F.col("a").alias("node"), jaccard_join.F.col("b").alias("component")).limit(0))
        got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def test_every_order_is_a_necessary_filter():
    rng = np.random.default_rng(6)
    level = rng.integers(0, 3, 1 << jaccard_join.SKETCH).astype(np.uint8)
    linked = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(4, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)]))
        if jaccard_join.links(a, b):
            linked += 1
            for k in range(jaccard_join.ORDERS):
                assert np.intersect1d(jaccard_join.prefix(a, level, k), jaccard_join.prefix(b, level, k)).size
    assert linked > 50


def test_suffix_dedup_of_a_repeated_id(spark):
    rows = [(1, "Z" * 150), (1, "abcdefghij" * 30), (0, "x"), (1, "Z" * 150), (2, "Z" * 120)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, TEXTS)).collect())
    alone = {t: brute_dedup([(1, t)])[1][1] for _, t in rows}
    assert got == Counter([(1, 150, alone["Z" * 150]), (1, 150, alone["Z" * 150]), (1, 300, alone["abcdefghij" * 30]), (0, 1, 0), (2, 120, 120)])


@pytest.mark.parametrize("share", [1000, 60])
def test_suffix_dedup_with_a_hot_passage(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    rng = random.Random(11)
    passage = words(rng, 60)
    rows = [(i, f"{words(rng, 20)} {passage if i % 2 else ''} {words(rng, 20)}") for i in range(200)]
    docs = spark.createDataFrame(rows, TEXTS).repartition(4)
    assert len(suffix_dedup.hot_anchors(docs)) > 0
    want = brute_dedup(rows)
    for r in suffix_dedup.dedup(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_top_k_of_odd_and_repeated_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, []), (4, [1.0]), (5, None), (6, [1.0, None]), (2, [3.0, 1.0]), (7, [0.0, 0.0]), (1, [1.0, 2.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(df, df.filter("vec_id in (1, 3)"), 3).collect())
    assert got == [*[(1, 1, 1, 5.0)] * 2, *[(1, 2, 2, 5.0)] * 2, *[(1, 3, 2, 5.0)] * 2]  # each row of id 1 leaves out itself only
    several = spark.createDataFrame([(1, [1.0, 2.0]), (1, [9.0, 9.0]), (2, [1.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, v array<double>")
    asked = top_k.top_k(several, several.filter("vec_id = 50")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in asked] == [(1, 18.0), (1, 3.0), (2, 2.0)]
    assert top_k.top_k(spark.createDataFrame([(1, []), (2, [])], "vec_id long, v array<double>"), df).count() == 0


def test_top_k_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(top_k, "CELL_BYTES", 8 * 8 * 40)
    rng = np.random.default_rng(12)
    x = np.floor(rng.normal(0, 50, (900, 8)) * rng.choice([0.1, 1, 6], (900, 1)))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    found = {(r.query_id, r.rank): r.vec_id for r in top_k.top_k(df, df.filter("vec_id % 9 = 0"), 4).collect()}
    assert len(found) == 400
    for q in range(0, 900, 9):
        score = x @ x[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], i))[:4]
        assert [found[q, k + 1] for k in range(4)] == best


def test_language_trees_are_not_cut(spark):
    """Over 96 different bytes and 8,192 contexts: exact all the same."""
    rng = random.Random(13)
    texts = [(lang, "".join(chr(rng.randint(lo, lo + 3000)) for _ in range(9000)).encode()) for lang, lo in (("ja", 0x3041), ("ko", 0x4E00), ("ja", 0x3100))]
    texts.append(("ko", bytes(range(256))))
    grams = [(lang, g) for lang, raw in texts for g in language._grams(language.PAD + raw)]
    trees = language.Trees(["ja", "ko"], np.array([["ja", "ko"].index(a) for a, _ in grams]), np.array([g for _, g in grams]), np.ones(len(grams)))
    assert len(trees.top.contexts) > 8192 and len(set(b"".join(r for _, r in texts))) > 96
    count: dict = {"ja": {}, "ko": {}}
    for lang, raw in texts:
        x = language.PAD + raw
        for i in range(3, len(x)):
            for k in range(4):
                node = count[lang].setdefault(x[i - k : i], Counter())
                node[x[i]] += 1

    def bits(lang, ctx, byte):
        node = count[lang].get(ctx)
        lower = lambda: bits(lang, ctx[1:], byte) if ctx else 8.0
        if node is None:
            return lower()
        n, d = sum(node.values()), len(node)
        return -math.log2(node[byte] / (n + d)) if byte in node else -math.log2(d / (n + d)) + lower()

    docs = [texts[0][1][:90], texts[1][1][300:420], "ひらがな 漢字 abc".encode(), b"\xff\x00", b""]
    for raw, row in zip(docs, trees.bits(docs), strict=True):
        x = language.PAD + raw
        for k, name in enumerate(["ja", "ko"]):
            assert row[k] == pytest.approx(sum(bits(name, x[i - 3 : i], x[i]) for i in range(3, len(x))), rel=1e-4)


def test_language_ties_repeats_and_letters(spark):
    rows = [(1, "aaaa bbbb", "xx"), (2, "aaaa bbbb", "yy"), (3, "½ ² 123 _", "xx"), (4, "aaaa", None), (4, "aaaa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.lang_pred) for r in language.identify(docs, language.train(docs.filter("doc_id < 3"))).collect())
    assert got == Counter({(1, "xx"): 1, (2, "xx"): 1, (3, "und"): 1, (4, "xx"): 2})


def planted(rng):
    """A text with spans that the base patterns miss and with look-alikes: (text, true spans)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(4, 8)))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    good = [
        (f"{rng.choice(['password', 'token', 'api key', 'secret'])} = \"", hexes, '"'),
        ("write to ", f"{name()} [at] {name()} [dot] {rng.choice(['com', 'org', 'net'])}", " soon"),
        ("mail ", f"{name()} at {name()} dot com", ", please"),
        ("call ", f"({rng.randint(200, 989)}) {digits(3)}-{digits(4)}", " today"),
        ("key ", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "."),
        ("her ssn is ", f"{rng.randint(101, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", ","),
    ]
    bad = [
        ("order no ", digits(16), " came"), ("commit ", hexes[:24], " fixed it"), ("on ", f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", " we met"),
        ("version ", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", " is out"), ("isbn ", digits(13), " in print"), ("they met at ", "noon", " there"),
    ]
    text, spans = words(rng, 8) + " ", []
    for kind, (before, span, after) in [(True, rng.choice(good)), (False, rng.choice(bad)), (True, rng.choice(good))]:
        text += before
        if kind:
            spans.append((len(text), len(text) + len(span)))
        text += f"{span}{after} {words(rng, 6)} "
    return text, spans


def test_pii_added_spans_recall_and_precision(spark):
    rng = random.Random(14)
    made = {i: planted(rng) for i in range(1500)}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in made.items()], TEXTS)
    found = pii.scan(docs)
    hit = wrong = 0
    for r in pii.find(found, pii.train(found)).collect():
        base = {s for s in r.base.split(",") if s}
        added = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s and s not in base}
        covered = added | {tuple(map(int, s.split(":")[1:])) for s in base}
        hit += sum(any(a < d and c < b for c, d in covered) for a, b in made[r.doc_id][1])
        wrong += sum(not any(a < d and c < b for c, d in made[r.doc_id][1]) for a, b in added)
    total = sum(len(s) for _, s in made.values())
    assert hit / total > 0.9
    assert wrong / (hit + wrong) < 0.1


def test_pii_names_an_expected_added_span(spark):
    rng = random.Random(15)
    text = 'the api token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" works'
    docs = spark.createDataFrame([(i, planted(rng)[0]) for i in range(400)] + [(900, text), (900, text)], TEXTS)
    found = pii.scan(docs)
    rows = [r for r in pii.find(found, pii.train(found)).collect() if r.doc_id == 900]
    assert [r.spans for r in rows] == ["secret:17:57"] * 2 and all(r.base == "" for r in rows)


def test_pii_lists_from_a_table_and_clashing_columns(spark):
    lists = pii.Lists.read(spark.createDataFrame([("secret", "losung"), ("against", "charge"), ("domains", "intern"), ("ssn", None)], "list string, word string"))
    assert "losung" in lists.context["secret"] and "charge" in lists.against and "intern" in lists.domains
    with pytest.raises(ValueError):
        pii.Lists.read(spark.createDataFrame([("against", "a"), ("against", "b")], "list string, word string"), most=1)
    docs = spark.createDataFrame([(1, "a@b.com", "x", 3, "t")], "doc_id long, text string, row string, n_chars long, t string")
    r = pii.redact(docs, pii.train(pii.scan(docs))).first()
    assert (r.text, r.row, r.n_chars, r.t) == ("<EMAIL>", "x", 7, "t")


def test_pii_spans_in_order():
    rng = random.Random(16)
    for _ in range(50):
        cands = [(rng.random(), "card", a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(20))]
        kept: list = []
        for p, k, a, b in sorted((c for c in cands if c[0] >= pii.THRESHOLD), key=lambda c: (-c[0], c[2] - c[3], c[2], c[1])):
            if not any(a < d and c < b for _, c, d in kept):
                kept.append((k, a, b))
        assert pii.choose(cands) == kept


def test_decontaminate_short_items_and_word_boundaries(spark):
    docs = spark.createDataFrame([(1, "a party of three men came"), (2, "ART of war"), (3, "start of warning"), (4, "the art, of war!")], TEXTS)
    bench = spark.createDataFrame([(7, "art"), (8, "art of war"), (9, "of war")], "item_id long, text string")
    got = {r.row.doc_id: [h.item_id for h in r.hits] for r in decontaminate.with_hits(docs, bench).collect()}
    assert got == {1: [], 2: [7, 8, 9], 3: [], 4: [7, 8, 9]}
    strict = decontaminate.with_hits(docs, bench, least=10).collect()
    assert {r.row.doc_id: [h.item_id for h in r.hits] for r in strict} == {1: [], 2: [8], 3: [], 4: [8]}


def test_decontaminate_in_scripts_without_blanks(spark):
    chinese, japanese, thai, mixed = "春江潮水连海平海上明月共潮生滟滟随波千里", "さくらさくらやよいのそらは", "สวัสดีชาวโลกทั้งหลาย", "GPT模型的训练数据"
    items = [(1, chinese), (2, japanese), (3, thai), (4, mixed), (5, "月"), (6, "yes"), (7, "Genau so."), (8, "café")]
    texts = {
        1: f"他说{chinese}然后走了", 2: f"A {chinese[:8]}x{chinese[9:]} b", 3: f"「{japanese}」", 4: f"ก{thai}ก", 5: f"关于{mixed}。", 6: "xgpt模型的训练数据", 7: "oh, YES!", 8: "yesterday", 9: "genau  so", 10: "cafés",
        11: "un café.", 12: f"{chinese[:10]}。{chinese[10:]}", 13: chinese[:12],
    }
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], TEXTS)
    got = {r.row.doc_id: [(h.item_id, h.distance) for h in r.hits] for r in decontaminate.with_hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[1] == [(1, 0), (5, 0)] and got[3] == [(2, 0)] and got[4] == [(3, 0)] and got[5] == [(4, 0)] and got[6] == [(4, 1)]
    assert got[2] == [] or got[2][0][0] == 1  # a character of three bytes and its spaces are more edits than 6 % of 60 bytes
    assert got[7] == [(6, 0)] and got[8] == [] and got[9] == [(7, 0)] and got[10] == [] and got[11] == [(8, 0)] and got[13] == [(5, 0)]
    for i, t in texts.items():  # against a plain table of distances, with the same spaces
        want = {}
        for k, x in items:
            edged, size = decontaminate.edged(x)
            text = f" {decontaminate.normal(t)} "
            last = [0] * (len(text) + 1)
            for a, c in enumerate(edged, 1):
                row = [a]
                for b, e in enumerate(text, 1):
                    row.append(min(last[b] + 1, row[-1] + 1, last[b - 1] + (c != e)))
                last = row
            if min(last) <= int(decontaminate.RATE * size):
                want[k] = min(last)
        assert dict(got[i]) == want


def test_mixing_prefers_longer_documents_and_splits_null_ids(spark):
    rng = random.Random(17)
    rows = [(i, " ".join(["w"] * rng.choice([3, 200])), "a") for i in range(3000)] + [(None, f"x {i}", "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1,), budget=1.5).filter("doc_id is not null").collect()
    share = lambda size: np.mean([r.copies == 2 for r in got if r.size == size])
    p = got[0].target / got[0].source_size - 1
    assert 0.2 < p < 0.8 and share(200) - share(3) > 0.1
    words_taken = sum(r.taken for r in got)
    assert abs(words_taken - got[0].target) <= 200
    names = {r.rank for r in mixing._ranked(*_null_ranks(spark)).collect()}
    assert len(names) == 5


def _null_ranks(spark):
    rows = spark.createDataFrame([(f"t{i}", "k", 3) for i in range(5)], "name string, key string, size long")
    goal = spark.createDataFrame([("k", 5, 0.5, 2.0, 1.0)], "key string, n_docs long, p double, mean double, wide double")
    return rows, goal, "s"


def test_quality_features_equations_and_calibration_by_plain_python(spark):
    rng = np.random.default_rng(18)
    texts = [" ".join("".join(rng.choice(list("abc!9 "), 4)) for _ in range(rng.integers(1, 30))) for _ in range(240)]
    y = [int(t.count("!") * 3 < len(t.split())) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(3)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(quality.text_statistics(docs), quality.learnable(labels))
    folds = spark.range(240).select("id", quality.F.pmod(quality.F.xxhash64("id", quality.F.lit(quality.SEED)), quality.F.lit(quality.CROSS)).alias("f"))
    fold = {r.id: r.f for r in folds.collect()}
    told = [i for i in range(240) if not zlib_mod(i)]
    x = np.array([quality.text_stats(texts[i]) for i in told], np.float32).astype(float)
    mean, scale = x.mean(0), x.std(0)
    assert np.allclose(mean, model.mean) and np.allclose(np.where(scale > 1e-9, scale, 1), model.scale)
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / model.scale, -8, 8) @ model.w + model.b), np.ones((len(x), 1))])
    target = np.array([y[i] for i in told], float)

    def ridge(keep):
        a = z[keep].T @ z[keep] + quality.RIDGE * keep.sum() * np.eye(z.shape[1]) / quality.FEATURES
        return np.linalg.solve(a, z[keep].T @ target[keep])

    assert np.allclose(ridge(np.ones(len(z), bool)), model.beta, atol=1e-6)
    of = np.array([fold[i] for i in told])
    raw = np.array([z[j] @ ridge(of != of[j]) for j in range(len(z))])
    bins = sorted({int(b) for b in quality.place(raw)})
    n, k = ([float(v[quality.place(raw) == b].sum()) for b in bins] for v in (np.ones(len(z)), target))
    best = [max(min(sum(k[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]  # isotonic by max-min
    assert np.allclose(model.y, np.clip(best, 0, 1), atol=1e-6)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    one = told[5]
    assert got[one] == pytest.approx(float(np.interp(z[5] @ model.beta, model.x, model.y)), abs=1e-6)


def zlib_mod(i):
    import zlib

    return zlib.crc32(str(i).encode()) % quality.FOLDS == 0


def test_quality_ties_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i % 50, ("plain words " if i % 2 else "SHOUT! 1 ") * 5, "r", 1) for i in range(100)], "doc_id long, text string, row string, x int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, None), (None, 1)], "doc_id long, quality int")
    scores: dict = {}
    for r in quality.classify(docs, labels).collect():
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and len({s for d in scores for s in scores[d]}) == 2
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} <= {"plain words " * 5}


def test_joins_of_hot_keys(spark):
    rows = spark.createDataFrame([("k" if i % 2 else f"r{i}", i) for i in range(400)], "key string, i int")
    keyed = rows.groupBy("key").count()
    want = sorted((r.i, r["count"]) for r in rows.join(keyed, "key").collect())
    assert sorted((r.i, r["count"]) for r in common.join_hot(rows, keyed, "key", "count").collect()) == want


def test_url_reputation_with_one_domain_of_half_of_all_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.{'blog.com' if i % 2 else f'd{i}.org'}/p") for i in range(300)], "page_id long, url string")
    seen = spark.createDataFrame([(f"h{i}.blog.com", i % 4 == 1) for i in range(1, 300, 2)], "host string, good boolean").selectExpr("host", "int(good) as good")
    rows = url_filter.filter_urls(pages, seen).collect()
    assert len(rows) == 300 and len({r.rate for r in rows if r.page_id % 2 == 0}) == 1
    assert {r.verdict for r in rows if r.page_id % 2} == {"allow"}  # the rule for com
    assert url_filter.url_domain(url_filter.F.lit("a.b.co.jp")) is not None


def test_long_conversations(spark):
    n = 3000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('t', id, '#') as text")
    r = chat_format.format_chats(df).withColumn("t", chat_format.read_turns(chat_format.F.col("formatted"))).withColumn("m", chat_format.loss_spans(chat_format.F.col("formatted"))).first()
    assert [t.text for t in r.t] == [f"t{i}#" for i in range(n)]
    assert [r.formatted[m.start : m.start + m.length] for m in r.m] == [f"t{i}\\h" for i in range(n) if i % 3]
    assert len(re.findall("### Role: ", r.formatted)) == 2 * n // 3


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from storynet.functions import shared

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
