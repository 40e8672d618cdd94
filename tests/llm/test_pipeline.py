"""The pipeline's stages against plain Python over the smallest tables."""

from __future__ import annotations

import re

import corpus_pipeline
from storynet.llm import decontaminate, jaccard_join, pii, quality


def test_stages_keep_columns_and_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.columns[: len(columns)] == columns
        if name == "quality_classifier":
            scored = {r.doc_id: r.score for r in quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert set(after) == {i for i in before if scored[i] >= quality.THRESHOLD}
            assert all(after[i] == before[i] for i in after)
        if name == "ngram_jaccard_join":
            sets = {i: jaccard_join.shingles(r.text) for i, r in after.items()}
            ids = sorted(sets)
            assert not any(jaccard_join.links(sets[a], sets[b]) for x, a in enumerate(ids) for b in ids[:x])
        if name == "benchmark_decontamination":
            plain = {i for i, r in before.items() if any(decontaminate.normal(t) in decontaminate.normal(r.text) for _, t in bench)}
            assert not plain & set(after) and len(before) - len(after) <= len(plain) + 2
        if name == "pii":
            assert not any(k in ("email", "card") for r in after.values() for k, _, _ in pii.base_spans(r.text or ""))
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "mixing":
            size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in before.items()}
            sums: dict = {}
            for i, r in before.items():
                sums[r.source] = sums.get(r.source, 0) + size[i]
            for source, words in sums.items():
                own = [r for r in after.values() if r.source == source]
                assert all(r.size == size[r.doc_id] and r.taken == r.copies * r.size and 1 <= r.copies <= 2 for r in own)
                assert abs(sum(r.taken for r in own) - own[0].target) <= max(size[i] for i, r in before.items() if r.source == source) and own[0].target <= 2 * words
        seen.append(len(after))
    assert seen[-1] > 0.5 * seen[0]
    assert {"size", "target", "copies", "taken"} <= set(docs.columns)


def test_stages_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
