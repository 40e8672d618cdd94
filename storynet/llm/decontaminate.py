"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared as UTF-8 bytes, lower-cased, with each run of ASCII
characters that are neither letters nor digits as one space. Scripts that are
written without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese) get a space
where a run of them begins or ends. An item whose first or last character is of
another script has a space there too, so that it begins and ends where words do;
within a run of those scripts it may begin and end anywhere. A document holds an
item if some part of it is within e edits of the whole item with its spaces,
e = ``RATE`` of the item's length without them. Items of every length are looked
for; what counts as evidence of a leak is up to the caller (``least``, in bytes of
the compared item: 0 here, ``EVIDENCE`` where documents are dropped). An item is
split into e + 1 pieces; e edits leave at least one of them whole, so every such
part has an exact piece hit in its place. An Aho-Corasick automaton finds the hits
in one pass over a text, and around each hit Myers' bit-parallel algorithm computes
the least edit distance. No match within the budget is missed.

The items are the stated query set. They go to the tasks in blocks of at most
``BLOCK_BYTES`` of text, each broadcast, so what is broadcast has a bound; each
further block is another map over the documents. Nothing is shuffled.

Defined cases: null, empty or unprintable texts and items match nothing; copies
of an item are items of their own; a repeated row is matched each time; an empty
table gives an empty result. All columns pass through as one struct, so their
names cannot clash.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.llm.common import ready, small, table

RATE, BLOCK_BYTES = 0.06, 8 << 20
#: Bytes of an item, as it is compared, from which a document that holds it is dropped.
EVIDENCE = 16
HITS = "array<struct<item_id:bigint,distance:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: Blocks of Unicode whose scripts are written without blanks.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_RUN, _INSIDE = re.compile(f"[{_UNSPACED}]+"), re.compile(f"[{_UNSPACED}]")


def normal(text: str | None) -> str:
    """What is compared, a character for each byte."""
    text = (text or "").lower()
    if not text.isascii():
        text = _RUN.sub(r" \g<0> ", text)
    return b" ".join(text.encode("utf-8", "replace").translate(_TABLE).split()).decode("latin-1")


def edged(item: str | None) -> tuple[str, int]:
    """An item as it is looked for, with a space at each end where a word ends, and its length without these."""
    plain = normal(item)
    text = plain.encode("latin-1").decode("utf-8", "replace")
    before, after = ("" if not text or _INSIDE.match(c) else " " for c in (text[:1], text[-1:]))
    return f"{before}{plain}{after}", len(plain)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces (start, text) of about the same length that make up ``item``."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(item: str, text: str, most: int) -> int:
    """The least edit distance between ``item`` and any part of ``text`` (Myers 1999); ``most`` + 1 if it is over ``most``."""
    if item in text:
        return 0
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best if best <= most else most + 1


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, least: int = 0):
        self.items = [(i, x, math.floor(rate * n)) for i, t in items for x, n in [edged(t)] if n >= max(least, 1)]
        keys: dict[str, list[tuple[int, int]]] = {}
        for k, (_, x, e) in enumerate(self.items):
            for at, piece in pieces(x, e):
                keys.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in keys.items():
            self.automaton.add_word(piece, (len(piece), places))
        if keys:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of each item that ``text`` holds."""
        if not self.items or not text:
            return []
        text, windows = f" {normal(text)} ", {}
        for end, (size, places) in self.automaton.iter(text):
            for k, at in places:
                _, x, e = self.items[k]
                start = end + 1 - size - at - e
                spans = windows.setdefault(k, [])
                if spans and start <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], start)
                    spans[-1][1] = max(spans[-1][1], start + len(x) + 2 * e)
                else:
                    spans.append([start, start + len(x) + 2 * e])
        found = []
        for k, spans in windows.items():
            i, x, e = self.items[k]
            best = e + 1
            for a, b in spans:
                best = min(best, least_distance(x, text[max(a, 0) : b], e))
                if best == 0:
                    break
            if best <= e:
                found.append((i, best))
        return sorted(found)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, least: int = 0) -> DataFrame:
    """row, a struct of all columns of ``docs``, and hits, the items (item_id, distance) of at least ``least`` bytes that its text holds."""
    spark = docs.sparkSession
    ready(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(2 * size / BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    out = docs.select(F.struct("*").alias("row"), F.array().cast(HITS).alias("hits"))
    for k in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect() if n_blocks > 1 else items.collect()
        held = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block])

        def scan(batches, held=held):
            matcher = Matcher(held.value, rate, least)
            for b in small(batches):
                found = [
                    [*(old or ()), *({"item_id": i, "distance": d} for i, d in matcher.find(t))]
                    for t, old in zip(b.column("row").field(text).to_pylist(), b.column("hits").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, _HIT)], ["row", "hits"])

        out = out.mapInArrow(scan, out.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(F.col("row.doc_id").alias("doc_id"), F.inline("hits"))
