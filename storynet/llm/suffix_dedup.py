"""Removal of repeated substrings by suffix arrays built in two stages.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier: in a smaller doc_id, or in the same document further left.

1. Each string of LENGTH bytes has an anchor, the rightmost of its least hashed
   grams of ``GRAM`` bytes (winnowing), so equal strings have equal anchors. A run
   of starts that share an anchor is a segment, and only segments with equal
   anchors can hold equal strings. A pass over the texts makes the segments;
   each task first merges its own equal segments, so that what is shuffled by
   anchor has an anchor's content at most once a task.
2. Of equal segments all but the earliest are removed whole. Where an anchor
   comes with several contents, the earliest segment of each is sorted: only
   suffixes smaller than their successors are sorted directly, the rest are
   induced from them by scanning buckets, and adjacent common prefixes of LENGTH
   bytes or more give the classes of equal strings; all but the earliest go.
3. Anchors with more than ``LARGE`` contents (the edges of a passage that very
   many documents share) do not meet in one task: their strings are dealt out
   one by one by a hash of the whole string, merged within tasks first. Segments
   of an anchor with over one in ``HOT_SHARE`` of all segments are dealt out by
   content from the start; which these are a first pass over the texts finds, by
   counting in each batch: at most 2 * HOT_SHARE anchors reach the driver.

Texts travel compressed, twice, by doc_id. Hashes have 64 bits and are compared
only between segments with equal 64-bit anchors.

Defined cases: a null text has no bytes; a null doc_id takes no part and keeps its
text whole; rows that repeat a doc_id with the same text count as one and get the
same result; rows with one doc_id and different texts are documents of their own,
in the order of doc_id and then of the text's MD5 digest; texts under LENGTH bytes
keep all; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.llm.common import ready, saved, small, table

LENGTH, GRAM, LARGE, BUFFER, SORT_BYTES, HOT_SHARE, MERGE_BYTES = 100, 24, 256, 1 << 19, 1 << 19, 1000, 24 << 20
_PLACE = np.uint64((1 << 20) - 1)
_RNG = np.random.default_rng(10)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for each place of a buffer."""
    if not _POWERS:
        n = BUFFER + LENGTH + 1
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place of ``x``, the same wherever they stand."""
    up, down = _powers()
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * up[: len(x)], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(x) - GRAM + 1]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(h: np.ndarray) -> np.ndarray:
    """Place of the anchor for each string of LENGTH bytes, given the hash of each gram."""
    key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    width, done = LENGTH - GRAM + 1, 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if done < width:
        key = np.minimum(key[: -(width - done)], key[width - done :])
    return (_PLACE - (key & _PLACE)).astype(np.int64)


def _buffers(raws: list[bytes]):
    """Parts of texts, together at most about BUFFER bytes: lists of (row, place in the text, bytes)."""
    part, held = [], 0
    for i, raw in enumerate(raws):
        for at in range(0, len(raw) - LENGTH + 1, BUFFER):
            piece = raw[at : at + BUFFER + LENGTH - 1]
            if part and held + len(piece) > BUFFER:
                yield part
                part, held = [], 0
            part.append((i, at, piece))
            held += len(piece)
    if part:
        yield part


def _starts(part) -> tuple[np.ndarray, ...]:
    """Of the segments in one of _buffers' parts: which text, first place in the buffer, number of strings, anchor hash; and where each text begins."""
    x = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
    sizes = np.array([len(p) for _, _, p in part])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = gram_hashes(x)
    place = anchors(h)
    of = np.repeat(np.arange(len(part)), sizes)[: len(place)]
    valid = np.arange(len(place)) + LENGTH <= (begin + sizes)[of]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(place)))
    first, count = first[valid[first]], count[valid[first]]
    return of[first], first, count, h[place[first]], begin


def segments(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """row, start, number of strings, anchor hash and content hash of each segment of the texts."""
    out = []
    for part in _buffers(raws):
        of, first, count, anchor, begin = _starts(part)
        whole = b"".join(p for _, _, p in part)
        content = [xxhash.xxh3_64_intdigest(whole[a:e]) for a, e in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)]
        row = np.array([i for i, _, _ in part])[of]
        start = first - begin[of] + np.array([at for _, at, _ in part])[of]
        out.append((row, start, count, anchor, np.array(content, np.uint64)))
    if not out:
        return (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _frequent(batches):
    """anchor, n: anchors with over one in 2 * HOT_SHARE of a batch's segments; and one row without anchor for all of them."""
    for b in small(batches):
        raws = [t.encode("utf-8", "replace") if t else b"" for t in b.column("text").to_pylist()]
        found = [_starts(part)[3] for part in _buffers(raws)]
        anchor, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        often = 2 * HOT_SHARE * n > n.sum()
        cols = [pa.array([*anchor[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[often].tolist(), int(n.sum())], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["anchor", "n"])


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors with over one in HOT_SHARE of all segments, and perhaps some with over half as many.

    An anchor that is hot has at least half its segments in batches where it is over half as frequent.
    """
    seen = saved(docs.select("text").mapInArrow(_frequent, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")))
    total = seen.filter("anchor is null").agg(F.sum("n")).first()[0] or 0
    rows = seen.filter((F.col("anchor").isNotNull()) & (F.col("n") * (2 * HOT_SHARE) > total)).select("anchor").collect()
    return np.array(sorted(r.anchor for r in rows), np.int64)


def _merged(doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans [a, e) of each document with overlapping and touching ones joined."""
    if not len(doc):
        return doc, a, e
    order = np.lexsort((a, doc))
    doc, a, e = doc[order], a[order], e[order]
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    # ends run on within a document: shift each document past the one before
    base = np.cumsum(new_doc) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + base)
    new = np.ones(len(doc), bool)
    new[1:] = a[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], a[at], reach[last] - base[last]


def _spread(doc: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A key that deals rows out evenly."""
    return (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (a.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def _earliest(keys: tuple[np.ndarray, ...], doc: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first among those with equal keys, and rows that come later in (doc, a) than some such row."""
    order = np.lexsort((a, doc, *keys))
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    first = np.ones(len(order), bool)
    first[1:] = ~same
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    later = (doc[order] != doc[lead]) | (a[order] != a[lead])
    return order[first], order[~first & later]


_SEGMENTS = "anchor long, salt long, content long, doc_id long, a int, n int"


def _make(hot: np.ndarray):
    """Segments, each content once for MERGE_BYTES of text; n = 0 marks a span [a, content) that is removed already. Hot anchors have a salt."""

    def merged(parts):
        doc, a, n, anchor, content = (np.concatenate(c) for c in zip(*parts, strict=True))
        first, later = _earliest((content, anchor), doc, a)
        d, s, e = _merged(doc[later], a[later], (a + n + LENGTH - 1)[later])
        key, what = anchor[first].view(np.int64), content[first].view(np.int64)
        cols = (
            np.concatenate([key, _spread(d, s).view(np.int64)]),
            np.concatenate([np.where(np.isin(key, hot), what | 1, 0), np.zeros(len(d), np.int64)]),
            np.concatenate([what, e]),
            np.concatenate([doc[first], d]),
            np.concatenate([a[first], s]).astype(np.int32),
            np.concatenate([n[first], np.zeros(len(d), np.int64)]).astype(np.int32),
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "salt", "content", "doc_id", "a", "n"])

    def make(batches):
        parts, held = [], 0
        for b in small(batches):
            ids = b.column("doc_id").to_pylist()
            raws = [t.encode("utf-8", "replace") if t and i is not None else b"" for i, t in zip(ids, b.column("text").to_pylist(), strict=True)]
            row, *rest = segments(raws)
            parts.append((np.array([i or 0 for i in ids], np.int64)[row], *rest))
            held += sum(map(len, raws))
            if held > MERGE_BYTES:
                yield merged(parts)
                parts, held = [], 0
        if parts:
            yield merged(parts)

    return make


def _pack(batches):
    c = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for b in small(batches):
        raws = [None if t is None else c.compress(t.encode("utf-8", "replace")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc_id"), pa.array(raws, pa.binary())], ["id", "doc_id", "z"])


_PARTS = "kind int, key long, anchor long, doc_id long, a int, seg binary"


def _cut_out(batches):
    """kind 1: a segment to sort; kind 2: a string of an anchor with many contents; kind 0: a span [a, key) to remove."""
    c = zstandard.ZstdDecompressor()
    for b in small(batches):
        seg, big = [], []
        for doc, z, wanted in zip(*(b.column(k).to_pylist() for k in ("doc_id", "z", "wanted")), strict=True):
            raw = c.decompress(z)
            for w in wanted:
                part = raw[w["a"] : w["a"] + w["n"] + LENGTH - 1]
                if w["large"]:
                    big += [(xxhash.xxh3_64_intdigest(part[i : i + LENGTH]), w["anchor"], doc, w["a"] + i) for i in range(len(part) - LENGTH + 1)]
                else:
                    seg.append((1, w["anchor"], w["anchor"], doc, w["a"], part))
        rows = seg
        if big:
            key, anchor, doc, a = (np.array(x, t) for x, t in zip(zip(*big, strict=True), (np.uint64, np.int64, np.int64, np.int64), strict=True))
            first, later = _earliest((key, anchor), doc, a)
            rows += [(2, *x, None) for x in zip(key.view(np.int64)[first].tolist(), anchor[first].tolist(), doc[first].tolist(), a[first].tolist(), strict=True)]
            d, s, e = _merged(doc[later], a[later], a[later] + LENGTH)
            rows += [(0, y, 0, x, z, None) for x, y, z in zip(d.tolist(), e.tolist(), s.tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["kind", "key", "anchor", "doc_id", "a", "seg"])


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in the order of the suffixes that start there, in two stages; LENGTH bytes at least are compared.

    A suffix smaller than its successor is sorted directly; any other is put in its bucket (its first byte) when the scan
    over the sorted suffixes reaches its successor.
    """
    n = len(x)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(x[1:].astype(np.int16) - x[:-1].astype(np.int16))
    step[-1] = -1  # the end is smaller than any byte
    at = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    padded = np.concatenate([x, np.zeros(LENGTH, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    own = np.flatnonzero(small)
    own = own[np.argsort(np.ascontiguousarray(windows[own]).view(f"S{LENGTH}").ravel(), kind="stable")]
    own_cut = np.searchsorted(x[own], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not small[n - 1]:
        waiting[x[n - 1]].append(np.array([n - 1]))

    def scanned(places: np.ndarray, after: int) -> None:
        before = places[places > 0] - 1
        before = before[~small[before] & (x[before] > after)]
        if len(before):
            first = x[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cuts):
                waiting[x[part[0]]].append(part)

    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):  # suffixes that begin with one byte more of the same follow in the same bucket
            out.append(wave)
            scanned(wave, c)
            wave = wave[wave > 0] - 1
            wave = wave[~small[wave] & (x[wave] == c)]
        part = own[own_cut[c] : own_cut[c + 1]]
        if len(part):
            out.append(part)
            scanned(part, c)
    return np.concatenate(out)


def equal_strings(segs: list[bytes], doc: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans (doc, start, end) of strings in ``segs`` that are equal to an earlier one; segment i starts at a[i] in doc[i]."""
    x = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8)
    sizes = np.array([len(s) for s in segs])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    of = np.repeat(np.arange(len(segs)), sizes + 1)
    sa = suffix_array(x)
    sa = sa[sa + LENGTH <= (begin + sizes)[of[sa]]]
    windows = np.lib.stride_tricks.sliding_window_view(x, LENGTH)
    common = np.zeros(len(sa), bool)
    for i in range(1, len(sa), 1 << 16):  # adjacent common prefixes, as far as LENGTH
        here = sa[i : i + (1 << 16)]
        common[i : i + len(here)] = (windows[here] == windows[sa[i - 1 : i - 1 + len(here)]]).all(1)
    group = np.cumsum(~common)
    d, s = doc[of[sa]], a[of[sa]] + sa - begin[of[sa]]
    _, later = _earliest((group,), d, s)
    return _merged(d[later], s[later], s[later] + LENGTH)


_SPANS = "doc_id long, a int, e int"


def _span_batch(spans) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(spans, types, strict=True)], ["doc_id", "a", "e"])


def _sort(batches):
    """Segments, sorted by anchor, to spans to remove; anchors are taken together up to SORT_BYTES."""
    key, doc, a, segs, held = [], [], [], [], 0
    for b in small(batches):
        rows = zip(*(b.column(k).to_pylist() for k in ("key", "doc_id", "a", "seg")), strict=True)
        for k, d, s, seg in rows:
            if held > SORT_BYTES and k != key[-1]:
                yield _span_batch(equal_strings(segs, np.array(doc), np.array(a)))
                key, doc, a, segs, held = [], [], [], [], 0
            key.append(k)
            doc.append(d)
            a.append(s)
            segs.append(seg)
            held += len(seg)
    if segs:
        yield _span_batch(equal_strings(segs, np.array(doc), np.array(a)))


def repeated_spans(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """doc_id, a, e: spans of bytes to remove, possibly overlapping."""
    hot = hot_anchors(docs)
    made = docs.select("doc_id", "text").mapInArrow(_make(hot), _SEGMENTS).repartition("anchor", "salt")
    by_content = W.partitionBy("anchor", "salt", "content").orderBy("doc_id", "a")
    first = F.first(F.struct("doc_id", "a")).over(by_content)
    lead = F.row_number().over(by_content) == 1
    marked = (
        made.withColumn("later", F.struct("doc_id", "a") > first)
        .withColumn("lead", lead)
        .withColumn("contents", F.sum(F.col("lead").cast("int")).over(W.partitionBy("anchor", "salt")))
    )
    marked = saved(marked.filter("n = 0 or later or lead and (contents > 1 or salt <> 0)"))
    end = F.when(F.col("n") == 0, F.col("content")).otherwise(F.col("a") + F.col("n") + LENGTH - 1).cast("int")
    whole = marked.filter("n = 0 or later").select("doc_id", "a", end.alias("e"))
    want = F.struct("anchor", "a", "n", ((F.col("contents") > LARGE) | (F.col("salt") != 0)).alias("large"))
    wanted = marked.filter("n > 0 and not later").groupBy("doc_id").agg(F.collect_list(want).alias("wanted"))
    parts = saved(packed.join(wanted, "doc_id").mapInArrow(_cut_out, _PARTS))
    sort = parts.filter("kind = 1").select("key", "doc_id", "a", "seg").repartition("key").sortWithinPartitions("key")
    by_string = W.partitionBy("key", "anchor").orderBy("doc_id", "a")
    strings = (
        parts.filter("kind = 2")
        .select("doc_id", "a", (F.struct("doc_id", "a") > F.first(F.struct("doc_id", "a")).over(by_string)).alias("later"))
        .filter("later")
        .select("doc_id", "a", (F.col("a") + LENGTH).alias("e"))
    )
    gone = parts.filter("kind = 0").select("doc_id", "a", F.col("key").cast("int").alias("e"))
    return whole.unionByName(sort.mapInArrow(_sort, _SPANS)).unionByName(strings).unionByName(gone)


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``raw``, and the maximal runs that were removed."""
    runs: list[list[int]] = []
    for a, e in sorted(spans):
        e = min(e, len(raw))
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        elif a < e:
            runs.append([a, e])
    at, out = 0, []
    for a, e in runs:
        out.append(raw[at:a])
        at = e
    return b"".join([*out, raw[at:]]), [(a, e) for a, e in runs]


_KEPT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _keep(with_bytes: bool):
    def keep(batches):
        c = zstandard.ZstdDecompressor()
        for b in small(batches):
            rows = []
            for doc, z, spans in zip(*(b.column(k).to_pylist() for k in ("id", "z", "spans")), strict=True):
                raw = c.decompress(z) if z is not None else b""
                left, runs = kept_bytes(raw, [(s["a"], s["e"]) for s in spans or ()])
                rows.append((doc, len(raw), len(raw) - len(left), len(runs), left if with_bytes else None, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return keep


def numbered(docs: DataFrame) -> DataFrame:
    """id, doc_id, text: the doc_id as id, and as doc_id a number in its order, another one for each text of the same id."""
    key = F.coalesce(F.md5(F.col("text")), F.lit(""))
    ids = docs.select(F.col("doc_id").alias("id"), "text", key.alias("key"))
    known = ids.filter("id is not null")
    if not known.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").head(1):
        return docs.select(F.col("doc_id").alias("id"), "doc_id", "text")
    order = known.select("id", "key").distinct().repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    order = saved(order.withColumn("doc_id", F.monotonically_increasing_id()))
    return ids.join(order, ["id", "key"], "left").select("id", "doc_id", "text")


def dedup(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256 for each row of ``docs``(doc_id, text); kept is null unless ``with_bytes``."""
    ready(docs.sparkSession)
    docs = numbered(docs.select("doc_id", "text"))
    packed = docs.mapInArrow(_pack, "id long, doc_id long, z binary")
    one = packed.select("doc_id", "z").filter("doc_id is not null")
    spans = repeated_spans(docs, one).groupBy("doc_id").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    return packed.join(spans, "doc_id", "left").select("id", "z", "spans").mapInArrow(_keep(with_bytes), _KEPT).withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup(docs, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents where doc_id is not null),
w as (select doc_id, i, substring(h, cast(2 * i + 1 as int), 200) as s from (select *, unnest(range(0, n - 99)) as i from d)),
f as (select doc_id, i, first_value(doc_id) over o as d0, first_value(i) over o as i0 from w window o as (partition by s order by doc_id, i)),
r as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 100, true) as fresh from f where doc_id <> d0 or i <> i0),
g as (select doc_id, i, sum(cast(fresh as int)) over (partition by doc_id order by i) as k from r),
s as (select doc_id, k, min(i) as a, max(i) + 100 as e from g group by all),
p as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as before from s),
t as (select doc_id, cast(sum(e - a) as bigint) as n_removed, count(*) as n_spans, max(e) as last,
    string_agg(substring(h, cast(2 * before + 1 as int), cast(2 * (a - before) as int)), '' order by a) as head from p join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, cast(2 * coalesce(last, 0) + 1 as int)))) as kept_sha256
from d left join t using (doc_id)
"""
