r"""Jaccard self-join of documents on word shingles, with filters from several global token orders.

A text's words are the runs of ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, and its
set the distinct ``SHINGLE``-word shingles (the whole sequence if it is shorter;
empty without words). Two documents link when |A & B| / |A | B| >= ``SIMILAR`` / 100.

1. Documents with equal sets form a class, which joins as one, so copies are never
   expanded into pairs. A class is named by a 64-bit hash of its set's 128-bit
   digest, or by the digest itself should two classes get the same hash.
2. Frequent shingles are found by counting all shingles of all documents in a
   table of 2**``SKETCH`` cells. A token order sorts by the class of frequency of a
   token's cell, rare first, then by a hash; the orders differ in the hash. Any
   order is exact, the frequencies only make it selective.
3. In each order two documents that link share a token among the first
   n - ceil(t n) + 1 of each (n tokens, t = SIMILAR / 100). The first order makes
   candidates by a join on tokens; length and position filters apply, and the
   tokens that two prefixes share must be as many as the rest leaves to find. Of
   these pairs only those stay whose prefixes in every other order have a token in
   common, too: the filters are intersected on ids and prefixes, and only for what
   is left texts are joined and sets compared.
4. A token's documents are not all paired. First each meets only the group's
   hub, the one with the smallest share of its tokens before this one: an original
   has fewer tokens of its own than its edited copies. The links give components. Then only documents of
   different components which the filters still admit are paired. So every link
   is either verified or lies inside a component, and components are exact.
5. What a token's documents have in common (their number, hub, least size) comes
   from windows where the sketch proves the group small, and from partial
   aggregates and a join, whose large partitions Spark splits, where a cell counts
   over ``HOT_ROWS``.

Components come from alternating large and small stars. Texts travel compressed.

Defined cases: null and empty texts have the empty set and link with nothing; a
row with a null doc_id links with nothing and its component is null; each row of a
repeated doc_id is judged by its own text, and component_id is the smallest doc_id
of its component; an empty table gives an empty result. ``keep_first`` keeps of
each component the row with the smallest doc_id (then digest of the text), and of
rows with equal doc_id and text the first by the JSON of all columns. Other columns
are not read by ``join``; ``keep_first`` passes them through as one struct, so their
names cannot clash.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.llm.common import join_hot, ready, saved, small, table

SHINGLE, SIMILAR, SKETCH, ORDERS, CHUNKS, HOT_ROWS, BITS = 5, 75, 20, 3, 64, 100_000, 24
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_ORDER = [np.uint64(x) for x in (1, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = (s ^ (s >> np.uint64(32))) * _MIX[0] + h[j : len(h) - k + 1 + j] * _MIX[j]
    return np.unique((s ^ (s >> np.uint64(31))) * _MIX[1])


def n_needed(n: int) -> int:
    """The least overlap with which a set of n links to any set."""
    return -(-SIMILAR * n // 100)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= SIMILAR * (len(a) + len(b) - both)


def prefix(s: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 tokens of ``s`` in one of the orders."""
    cell = (s & np.uint64((1 << SKETCH) - 1)).astype(np.int64)
    key = s if order == 0 else (s ^ (s >> np.uint64(29))) * _ORDER[order]
    key = (level[cell].astype(np.uint64) << np.uint64(58)) | (key >> np.uint64(6))
    return s[np.argsort(key, kind="stable")[: len(s) - n_needed(len(s)) + 1]]


def levels(counts: np.ndarray) -> np.ndarray:
    """Frequency class of each cell of the sketch: 0 up to 4 standard deviations over the mean, then by powers of two."""
    mean = counts.mean() if len(counts) else 0.0
    over = np.maximum((counts - mean) / (4 * np.sqrt(mean + 1)), 0)
    return np.where(over < 1, 0, 1 + np.log2(np.maximum(over, 1)).astype(np.int64)).clip(0, 60).astype(np.uint8)


_SETS = "doc_id long, key string, n long, digest binary, chunk int, salt int, counts binary"


def _sets(batches):
    """A row for each document, and at the end the counts of this task's shingles, in chunks."""
    counts, z, salt = np.zeros(1 << SKETCH, np.uint32), zstandard.ZstdCompressor(), 0
    names = ["doc_id", "key", "n", "digest", "chunk", "salt", "counts"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())

    def batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    for b in small(batches):
        ids, n, digest = b.column("doc_id").to_pylist(), [], []
        for text in b.column("text").to_pylist():
            s = shingles(text)
            np.add.at(counts, (s & np.uint64((1 << SKETCH) - 1)).astype(np.int64), np.uint32(1))
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            salt = (salt + len(s)) % 32
        none = [None] * len(ids)
        yield batch((ids, b.column("key").to_pylist(), n, digest, none, none, none))
    blobs = [z.compress(c.tobytes()) for c in np.split(counts, CHUNKS)]
    none = [None] * CHUNKS
    yield batch((none, none, none, none, range(CHUNKS), [salt] * CHUNKS, blobs))


def _sum(pdf):
    unpack = zstandard.ZstdDecompressor().decompress
    total = np.zeros((1 << SKETCH) // CHUNKS, np.uint64)
    for blob in pdf["counts"]:
        raw = unpack(blob)
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(total) else np.uint64)
    return pdf.head(1)[["chunk"]].assign(counts=[zstandard.ZstdCompressor().compress(total.tobytes())])


def frequencies(made: DataFrame) -> np.ndarray:
    """The sketch of all documents, added up in two steps; CHUNKS rows of fixed size reach the driver."""
    part = made.filter("chunk is not null")
    kind = "chunk int, counts binary"
    part = part.groupBy("chunk", "salt").applyInPandas(_sum, kind).groupBy("chunk").applyInPandas(_sum, kind)
    unpack = zstandard.ZstdDecompressor().decompress
    rows = sorted(part.collect(), key=lambda r: r.chunk)
    return np.concatenate([np.frombuffer(unpack(r.counts), np.uint64) for r in rows]).astype(float) if rows else np.zeros(1 << SKETCH)


def _name(digest: bytes, narrow: bool) -> int | str:
    """A class's name, as Spark's xxhash64 or hex of its digest."""
    return int.from_bytes(xxhash.xxh64_digest(digest, seed=42), "big", signed=True) if narrow else digest.hex().upper()


def _prefix_rows(held, narrow: bool):
    def rows(batches):
        (level, hot), seen = held.value, set()
        for b in small(batches):
            tokens, names, sizes, places = [], [], [], []
            if len(seen) > 1 << 17:
                seen.clear()
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(text) if doc is not None else ()
                if not len(s) or (digest := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue  # an equal set before stands for it
                seen.add(digest)
                p = prefix(s, level, 0)
                tokens.append(p)
                names += [_name(digest, narrow)] * len(p) if not narrow else []
                sizes.append(np.full(len(p), len(s), np.int32))
                places.append(np.arange(len(p), dtype=np.int32))
                if narrow:
                    names.append(np.full(len(p), _name(digest, narrow), np.int64))
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            token = join(tokens, np.uint64)
            name = pa.array(join(names, np.int64) if narrow else names, pa.int64() if narrow else pa.string())
            warm = pa.array(hot[(token & np.uint64((1 << SKETCH) - 1)).astype(np.int64)])
            cols = [pa.array(token.view(np.int64)), name, pa.array(join(sizes, np.int32)), pa.array(join(places, np.int32)), warm]
            yield pa.RecordBatch.from_arrays(cols, ["token", "rep", "n", "i", "hot"])

    return rows


def _pack(held, bits):
    """Of the rows whose bit is set: texts compressed, with the prefixes of all orders but the first as 32-bit hashes (a collision can only keep a pair)."""

    def pack(batches):
        (level, _), wanted = held.value, np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little")
        c = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in small(batches):
            b = b.filter(pa.array(wanted[b.column("bit").to_numpy()] == 1))
            raws, prefixes = [], []
            for text in b.column("text").to_pylist():
                s = shingles(text)
                raws.append(c.compress((text or "").encode("utf-8", "replace")))
                prefixes.append([(prefix(s, level, k) >> np.uint64(32)).astype(np.uint32).view(np.int32) for k in range(1, ORDERS)])
            cols = [b.column("doc_id"), b.column("key"), pa.array(raws, pa.binary()), pa.array(prefixes, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "z", "p"])

    return pack


def _bit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bit", F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << BITS)))


def _bitmaps(rows: DataFrame) -> DataFrame:
    """n, bits: a bit table of the rows (doc_id, key) in maps of 2**15 bits, together 2**BITS bits whatever the rows: it lets some others through, and none of them is missed."""
    place = F.col("bit") + 1  # buckets and places count from 1
    return _bit(rows).groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def _bitmap(rows: DataFrame):
    """The bit table of ``_bitmaps`` for Python workers."""
    size, table = 4096, bytearray((1 << BITS) // 8)  # bytes of one of Spark's bitmaps, and of all
    for r in _bitmaps(rows).collect():
        table[(r.n - 1) * size : r.n * size] = r.bits
    return rows.sparkSession.sparkContext.broadcast(bytes(table))


def _verify(batches):
    unpack = zstandard.ZstdDecompressor().decompress

    @lru_cache(256)
    def known(z: bytes):
        return shingles(unpack(z).decode("utf-8"))

    for b in small(batches):
        out = [links(known(za), known(zb)) for za, zb in zip(b.column("za").to_pylist(), b.column("zb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])


def _needed() -> Column:
    """The least overlap of sets of na and nb tokens that link."""
    return F.ceil(SIMILAR * (F.col("na") + F.col("nb")) / (100 + SIMILAR))


def _admits() -> Column:
    """Lengths na and nb and the places ia and ib of a shared token, if no earlier one is shared, leave room for the overlap."""
    near = 100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")
    return near & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= _needed())


def _shares() -> Column:
    """ta and tb, the tokens of both prefixes that any two documents share, have enough in common.

    The prefix that ends first holds all shared tokens up to its end; after it come ceil(t n) - 1 tokens at most.
    """
    after = F.greatest(*[F.ceil(SIMILAR * F.col(n) / 100) for n in ("na", "nb")]) - 1
    return F.size(F.array_intersect("ta", "tb")) >= F.greatest(_needed() - after, F.lit(1))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of ``edges``(a, b) reaches."""
    edges = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = saved(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def _told(rows: DataFrame, hot: bool, **aggs: Column) -> DataFrame:
    """``rows`` with aggregates over the rows of its token: by windows, or for hot tokens, if there are any, by partial aggregates and a join."""
    over = (rows.filter("not hot") if hot else rows).select("*", *[c.over(W.partitionBy("token")).alias(k) for k, c in aggs.items()])
    if not hot:
        return over
    hot = rows.filter("hot")
    return over.unionByName(hot.join(hot.groupBy("token").agg(*[c.alias(k) for k, c in aggs.items()]), "token"))


def _linked(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, component, component_id for each row of ``docs``(doc_id, text).

    ``key`` is a digest of the text; the component's name is null for rows that link with nothing because they have no
    doc_id or no shingles.
    """
    ready(docs.sparkSession)
    docs = docs.select("doc_id", "text", _text_key(F.col("text")).alias("key"))
    made = saved(docs.mapInArrow(_sets, _SETS))
    counts = frequencies(made)
    warm = counts > HOT_ROWS
    held, hot = docs.sparkSession.sparkContext.broadcast((levels(counts), warm)), bool(warm.any())  # 2 * 2**SKETCH bytes
    sets = made.filter("chunk is null").select("doc_id", "key", "n", "digest")
    lead = F.min(F.struct("doc_id", "key")).alias("lead")
    classes = saved(sets.filter("doc_id is not null and n > 0").groupBy("digest").agg(lead, F.count("*").alias("copies")))
    narrow = classes.select(F.xxhash64("digest")).distinct().count() == classes.count()
    classes = classes.withColumn("rep", F.xxhash64("digest") if narrow else F.hex("digest"))
    kind = "long" if narrow else "string"

    rows = docs.mapInArrow(_prefix_rows(held, narrow), f"token long, rep {kind}, n int, i int, hot boolean").repartition("token")
    again = (rows.filter("not hot") if hot else rows).withColumn("size", F.count("*").over(W.partitionBy("token"))).filter("size > 1").drop("size")
    least = [F.min(c).alias(c) for c in ("n", "i")]
    shared = again.groupBy("token", "rep", "hot").agg(*least)
    shared = saved(shared.unionByName(rows.filter("hot").groupBy("token", "rep", "hot").agg(*least))) if hot else shared
    hub = F.min(F.struct((F.col("i") / F.col("n")).alias("share"), "rep", "n", "i"))
    shared = saved(_told(shared, hot, size=F.count("*"), hub=hub).filter("size > 1"))
    lists = saved(shared.groupBy("rep").agg(F.collect_set("token").alias("tokens")))

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b, linked for each of ``pairs`` that shares enough tokens in the first order; linked is true only if all orders and the sets agree."""
        for end in "ab":
            pairs = pairs.join(lists.select(F.col("rep").alias(end), F.col("tokens").alias(f"t{end}")), end)
        pairs = saved(pairs.filter(_shares()).select("a", "b"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        wanted = saved(classes.join(wanted, "rep").select("rep", F.col("lead.doc_id").alias("doc_id"), F.col("lead.key").alias("key")))
        texts = _bit(docs).mapInArrow(_pack(held, _bitmap(wanted)), "doc_id long, key string, z binary, p array<array<int>>")
        packed = saved(texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["rep"]).select("rep", "z", "p"))
        left = pairs
        for end in "ab":
            left = left.join(packed.select(F.col("rep").alias(end), F.col("p").alias(f"p{end}")), end)
        every = [F.arrays_overlap(F.col("pa")[k], F.col("pb")[k]) for k in range(ORDERS - 1)]
        left = saved(left.filter(reduce(and_, every)).select("a", "b"))
        for end in "ab":
            left = left.join(packed.select(F.col("rep").alias(end), F.col("z").alias(f"z{end}")), end)
        return saved(left.select("a", "b", "za", "zb").mapInArrow(_verify, f"a {kind}, b {kind}, linked boolean"))

    star = shared.filter("rep <> hub.rep").selectExpr(  # the smaller name first, so that a pair comes once
        "inline(array(if(hub.rep < rep, struct(hub.rep as a, hub.n as na, hub.i as ia, rep as b, n as nb, i as ib), "
        "struct(rep as a, n as na, i as ia, hub.rep as b, hub.n as nb, hub.i as ib))))"
    )
    met = star.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("na", "nb", "ia", "ib")]).filter(_admits())
    first = verified(met)
    found = components(first.filter("linked").select("a", "b"))

    # what is left: pairs of different components, if the filters can admit them at this token
    before = F.lag("token").over(W.partitionBy("rep").orderBy("i"))
    own = shared.select("token", "rep", "n", "i", "hot", before.alias("before")).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.withColumn("component", F.coalesce("component", "rep"))
    own = _told(own, hot, least_n=F.min("n"), low=F.min("component"), high=F.max("component")).filter("low <> high")
    # its place i leaves room for an overlap with the shortest set of the group
    own = own.filter(F.col("n") - F.col("i") >= F.ceil(SIMILAR * (F.col("n") + F.greatest(F.col("least_n"), F.ceil(SIMILAR * F.col("n") / 100))) / (100 + SIMILAR)))
    own = saved(own.select("token", "rep", "n", "i", "component", "before"))
    x = own.selectExpr("token", "rep as a", "n as na", "i as ia", "component as ca", "before as ba")
    y = own.selectExpr("token", "rep as b", "n as nb", "i as ib", "component as cb", "before as bb")
    # two that have the same token before this one share an earlier one, and meet there
    new = F.col("ba").isNull() | F.col("bb").isNull() | (F.col("ba") != F.col("bb"))
    rest = x.join(y, (x.token == y.token) & (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & new & _admits())
    rest = rest.select("a", "na", "b", "nb").distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = verified(rest)
    found = components(first.unionByName(second).filter("linked").select("a", "b"))

    named = classes.join(found, classes.rep == found.node, "left").select(
        "digest", "copies", F.col("lead.doc_id").alias("least"), F.coalesce("component", "rep").alias("component")
    )
    named = saved(named)
    smallest = saved(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = saved(join_hot(named, smallest, "component", "n").select("digest", "copies", "component", "component_id"))
    able = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = ["doc_id", "key", "n", "component", "component_id"]
    alone = sets.filter(~able).select("doc_id", "key", "n", F.lit(None).cast(kind).alias("component"), F.col("doc_id").alias("component_id"))
    return join_hot(sets.filter(able), named, "digest", "copies").select(*out).unionByName(alone)


def _text_key(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit(""))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``(doc_id, text)."""
    return _linked(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, with all columns, for each component: that with the smallest doc_id; rows without doc_id stay."""
    out = saved(_linked(docs).filter("doc_id is not null").select("doc_id", "key", "component"))
    first = saved(out.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("n")))
    gone = join_hot(out, first, "component", "n").filter(F.struct("doc_id", "key") != F.col("first")).select("doc_id", "key", F.lit(True).alias("gone"))
    twice = out.groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key", F.lit(False).alias("gone"))
    marks = saved(gone.unionByName(twice).groupBy("doc_id", "key").agg(F.max("gone").alias("gone")))
    # only rows whose bit is set can be marked: the others need no shuffle
    rows = _bit(docs.select(F.struct("*").alias("row"), "doc_id", _text_key(F.col("text")).alias("key")))
    rows = rows.withColumn("n", F.floor(F.col("bit") / (1 << 15)) + 1).join(F.broadcast(_bitmaps(marks)), "n", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit % 32768 / 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("shiftright(byte, cast(bit % 8 as int)) % 2") == 1, F.lit(False))
    rows = rows.withColumn("byte", byte).withColumn("is_set", is_set)
    clear = rows.filter("not is_set").select("row")
    rows = rows.filter("is_set").select("row", "doc_id", "key").join(marks, ["doc_id", "key"], "left")
    kept = clear.unionByName(rows.filter("gone is null").select("row"))
    if marks.filter("not gone").head(1):
        again = rows.filter("not gone").groupBy("doc_id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.unionByName(again.select("row"))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from w where w is not null),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from documents where doc_id is not null union select e.b, r.c from r join e on e.a = r.doc_id and r.c < e.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(c) from r where r.doc_id = d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id
"""
