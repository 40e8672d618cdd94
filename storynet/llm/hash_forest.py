"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

Every vector gets ``TREES`` hash strings of ``BITS`` signs of random projections. For
products of vectors of any length, a vector x is first made x / m with one more
component, so that all get length 1 (m: the greatest length); a query's additional
component is 0. A tree is the array of all vectors sorted by one string, dealt out in
cells: ranges of strings, cut where a sample of the strings has its quantiles. All
vectors are in every tree.

A query descends each tree to the longest prefix that it shares with a string there,
then all trees ascend together, one character at a time, until the prefixes of one
length hold enough vectors over all trees. How many share a prefix is counted in the
sample. The vectors under that prefix are a range of a tree's array: the query goes to
the cells which the range meets, a binary search in the sorted cell gives the range,
and its products are computed there. Each cell returns its ``k`` best, and these are
ranked after a vector found in several trees is counted once.

How many vectors are enough is fitted too: for up to ``ASKED`` of the queries the true
neighbours are found by one pass over all vectors, the prefix lengths at which the
trees hold them are known, and the ascent gets the least number with which a part of
``RECALL`` of those neighbours is found. Vectors without structure so need a large part
of all rows; clustered ones need few.

Copies of a vector are one entry, with its ``k`` + 1 smallest ids: no more of them can
be among the ``k`` nearest. Queries that are copies are asked once. So copies make no
range long, and a range of different vectors with one string is cut by a hash.

Bounds: the sample has about ``SAMPLE`` strings a tree (all, if there are fewer rows)
and goes to the tasks with the projections; of the fit, the driver sees ``ASKED`` times
``k`` rows. Everything else grows with the table in Spark: the entries are sent once
for each tree, queries once for each cell that they need.

Defined cases: a null id or vector, a zero vector, or a null, NaN or infinite component
takes no part; the table's vectors have the length that most of them have (the greater
one of two), others take no part; rows that repeat an id are rows of their own, and
only a query's own row is left out; equal products go to the smaller id; fewer
candidates than ``k`` give fewer rows; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storynet.llm.cells import CELL_BYTES, best, finite, matrix, met, numbered, of_one_length, rows_of_cell
from storynet.llm.common import saved, small, table

TREES, BITS, SEED, K = 16, 62, 1, 20
SAMPLE, ASKED, RECALL = 16_384, 256, 0.96
#: Copies of an entry are told apart by 128 bits of its components.
_KEY = ["key_a", "key_b"]


@dataclass
class Forest:
    """What hashes vectors, and the sample's sorted strings of each tree."""

    planes: np.ndarray  # trees x bits x (size + 1)
    longest: float
    scale: float = 1.0  # vectors for each one of the sample
    strings: np.ndarray | None = None  # trees x sampled strings, sorted
    enough: float = 0.0
    cuts: tuple[np.ndarray, ...] = ()  # first string of each cell but the first, by tree
    parts: tuple[np.ndarray, ...] = ()  # pieces of each cell

    def hashes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """The strings of the rows of ``x`` in every tree, as whole numbers."""
        if query:
            more = np.zeros(len(x))
        else:
            x = x / self.longest
            more = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        x = np.column_stack([x, more])
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t, plane in enumerate(self.planes):
            signs = x @ plane.T > 0
            for b in range(signs.shape[1]):
                out[:, t] = out[:, t] << 1 | signs[:, b]
        return out

    def counts(self, asked: np.ndarray) -> np.ndarray:
        """queries x prefix lengths (0 to all bits): vectors that share a prefix of that length, summed over the trees."""
        bits = self.planes.shape[1]
        out = np.zeros((len(asked), bits + 1))
        for length in range(bits + 1):
            low, high = prefix(asked, length, bits)
            for t, strings in enumerate(self.strings):
                out[:, length] += np.searchsorted(strings, high[:, t], "right") - np.searchsorted(strings, low[:, t], "left")
        return out * self.scale


def depth(counts: np.ndarray, enough: float) -> np.ndarray:
    """The prefix length at which each query's ascent ends; 0, a whole tree, if nothing longer holds enough."""
    held = counts >= enough
    held[:, 0] = True
    return held.shape[1] - 1 - held[:, ::-1].argmax(1)


def prefix(strings: np.ndarray, length: np.ndarray | int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest string that share the first ``length`` characters."""
    rest = (np.int64(1) << (bits - np.asarray(length, np.int64))) - 1
    return strings & ~rest, strings | rest


def shared(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the common prefix of strings."""
    rest, length = a ^ b, np.zeros(np.broadcast(a, b).shape, np.int64)
    for at in range(1, bits + 1):
        length += rest >> (bits - at) == 0
    return length


def _longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def _entries(vectors: DataFrame, queries: str, k: int) -> tuple[DataFrame, DataFrame]:
    """One row for each different vector, with its smallest ids; and the query rows with the key of their vector."""
    keyed = vectors.withColumns({"key_a": F.xxhash64("v"), "key_b": F.xxhash64(F.lit(1), "v")})
    order = F.row_number().over(W.partitionBy(*_KEY).orderBy("vec_id", "row"))
    asks = keyed.filter(queries)
    first = keyed.withColumn("place", order).filter(F.col("place") <= k + 1)
    entries = first.groupBy(*_KEY).agg(F.first("v").alias("v"), F.collect_list(F.struct("vec_id", "row")).alias("ids"))  # k + 1 at most
    flagged = entries.join(asks.select(*_KEY).distinct().withColumn("asks", F.lit(True)), _KEY, "left")
    return flagged.withColumn("asked", F.coalesce("asks", F.lit(False))).drop("asks"), asks.select(*_KEY, "vec_id", "row")


def _hashed(entries: DataFrame, forest: Forest) -> DataFrame:
    """The entries with their strings, those of the questions too."""
    strings = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("h", "qh")]
    schema = T.StructType([*entries.schema.fields, *strings])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = matrix(batch.column("v"))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(forest.hashes(x, False)), _lists(forest.hashes(x, True))], schema.names)

    return entries.mapInArrow(add, schema)


def _nearest(entries: DataFrame, asked: list, k: int) -> DataFrame:
    """The ``k`` nearest entries of a bounded set of questions, by one pass over all."""
    q, keys = np.array([r.v for r in asked], np.float64), np.array([[r.key_a, r.key_b] for r in asked], np.int64)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            score = q @ matrix(batch.column("v")).T
            own = np.stack([batch.column(c).to_numpy() for c in _KEY], 1)
            h, out = batch.column("h"), []
            for i, s in enumerate(score):
                s = np.where((own == keys[i]).all(1), -np.inf, s)
                out += [(i, s[j], h[j].as_py()) for j in best(s, own[:, 0], k) if s[j] > -np.inf]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] or [pa.array([], t) for t in (pa.int64(), pa.float64(), pa.list_(pa.int64()))], ["question", "score", "h"])

    found = entries.mapInArrow(look, "question long, score double, h array<bigint>")
    return found.withColumn("place", F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "h"))).filter(F.col("place") <= k)


def _fit(entries: DataFrame, forest: Forest, n: int, size: int, k: int, recall: float) -> None:
    """Sample's strings, the number that is enough, and the cells."""
    bits = forest.planes.shape[1]
    mix = lambda seed: F.pmod(F.xxhash64(F.lit(seed), *_KEY), F.lit(1 << 30))
    taken = entries.filter(mix(2) < F.lit(int(SAMPLE / max(n, SAMPLE) * (1 << 30))))
    strings = np.array([r.h for r in taken.select("h").collect()], np.int64).reshape(-1, len(forest.planes))
    forest.strings, forest.scale = np.sort(strings.T, axis=1), max(n, 1) / max(len(strings), 1)
    asked = entries.filter("asked").orderBy(mix(3), *_KEY).limit(ASKED).select(*_KEY, "v", "qh").collect()
    if asked:
        own = np.array([r.qh for r in asked], np.int64)
        true = _nearest(entries, asked, k).select("question", "h").collect()  # ASKED * k rows
        at = np.array([r.question for r in true], np.int64)
        agree = shared(own[at], np.array([r.h for r in true], np.int64).reshape(-1, len(forest.planes)), bits).max(1) if true else np.zeros(0)
        counts = forest.counts(own)
        for enough in n * len(forest.planes) * 0.5 ** (np.arange(160)[::-1] / 4):
            forest.enough = float(enough)
            if not true or (agree >= depth(counts, enough)[at]).mean() >= recall:
                break
    rows = rows_of_cell(size, n)
    step = max(1, int(rows / forest.scale))
    cuts, parts = [], []
    for s in forest.strings:
        first = np.unique(s[step::step]) if len(s) > step else s[:0]
        held = np.diff(np.concatenate([[0], np.searchsorted(s, first, "left"), [len(s)]])) * forest.scale
        cuts.append(first)
        parts.append(np.maximum(1, np.ceil(held / (2 * rows))).astype(np.int64))
    forest.cuts, forest.parts = tuple(cuts), tuple(parts)


class Cell:
    """A cell's entries, sorted by their strings."""

    def __init__(self, rows: pa.Table):
        h = rows.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        self.h, self.x = h[order], matrix(rows.column("v"))[order]
        self.keys = np.stack([rows.column(c).to_numpy()[order] for c in _KEY], 1)
        self.least = rows.column("least").to_numpy()[order]


def _answer(bits: int, k: int):
    names = ["ask_a", "ask_b", *_KEY, "score"]

    def answer(cell: Cell, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low, high = prefix(asked.column("h").to_numpy(), asked.column("depth").to_numpy(), bits)
        start, end = np.searchsorted(cell.h, low, "left"), np.searchsorted(cell.h, high, "right")
        q, keys, out = matrix(asked.column("v")), np.stack([asked.column(c).to_numpy() for c in _KEY], 1), []
        spans, which = np.unique(np.stack([start, end], 1), axis=0, return_inverse=True)
        for span, (a, b) in enumerate(spans):
            x, own = cell.x[a:b], np.flatnonzero(which == span)
            for some in np.array_split(own, -(-len(own) * (b - a) * 8 // CELL_BYTES)) if a < b else []:
                score = q[some] @ x.T
                near = np.partition(score, -k, axis=1)[:, -k] if b - a > k else np.full(len(some), -np.inf)
                for i, row, least in zip(some, score, near, strict=True):
                    at = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least))) if b - a > k else np.arange(b - a)
                    exact = (x[at] * q[i]).sum(1)  # summed in one order, so that equal vectors get equal scores
                    place = best(exact, cell.least[at + a], k)
                    out.append((np.repeat(keys[i : i + 1], len(place), 0), cell.keys[at[place] + a], exact[place]))
        if out:
            a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*a.T, *b.T, s)], names)

    return answer


def _questions(hashed: DataFrame, forest: Forest) -> DataFrame:
    """Each question once for each cell and piece that its range meets."""
    bits = forest.planes.shape[1]

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1 << 18):
            asked = _longs(batch.column("qh"))
            length = depth(forest.counts(asked), forest.enough)
            low, high = prefix(asked, length[:, None], bits)
            places = []
            for t, cuts in enumerate(forest.cuts):
                a, b = np.searchsorted(cuts, low[:, t], "right"), np.searchsorted(cuts, high[:, t], "right")
                for i in np.flatnonzero(length > 0) if t else range(len(asked)):  # one tree holds all
                    places += [(i, t, c, p) for c in range(a[i], b[i] + 1) for p in range(forest.parts[t][c])]
            if not places:
                continue
            i, t, c, p = np.array(places, np.int64).T
            columns = [pa.array(t), pa.array(c), pa.array(p), pa.array(asked[i, t]), pa.array(length[i])]
            rows = batch.select([*_KEY, "v"]).take(pa.array(i))
            yield from small([pa.RecordBatch.from_arrays([*columns, *rows.columns], ["tree", "cell", "part", "h", "depth", *_KEY, "v"])])

    kind = hashed.schema["v"].dataType.simpleString()
    return hashed.filter("asked").select(*_KEY, "v", "qh").mapInArrow(send, f"tree long, cell long, part long, h long, depth long, key_a long, key_b long, v {kind}")


def _placed(hashed: DataFrame, forest: Forest) -> DataFrame:
    """Each entry once for each tree, with its cell."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            h, mix = _longs(batch.column("h")), batch.column("key_b").to_numpy()
            cell = np.stack([np.searchsorted(cuts, h[:, t], "right") for t, cuts in enumerate(forest.cuts)], 1)
            part = np.stack([mix % forest.parts[t][cell[:, t]] for t in range(h.shape[1])], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(cell), _lists(part)], [*batch.schema.names, "cells", "pieces"])

    rows = hashed.select(*_KEY, "v", "h", F.element_at("ids", 1)["vec_id"].alias("least"))
    kind = hashed.schema["v"].dataType.simpleString()
    out = rows.mapInArrow(place, f"key_a long, key_b long, v {kind}, h array<bigint>, least long, cells array<bigint>, pieces array<bigint>")
    each = out.select(*_KEY, "v", "least", F.posexplode(F.arrays_zip("h", "cells", "pieces")).alias("tree", "z"))
    return each.select(F.col("tree").cast("long").alias("tree"), F.col("z.cells").alias("cell"), F.col("z.pieces").alias("part"), F.col("z.h").alias("h"), "least", *_KEY, "v")


def search(vectors: DataFrame, queries: str, k: int = K, trees: int = TREES, bits: int = BITS, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of ``vectors``(vec_id, v) for its rows of which the SQL condition ``queries`` holds."""
    some = F.exists("v", lambda x: x != 0)
    plain, size = of_one_length(finite(vectors.select("vec_id", "v"), "vec_id").filter(some))
    rows = numbered(plain)
    entries, asks = _entries(rows, queries, k)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest = rows.agg(F.max(length)).first()[0] or 1.0
    planes = np.random.default_rng(seed).standard_normal((trees, bits, size + 1))
    forest = Forest(planes, longest)
    hashed = saved(_hashed(entries, forest))
    _fit(hashed, forest, hashed.count(), size, k, recall)

    found = met(_placed(hashed, forest), _questions(hashed, forest), ["tree", "cell", "part"], Cell, _answer(bits, k + 1), "ask_a long, ask_b long, key_a long, key_b long, score double")
    once = found.groupBy("ask_a", "ask_b", *_KEY).agg(F.max("score").alias("score"))
    ids = once.join(hashed.select(*_KEY, "ids"), _KEY).select("ask_a", "ask_b", "score", F.inline("ids"))
    order = W.partitionBy("ask_a", "ask_b").orderBy(F.desc("score"), "vec_id", "row")
    near = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)  # one more, for the query's own row
    asks = asks.select(F.col("key_a").alias("ask_a"), F.col("key_b").alias("ask_b"), F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    answers = asks.join(near.drop("place"), ["ask_a", "ask_b"]).filter(F.col("row") != F.col("own"))
    rank = F.row_number().over(W.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")), "vec_id % 20 = 0")
