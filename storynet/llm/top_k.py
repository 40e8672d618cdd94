"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put into ``BUCKETS`` buckets of similar length (quantiles), and a
bucket is cut by a hash of the id into groups of about ``CELL_BYTES`` at most, so
that copies of one vector cannot make a group large. Queries come in blocks of the
same size; a block meets a group in one task. First each block meets one group of
the longest vectors, which gives every query a lower bound t of its k-th score,
so that q needs vectors of a length of at least t / |q|. A query is then sent only
to the groups of buckets that reach its length, and a vector only to the blocks of
which some query's length its bucket reaches. In each group with greatest length
l, a query needs a cosine of at least t / (|q| l): if it is at least
``COORDINATE_FROM``, the vectors must lie in the intervals that this cosine leaves
for q's largest coordinates (found in sorted coordinate lists); else they must have
a length of at least t / |q|. What is left is verified by its inner product.
Pruning keeps a slack far above rounding errors, so results are exact. Each group
returns k rows a query, and these are ranked.

A number of queries that grows with the table makes work that grows with its
square, less what is pruned. What is shuffled is not the pairs: with cells of c
vectors, n vectors and m queries are sent n * m / c + m * n / c rows at most.

Defined cases: a null vector or one with a null, NaN or infinite component takes
no part, neither does a null id; the table's vectors have the length that most of
them have (the greater one of two), and vectors of another length, empty ones
too, take no part; rows that repeat a vec_id are candidates and queries of their
own, and a query leaves out its own row only (of rows that agree in id and vector,
one is its own); equal scores go to the smaller id; fewer candidates than k give fewer rows; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.llm.common import saved, table

BUCKETS, CELL_BYTES, COORDINATE_FROM, COORDINATES, SLACK = 32, 4 << 20, 0.2, 4, 1e-6
_OUT = "query_id long, own long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors``(vec_id, v) that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


class Bucket:
    """A group of vectors with what pruning needs; lists of a coordinate are sorted when first asked for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.rows = np.zeros(len(ids), np.int64) if rows is None else rows[order]
        self.norm = np.sqrt((self.x**2).sum(1))
        self.longest = self.norm.max()
        self.unit = self.x / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def survivors(self, q: np.ndarray, bound: float) -> np.ndarray | None:
        """Places of vectors whose product with q may reach ``bound``; None for all."""
        size = math.sqrt(float(q @ q))
        if bound <= 0 or size == 0 or not math.isfinite(bound):
            return None
        cosine = bound / (size * self.longest) - SLACK if self.longest > 0 else 2.0
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine < COORDINATE_FROM:
            return np.flatnonzero(self.norm >= bound / size * (1 - SLACK))
        unit = q / size
        spans = []
        for f in np.argsort(-np.abs(unit))[:COORDINATES]:
            c = float(unit[f])
            spread = math.sqrt(max(0.0, (1 - cosine**2) * (1 - c * c)))
            low = -1.0 if -c >= cosine else c * cosine - spread
            high = 1.0 if c >= cosine else c * cosine + spread
            order, values = self.column(int(f))
            a, b = np.searchsorted(values, low - SLACK, "left"), np.searchsorted(values, high + SLACK, "right")
            spans.append((b - a, a, b, int(f), low, high))
        spans.sort()
        _, a, b, f, *_ = spans[0]
        left = self.column(f)[0][a:b]
        for *_, f, low, high in spans[1:]:
            u = self.unit[left, f]
            left = left[(u >= low - SLACK) & (u <= high + SLACK)]
        return np.sort(left)

    def best(self, own: int, q: np.ndarray, bound: float, k: int, row: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but the row ``row`` of the id ``own``, smaller ids first among equals."""
        at = self.survivors(q, bound)
        ids, rows, score = (self.ids, self.rows, self.x @ q) if at is None else (self.ids[at], self.rows[at], self.x[at] @ q)
        other = (ids != own) | (rows != row)
        ids, score = ids[other], score[other]
        if len(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[score >= least], score[score >= least]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def _meet(k: int):
    def meet(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(vectors) and len(queries):
            bucket = Bucket(vectors["vec_id"].to_numpy(), _matrix(vectors["v"]), vectors["row"].to_numpy())
            for name, row, q, bound in zip(queries["query_id"], queries["own"], _matrix(queries["v"]), queries["bound"], strict=True):
                ids, score = bucket.best(name, q, bound, k, row)
                parts.append(pd.DataFrame({"query_id": name, "own": row, "vec_id": ids, "score": score}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "own": [], "vec_id": [], "score": []}).astype({c: "int64" for c in ("query_id", "own", "vec_id")})

    return meet


def _pass(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each group for each query; ``vectors``(group, blocks, vec_id, row, v), ``queries``(block, groups, query_id, own, v, bound)."""
    left = vectors.select("group", F.explode("blocks").alias("block"), "vec_id", "row", "v")
    right = queries.select("block", F.explode("groups").alias("group"), "query_id", "own", "v", "bound")
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInPandas(_meet(k), _OUT)


def _numbered(vectors: DataFrame, length: int) -> DataFrame:
    """vec_id, v, row, norm of the vectors of a length, saved. ``row`` tells rows of one id apart, alike in vectors and queries: a digest of the vector and which of its copies it is."""
    sized = vectors.filter(F.size("v") == length)
    again = F.row_number().over(W.partitionBy("vec_id", "v").orderBy(F.lit(1)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return saved(sized.withColumn("again", again).select("vec_id", "v", F.xxhash64("again", "v").alias("row"), norm.alias("norm")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors``(vec_id, v) for each row of ``queries``(vec_id, v)."""
    vectors, queries = (usable(df).select("vec_id", F.col("v").cast("array<double>").alias("v")) for df in (vectors, queries))
    common = vectors.filter(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = common.n if common else -1
    vectors, queries = _numbered(vectors, length), _numbered(queries, length)
    n, n_queries, cell = vectors.count(), queries.count(), max(CELL_BYTES // (8 * max(length, 1)), 1)
    n_buckets = max(1, min(BUCKETS, n // 256))
    cuts = sorted(set(vectors.approxQuantile("norm", [i / n_buckets for i in range(1, n_buckets)], 0.01))) if n_buckets > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("norm"))) if cuts else F.lit(0)
    vectors = vectors.withColumn("bucket", bucket)
    seen = {r.bucket: r for r in vectors.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}  # BUCKETS at most
    rows = min(cell, max(256, n // 32))
    numbers = range(len(cuts) + 1)
    parts = [-(-seen[b].n // rows) if b in seen else 1 for b in numbers]
    longest = list(accumulate((seen[b].longest if b in seen else 0.0 for b in numbers), max))  # an empty bucket has the one before's
    first = [sum(parts[:b]) for b in numbers]
    blocks = max(1, -(-n_queries // cell))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    group = (of(first) + F.pmod(F.xxhash64("vec_id", "row"), of(parts))).cast("int")
    grouped = vectors.select(group.alias("group"), "bucket", "vec_id", "row", "v")
    block = F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int")
    asked = queries.select(block.alias("block"), F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "v", "norm")
    none = float("-inf")

    probe = grouped.filter(F.col("group") == first[-1]).withColumn("blocks", F.sequence(F.lit(0), F.lit(blocks - 1)))
    probed = _pass(probe, asked.select("*", F.lit(none).alias("bound"), F.array(F.lit(first[-1])).alias("groups")), k)
    bounds = probed.groupBy("query_id", "own").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("bound"))
    asked = asked.join(bounds, ["query_id", "own"], "left").fillna(none, ["bound"])
    need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm") * (1 - SLACK)).otherwise(0.0)
    asked = saved(asked.withColumn("need", need))
    reach = F.size(F.filter(F.array(*map(F.lit, longest)), lambda x: x < F.col("need")))  # buckets are in order of length
    from_group = F.element_at(F.array(*map(F.lit, [*first, sum(parts)])), reach + 1)
    groups = F.when(from_group < sum(parts), F.sequence(from_group, F.lit(sum(parts) - 1)))
    needs = {r.block: r.need for r in asked.groupBy("block").agg(F.min("need").alias("need")).collect()}  # a row for each block
    met = [[b for b in range(blocks) if b in needs and needs[b] <= x] for x in longest]
    by_bucket = F.array(*[F.array(*map(F.lit, m)).cast("array<int>") for m in met])
    found = _pass(grouped.withColumn("blocks", F.element_at(by_bucket, F.col("bucket") + 1)), asked.withColumn("groups", groups), k)
    rank = F.row_number().over(W.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    raw = usable(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))).withColumnRenamed("v", "embedding")
    vectors = raw.select("vec_id", v.alias("v"))
    found = top_k(vectors, vectors.filter("vec_id % 50 = 0"))
    return found.withColumn("score", F.col("score").cast("long"))


SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 5
"""
