"""Clusters around centroids, with the nearest one found by the threshold algorithm.

Every dimension has the list of all centroids sorted by their value there. From a
vector's own value two pointers walk that list outward, so that each step reads the
dimension's next nearest centroid. A centroid that is read for the first time, in
whichever dimension, gets its exact distance. A centroid not yet read is at least as
far in every dimension as what the walk would read next there, so the squares of
these frontier distances sum to a lower bound; a vector stops as soon as this sum is
strictly greater than its best distance. Equal sums go on, so ties are seen and go to
the smaller number.

The vectors are integers and all sums are integers, so results are exact and do not
depend on how rows are dealt out. Centroids (``k`` times ``size`` numbers, both
parameters) go to the tasks with the function; a task returns ``k`` partial sums,
which Spark adds up. The vectors are saved once and read once for each round; nothing
is shuffled but those sums.

Defined cases: a null vector, one of another length than ``size`` or one with a null,
NaN or infinite component is no row of the result; of rows with a null id each is
assigned like any other, but they are the last to become centroids; rows that repeat
an id are rows of their own (as centroids, the least vector in array order first);
with fewer vectors than ``k`` there are fewer centroids; a centroid without vectors
stays; an empty table gives an empty result. A component of 2^27 or more in absolute
value is an error, since distances would not fit a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.llm.cells import finite
from storynet.llm.common import saved, small, table

K, ROUNDS, SIZE, SEED = 16, 3, 64, 1
#: Greatest component in absolute value, rows that are assigned at a time, and a distance beyond all others.
LARGEST, STEP, FAR = 1 << 27, 2048, 1 << 28


class Lists:
    """Centroids, and for each dimension their numbers in order of value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.number = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.value = np.sort(centroids, axis=0).T.copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid, and how many distances that took."""
        k, size = self.centroids.shape
        dims, taken = np.arange(size), 0
        best, who = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        high = np.stack([np.searchsorted(self.value[d], x[:, d]) for d in dims], axis=1)
        low, seen, live = high - 1, np.zeros((len(x), k), bool), np.arange(len(x))
        for _ in range(k):
            own, below, above = x[live], low[live], high[live]
            left = np.where(below >= 0, own - self.value[dims, np.maximum(below, 0)], FAR)
            right = np.where(above < k, self.value[dims, np.minimum(above, k - 1)] - own, FAR)
            go = (np.minimum(left, right) ** 2).sum(1) <= best[live]
            live, own, below, above = live[go], own[go], below[go], above[go]
            if not len(live):
                break
            down = (left <= right)[go]
            read = self.number[dims, np.where(down, below, above)]
            new = np.zeros((len(live), k), bool)
            new[np.arange(len(live))[:, None], read] = True
            new &= ~seen[live]
            seen[live] |= new
            row, c = np.nonzero(new)
            far = np.full(new.shape, np.iinfo(np.int64).max)
            far[row, c] = ((own[row] - self.centroids[c]) ** 2).sum(1)
            taken += len(row)
            least, at = far.min(1), far.argmin(1)
            better = (least < best[live]) | (least == best[live]) & (at < who[live])
            best[live[better]], who[live[better]] = least[better], at[better]
            low[live], high[live] = below - down, above + ~down
        return who, best, taken


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in small(batches):
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            if len(x) and (x.max() >= LARGEST or x.min() <= -LARGEST):
                raise ValueError(f"a component reaches {LARGEST} in absolute value")
            yield part, x


def _sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of vectors and sum of their components for each centroid."""
    k, size = centroids.shape

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, n, total = Lists(centroids), np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, x in _blocks(batches, size):
            who = lists.nearest(x)[0]
            n += np.bincount(who, minlength=k)
            np.add.at(total, who, x)
        if n.any():
            yield pa.RecordBatch.from_pydict({"cluster": np.arange(k), "n": n, "total": list(total)})

    rows = vectors.mapInArrow(partial, "cluster long, n long, total array<long>")
    each = rows.select("cluster", F.posexplode(F.concat(F.array("n"), "total")).alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((k, size + 1), np.int64)
    for r in each.collect():  # k * (size + 1) numbers
        out[r.cluster, r.at] = r.x
    return out[:, 0], out[:, 1:]


def _first(vectors: DataFrame, k: int, size: int, seed: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", order.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, size)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each of ``vectors``(vec_id, v array<long>)."""
    spark = vectors.sparkSession
    vectors = saved(vectors.filter(F.size("v") == size).select("vec_id", "v"))
    centroids = _first(vectors, k, size, seed)
    if len(centroids):
        for _ in range(rounds):
            n, total = _sums(vectors, centroids)
            centroids = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids) if len(centroids) else None
        for part, x in _blocks(batches, size):
            who, distance, _ = lists.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = saved(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, i, sum(inertia.values()), digest[c]) for c, i in inertia.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(known), "cluster")  # k rows at most
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def whole(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """Vectors whose components x become floor(scale * x); those with null or non-finite components go."""
    v = F.transform("v", lambda x: F.floor(scale * x.cast("double")))
    return finite(vectors).select("vec_id", v.alias("v"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(whole(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))))


def _sql() -> str:
    """The rounds one after the other."""
    head = f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as v
  from embeddings where embedding is not null and len(embedding) = {SIZE}
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select cast(row_number() over (order by h nulls last, v) - 1 as int) as k, v as c from (
  select v, sha256('{SEED}:' || cast(vec_id as varchar)) as h from v) t qualify k < {K})"""
    near = """
a{i} as materialized (select r, vec_id, v, k, d from (
  select *, row_number() over (partition by r order by d, k) as o from (
    select r, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v cross join c{i}) p) q
  where o = 1)"""
    move = """
s{i} as (select k, list(x order by p) as c from (
  select k, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as x from (
    select k, unnest(v)::hugeint as x, unnest(range(len(v))) as p from a{i}) t group by k, p) u group by k),
c{j} as materialized (select c{i}.k, coalesce(s{i}.c::bigint[], c{i}.c) as c from c{i} left join s{i} on s{i}.k = c{i}.k)"""
    steps = [part for i in range(ROUNDS) for part in (near.format(i=i), move.format(i=i, j=i + 1))]
    return ",".join([head, *steps, near.format(i=ROUNDS)]) + f"""
select vec_id, a.k as cluster, d as distance, cast(sum(d) over (partition by a.k) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on c.k = a.k"""


SQL = _sql()
