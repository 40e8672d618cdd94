"""Hard negatives by BOND, a vertical scan of vectors.

A cell holds its vectors by columns, with the least and the greatest value of each
dimension. An anchor reads the columns in descending magnitude of its own components,
``READ`` at a time, and adds up partial products for the rows in its bitmap. What the
dimensions that are left can add to a product lies between the sums of their least and
greatest contributions, so each row's product has two bounds. Rows whose bounds rule
them out leave the bitmap, until the columns are read or no row is left.

* Positives: the bitmap starts with the anchor's label and without its own row. A row
  leaves when its upper bound is under the k-th greatest lower bound.
* Negatives: it starts with the other labels. A row stays while its bounds reach one
  of the anchor's windows, ``low`` to ``high`` percent of each positive's product, and
  while its upper bound reaches the window's k-th greatest lower bound among the rows
  that are inside for certain. Then the window's exact limits decide.

The first search deals vectors out by label and an anchor goes to the cells of its
label; a label with many rows has many cells. The second deals them out by row, and
every anchor goes to every cell: a stated query set meets all rows in blocks, one cell
in a task with the anchors streaming past. Each cell returns ``k`` rows an anchor and
window at most, and these are ranked. Nothing but the anchors and those rows is
repeated, and no row is left out.

Defined cases: a null vec_id, label or vector, or a null, NaN or infinite component
takes no part; the table's vectors have the length that most of them have (the
greater one of two), others take no part; rows that repeat a vec_id are rows of their
own, and each is an anchor of its own; equal products go to the smaller id; a label
with one row gives an anchor without positives, so no rows; a negative product of a
positive leaves an empty window; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.llm.cells import best, finite, matrix, met, numbered, of_one_length, rows_of_cell
from storynet.llm.common import join_hot, saved, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Columns that are read between two looks at the bounds, and the part of the greatest product that rounding may take.
READ, SLACK = 8, 1e-12


class Columns:
    """A cell's vectors by columns."""

    def __init__(self, rows: pa.Table):
        self.row, self.ids, self.label = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.column = np.ascontiguousarray(matrix(rows.column("v")).T)
        self.least, self.greatest = self.column.min(1), self.column.max(1)

    def scan(self, q: np.ndarray, rows: np.ndarray, stay: Callable[[np.ndarray, np.ndarray, float], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of ``rows`` those that ``stay``(lower bounds, upper bounds, slack) keeps to the end, and their products with ``q``."""
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.least, q * self.greatest])[:, order]
        low = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0.0)
        high = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0.0)
        slack, product = SLACK * float(np.abs(ends).max(0).sum()), np.zeros(len(rows))
        for at in range(0, len(q), READ):
            dims = order[at : at + READ]
            product = product + q[dims] @ self.column[dims][:, rows]
            left = min(at + READ, len(q))
            keep = stay(product + low[left], product + high[left], slack)
            if not keep.all():
                rows, product = rows[keep], product[keep]
            if not len(rows):
                break
        return rows, product


def _positives(k: int):
    def stay(low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
        return high >= np.partition(low, len(low) - k)[len(low) - k] - slack if len(low) > k else np.ones(len(low), bool)

    def answer(cell: Columns, anchors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for own, name, q in zip(anchors.column("row").to_numpy(), anchors.column("vec_id").to_numpy(), matrix(anchors.column("v")), strict=True):
            rows, product = cell.scan(q, np.flatnonzero(cell.row != own), stay)
            at = best(product, cell.ids[rows], k)
            out += [(own, name, cell.row[r], cell.ids[r], s) for r, s in zip(rows[at], product[at], strict=True)]
        yield _batch(out, ["row", "anchor_id", "positive_row", "positive_id", "positive_score"])

    return answer


def _negatives(k: int, low: int, high: int):
    def windows(products: np.ndarray) -> np.ndarray:
        return np.stack([products * (low / 100), products * (high / 100)], 1)

    def answer(cell: Columns, anchors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        columns = (anchors.column(c).to_numpy() for c in ("row", "label"))
        for own, label, q, positives in zip(*columns, matrix(anchors.column("v")), anchors.column("positives").to_pylist(), strict=True):
            products = np.array([p["positive_score"] for p in positives])
            spans = windows(products)

            def stay(least: np.ndarray, most: np.ndarray, slack: float, spans=spans) -> np.ndarray:
                keep = np.zeros(len(least), bool)
                for a, b in spans:
                    if a > b:
                        continue
                    room = slack + SLACK * abs(b)
                    inside = least[(least >= a + room) & (most <= b - room)]
                    floor = np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else a
                    keep |= (most >= max(a, floor) - room) & (least <= b + room)
                return keep

            rows, product = cell.scan(q, np.flatnonzero(cell.label != label), stay)
            for p in positives:
                fits = np.flatnonzero((low * p["positive_score"] <= 100 * product) & (100 * product <= high * p["positive_score"]))
                at = fits[best(product[fits], cell.ids[rows[fits]], k)]
                out += [(own, p["positive"], cell.ids[r], s) for r, s in zip(rows[at], product[at], strict=True)]
        yield _batch(out, ["row", "positive", "negative_id", "negative_score"])

    return answer


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "positive" else pa.float64() if n.endswith("score") else pa.int64() for n in names]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def mine(
    vectors: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors``(vec_id, label, v) of which the SQL condition ``anchors`` holds."""
    plain = finite(vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v")), "vec_id", "label")
    plain, size = of_one_length(plain)
    rows = numbered(plain)
    n = rows.count()
    per_cell = rows_of_cell(size, n, share=8)

    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    placed = join_hot(rows, sizes, "label", "n").withColumn("parts", F.ceil(F.col("n") / per_cell).cast("int"))
    mix = F.xxhash64("row")
    by_label = placed.select("label", F.pmod(mix, "parts").cast("int").alias("part"), "row", "vec_id", "v")
    asked = placed.filter(anchors).select("label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row", "vec_id", "v")
    near = met(by_label, asked, ["label", "part"], Columns, _positives(positives), "row long, anchor_id long, positive_row long, positive_id long, positive_score double")
    number = F.row_number().over(W.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row"))
    first = saved(near.withColumn("positive", number).filter(F.col("positive") <= positives).drop("positive_row"))

    chosen = first.groupBy("row").agg(F.collect_list(F.struct("positive", "positive_score")).alias("positives"))  # ``positives`` entries at most
    cells = max(1, -(-n // per_cell))
    asked = rows.filter(anchors).join(chosen, "row").select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("part"), "row", "label", "v", "positives")
    by_row = rows.select(F.pmod(mix, F.lit(cells)).cast("int").alias("part"), "row", "vec_id", "label", "v")
    found = met(by_row, asked, ["part"], Columns, _negatives(negatives, low, high), "row long, positive int, negative_id long, negative_score double")
    rank = F.row_number().over(W.partitionBy("row", "positive").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return ranked.join(first, ["row", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("v", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    raw = finite(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v")), "vec_id", "label")
    found = mine(raw.select("vec_id", label.alias("label"), v.alias("v")), "vec_id % 50 = 0")
    return found.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


SQL = """
with v as materialized (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.r, a.vec_id as anchor_id, c.r as other, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.v, c.v) as bigint) as score
  from v a join v c on a.r <> c.r where a.vec_id % 50 = 0),
p as (select * from (select *, row_number() over (partition by r order by score desc, vec_id, other) as o from s where same) t where o <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.r, p.other order by s.score desc, s.vec_id) as rank
  from p join s on s.r = p.r and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
