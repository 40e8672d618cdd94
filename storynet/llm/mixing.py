r"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions.

A document's size is its number of words (``[^\x20\x09-\x0D]+``). The sources
share ``budget`` times all words by weight; no source gets more than ``most``
times its own words, and what is over goes to the others by weight. With
r = target / words of its source, each document is taken floor(r) times for
certain and perhaps once more. The probabilities of that differ within a source:
longer documents are likelier. With x the number of binary digits of a size, m
its mean over the source's words and w the greatest distance from m of an x in
the source, a document is included with probability
p_i = p + ``TILT`` p (1 - p) (x - m) / w, p = r - floor(r): always between 0 and 1,
and the words expected are those that the source still needs. The documents are
ranked by the Pareto variable (u / (1 - u)) / (p_i / (1 - p_i)), u a uniform
number from the document's id and the seed, and each source takes the first ones
up to its fixed size, which is counted in words: a document is in if the middle
of its words lies within what the source still needs. So the words taken miss
the target by less than the size of one document, and reruns agree.

No source is sorted as a whole: the ranks are cut into ``BUCKETS`` ranges, their
sizes summed, and only the range in which a source's target falls is sorted.

The sources themselves, a row each, are ranked and levelled in one task: they are
thousands at most, not documents.

Defined cases: a null text has size 0; a null doc_id draws its u from the text; a null source is a source of its own and
comes last; repeated rows have the same rank, each counts, and the sort takes
either; sources without words get target 0; an empty table gives an empty
result. Other columns are read only to ``keep`` them, as one struct, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.llm.common import cut, join_hot, saved, table

WEIGHTS, BUDGET, MOST, SEED, BUCKETS, TILT = (3, 1, 2), 1.5, 2, "mix-1", 4096, 0.8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(name: Column, seed: str) -> Column:
    """Between 0 and 1, both excluded, from 52 bits of a digest."""
    text = F.concat(name, F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Adds weight and target to ``sources``(source, source_size): one row for each source."""
    n = len(weights)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % n + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    )
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("cap_rank", "level"))
    ranked = ranked.withColumn("cap_rank", F.row_number().over(order))
    ranked = ranked.withColumn("first", F.min(fits).over(every))
    below = F.col("first").isNull() | (F.col("cap_rank") < F.col("first.cap_rank"))
    target = F.when(below, F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return ranked.withColumn("target", target).drop("cap", "level", "cap_rank", "first")


def digits(size: Column) -> Column:
    """Binary digits of a size, 1 for 0."""
    return F.length(F.bin(size)).cast("long")


def _ranked(rows: DataFrame, goal: DataFrame, seed: str) -> DataFrame:
    u, p = uniform(F.col("name"), seed), F.col("p")
    own = p + TILT * p * (1 - p) * F.when(F.col("wide") > 0, (digits(F.col("size")) - F.col("mean")) / F.col("wide")).otherwise(0.0)
    rows = join_hot(rows, goal, "key", "n_docs").withColumn("own", own)
    # x / (1 - x) as 1 / (1 / x - 1): each value is written once, so that the generated code stays small enough to be compiled
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, (1 / F.col("own") - 1) / (1 / u - 1)))
    return rows.withColumn("bucket", F.floor(BUCKETS / (1 / F.col("rank") + 1)).cast("int"))


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    seed: str = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: bool = False,
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, copies, taken; with ``keep`` also row, a struct of all its columns."""
    of = lambda name: F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("null"))
    used = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        of(source).alias("key"),
        F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text)), F.lit("")).alias("name"),
        F.explode(F.array(word_count(F.col(text)))).alias("size"),  # so that no filter counts words again
        *[F.struct("*").alias("row")] * keep,
    )
    sizes = saved(used.drop("row"))
    used = used.drop("source") if keep else sizes.drop("source")
    x = digits(F.col("size"))
    sums = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.sum(F.col("size") * x).alias("sx"), F.min(x).alias("x0"), F.max(x).alias("x1")
    )
    goal = targets(sums, weights, budget, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = cut(
        goal.withColumn("key", of("source"))
        .withColumn("sure", F.floor(rate).cast("long"))
        .withColumn("p", rate - F.floor(rate))
        .withColumn("need", F.col("target") - F.col("sure") * F.col("source_size"))
        .withColumn("mean", F.when(F.col("source_size") > 0, F.col("sx") / F.col("source_size")).otherwise(0.0))
        .withColumn("wide", F.greatest(F.col("x1") - F.col("mean"), F.col("mean") - F.col("x0")))
        .drop("source", "weight", "sx", "x0", "x1")
    )
    ranked = _ranked(sizes.drop("source"), goal, seed)
    by_bucket = ranked.filter("p > 0").groupBy("key", "need", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("key").orderBy("bucket"))
    cuts = (
        by_bucket.withColumn("upto", upto)
        .groupBy("key")
        .agg(F.min(F.when(F.col("upto") > F.col("need"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("cut"))
        .select("key", F.coalesce("cut.bucket", F.lit(BUCKETS + 1)).alias("cut"), F.coalesce("cut.before", F.lit(0)).alias("before"))
    )
    goal = cut(goal.join(cuts, "key", "left"))
    ranked = _ranked(used, goal, seed)
    out = ["doc_id", "size", "source_size", "target", *["row"] * keep]
    at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    clear = ranked.filter(~at_cut).select(
        *out, (F.col("sure") + F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0)).alias("copies")
    )
    upto = F.sum("size").over(W.partitionBy("key").orderBy("rank", "name", "size").rowsBetween(W.unboundedPreceding, 0))
    middle = F.col("before") + upto - F.col("size") / 2
    edge = ranked.filter(at_cut).select(
        *out, (F.col("sure") + F.when(middle <= F.col("need"), 1).otherwise(0)).alias("copies")
    )
    return clear.unionByName(edge).withColumn("taken", F.col("copies") * F.col("size"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
with d as (
  select doc_id, source, coalesce(cast(doc_id as varchar), md5(text), '') as name,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, cast(sum(size * length(bin(size))) as bigint) as sx,
    min(length(bin(size))) as x0, max(length(bin(size))) as x1 from d group by source),
w as (select *, [3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight,
  2 * source_size as cap from s),
l as (select *, row_number() over o as cap_rank,
    (1.5::double * (select sum(source_size) from s)
     - coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following) as level
  from w window o as (order by cap::double / weight, source nulls last)),
f as (select min(cap_rank) as r, min_by(level, cap_rank) as level from l where level * weight <= cap),
t as (select *, case when r is null or cap_rank < r then cap::double else f.level * weight end as target,
    case when source_size > 0 then sx::double / source_size else 0 end as mean from l, f),
g as (select *, case when source_size > 0 then target / source_size else 0 end as rate, greatest(x1 - mean, mean - x0) as wide from t),
h as (select d.*, source_size, target, floor(rate) as sure, rate - floor(rate) as p,
    target - floor(rate) * source_size as need, case when wide > 0 then (length(bin(size)) - mean) / wide else 0 end as tilt,
    (cast('0x' || substr(md5(name || ':{SEED}'), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double as u
  from d join g on d.source is not distinct from g.source),
i as (select *, p + {TILT}::double * p * (1 - p) * tilt as own from h),
q as (select *, case when p > 0 then (1 / own - 1) / (1 / u - 1) end as rank from i),
c as (select *, sum(size) over (partition by source order by rank, name, size rows between unbounded preceding and current row)
    - size / 2 as middle from q)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast((sure + case when p > 0 and middle <= need then 1 else 0 end) * size as bigint) as taken from c
"""
