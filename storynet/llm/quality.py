"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text (lengths, character classes, repeated words and
lines) are standardised and mapped by ``FEATURES`` random Fourier features,
which approximate a Gaussian kernel. Each partition of the labelled rows sums
its part of the normal equations, for each of ``CROSS`` folds; the parts are added
up by row of the matrix, first within ``SPREAD`` shares of the partitions, and the
driver solves systems of FEATURES + 1 unknowns: one of all rows, for scoring, and
one without each fold. Raw scores are calibrated by isotonic regression over a
histogram of ``BINS`` bins, in which each labelled row stands with the score of
the system that has not seen its fold.

All labelled rows are used, without a sample. Texts are read once: what is kept
and shuffled are the statistics. To the driver come the matrices, the means and
the histogram, whose sizes are parameters.

Defined cases: null and empty texts have statistics too and get a score; null
labels are not learnt from, several labels of a document are averaged; if the
labelled rows are none or all alike, every score is their mean (0.5 if none);
repeated rows are scored each; an empty table gives an empty result. Other
columns are not read; ``keep_good`` passes them through as one struct.
"""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.llm.common import ready, saved, small, table

FEATURES, WIDTH, RIDGE, SEED, BINS, THRESHOLD, FOLDS = 256, 0.25, 1e-3, 9, 2000, 0.3, 5
CROSS, SPREAD = 4, 32
N_STATS = 14


def text_stats(text: str | None) -> list[float]:
    """Statistics of a whole text; none depends on language or length alone but the two logarithms."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, size = max(len(words), 1), max(len(raw), 1)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    space = int(seen[9:14].sum() + seen[32])
    return [
        np.log1p(len(words)),
        np.log1p(len(raw)),
        min((len(raw) - space) / n, 40.0),
        len(set(words)) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        upper / max(upper + lower, 1),
        seen[33] / n,
        seen[124] / n,
        int(seen[48:58].sum()) / size,
        (seen[44] + seen[46]) / n,
        (int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())) / size,
        len(set(lines)) / len(lines),
        min(len(lines) / n, 1.0),
        space / size,
    ]


def _stats(batches):
    for b in small(batches):
        rows = [text_stats(t) for t in b.column("text").to_pylist()]
        flat = pa.array(np.asarray(rows, np.float32).ravel())
        x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), x], ["doc_id", "x"])


def _matrix(batch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


class Model:
    """What scoring needs: a few arrays of fixed size."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, WIDTH, (N_STATS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, betas: np.ndarray | None = None, fold: np.ndarray | None = None) -> np.ndarray:
        """Raw scores; with ``betas`` and ``fold`` each row by the weights of its own fold."""
        parts = []
        for i in range(0, len(x), 4096):
            z = self.lift(x[i : i + 4096])
            parts.append(z @ self.beta if betas is None else (z * betas[fold[i : i + 4096]]).sum(1))
        return np.concatenate(parts) if parts else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.x, self.y)


def isotonic(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: rates k / n made non-decreasing, n as weights."""
    pools: list[list[float]] = []
    for a, b in zip(n, k, strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.repeat([b / a for a, b, _ in pools], [int(c) for *_, c in pools])


def _add(pdf):
    total = np.sum([np.frombuffer(x) for x in pdf["part"]], axis=0)
    return pdf.head(1)[["i"]].assign(part=[total.tobytes()])


def place(raw: np.ndarray) -> np.ndarray:
    """The bin of a raw score."""
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)


def solve(total: np.ndarray, n: float) -> np.ndarray:
    """Ridge weights from the sums of z z' and z y over ``n`` rows."""
    return np.linalg.solve(total[:, :-1] + RIDGE * max(n, 1) * np.eye(FEATURES + 1) / FEATURES, total[:, -1])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """``stats``(doc_id, x) and ``labels``(doc_id, y): the model learnt from all rows that both have."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(CROSS)).cast("int")
    told = saved(stats.join(labels, "doc_id").select("x", "y", fold.alias("fold")))
    sums = told.select(*[F.col("x")[i].cast("double").alias(f"x{i}") for i in range(N_STATS)], "y").agg(
        F.count("*"), F.avg("y"), *[f(f"x{i}") for f in (F.avg, F.stddev_pop) for i in range(N_STATS)]
    )
    n, rate, *moments = sums.first()
    if not n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    mean, scale = np.array(moments[:N_STATS]), np.array(moments[N_STATS:])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    model.y[:] = rate

    def parts(batches):
        total = np.zeros((CROSS, FEATURES + 1, FEATURES + 2))
        for b in small(batches):
            x, y, of = _matrix(b), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for i in range(0, len(x), 4096):
                z, yz, f = model.lift(x[i : i + 4096]), y[i : i + 4096, None], of[i : i + 4096]
                for k in np.unique(f):
                    own = z[f == k]
                    total[k] += own.T @ np.hstack([own, yz[f == k]])
        rows, share = CROSS * (FEATURES + 1), TaskContext.get().partitionId() % SPREAD
        cols = [pa.array(range(rows), pa.int32()), pa.array([share] * rows, pa.int32()), pa.array([r.tobytes() for r in total.reshape(rows, -1)])]
        yield pa.RecordBatch.from_arrays(cols, ["i", "share", "part"])

    shared = told.mapInArrow(parts, "i int, share int, part binary").groupBy("i", "share").applyInPandas(_add, "i int, part binary")
    rows = shared.groupBy("i").applyInPandas(_add, "i int, part binary").collect()
    total = np.array([np.frombuffer(r.part) for r in sorted(rows, key=lambda r: r.i)]).reshape(CROSS, FEATURES + 1, FEATURES + 2)
    size = total[:, -1, -2]  # the constant times itself: rows of a fold
    model.beta = solve(total.sum(0), n)
    rest = total.sum(0) - total
    without = np.array([solve(rest[k], n - size[k]) if n > size[k] else model.beta for k in range(CROSS)])

    def bins(batches):
        for b in small(batches):
            at = place(model.raw(_matrix(b), without, b.column("fold").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("y")], ["bin", "y"])

    seen = (
        told.mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    ).collect()
    seen.sort(key=lambda r: r.bin)
    y = isotonic(np.array([r.n for r in seen], float), np.array([r.k for r in seen], float))
    model.x, model.y = (np.array([r.bin for r in seen]) + 0.5) / BINS * 2 - 0.5, np.clip(y, 0, 1)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x for each row of ``docs``(doc_id, text), as a saved table."""
    return saved(docs.select("doc_id", "text").mapInArrow(_stats, "doc_id long, x array<float>"))


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, y from labels outside the held-out fold."""
    told = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    return told.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    stats = text_statistics(docs)
    model = fit(stats, learnable(labels))

    def score(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b)))], ["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``, with all columns; texts do not leave their tasks."""
    ready(docs.sparkSession)
    model = fit(text_statistics(docs), learnable(labels))
    wrapped = docs.select(F.struct("*").alias("row"))

    def keep(batches):
        for b in small(batches):
            x = np.asarray([text_stats(t) for t in b.column("row").field("text").to_pylist()], np.float32).astype(np.float64).reshape(-1, N_STATS)
            yield b.filter(pa.array(model.score(x) >= threshold))

    return wrapped.mapInArrow(keep, wrapped.schema).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
