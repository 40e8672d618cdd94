"""Cells of vectors that a stream of questions meets: what the searches over vectors share.

A cell is a bounded number of vectors under one key. ``met`` deals rows out by cell and sorts each partition, so that a
cell's vectors come before its questions: a task holds one cell and streams the questions, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storynet.llm.common import give_back, saved

#: Bytes of vectors, as doubles, that a cell holds at most on average.
CELL_BYTES = 4 << 20


def finite(vectors: DataFrame, *needed: str) -> DataFrame:
    """Rows of ``vectors``(v, ...) with a vector of finite components and none of ``needed`` null."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    there = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False))
    for name in needed:
        there &= F.col(name).isNotNull()
    return vectors.filter(there)


def of_one_length(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the length that most of them have (the greater one of two), and that length; 0 if there is none."""
    found = vectors.filter(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = found.n if found else 0
    return vectors.filter(F.size("v") == max(size, 1)), size


def numbered(vectors: DataFrame) -> DataFrame:
    """The rows, saved, with a number of their own in ``row``: rows that repeat an id stay different rows."""
    return saved(vectors.withColumn("row", F.monotonically_increasing_id()))


def rows_of_cell(size: int, n: int, least: int = 256, share: int = 32) -> int:
    """Rows of a cell: as CELL_BYTES allows, and a small table still makes about ``share`` cells."""
    return max(1, min(CELL_BYTES // (8 * max(size, 1)), max(least, n // share)))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of sorted batches within which ``keys`` are equal."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield tuple(v[a] for v in values), batch.slice(a, b - a)


def met(vectors: DataFrame, questions: DataFrame, keys: list[str], index: Callable, answer: Callable, schema: str) -> DataFrame:
    """``answer``(``index``(a cell's vectors), some of its questions) for every cell that has both.

    Both frames have ``keys``; what one of them lacks of the other's columns is null in its rows.
    """
    rows = vectors.withColumn("asks", F.lit(False)).unionByName(questions.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    keyed = [*keys, "asks"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, built = None, [], None
        for (*key, asks), piece in _runs(batches, keyed):
            if key != cell:
                cell, held, built = key, [], None
            if not asks:
                held.append(piece)
                continue
            if built is None and held:
                built, held = index(pa.Table.from_batches(held)), []
            if built is not None:
                yield from answer(built, piece)
        give_back()

    return rows.repartition(*keys).sortWithinPartitions(*keyed).mapInArrow(scan, schema)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, smaller ids first among equals."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]
