"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.functions import shared
from storynet.functions.shared import shared_dir, ship_package

#: What Python's bytes.split() and the contracts call white space.
SPACE = " \\x09-\\x0D"


#: Spark's own default for the bytes of an Arrow batch, and what is set in its place.
_ARROW, _ARROW_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def ready(spark: SparkSession) -> None:
    """Workers can import the package, and Arrow batches hold BATCH_BYTES at most where the session has Spark's default."""
    ship_package(spark)
    if spark.conf.get(_ARROW, "1b").rstrip("b") == str(_ARROW_DEFAULT):
        spark.conf.set(_ARROW, str(BATCH_BYTES))


def small(batches, most: int = BATCH_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``most`` bytes, at least one row each; afterwards the worker's memory goes back."""
    for b in batches:
        step = max(1, b.num_rows * most // max(b.nbytes, 1))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    give_back()


def give_back() -> None:
    """Returns what Arrow and the C library keep of freed memory, since workers live on for further tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a checkpoint, so that a lost executor repeats only what follows."""
    ready(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """The same rows as a compressed table in the shared folder, for what is large or read more than once."""
    ready(df.sparkSession)
    return shared.saved(df)


#: A key with over one in HOT_SHARE of all rows is hot, so there are at most HOT_SHARE such keys.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row for each key (not null) and the ``count`` of rows it meets.

    Hot keys are joined by broadcast, at most HOT_SHARE of them; the rest by a shuffled join without large groups.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = keyed.filter(F.col(count) * HOT_SHARE >= total)
    names = [r[0] for r in hot.select(key).collect()]
    if not names:
        return rows.join(keyed, key)
    is_hot = F.col(key).isin(*names)
    rest = keyed.filter(F.col(count) * HOT_SHARE < total)
    return rows.filter(is_hot).join(F.broadcast(hot), key).unionByName(rows.filter(~is_hot).join(rest, key))
