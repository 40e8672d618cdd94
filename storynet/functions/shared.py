"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

_ROOT = Path(__file__).resolve().parents[2]


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package: nothing to do where PYTHONPATH has it, else Spark hands them a zip of it."""
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_storynet_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="storynet-")
    sc.addPyFile(shutil.make_archive(f"{folder}/storynet", "zip", _ROOT, "storynet"))
    sc._storynet_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="storynet-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    ship_package(spark)
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it ends, not when the driver happens to collect its garbage."""
    was = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, was)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, those of one key together, over all shuffle partitions: AQE would merge them by their bytes, against which Python's work on a row is large."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fold_sorted(rows: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """A fold over the rows of each key in order, which emits a row for each: linear in the rows, and a task holds one batch of them at a time.

    ``step``(state, row as a tuple of ``rows``' columns) gives the new state and the row to emit; ``start``() is the state of a new key.
    """
    names = rows.columns
    at = names.index(key)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = object(), None
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if row[at] != own:
                    own, state = row[at], start()
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(target.names, zip(*out, strict=True), strict=True)}, schema=target)

    spark = rows.sparkSession
    target = to_arrow_schema(spark.createDataFrame([], schema).schema)
    ship_package(spark)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(scan, schema)
