"""Streams into a store that stays right whatever happens to their checkpoints.

A store is a folder of committed tables (``chats.write_commit``). Each micro-batch is one commit under the key (stream
id, batch number), where the id is the one in the checkpoint; the manifest is the ledger. A batch that is delivered again
under its key adds nothing. A new checkpoint has another id and starts over with batch 0: its rows are compared with the
store by their keys, so that only what is new is added and changed content becomes a conflict row, in any grouping of the
input into batches. Tables lie in folders by a hash of the first key, and a batch reads those that its rows fall into.

One stream writes to a store at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.sources import chats

#: Folders of a table by the hash of its first key.
PARTS = 64
SOURCES, CONFLICTS = "sources", "conflicts"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark has given the stream of a checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _stored(spark: SparkSession, store: str, name: str, schema: str, parts: list[int]) -> DataFrame:
    """The committed rows of a table in some of its folders."""
    at, fs = chats._files(spark, f"{store}/{name}")
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, commit_id string, part int").parquet(f"{store}/{name}").filter(F.col("part").isin(*parts))
    return rows.join(chats.committed_keys(spark, store).select("commit_id"), "commit_id", "left_semi").drop("commit_id", "part")


def _commit_each(stream: DataFrame, store: str, checkpoint: str, key: str, tables):
    """A writer that commits ``tables``(batch with part, parts, spark) of each micro-batch once."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{stream_id(spark, checkpoint)}:{number}"
        if chats.is_committed(spark, store, name):
            return
        rows = batch.withColumn("part", part_of(key)).persist()  # else the source is read again for each table
        try:
            parts = [r.part for r in rows.select("part").distinct().collect()]  # PARTS at most
            chats.write_commit(tables(rows, parts, spark), store, name, partition_by="part")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def append_sources(stream: DataFrame, store: str, checkpoint: str):
    """Appends sources (chat_id, ref, sha, ...) of a stream; a known ref with another digest keeps its content and becomes a conflict row. Returns the writer."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)

    def tables(rows: DataFrame, parts: list[int], spark: SparkSession) -> dict[str, DataFrame]:
        stored = _stored(spark, store, SOURCES, schema, parts).select("chat_id", "ref", "sha")
        stored = stored.join(rows.select("chat_id").distinct(), "chat_id", "left_semi")
        added, differ = chats.new_sources(stored, rows)
        return {SOURCES: added, CONFLICTS: differ.withColumn("part", part_of("chat_id"))}

    return _commit_each(stream, store, checkpoint, "chat_id", tables)


def append_rows(stream: DataFrame, store: str, name: str, keys: list[str], checkpoint: str):
    """Commits rows of a stream once for each of ``keys``, whichever checkpoint delivers them; of several new rows with one key the first in order counts. Returns the writer."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    rest = [c for c in stream.columns if c not in keys]

    def tables(rows: DataFrame, parts: list[int], spark: SparkSession) -> dict[str, DataFrame]:
        stored = _stored(spark, store, name, schema, parts).select(*keys)
        new = rows.join(stored, keys, "left_anti")
        one = new.groupBy(*keys, "part").agg(F.min(F.struct(*rest)).alias("r")) if rest else new.distinct()
        return {name: one.select(*keys, "part", "r.*").select(*stream.columns, "part") if rest else one}

    return _commit_each(stream, store, checkpoint, keys[0], tables)


def read_sources(spark: SparkSession, store: str) -> DataFrame:
    return chats.read_committed(spark, store, SOURCES).drop("part")


def read_conflicts(spark: SparkSession, store: str) -> DataFrame:
    """chat_id, ref, kept_sha, new_sha: each differing content once, however often it came."""
    return chats.read_committed(spark, store, CONFLICTS).drop("part").distinct()


def read_rows(spark: SparkSession, store: str, name: str) -> DataFrame:
    return chats.read_committed(spark, store, name).drop("part")
