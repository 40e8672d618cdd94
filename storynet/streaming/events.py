"""The incremental rules as Structured Streaming jobs, keyed by chat."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storynet.functions.shared import shared_dir


def rolling_events(stream: DataFrame) -> DataFrame:
    """``stream``(chat_id, event_id, at): events that became final, in append mode: chat_id, event_id.

    A chat's newest event is forming and the one before pending; both stay in state. Events of one micro-batch are
    ordered by (at, event_id); a chat's events arrive in that order over micro-batches.
    """

    def roll(key, frames, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(frames)).sort_values(["at", "event_id"])
        ids = held + [int(i) for i in new["event_id"]]
        state.update((ids[-2:],))
        yield pd.DataFrame({"chat_id": [key[0]] * len(ids[:-2]), "event_id": ids[:-2]})

    return stream.groupBy("chat_id").applyInPandasWithState(
        roll, "chat_id string, event_id long", "ids array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def due_chats(stream: DataFrame, interval: int = 10, tail: int = 4) -> DataFrame:
    """``stream``(chat_id, floor): chat_id, through, each time floors beyond through + interval + tail exist; the tail stays unprocessed."""

    def count(key, frames, state: GroupState):
        through, top = state.get if state.exists else (-1, -1)
        top = max(top, *(int(f["floor"].max()) for f in frames))
        due = top > through + interval + tail
        through = top - tail if due else through
        state.update((through, top))
        yield pd.DataFrame({"chat_id": [key[0]] * due, "through": [through] * due})

    return stream.groupBy("chat_id").applyInPandasWithState(
        count, "chat_id string, through long", "through bigint, top bigint", "append", GroupStateTimeout.NoTimeout
    )


def split_edits(stream: DataFrame, receipt_sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stream``(chat_id, floor, source_id, version) against covered sources: new messages, and edits of covered ones, which wait for review."""
    keys = ["chat_id", "floor"]
    covered = receipt_sources.select(*keys, F.col("version").alias("known"))
    edits = stream.join(covered, keys).filter(~F.col("version").eqNullSafe(F.col("known")))
    return stream.join(covered.select(*keys), keys, "left_anti"), edits


def run_to_table(result: DataFrame) -> DataFrame:
    """Runs a stream over all that is there, and reads its output."""
    spark = result.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = result.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
