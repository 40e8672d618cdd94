"""Found event boundaries against those that people gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storynet.functions import text as tx


def score_boundaries(found: DataFrame, gold: DataFrame, processed: DataFrame) -> DataFrame:
    """``found`` and ``gold``(chat_id, ix, status, ref, quote), ``processed``(chat_id, rounds, required): chat_id, ix, outcome.

    not_due if too few rounds are processed; missing or extra by index; status_differs; start_differs unless the refs are the same
    and one normalised quote begins with the other; else match.
    """
    keys = ["chat_id", "ix"]
    f = found.select(*keys, F.col("status").alias("f_status"), F.col("ref").alias("f_ref"), tx.anchor_text(F.col("quote")).alias("f_quote"))
    g = gold.select(*keys, F.col("status").alias("g_status"), F.col("ref").alias("g_ref"), tx.anchor_text(F.col("quote")).alias("g_quote"))
    rows = f.join(g, keys, "full").join(processed, "chat_id", "left")
    near = (F.col("f_ref") == F.col("g_ref")) & (F.startswith("f_quote", "g_quote") | F.startswith("g_quote", "f_quote"))
    outcome = (
        F.when(F.coalesce(F.col("rounds") < F.col("required"), F.lit(False)), "not_due")
        .when(F.col("f_status").isNull(), "missing")
        .when(F.col("g_status").isNull(), "extra")
        .when(F.col("f_status") != F.col("g_status"), "status_differs")
        .when(~F.coalesce(near, F.lit(False)), "start_differs")
        .otherwise("match")
    )
    return rows.select(*keys, outcome.alias("outcome"))


def gold_scope(gold: DataFrame, chats: DataFrame, batch_rounds: int) -> DataFrame:
    """``gold``(chat_id, sha256, rounds, batches), ``chats``(chat_id, sha256): chat_id, code, null if the fixture belongs to this text and these batches."""
    rows = gold.join(chats.withColumnRenamed("sha256", "now"), "chat_id", "left")
    code = F.when(F.col("now").isNull(), "CHAT_MISSING").when(F.col("now") != F.col("sha256"), "SOURCE_CHANGED").when(F.col("rounds") != batch_rounds * F.col("batches"), "ROUNDS_DIFFER")
    return rows.select("chat_id", code.alias("code"))
