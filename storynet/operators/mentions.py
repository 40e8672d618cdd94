"""Which of a chat's words, names or quotes stand in which of its texts.

A chat's needles become one Aho-Corasick automaton, and its texts stream past it, so each text is read once however many
needles there are, and only hits leave a task. A chat with many texts is cut into parts, which all get its needles, and one
with many needles into blocks, which all get its texts; so neither a chat that holds half of all rows nor one with a
million names is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storynet.functions.shared import ship_package

#: Characters of a chat's texts for a part, and needles for a block.
PART_CHARS, BLOCK_NEEDLES = 4_000_000, 20_000
_OUT = ["chat_id", "needle", "ref"]


def found_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """``needles``(chat_id, needle) that ``texts``(chat_id, ref, text) contain literally: chat_id, needle, ref, each once; an empty needle is in no text."""
    asked = needles.select(F.col("chat_id").cast("string").alias("chat_id"), "needle").filter("needle <> '' and chat_id is not null").distinct()
    told = texts.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("ref").cast("string").alias("ref"), "text").filter("text <> ''")
    size = lambda df, amount, most, name: df.groupBy("chat_id").agg(F.ceil(amount / most).cast("int").alias(name)).filter(F.col(name) > 1)
    parts = size(told, F.sum(F.length("text").cast("long")), PART_CHARS, "parts")  # of large chats only
    blocks = size(asked, F.count("*"), BLOCK_NEEDLES, "blocks")
    many = lambda df: df.join(parts, "chat_id", "left").join(blocks, "chat_id", "left").fillna(1, ["parts", "blocks"])
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = many(asked).select("chat_id", own("blocks", "needle").alias("block"), every("parts").alias("part"), F.lit(False).alias("reads"), "needle", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("text"))
    b = many(told).select("chat_id", every("blocks").alias("block"), own("parts", "ref", "text").alias("part"), F.lit(True).alias("reads"), F.lit(None).cast("string").alias("needle"), "ref", "text")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, found = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for chat, block, part, reads, needle, ref, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (chat, block, part) != own:
                    own, words, found = (chat, block, part), [], None
                if not reads:
                    words.append(needle)
                    continue
                if found is None and words:
                    found, words = _automaton(words), []
                if found is not None:
                    out += [(chat, w, ref) for w in sorted({w for _, w in found.iter(text)})]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] or [pa.array([], pa.string())] * 3, _OUT)

    ship_package(needles.sparkSession)
    keys = ["chat_id", "block", "part"]
    rows = a.unionByName(b).repartition(*keys).sortWithinPartitions(*keys, "reads")
    found = rows.mapInArrow(scan, ", ".join(f"{c} string" for c in _OUT))
    return found.distinct()


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out
