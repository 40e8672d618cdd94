"""The document pipeline: each stage's result is written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``; the last returns them
with size, target, copies and taken. The stages hold no state of their own:
statistics, models and components come from the stage's own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.llm import decontaminate, jaccard_join, mixing, pii, quality
from storynet.llm.common import shared_dir, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies; rows that repeat it go too."""
    return jaccard_join.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; items under ``EVIDENCE`` bytes, which any text may hold, are no reason to drop one."""
    hits = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), least=decontaminate.EVIDENCE)
    return hits.filter(F.size("hits") == 0).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with all personal data that was found masked."""
    return pii.redact(docs, pii.train(pii.scan(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often; a document without words is taken or not by its rank."""
    mixed = mixing.mix(docs, keep=True).filter("copies > 0")
    return mixed.select("row.*", "size", "target", "copies", "taken")


STAGES = [
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL can express neither the classifier nor the span model; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to and read from the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
