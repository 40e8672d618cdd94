"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of bytes of order 0 to 3. With n occurrences of
a context and d different next bytes, a byte seen c times costs
-log2(c / (n + d)) bits there, an unseen one the escape -log2(d / (n + d)) plus
its cost one order lower; below order 0 a byte costs 8 bits. Contexts that a
language has never seen cost nothing to leave. The counts are frozen after
training, so these are exact code lengths; each whole text is coded under each
language, preceded by three newlines, and the shortest code wins. The score is
the posterior of the winner under equal priors.

The trees are learnt from a sample of about ``TRAIN_DOCS`` documents for each
language, chosen by a hash of doc_id; counting them is a Spark aggregation. For
scoring, every context and every byte that followed it in any language has a row
of costs, one for each language, in sorted tables; nothing is cut. What is
broadcast is bounded by the sample: 4 bytes for each language and distinct string
of four bytes or less in it.

Defined cases: a null text or one without a letter (Unicode category L) is ``und``
with score 0; without anything to learn from, so is every text; null languages are
not learnt; equal code lengths go to the language that sorts first; repeated rows
are predicted each; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.llm.common import ready, saved, small, table

TRAIN_DOCS, FOLDS, FOLD, CHUNK = 1500, 4, 2, 1 << 18
PAD = b"\n\n\n"
LETTER = regex.compile(r"\p{L}")


def _grams(raw: bytes) -> np.ndarray:
    """The code of (three bytes before, byte) at each byte of ``raw``, which begins with PAD."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    return ((x[:-3] * 256 + x[1:-2]) * 256 + x[2:-1]) * 256 + x[3:]


def _count(batches):
    for b in small(batches):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text.encode("utf-8", "replace"))
        for lang, raws in by_lang.items():
            gram, n = np.unique(np.concatenate([_grams(PAD + r) for r in raws]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram)), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
            )


class Level:
    """One order of the trees: costs of the strings seen (context and byte), and of leaving the contexts seen, by language."""

    def __init__(self, order: int, langs: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, lower: Level | None):
        gram = gram & ((1 << 8 * (order + 1)) - 1)
        self.grams, at = np.unique(gram, return_inverse=True)
        self.contexts, of = np.unique(self.grams >> 8, return_inverse=True)
        count = np.zeros((len(self.grams), langs))
        np.add.at(count, (at, lang), n)
        total, kinds = np.zeros((2, len(self.contexts), langs))
        np.add.at(total, of, count)
        np.add.at(kinds, of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            hit = -np.log2(count / (total + kinds)[of])
        below = lower.costs(self.grams & ((1 << 8 * order) - 1)) if lower else np.full((len(self.grams), langs), 8.0)
        # a last row stands for contexts that no language has
        self.leave = np.vstack([leave, np.zeros((1, langs))]).astype(np.float32)
        self.cost = np.where(count > 0, hit, leave[of] + below).astype(np.float32)
        self.lower, self.mask = lower, (1 << 8 * order) - 1

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Costs (string, language) of the last byte of each string."""
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        out, new = self.cost[at], np.flatnonzero(self.grams[at] != gram)
        if len(new):
            rest = gram[new]
            place = np.minimum(np.searchsorted(self.contexts, rest >> 8), len(self.contexts) - 1)
            place[self.contexts[place] != rest >> 8] = len(self.contexts)
            out[new] = self.leave[place] + (self.lower.costs(rest & self.mask) if self.lower else np.float32(8))
        return out


class Trees:
    """Costs in bits, frozen."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs, self.top = langs, None
        for order in range(4):
            self.top = Level(order, len(langs), lang, gram, n, self.top)

    def bits(self, raws: list[bytes]) -> np.ndarray:
        """Code lengths (text, language)."""
        out, part, first, held = np.zeros((len(raws), len(self.langs))), [], 0, 0
        for i, raw in enumerate(raws):
            if len(raw) > CHUNK:
                whole = PAD + raw
                for at in range(0, len(raw), CHUNK):
                    out[i] += self._costs(whole[at : at + CHUNK + 3]).sum(0, dtype=np.float64)
            else:
                part.append(i)
                held += len(raw)
            if held > CHUNK or i == len(raws) - 1:
                self._many(raws, part, out)
                part, held = [], 0
        return out

    def _many(self, raws, part, out) -> None:
        part = [i for i in part if raws[i]]
        if not part:
            return
        x, starts, at = b"".join(PAD + raws[i] for i in part), [], 0
        for i in part:
            starts += [at, at + len(raws[i])]
            at += len(raws[i]) + 3
        cost = self._costs(x).astype(np.float64)
        starts = np.array(starts)
        sums = np.add.reduceat(cost, starts[starts < len(cost)], axis=0)[::2]
        out[part] = sums

    def _costs(self, raw: bytes) -> np.ndarray:
        return self.top.costs(_grams(raw))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == FOLD, F.lit(False))


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Trees | None:
    """Trees from ``docs``(doc_id, text, lang), a sample of about ``per_lang`` documents of each language."""
    ready(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = saved(docs.groupBy("lang").agg(F.count("*").alias("n")))  # a row for each language
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000_000))
    grams = (
        docs.join(sizes, "lang")
        .filter(u < F.lit(1e9 * per_lang) / F.col("n"))
        .select("lang", "text")
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
        .sort_values(["lang", "gram"])
    )
    langs = sorted(set(grams["lang"]))
    if not langs:
        return None
    return Trees(langs, np.searchsorted(langs, grams["lang"]), grams["gram"].to_numpy(), grams["n"].to_numpy())


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches):
        trees = held.value
        for b in small(batches):
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if trees is not None and t and LETTER.search(t)]
            pred, sure = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                bits = trees.bits([texts[i].encode("utf-8", "replace") for i in known])
                best = bits.argmin(1)
                more = bits - bits.min(1, keepdims=True)
                sure[known] = 1 / np.exp2(-np.minimum(more, 1000)).sum(1)
                for i, k in zip(known, best, strict=True):
                    pred[i] = trees.langs[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, trees).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
