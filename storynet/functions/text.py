"""Text cleaning, signatures and clue rules as column expressions, and small Arrow helpers where Spark has no function."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that the three signature variants drop, and those that anchoring drops.
NAME_DROP = r"[\s·・,，。．、:：;；'\"“”‘’「」『』()（）\[\]【】<>《》!！?？_\-—…~]"
PLAIN_DROP = r"[\s·・,，。．、:：;；]"
FIELD_DROP = r"[\s_\-./\\:：]"
ANCHOR_DROP = r"[\s\p{Z}\p{P}*_`~]"
QUOTE_DROP = r"[\s\"'“”‘’「」『』]"


@F.pandas_udf(T.StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence-matcher ratio of two texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def similarity_bound(a: Column, b: Column) -> Column:
    """The ratio cannot exceed this, so it is a cheap filter before ``similarity``."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def name_signature(c: Column) -> Column:
    return F.regexp_replace(nfkc_fold(c), NAME_DROP, "")


def plain_signature(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, PLAIN_DROP, ""))


def field_signature(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, FIELD_DROP, ""))


def anchor_text(c: Column) -> Column:
    """What quotes are compared by: no white space, punctuation or marks."""
    return F.regexp_replace(c, ANCHOR_DROP, "")


def evidence_text(c: Column) -> Column:
    """The other rule: only white space and quote marks go."""
    return F.regexp_replace(c, QUOTE_DROP, "")


def strip_markup(c: Column, scene: bool = True) -> Column:
    """Inside of the first content element if any, without comments and tags; a back-tick header becomes a scene-time line."""
    inside = F.regexp_extract(c, r"(?is)<content\b[^>]*>(.*?)</content\s*>", 1)
    body = F.when(F.rlike(c, F.lit(r"(?is)<content\b[^>]*>.*?</content\s*>")), inside).otherwise(c)
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]+>", "")
    if not scene:
        return body
    head = F.regexp_extract(c, r"(?s)^\s*`([^`\n]+)`", 1)
    return F.when(head != "", F.concat(F.lit("[scene] "), head, F.lit("\n"), F.regexp_replace(body, r"(?s)^\s*`[^`\n]+`\s*", ""))).otherwise(body)


def tidy_lines(c: Column) -> Column:
    """Trimmed line ends, two newlines at most, no blank ends."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_messages(messages: DataFrame) -> DataFrame:
    """content cleaned by role: assistant texts lose markup and entities, user texts only comments."""
    raw = F.replace(F.col("content"), F.lit("\0"), F.lit(""))
    told = tidy_lines(unescape_html(strip_markup(raw)))
    asked = tidy_lines(F.regexp_replace(raw, r"(?s)<!--.*?-->", ""))
    return messages.withColumn("content", F.when(F.col("role") == "assistant", told).otherwise(asked))


def scene_header_parts(c: Column) -> tuple[Column, Column]:
    """place and time of a header: parts between middle dots, split at the first that names a year or era; without one both are empty."""
    parts = F.transform(F.split(c, "·"), lambda p: F.trim(p))
    dated = F.transform(parts, lambda p: F.rlike(p, F.lit(r"[0-9]{3,4}|[0-9]+\s*年|年|era\b|year\b")))
    at = F.array_position(dated, True).cast("int")
    place = F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), "·")).otherwise("")
    time = F.when(at > 0, F.array_join(F.slice(parts, F.greatest(at, F.lit(1)), F.size(parts)), "·")).otherwise("")
    return place, time


#: Neutral clue rules (kind, pattern); callers pass their own language's as rows of the same shape.
CLUES = (
    ("arrival", r"(?i)\b(arrived? (?:at|in)|reached|came to) ([A-Za-z]+)"),
    ("exit", r"(?i)\b(left|departed from|walked out of) ([A-Za-z]+)"),
    ("reset", r"(?i)\b(next morning|the following day|days later|weeks later)\b"),
    ("activity", r"(?i)\b(began|started) (?:to )?[a-z]+"),
    ("lodging", r"(?i)\b(slept|stayed the night|checked in)\b"),
)
REJECT = r"(?i)\b(remember(?:ed)?|plan(?:ned)?|would|if|not|never|dreamt)\b[^.!?\n]{0,28}$"
TIMES = r"(?i)\b(dawn|noon|dusk|midnight|[0-9]{1,2}:[0-9]{2}|[0-9]{1,2} ?[ap]m)\b"


def body_time(c: Column) -> Column:
    """First explicit time in narration: quoted speech and thoughts do not count."""
    told = F.regexp_replace(c, r"(?s)\"[^\"]*\"|“[^”]*”|「[^」]*」|\*[^*]*\*", " ")
    return F.nullif(F.regexp_extract(told, TIMES, 0), F.lit(""))


def body_place(c: Column, arrival: str = CLUES[0][1]) -> Column:
    """First place that is really reached: a match is passed over if the 28 characters before speak of memory, plans or negation."""
    cuts = F.split(c, r"(?<=[.!?\n])\s*")
    hits = F.transform(cuts, lambda s: F.struct(F.regexp_extract(s, arrival, 2).alias("place"), F.regexp_extract(s, r"(?s)^(.*?)" + arrival, 1).alias("lead")))
    good = F.filter(hits, lambda h: (h["place"] != "") & ~F.rlike(h["lead"], F.lit(REJECT)))
    return F.try_element_at(good, F.lit(1))["place"]


def clue_matches(units: DataFrame, rules=CLUES) -> DataFrame:
    """``units``(ref, unit, ord, text), the first of a ref left out, by rule: ref, unit, kind."""
    kinds = F.filter(F.array(*[F.when(F.col("text").rlike(p), k) for k, p in rules]), lambda k: k.isNotNull())
    return units.filter("ord > 1").select("ref", "unit", "ord", F.explode(kinds).alias("kind"))


def internal_start_clues(units: DataFrame, rules=CLUES) -> DataFrame:
    """Units that may start an event inside a message; hard if one arrives and resets, or leaves and something begins."""
    found = clue_matches(units, rules).groupBy("ref", "unit").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    both = lambda a, b: F.array_contains("kinds", a) & F.array_contains("kinds", b)
    return found.withColumn("hard", both("arrival", "reset") | both("exit", "activity"))


def hard_round_boundaries(blocks: DataFrame, forming: DataFrame) -> DataFrame:
    """``blocks``(chat_id, ix, text, place_changed) that surely start an event: a reset or lodging, or a changed place with a weaker clue.

    A chat's first block counts only if ``forming``(chat_id) has an event to end.
    """
    kind = {k: F.col("text").rlike(p) for k, p in CLUES}
    hard = kind["reset"] | kind["lodging"] | (F.col("place_changed") & (kind["arrival"] | kind["exit"] | kind["activity"]))
    rows = blocks.join(forming.select("chat_id", F.lit(True).alias("open")).distinct(), "chat_id", "left")
    return rows.filter(hard & ((F.col("ix") > 0) | F.coalesce("open", F.lit(False)))).select("chat_id", "ix")


def stripped(c: Column | str) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def letters(c: Column | str) -> Column:
    """Letters and digits only, of any script: what decides whether one text contains another."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
