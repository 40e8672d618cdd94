"""Corrections of keys and values against rules; the rules are the caller's."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storynet.functions import text as tx


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def key_signature(c: Column) -> Column:
    """NFKC without blank ends, camel case to snake case, dashes, spaces and repeated underscores to one underscore, lower case."""
    snake = F.regexp_replace(F.regexp_replace(_nfkc(c), r"^\s+|\s+$", ""), r"(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.lower(F.regexp_replace(snake, r"[-_\s]+", "_"))


def path_matches(pattern: Column, path: Column) -> Column:
    """Patterns have as many parts as the path, ``*`` for any one."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    each = F.zip_with(parts(pattern), parts(path), lambda a, b: F.coalesce((a == "*") | (a == b), F.lit(False)))
    return F.forall(each, lambda x: x)


def repair_keys(keys: DataFrame, rules: DataFrame, aliases: DataFrame, threshold: float, margin: float, fuzzy: bool = True) -> DataFrame:
    """``keys``(component, path, key), ``rules``(component, path, field), ``aliases``(component, path, ord, alias, field; path may be a pattern) to correction and code.

    Keys, fields and aliases are compared by signature. An unknown key becomes the only field with its signature, else the field of the
    first alias with it, else the most similar field if it reaches ``threshold`` and leads the second, whatever that one reaches, by ``margin``
    (AMBIGUOUS_FIELD if several reach the threshold without that lead); a field that the object has already is CORRECTION_COLLISION, no match
    UNKNOWN_FIELD. Only distinct unknown keys are compared.
    """
    at = ["component", "path"]
    known = rules.select(*at, F.col("field").alias("key"))
    fields = rules.select(*at, "field", key_signature(F.col("field")).alias("f_sig"))
    unknown = keys.distinct().join(known, [*at, "key"], "left_anti").withColumn("sig", key_signature(F.col("key")))
    by_sig = fields.groupBy(*at, F.col("f_sig").alias("sig")).agg(F.min("field").alias("same"), F.countDistinct("field").alias("n")).filter("n = 1").drop("n")
    named = aliases.select("component", F.col("path").alias("pattern"), "ord", key_signature(F.col("alias")).alias("sig"), F.col("field").alias("alias_field"))
    met = unknown.join(named, ["component", "sig"]).filter(path_matches(F.col("pattern"), F.col("path")))
    by_alias = met.groupBy(*at, "key").agg(F.min(F.struct("ord", "alias_field"))["alias_field"].alias("alias_field"))
    # the second best counts as far down as the margin reaches
    pairs = unknown.join(fields, at).filter(tx.similarity_bound(F.col("sig"), F.col("f_sig")) >= threshold - margin)
    scored = (pairs if fuzzy else pairs.limit(0)).withColumn("ratio", tx.similarity(F.col("sig"), F.col("f_sig")))
    own = W.partitionBy(*at, "key").orderBy(F.desc("ratio"), F.desc("field"))
    best = scored.withColumn("rank", F.row_number().over(own)).withColumn("second", F.lead("ratio").over(own)).filter("rank = 1").filter(F.col("ratio") >= threshold)
    clear = F.col("ratio") - F.coalesce("second", F.lit(0.0)) >= margin
    best = best.select(*at, "key", F.col("field").alias("near"), clear.alias("clear"), F.coalesce(F.col("second") >= threshold, F.lit(False)).alias("several"))
    rows = unknown.join(by_sig, [*at, "sig"], "left").join(by_alias, [*at, "key"], "left").join(best, [*at, "key"], "left")
    rows = rows.withColumn("correction", F.coalesce("same", "alias_field", F.when(F.col("clear"), F.col("near"))))
    taken = keys.select(*at, F.col("key").alias("correction"), F.lit(True).alias("taken")).distinct()
    rows = rows.join(taken, [*at, "correction"], "left")
    code = F.when(F.col("taken"), "CORRECTION_COLLISION").when(F.col("correction").isNotNull(), "CORRECTED").when(F.col("several"), "AMBIGUOUS_FIELD").otherwise("UNKNOWN_FIELD")
    return rows.select(*at, "key", F.when(~F.coalesce("taken", F.lit(False)), F.col("correction")).alias("correction"), code.alias("code"))


def repair_values(fields: DataFrame, aliases: DataFrame, protected: str = r"(name|title|description|summary|text)$") -> DataFrame:
    """``fields``(entity_id, path, value) with values replaced by exact (path, alias) rows of ``aliases``(path, alias, canonical); free text stays."""
    rows = fields.join(aliases.withColumnRenamed("alias", "value"), ["path", "value"], "left")
    new = F.when(F.rlike("path", F.lit(protected)), F.col("value")).otherwise(F.coalesce("canonical", "value"))
    return rows.select("entity_id", "path", new.alias("value"), F.col("canonical").isNotNull().alias("matched"))


def normalise_enums(plan: DataFrame, spellings: dict[str, dict[str, str]], arrays: tuple[str, ...] = ()) -> DataFrame:
    """Known other spellings of enum columns, and empty lists for missing arrays."""
    for column, names in spellings.items():
        value = F.col(column)
        for old, new in names.items():
            value = F.when(F.col(column) == old, new).otherwise(value)
        plan = plan.withColumn(column, value)
    for column in arrays:
        plan = plan.withColumn(column, F.coalesce(column, F.array().cast(plan.schema[column].dataType)))
    return plan
