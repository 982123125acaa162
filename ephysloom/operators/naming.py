"""Joins on normalised names: match reports, aliases and candidates.

Defined results: names are normalised on both sides; null or blank names match
nothing and are counted as unmatched; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.skew import SALT, salted


def match_flags(left: DataFrame, right: DataFrame, group: Sequence[str], key: str, fallback: str, right_key: str, right_fallback: str) -> DataFrame:
    """``left`` with ``by_key`` and ``by_fallback`` (only where the key fails).

    The right side is cut to its distinct names first; hot groups of the left
    are salted.
    """
    names = right.select(*group, F.explode(F.array(F.struct(F.lit("k").alias("how"), F.col(right_key).alias("name")), F.struct(F.lit("f").alias("how"), F.col(right_fallback).alias("name")))).alias("x"))
    names = names.select(*group, F.col("x.how").alias("how"), F.col("x.name").alias("name")).filter(F.col("name").isNotNull() & (F.col("name") != "")).distinct()
    n = names.groupBy(*group, "name").agg(F.max(F.col("how") == "k").alias("__k"), F.max(F.col("how") == "f").alias("__f"))
    a = n.filter("__k").withColumnRenamed("name", key).select(*group, key, F.lit(True).alias("__hit"))
    b = n.filter("__f").withColumnRenamed("name", fallback).select(*group, fallback, F.lit(True).alias("__raw"))
    spread = F.struct(*left.columns)
    l, a = salted(left, a, [*group, key], spread)
    d = l.join(a, [*group, key, SALT], "left").drop(SALT)
    l, b = salted(d, b, [*group, fallback], spread)
    d = l.join(b, [*group, fallback, SALT], "left").drop(SALT)
    hit = F.coalesce("__hit", F.lit(False))
    return d.withColumn("by_key", hit).withColumn("by_fallback", ~hit & F.coalesce("__raw", F.lit(False))).drop("__hit", "__raw")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return F.when(F.greatest(F.length(a), F.length(b)) > 0, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(1.0)


def candidates(unmatched: DataFrame, names: DataFrame, block: Sequence[str], left: str, right: str, top: int) -> DataFrame:
    """The ``top`` most similar names of the same block (patient and contact
    number) for every unmatched name: ``*block, left, right, similarity, no``."""
    j = unmatched.select(*block, left).distinct().join(names.select(*block, right).distinct(), list(block))
    j = j.withColumn("similarity", similarity(F.col(left), F.col(right)))
    w = W.partitionBy(*block, left).orderBy(F.desc("similarity"), right)
    return j.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= top)
