"""Ranks with ties, and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie rank of ``value`` in each group.

    Equal values are counted first, so the sorted window holds distinct values
    only; a value's rank is what lies below it plus half its own count.  Nulls
    and NaN have no rank.
    """
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy("__x")
    r = v.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col(value).alias("__x"), "__c")
    r = r.withColumn("__r", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)) - (F.col("__c") - 1) / 2).drop("__c")
    cond = F.col(value) == F.col("__x")
    for i, k in enumerate(by):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(r, cond, "left").select(*df.columns, F.col("__r").alias(out))


def bh_adjusted(df: DataFrame, by: Sequence[str], p: str, order: Sequence[str], out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg: ``p n / rank``, running minimum from the largest
    down, at most 1; nulls stay null and do not count."""
    w = W.partitionBy(*by)
    n = F.count(p).over(w)
    rank = F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), *order))
    d = df.withColumn("__q", F.when(F.col(p).isNotNull(), F.col(p) * n / rank)).withColumn("__rank", rank)
    down = w.orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min("__q").over(down), F.lit(1.0)))).drop("__q", "__rank")


def bh_mask(df: DataFrame, by: Sequence[str], p: str, order: Sequence[str], q: float, out: str = "significant") -> DataFrame:
    """Whether ``p`` is at most the largest p with ``p <= q k / m``."""
    w = W.partitionBy(*by)
    k = F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), *order))
    d = df.withColumn("__ok", F.when(F.col(p) <= q * k / F.count(p).over(w), F.col(p)))
    return d.withColumn(out, F.coalesce(F.col(p) <= F.max("__ok").over(w), F.lit(False))).drop("__ok")


def entropy_bits(n: Column, total: Column) -> Column:
    """This part's share of the Shannon entropy."""
    return F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0)
