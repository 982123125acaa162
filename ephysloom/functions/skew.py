"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01, least: int = 100_000) -> DataFrame:
    """Keys that hold at least ``share`` of the rows (and ``least`` rows).

    Counted with a map-side combine.  At most ``1/share`` keys can qualify, so
    the result has a proven bound and may be broadcast.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    n = n.filter(F.col("__n") >= least)
    total = df.agg((F.count(F.lit(1)) * share).alias("__least"))
    return n.join(F.broadcast(total), F.col("__n") >= F.col("__least")).select(*keys)


def salted(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, salts: int = 16, share: float = 0.01, least: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt column to be joined on besides ``keys``.

    Rows of ``left`` under a hot key are spread over ``salts`` sub-keys by
    ``spread``; only the matching rows of ``right`` are repeated.  Cold keys get
    salt 0 on both sides, so nothing else grows.
    """
    hot = hot_keys(left, keys, share, least).withColumn("__hot", F.lit(True))
    l = left.join(F.broadcast(hot), list(keys), "left")
    l = l.withColumn(SALT, F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    r = right.join(F.broadcast(hot), list(keys), "left")
    r = r.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.when(F.col("__hot"), salts - 1).otherwise(0)))).drop("__hot")
    return l, r
