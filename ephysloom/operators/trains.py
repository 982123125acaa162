"""Event trains and clocks: gaps, bursts, nearest matches, parts and lags.

Trains are rows of (group, time); times are numbers (microseconds or seconds).
Defined results: null times are left out; equal times keep the order given by
the tie columns; a group of one row has no interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bursts(df: DataFrame, group: Sequence[str], time: str, gap: float, ties: Sequence[str] = ()) -> DataFrame:
    """``*group, burst, start, end, n``: a step of more than ``gap`` begins the next burst."""
    w = W.partitionBy(*group).orderBy(time, *ties)
    d = df.filter(F.col(time).isNotNull()).withColumn("__new", (F.coalesce(F.col(time) - F.lag(time).over(w) > gap, F.lit(False))).cast("int"))
    d = d.withColumn("burst", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*group, "burst").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, at: str, bucket: int | None = None) -> DataFrame:
    """``left`` with ``before`` and ``after`` (the neighbouring times of
    ``right``) and ``nearest`` (the closer one, the earlier of two as close).

    One sorted pass over both sides together, no join: the last right time at or
    before and the first at or after each left row.  ``bucket`` cuts a long
    group into pieces of time; what a piece lacks is carried from the nearest
    piece that has any right time, by a window over the pieces alone.
    """
    cols = left.columns
    cut = F.floor(F.col("__t") / bucket) if bucket else F.lit(0).cast("long")
    a = left.select(*cols, F.col(time).alias("__t"), F.lit(None).cast(right.schema[at].dataType).alias("__r"), F.lit(True).alias("__l"))
    b = right.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__t"), F.col(at).alias("__r"), F.lit(False).alias("__l"))
    u = a.unionByName(b, allowMissingColumns=True).withColumn("__b", cut)
    w = W.partitionBy(*keys, "__b").orderBy("__t")
    u = u.withColumn("before", F.max("__r").over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("after", F.min("__r").over(w.rangeBetween(0, W.unboundedFollowing)))
    u = u.filter("__l")
    if bucket:
        ends = right.filter(F.col(at).isNotNull()).groupBy(*keys, F.floor(F.col(at) / bucket).alias("__b")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
        pieces = u.select(*keys, "__b").distinct().join(ends, [*keys, "__b"], "full")
        p = W.partitionBy(*keys).orderBy("__b")
        pieces = pieces.select(*keys, "__b", F.last("hi", True).over(p.rowsBetween(W.unboundedPreceding, -1)).alias("__prev"), F.first("lo", True).over(p.rowsBetween(1, W.unboundedFollowing)).alias("__next"))
        u = u.join(pieces, [*keys, "__b"], "left").withColumn("before", F.coalesce("before", "__prev")).withColumn("after", F.coalesce("after", "__next"))
    t = F.col("__t")
    closer = F.when(F.col("after").isNull() | (t - F.col("before") <= F.col("after") - t), F.col("before")).otherwise(F.col("after"))
    return u.select(*cols, "before", "after", closer.alias("nearest"))


def running_starts(df: DataFrame, group: Sequence[str], order: Sequence[str], length: str) -> DataFrame:
    """``start``: the summed lengths of the parts before."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("start", F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))


def affine_fit(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares ``y = slope x + offset`` per group, with the largest residual."""
    f = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("offset"))
    r = df.join(f, list(group)).withColumn("__r", F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("offset")))
    return r.groupBy(*group).agg(F.max("n").alias("n"), F.max("slope").alias("slope"), F.max("offset").alias("offset"), F.max("__r").alias("worst"))


def fill_nearest(value: Column, forward: W, backward: W) -> Column:
    """The value, else the last before, else the first after (nulls and NaN filled)."""
    v = F.when(~F.isnan(value), value)
    return F.coalesce(v, F.last(v, True).over(forward), F.first(v, True).over(backward))
