"""Trial tables: validity with the first failing reason, outlier fences on the
survivors, rejection by robust scores with a cap, order and intervals.

Defined results: a null compared value fails no rule (rules that must fail on
null say so); groups of null keys are groups of their own; repeated rows are
trials of their own unless ``distinct`` was applied before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import group_quantiles


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule a row fails, null if it passes all."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(list(rules)):
        out = F.when(F.coalesce(fails, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def validity(on: str, end: str, stim: str, post: str, accuracy: str, bad: Column, allowed: Sequence[str], min_stim: float, min_post: float, max_post: float) -> Column:
    """The validity chain: bad span, accuracy, short stimulus, short and long response."""
    ok = F.lower(F.trim(F.col(accuracy))).isin(*allowed)
    return first_reason(
        [
            ("bad_span", bad),
            ("accuracy", ~F.coalesce(ok, F.lit(False))),
            ("stim_short", F.col(stim) < min_stim),
            ("post_short", F.col(post) < min_post),
            ("post_long", F.col(post) > max_post),
        ]
    )


def annotation_errors(df: DataFrame, onset: str, offset: str, end: str) -> DataFrame:
    """Rows whose offset is not after the onset or whose end is before the offset."""
    kind = first_reason([("offset_not_after_onset", F.col(offset) <= F.col(onset)), ("end_before_offset", F.col(end) < F.col(offset))])
    return df.withColumn("error", kind).filter("error is not null")


def fences(df: DataFrame, group: Sequence[str], value: str, how: str, low: float, high: float) -> DataFrame:
    """``*group, n, lo, hi``: fences of the survivors' values.

    ``iqr``: quartiles minus/plus low/high times their distance; ``z``: mean
    minus/plus times the population sd; ``pct``: the quantiles low and high.
    """
    if how == "z":
        s = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
        return s.select(*group, "n", (F.col("m") - low * F.col("sd")).alias("lo"), (F.col("m") + high * F.col("sd")).alias("hi"))
    if how == "pct":
        return group_quantiles(df, group, F.col(value), {"lo": low, "hi": high})
    q = group_quantiles(df, group, F.col(value), {"q1": 0.25, "q3": 0.75})
    d = F.col("q3") - F.col("q1")
    return q.select(*group, "n", (F.col("q1") - low * d).alias("lo"), (F.col("q3") + high * d).alias("hi"))


def group_z(df: DataFrame, group: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """Sample-sd z within the group; a flat group (sd at most 1e-9) gives 0."""
    w = W.partitionBy(*group)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn(out, F.when(F.coalesce(sd, F.lit(0.0)) <= 1e-9, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / sd))


def robust_reject(df: DataFrame, group: Sequence[str], score: str, order: Sequence[str], k_mad: float = 5.0, k_z: float = 4.0, least: int = 4, cap: float = 0.34) -> DataFrame:
    """Flag ``rejected``: above median + k * 1.4826 * MAD or above k_z sample
    sds, in groups of at least ``least``; at most ``floor(cap * n)`` of a group,
    the greatest scores first (ties by ``order``)."""
    med = group_quantiles(df, group, F.col(score), {"med": 0.5}).drop("n")
    d = df.join(med, list(group))
    dev = group_quantiles(d.withColumn("__dev", F.abs(F.col(score) - F.col("med"))), group, F.col("__dev"), {"mad": 0.5}).drop("n")
    base = df.groupBy(*group).agg(F.count(score).alias("n"), F.avg(score).alias("m"), F.stddev_samp(score).alias("sd"))
    d = d.join(dev, list(group)).join(base, list(group))
    by_mad = (F.col("mad") > 1e-6) & (F.col(score) > F.col("med") + k_mad * 1.4826 * F.col("mad"))
    by_z = (F.col("sd") > 1e-9) & ((F.col(score) - F.col("m")) / F.col("sd") > k_z)
    d = d.withColumn("hit", F.coalesce((F.col("n") >= least) & (by_mad | by_z), F.lit(False)))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("hit"), F.desc(score), *order))
    return d.withColumn("rejected", F.col("hit") & (rank <= F.floor(cap * F.col("n"))))


def overlapping_span(trials: DataFrame, spans: DataFrame, keys: Sequence[str], t0: str, t1: str, a: str, b: str, trial_id: str, bucket: float) -> DataFrame:
    """``trial_id, span_start``: the first span each trial overlaps (``t0 < b``
    and ``t1 > a``).  Both sides are cut into buckets of time, so the range join
    is an equi-join on key and bucket."""
    cut = lambda x: F.floor(F.col(x) / bucket).cast("long")
    l = trials.select(*keys, F.col(trial_id).alias("trial_id"), F.col(t0).alias("t0"), F.col(t1).alias("t1"), F.explode(F.sequence(cut(t0), cut(t1))).alias("__k"))
    r = spans.select(*keys, F.col(a).alias("a"), F.col(b).alias("b"), F.explode(F.sequence(cut(a), cut(b))).alias("__k"))
    j = l.join(r, [*keys, "__k"]).filter((F.col("t0") < F.col("b")) & (F.col("t1") > F.col("a")))
    return j.groupBy("trial_id").agg(F.min("a").alias("span_start"))


def next_gap(df: DataFrame, group: Sequence[str], onset: str, end: str, order: Sequence[str], out: str = "iti") -> DataFrame:
    """Inter-trial interval: next onset minus this trial's end, null for the last."""
    return df.withColumn(out, F.lead(onset).over(W.partitionBy(*group).orderBy(onset, *order)) - F.col(end))
