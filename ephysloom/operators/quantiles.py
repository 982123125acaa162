"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
task.  Here a bounded sketch brackets the wanted ranks first; a second pass
counts the values below each bracket (map-side combined) and keeps only those
inside it, about ``4 / accuracy`` of the group.

Defined results: nulls and NaN are left out; a group without values has no row;
ties are kept; ``interpolate`` takes the linear rule between neighbouring ranks,
else the lower rank is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float], accuracy: int = 2000, interpolate: bool = True) -> DataFrame:
    """``*keys, n, <name per entry of probs>``."""
    ks = list(keys)
    v = df.select(*ks, value.cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    reach = 2.0 / accuracy
    wanted = [p for q in probs.values() for p in (max(0.0, q - reach), min(1.0, q + reach))]
    sketch = v.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", F.array(*[F.lit(p) for p in wanted]), F.lit(accuracy)).alias("__b"),
    )
    at = []
    for i, q in enumerate(probs.values()):
        lo = F.col("__min") if q <= reach else F.element_at("__b", 2 * i + 1)
        # ranks k and k + 1 are needed, so a few ranks more than the sketch's error
        hi = F.col("__max") if q >= 1 - reach else F.element_at("__b", 2 * i + 2)
        small = F.col("n") <= accuracy
        at.append(F.struct(F.lit(i).alias("i"), F.when(small, F.col("__min")).otherwise(lo).alias("lo"), F.when(small, F.col("__max")).otherwise(hi).alias("hi")))
    sketch = sketch.select(*ks, "n", F.array(*at).alias("__at"))
    if ks:
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ks]
        on = same[0]
        for s in same[1:]:
            on = on & s
        j = v.alias("a").join(sketch.alias("b"), on).select(*[F.col(f"a.{k}").alias(k) for k in ks], "n", "__v", F.explode("__at").alias("x"))
    else:
        j = v.join(F.broadcast(sketch)).select("n", "__v", F.explode("__at").alias("x"))  # one row
    inside = (F.col("__v") >= F.col("x.lo")) & (F.col("__v") <= F.col("x.hi"))
    # equal values inside a bracket are counted, not repeated
    c = j.filter(inside | (F.col("__v") < F.col("x.lo"))).groupBy(*ks, "n", F.col("x.i").alias("i"), F.when(inside, F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("c"))
    g = c.groupBy(*ks, "n", "i").agg(
        F.sum(F.when(F.col("__v").isNull(), F.col("c")).otherwise(0)).alias("below"),
        F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__v", "c")))).alias("vs"),
    )
    prob = F.element_at(F.array(*[F.lit(float(q)) for q in probs.values()]), F.col("i") + 1)
    g = g.withColumn("h", (F.col("n") - 1) * prob)

    def nth(k: Column) -> Column:  # value of rank k (from 0) by walking the counts
        start = F.struct(F.col("below").alias("seen"), F.lit(None).cast("double").alias("v"))
        return F.aggregate("vs", start, lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["v"], F.when(a["seen"] + x["c"] > k, x["__v"])).alias("v")))["v"]

    lo = nth(F.floor("h"))
    out = lo + (nth(F.least(F.floor("h") + 1, F.col("n") - 1)) - lo) * (F.col("h") - F.floor("h")) if interpolate else lo
    g = g.select(*ks, "n", "i", out.alias("q"))
    return g.groupBy(*ks, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(probs)])
