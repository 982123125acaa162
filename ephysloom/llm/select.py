"""Percentiles per group by distributed multi-select.

Every partition proposes the median of its values in each open range; the
weighted median of the proposals becomes the range's pivot; values below, equal
to and above it are counted; ranges without a wanted rank are ruled out; and so
on until a range is small enough to be sorted on its own.  All percentiles of a
group are sought together.  Nothing is approximated: the stated rank error is 0.

Only proposals (one per partition and range) and counts move between the rounds.
Groups of at most ``finish`` values are small from the start and take the final
step at once, so the rounds see the large groups alone, and however large a
group is, no task holds more than ``finish`` values of it.

Counts and proposals of separate days or partitions simply add up: the same
operator over the day as a further group gives day summaries, and ``combine``
merges those with a rank error of at most one step of their grid.

Defined results: only finite values count; a group without any yields no rows;
ties are one value; percentile p is the smallest value with at least p percent
of the values at or below it; a null group is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

INF = float("inf")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One proposal per range of this partition: weighted median of chunk medians."""
    got: dict[int, list[tuple[float, int]]] = {}

    def chunk(rid: np.ndarray, v: np.ndarray):
        order = np.lexsort((v, rid))
        rid, v = rid[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
        size = np.diff(np.append(first, len(rid)))
        for r, m, n in zip(rid[first].tolist(), v[first + (size - 1) // 2].tolist(), size.tolist(), strict=True):
            got.setdefault(r, []).append((m, n))

    rids, vs, held = [], [], 0
    for b in batches:
        rids.append(b.column("rid").to_numpy(zero_copy_only=False))
        vs.append(b.column("v").to_numpy(zero_copy_only=False))
        held += b.num_rows
        if held >= 200_000:
            chunk(np.concatenate(rids), np.concatenate(vs))
            rids, vs, held = [], [], 0
    if held:
        chunk(np.concatenate(rids), np.concatenate(vs))
    if got:
        out = []
        for r, ms in got.items():
            ms.sort()
            n, c = sum(k for _, k in ms), 0
            for m, k in ms:
                c += k
                if 2 * c >= n:
                    out.append((r, m, n))
                    break
        r, m, n = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(m, pa.float64()), pa.array(n, pa.int64())], names=["rid", "m", "n"])


def _in_range(rows: DataFrame, ranges: DataFrame, few: bool, salts: int = 64) -> DataFrame:
    """Rows (g, v) with the range they fall in.  Few ranges (counted by the
    caller) are broadcast; else both sides are salted, for every group here is
    a large one."""
    r = ranges
    on = rows["g"] == r["g"]
    if few:
        r = F.broadcast(r)
    else:
        rows = rows.withColumn("__s", (F.rand(11) * salts).cast("int"))  # by row: equal values must not share a salt
        r = r.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = (rows["g"] == r["g"]) & (rows["__s"] == r["__s"])
    return rows.join(r, on & (rows["v"] > r["lo"]) & (rows["v"] < r["hi"])).drop(r["g"])


def multiselect(values: DataFrame, groups: Sequence[str], value: str, percents: Sequence[int], finish: int = 65_536, broadcast_ranges: int = 50_000, max_rounds: int = 200) -> DataFrame:
    """``*groups, pct, value, n, rank`` for whole percents of each group."""
    spark = values.sparkSession
    keep = Scratch(spark)
    gs, ks = list(groups), [f"__k{i}" for i in range(len(groups))]  # own names, so that none clashes
    v = values.select(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in gs]).alias("g"), *[F.col(c).alias(k) for c, k in zip(gs, ks, strict=True)], F.col(value).cast("double").alias("v")).filter(finite(F.col("v")))
    # -0.0 and 0.0 are one value
    v = v.withColumn("v", F.col("v") + F.lit(0.0))
    sizes = v.groupBy("g", *ks).agg(F.count(F.lit(1)).alias("n"))
    rank = lambda p: F.greatest(F.lit(1).cast("long"), F.call_function("div", F.col("n") * F.lit(p).cast("long") + 99, F.lit(100).cast("long")))
    wanted = F.array(*[F.struct(F.lit(p).alias("pct"), rank(p).alias("k")) for p in percents])
    sizes = keep.save(sizes)
    if sizes.groupBy("g").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two groups share a hash; name them differently")
    v = v.select("g", "v")
    ranges = sizes.select("g", F.col("g").alias("rid"), F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"), "n", wanted.alias("want"))
    done = ranges.filter(F.col("n") <= finish)  # taken from ``v`` at the end
    ended: list[tuple[DataFrame, DataFrame]] = []  # later ranges with their values
    open_ = keep.save(ranges.filter(F.col("n") > finish))
    found: list[DataFrame] = []
    left = open_.count()
    rows = None
    held = 0
    for no in range(max_rounds):
        if not left:
            break
        few = left <= broadcast_ranges
        total = open_.agg(F.sum("n")).first()[0]
        if rows is None or total < held / 2:  # ruled-out values are dropped
            old, rows = rows, keep.save(_in_range(v if rows is None else rows, open_.select("g", "lo", "hi"), few).select("g", "v"))
            keep.drop(old)
            held = total
        located = _in_range(rows, open_.select("g", "rid", "lo", "hi"), few)
        proposals = located.select("rid", "v").mapInArrow(_propose, "rid long, m double, n long")
        pivots = proposals.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("m", "n"))).alias("ms"), F.sum("n").alias("t"))
        walk = F.aggregate(
            "ms",
            F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("p")),
            lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(a["p"].isNull() & ((a["c"] + x["n"]) * 2 >= F.col("t")), x["m"]).otherwise(a["p"]).alias("p")),
        )
        pivoted = keep.save(open_.join(pivots.select("rid", walk["p"].alias("p")), "rid"))
        counted = _in_range(rows, pivoted.select("g", "rid", "lo", "hi", "p"), few).groupBy("rid").agg(
            F.sum((F.col("v") < F.col("p")).cast("long")).alias("lt"), F.sum((F.col("v") == F.col("p")).cast("long")).alias("eq")
        )
        s = pivoted.join(counted, "rid")
        lt, le = F.col("lt"), F.col("lt") + F.col("eq")
        below = F.filter("want", lambda x: x["k"] <= lt)
        at = F.filter("want", lambda x: (x["k"] > lt) & (x["k"] <= le))
        above = F.transform(F.filter("want", lambda x: x["k"] > le), lambda x: F.struct(x["pct"].alias("pct"), (x["k"] - le).alias("k")))
        split = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("p").alias("hi"), lt.alias("n"), below.alias("want")),
            F.struct(F.col("p").alias("lo"), F.col("hi").alias("hi"), (F.col("n") - le).alias("n"), above.alias("want")),
        )
        s = keep.save(s.select("g", "p", at.alias("at"), F.filter(split, lambda x: F.size(x["want"]) > 0).alias("split")))
        found.append(s.select("g", F.explode("at").alias("x"), "p").select("g", "x.pct", F.col("p").alias("value")))
        nxt = s.select("g", F.explode("split").alias("x")).select("g", F.xxhash64("g", "x.lo", "x.hi", F.lit(no)).alias("rid"), "x.lo", "x.hi", "x.n", "x.want")
        # the values of a range that ends here are saved now: later rewrites of ``rows`` hold open ranges only
        ends = keep.save(nxt.filter(F.col("n") <= finish))
        n_ends = ends.count()
        if n_ends:
            ended.append((ends, keep.save(_in_range(rows, ends.select("g", "rid", "lo", "hi"), n_ends <= broadcast_ranges).select("rid", "v"))))
        old, open_ = open_, keep.save(nxt.filter(F.col("n") > finish))
        keep.drop(pivoted, old)
        left = open_.count()
    if left:
        raise RuntimeError("multi-select did not end")
    # final step: at most ``finish`` values a range
    last = v.join(done.select("g"), "g", "left_semi").select(F.col("g").alias("rid"), "v")
    for ends, vals in ended:
        done, last = done.unionByName(ends), last.unionByName(vals)
    held_values = last.groupBy("rid").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    end = done.join(held_values, "rid").select("g", F.explode("want").alias("x"), "vs").select("g", "x.pct", F.element_at("vs", F.col("x.k").cast("int")).alias("value"))
    for f in found:
        end = end.unionByName(f)
    end = keep.save(end)
    n_want, n_got = sizes.count() * len(percents), end.filter(F.col("value").isNotNull()).select("g", "pct").distinct().count()
    if n_got != n_want:
        raise RuntimeError(f"multi-select lost {n_want - n_got} of {n_want} percentiles")
    return sizes.join(end, "g").select(*[F.col(k).alias(c) for c, k in zip(gs, ks, strict=True)], F.col("pct").cast("int").alias("pct"), "value", "n", F.call_function("div", F.col("n") * F.col("pct") + 99, F.lit(100).cast("long")).alias("rank"))


def combine(points: DataFrame, groups: Sequence[str], parts: Sequence[str], percents: Sequence[int], even: Sequence[int] | None = None) -> DataFrame:
    """Merge percentile grids of separate parts (days, partitions).

    ``points`` holds, per group and part, values at the evenly spaced percents
    ``even`` with the part's ``n``.  A point stands for its step's share of the part; the
    merged percentile is the first point with enough weight at or below it.
    Rank error: at most one grid step of the total, given as ``error``.  The
    grid must be even (1, 2, ... 100 or the like), else it raises.
    """
    gs = list(groups)
    if even is None or len({b - a for a, b in zip(even, even[1:], strict=False)}) > 1 or even[-1] != 100 or even[0] != even[1] - even[0]:
        raise ValueError("points must stand at evenly spaced percents up to 100, given as ``even``")
    ids = [*gs, *parts]
    step = points.groupBy(*ids).agg(F.count(F.lit(1)).alias("steps"), F.max("n").alias("n_part"))
    step = step.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(ids)], "steps", "n_part")
    on = F.lit(True)
    for i, c in enumerate(ids):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    w = points.join(step, on).select(*gs, "value", (F.col("n_part") / F.col("steps")).alias("w"), "steps")
    w = w.groupBy(*gs, "value").agg(F.sum("w").alias("w"), F.min("steps").alias("steps"))
    per = w.groupBy(*gs).agg(F.array_sort(F.collect_list(F.struct("value", "w"))).alias("ps"), F.sum("w").alias("n"), (1.0 / F.min("steps")).alias("error"))

    def at(p):
        return F.aggregate(
            "ps",
            F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v")),
            lambda a, x: F.struct((a["c"] + x["w"]).alias("c"), F.when(a["v"].isNull() & (a["c"] + x["w"] >= F.col("n") * (p / 100) - 1e-6), x["value"]).otherwise(a["v"]).alias("v")),
        )["v"]

    each = F.array(*[F.struct(F.lit(p).alias("pct"), at(p).alias("value")) for p in percents])
    return per.select(*gs, F.explode(each).alias("x"), F.round("n").cast("long").alias("n"), "error").select(*gs, "x.pct", "x.value", "n", "error")
