"""Overlapping and gapped intervals: continuous periods and the gaps between.

Time is discretised exactly, in microseconds.  Each interval is lengthened by
the tolerance, so that runs at most that far apart touch, and laid over cells
as wide as the tolerance, 60 to a shard.  A lengthened interval always reaches
the end of the cell it starts in, so a cell is described completely by three
numbers: the first start in it, the last end in it, and whether some interval
covers it whole.  Per entity and shard that is a compressed run bitmap (one
60-bit word plus at most 60 heads and tails) whose union is min, max and bit_or
- combined on the map side, whatever the number of rows.  Whole shards inside a
long interval stay one run record.  Set runs are read off each shard and stitched
within blocks of shards; from block to block only the last end and the number of
periods are carried, so no task sorts more than a block of an entity.  Clear runs
are what lies between.  (With tolerance 0 there is no cell width; the intervals
themselves are stitched in blocks.)

Defined results: an interval without both ends, or whose end is not after its
start, does not count; null entity values form an entity of their own; an
entity without valid intervals yields nothing; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 60  # cells per shard: one bit of a long each
SHARDS = 64  # shards per block


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without zone."""
    return F.unix_micros(c.cast("timestamp"))


def latest_version(df: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """Per key the row with the greatest version (ties: the greatest row)."""
    best = F.max(F.struct(F.col(version).alias("__v"), *columns)).alias("__b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"__b.{c}").alias(c) for c in columns])


def merge_runs(df: DataFrame, entity: Sequence[str], start: str, end: str, tolerance: int = 60_000_000) -> DataFrame:
    """Periods per entity: ``*entity, start_us, end_us, prev_us`` from long
    columns; ``prev_us`` is the end of the period before, null for the first.

    ``tolerance`` (microseconds, at least 0) is the widest hole that is closed.
    """
    w, e = F.lit(tolerance), list(entity)
    d = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    if not tolerance:
        return stitch(d.select(*e, F.col(start).alias("s"), F.col(end).alias("t")), e, "s", "t", 3_600_000_000 * SHARDS)
    d = d.select(*e, F.col(start).alias("s"), (F.col(end) + w).alias("t"))
    cell = lambda a: _floordiv(a, tolerance)
    d = d.withColumn("hc", cell(F.col("s"))).withColumn("tc", cell(F.col("t")))
    d = d.withColumn("hs", _floordiv(F.col("hc"), CELLS)).withColumn("ts", _floordiv(F.col("tc"), CELLS))
    none = F.lit(None).cast("long")

    def piece(shard, minute, head, tail, mask, upto=none):
        return F.struct(shard.alias("shard"), minute.cast("int").alias("minute"), head.alias("head"), tail.alias("tail"), mask.alias("mask"), upto.alias("upto"))

    def bits(lo, hi):  # cells lo..hi of a shard as a 60-bit word, 0 if none
        n = F.greatest(hi - lo + 1, F.lit(0)).cast("int")
        ones = F.when(n >= CELLS, F.lit((1 << CELLS) - 1)).otherwise(F.expr("1L") * F.pow(F.lit(2.0), n).cast("long") - 1)
        return (ones * F.pow(F.lit(2.0), F.greatest(lo, F.lit(0)).cast("int")).cast("long")).cast("long")

    hm, tm = F.col("hc") - F.col("hs") * CELLS, F.col("tc") - F.col("ts") * CELLS
    same = F.col("hs") == F.col("ts")
    pieces = F.array(
        piece(F.col("hs"), hm, F.col("s"), none, none),
        piece(F.col("ts"), tm, none, F.col("t"), none),
        piece(F.col("hs"), F.lit(-1), none, none, F.when(same, bits(hm + 1, tm - 1)).otherwise(bits(hm + 1, F.lit(CELLS - 1).cast("long")))),
        piece(F.col("ts"), F.lit(-1), none, none, F.when(same, F.lit(0).cast("long")).otherwise(bits(F.lit(0).cast("long"), tm - 1))),
        piece(F.when(F.col("ts") - F.col("hs") > 1, F.col("hs") + 1), F.lit(-2), none, none, none, F.col("ts") - 1),
    )
    p = d.select(*e, F.explode(pieces).alias("p")).select(*e, "p.*").filter(F.col("shard").isNotNull() & ((F.col("minute") != -1) | (F.col("mask") != 0)))
    cells = p.groupBy(*e, "shard", "minute").agg(F.min("head").alias("head"), F.max("tail").alias("tail"), F.expr("bit_or(mask)").alias("mask"), F.max("upto").alias("upto"))

    # set runs of a shard: at most CELLS heads, CELLS tails and CELLS/2 bit runs
    base = (F.col("shard") * CELLS + F.col("minute")) * w
    head = F.when(F.col("head").isNotNull(), F.struct(F.col("head").alias("s"), (base + w).alias("t")))
    tail = F.when(F.col("tail").isNotNull() & (F.col("tail") > base), F.struct(base.alias("s"), F.col("tail").alias("t")))
    mask = F.when(
        F.col("minute") == -1,
        F.filter(
            F.transform(
                F.sequence(F.lit(0), F.lit(CELLS - 1)),
                lambda i: F.when(
                    F.col("mask").bitwiseAND(F.pow(F.lit(2.0), i).cast("long")) != 0,
                    F.struct(((F.col("shard") * CELLS + i) * w).alias("s"), ((F.col("shard") * CELLS + i + 1) * w).alias("t")),
                ),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    shard_w = F.lit(CELLS * tolerance)
    whole = F.when(F.col("minute") == -2, F.array(F.struct((F.col("shard") * shard_w).alias("s"), ((F.col("upto") + 1) * shard_w).alias("t"))))
    runs = F.coalesce(whole, mask, F.array_compact(F.array(head, tail)))
    per = cells.select(*e, "shard", (F.col("minute") == -2).alias("mid"), runs.alias("r")).groupBy(*e, "shard", "mid").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("r"))
    folded = F.aggregate(
        "r",
        F.expr("cast(array() as array<struct<s:bigint,t:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["t"] >= x["s"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["t"], x["t"]).alias("t"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    flat = per.select(*e, F.explode(folded).alias("x")).select(*e, "x.s", "x.t")
    out = stitch(flat, e, "s", "t", SHARDS * CELLS * tolerance)
    return out.select(*e, "start_us", (F.col("end_us") - w).alias("end_us"), (F.col("prev_us") - w).alias("prev_us"))


def _floordiv(c: Column, n: int) -> Column:
    """Exact floor division of longs (a double quotient would round)."""
    return F.call_function("div", c - F.pmod(c, F.lit(n).cast("long")), F.lit(n).cast("long"))


def stitch(df: DataFrame, entity: Sequence[str], start: str, end: str, block: int) -> DataFrame:
    """Merge runs that touch or overlap: ``*entity, start_us, end_us, prev_us``.

    A run begins a period if it starts after every end before it: the ends of its
    own block by a running maximum, those of earlier blocks by one number carried
    per block.  The window over an entity sees one row a block.
    """
    e = list(entity)
    keys = [F.col(c).alias(f"__e{i}") for i, c in enumerate(e)]
    names = [f"__e{i}" for i in range(len(e))]
    d = df.select(*keys, F.col(start).alias("s"), F.col(end).alias("t"), _floordiv(F.col(start), block).alias("__b"))

    def per_block(x: DataFrame, *aggs) -> DataFrame:
        g = x.groupBy(*names, "__b").agg(*aggs)
        return g.select(*[F.col(n).alias(f"r{n}") for n in [*names, "__b"]], *[F.col(c) for c in g.columns if c not in (*names, "__b")])

    def on(*cols):
        c = F.lit(True)
        for n in cols:
            c = c & F.col(n).eqNullSafe(F.col(f"r{n}"))
        return c

    rw = W.partitionBy(*[f"r{n}" for n in names]).orderBy("r__b").rowsBetween(W.unboundedPreceding, -1)
    ends = per_block(d, F.max("t").alias("__t")).withColumn("__carry", F.max("__t").over(rw)).drop("__t")
    d = d.join(ends, on(*names, "__b")).select(*names, "s", "t", "__b", "__carry")
    bw = W.partitionBy(*names, "__b").orderBy("s", "t")
    before = F.greatest(F.max("t").over(bw.rowsBetween(W.unboundedPreceding, -1)), F.col("__carry"))
    d = d.withColumn("__before", before).withColumn("__new", (F.col("__before").isNull() | (F.col("s") > F.col("__before"))).cast("long"))
    made = per_block(d, F.sum("__new").alias("__n")).withColumn("__from", F.coalesce(F.sum("__n").over(rw), F.lit(0))).drop("__n")
    d = d.join(made, on(*names, "__b"))
    d = d.withColumn("__no", F.col("__from") + F.sum("__new").over(bw.rowsBetween(W.unboundedPreceding, 0)))
    p = d.groupBy(*names, "__no").agg(F.min("s").alias("start_us"), F.max("t").alias("end_us"), F.max(F.when(F.col("__new") == 1, F.col("__before"))).alias("prev_us"))
    return p.select(*[F.col(f"__e{i}").alias(c) for i, c in enumerate(e)], "start_us", "end_us", "prev_us")


def periods_and_gaps(periods: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Set and clear runs: ``*entity, kind, start_us, end_us``; no shuffle, each
    period knows the end before it."""
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_us").alias("start_us"), F.col("end_us").alias("end_us")),
        F.struct(F.when(F.col("prev_us").isNotNull(), F.lit("gap")).alias("kind"), F.col("prev_us").alias("start_us"), F.col("start_us").alias("end_us")),
    )
    e = list(entity)
    return periods.select(*e, F.explode(both).alias("x")).select(*e, "x.*").filter(F.col("kind").isNotNull())
