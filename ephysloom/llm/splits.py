"""Splits that keep related records together.

Records are linked through shared things; each thing gives star links from one
of its records, never pairs.  ``spanning_forest`` contracts the links in the
manner of Boruvka: every component takes its least edge (to the neighbour with
the smallest name; only two components can so name each other, and the smaller
of them stays a root), the trees so made are flattened by pointer jumping, links
are rewritten to their roots, and links within one root fall away; so on until
none is left.  Each round at least halves the linked components, so the rounds
are logarithmic in their number, whatever the shape of the graph.  The edges
taken are written each round, in terms of the nodes they join: together they are
a spanning forest, from which every shared split can be explained.

The few components that hold a large share of the records are dealt one by one;
all others are dealt to the splits in strata of like size: within a stratum they are ordered by a hash, and each takes the split its place in the
cumulated records falls into.  The cumulated counts are formed within blocks of
the hash and carried from block to block, so a stratum of any number of
components (most are single records) is dealt in many tasks.

Defined results: a null link is none; repeated links and links of a node to
itself change nothing; a node without links is a component of its own; the
result does not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Scratch


def star_links(members: DataFrame, node: str, thing: str) -> DataFrame:
    """``a, b``: each node of a thing linked to the thing's smallest node."""
    m = members.select(F.col(node).alias("b"), F.col(thing).alias("t")).dropna().distinct()
    return m.join(m.groupBy("t").agg(F.min("b").alias("a")), "t").filter("a <> b").select("a", "b")


def spanning_forest(nodes: DataFrame, links: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``node, root`` of every node of ``nodes (node)`` and ``links (a, b)``,
    ``a, b`` of the links taken).  Ends when no link is left, however many rounds."""
    links = links.select("a", "b").dropna().filter("a <> b")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    both = links.select(*pair).distinct()
    both = keep.save(both.select("a", "b", F.col("a").alias("oa"), F.col("b").alias("ob")))
    ends = both.select(F.explode(F.array("a", "b")).alias("node"))
    of = keep.save(nodes.select("node").dropna().unionByName(ends).distinct().select("node", F.col("node").alias("root")))
    forest: DataFrame | None = None
    while not both.isEmpty():
        near = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "oa", "ob"))
        least = near.groupBy("a").agg(F.min(F.struct("b", "oa", "ob")).alias("m")).select(F.col("a").alias("r"), F.col("m.b").alias("p"), "m.oa", "m.ob")
        least = keep.save(least)
        taken = least.select(F.col("oa").alias("a"), F.col("ob").alias("b")).distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        back = least.select(F.col("r").alias("p"), F.col("p").alias("pp"))
        root = (F.col("pp") == F.col("r")) & (F.col("r") < F.col("p"))
        up = keep.save(least.join(back, "p").select("r", F.when(root, F.col("r")).otherwise(F.col("p")).alias("p")))
        while True:
            top = up.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            jumped = keep.save(up.join(top, "p", "left").select("r", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            more = not jumped.filter("moved").isEmpty()
            up = jumped.select("r", "p")
            if not more:
                break
        new_of = keep.save(of.join(up.select(F.col("r").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        a, b = up.select(F.col("r").alias("a"), F.col("p").alias("pa")), up.select(F.col("r").alias("b"), F.col("p").alias("pb"))
        l = both.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "oa", "ob")
        new_both = keep.save(l.groupBy("a", "b").agg(F.min(F.struct("oa", "ob")).alias("o")).select("a", "b", "o.oa", "o.ob"))
        keep.drop(of, both)
        of, both = new_of, new_both
    return of, forest if forest is not None else links.limit(0)


def components(nodes: DataFrame, links: DataFrame, keep: Scratch) -> DataFrame:
    """``node, root`` alone."""
    return spanning_forest(nodes, links, keep)[0]


def deal(sizes: DataFrame, shares: Sequence[tuple[str, float]], seed: int = 7, large: float = 0.002) -> DataFrame:
    """``root, split`` from ``root, n``.

    Components with at least ``large`` of all records (at most ``1 / large``) are
    dealt first, the largest first, each to the split that lacks most: no place in
    an order can balance them.  The rest fills what the splits still lack, in
    strata by the power of two of ``n``: ordered by hash, the middle of each
    one's records in the stratum's cumulated total decides its split.
    """
    size = F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).cast("long")
    s = sizes.select("root", size.alias("n"), F.floor(F.log2(size)).cast("int").alias("band"), F.xxhash64(F.lit(seed), "root").alias("h"))
    total = s.agg(F.sum("n")).first()[0] or 0
    least = max(2.0, large * total)
    heads = s.filter(F.col("n") >= least).select("root", "n", "h").collect()  # at most 1 / large rows
    lack = [share * total for _, share in shares]
    dealt = []
    for h in sorted(heads, key=lambda x: (-x["n"], x["h"], x["root"])):
        k = max(range(len(lack)), key=lambda i: (lack[i], -i))
        lack[k] -= h["n"]
        dealt.append((h["root"], shares[k][0]))
    lack = [max(x, 0.0) for x in lack]
    ends = [sum(lack[: k + 1]) / (sum(lack) or 1.0) for k in range(len(lack))]

    s = s.filter(F.col("n") < least).withColumn("block", F.shiftright("h", 52))  # 4096 blocks in the hash's order
    b = s.groupBy("band", "block").agg(F.sum("n").alias("in_block"))
    w = W.partitionBy("band")
    b = b.select("band", "block", F.coalesce(F.sum("in_block").over(w.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.sum("in_block").over(w).alias("all"))
    order = W.partitionBy("band", "block").orderBy("h", "root").rowsBetween(W.unboundedPreceding, -1)
    s = s.join(b, ["band", "block"])
    at = (F.col("earlier") + F.coalesce(F.sum("n").over(order), F.lit(0)) + F.col("n") / 2) / F.col("all")
    s = s.withColumn("at", at)
    split = F.lit(shares[-1][0])
    for k in range(len(shares) - 2, -1, -1):
        split = F.when(F.col("at") < ends[k], F.lit(shares[k][0])).otherwise(split)
    rest = s.select("root", split.alias("split"))
    if not dealt:
        return rest
    return rest.unionByName(sizes.sparkSession.createDataFrame(dealt, sizes.select("root", F.lit("").alias("split")).schema))
