"""References to records that do not exist.

A foreign-key graph is described by nodes (tables with a ``row_id``) and
``Ref`` edges.  ``orphan_cascade`` finds, for every edge, the child rows whose
reference is given but has no parent valid at the child's time (*direct*
orphans), then carries the loss down the graph: a child whose every valid
parent is itself an orphan is an *inherited* orphan.  Tables are taken in
topological order and each edge between two tables is one join: the parents are
cut to distinct keys and bounds with their state (alive, or lost at a depth),
and a child's parents are counted in the same shuffle that makes its rows
distinct.  Edges of a table to itself are iterated by semi-joins of the newly
lost rows until no row is added.

Defined results: a null or blank key refers to nothing and is never an orphan;
a row with a null time matches only parents without bounds; repeated rows are
counted once by ``row_id``; an empty parent table makes every given reference a
direct orphan; extra columns are ignored.  ``reason`` of a direct orphan:
``never`` (no such key), ``removed`` (all ended before), ``later`` (all begin
after), ``between`` (some ended, some begin after), ``undated`` (the child has no
time); of an inherited one ``parent``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import given
from ..functions.skew import SALT, salted
from ..session import Scratch


@dataclass(frozen=True)
class Ref:
    """``child[child_key] -> parent[parent_key]``, optionally at a time.

    ``at`` is the child's time; ``valid`` the parent's (from, until) bounds,
    from inclusive, until exclusive, null meaning unbounded.  ``key`` turns a
    raw key column into the compared form.
    """

    name: str
    child: str
    child_key: Sequence[str]
    parent: str
    parent_key: Sequence[str]
    key: object = None
    at: str | None = None
    valid: tuple[str, str] | None = None


SCHEMA = "row_id long, ref string, kind string, reason string, depth int, at timestamp_ntz"
_NONE = "timestamp_ntz"


def row_hash(*columns: str) -> Column:
    """A row id out of columns, nulls told apart from each other."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit(f"\0{i}")) for i, c in enumerate(columns)])


def _norm(ref: Ref, c: str) -> Column:
    return ref.key(F.col(c)) if ref.key else F.col(c)


def _child(df: DataFrame, ref: Ref) -> DataFrame:
    """row_id, k0.., at of the child rows that refer to something."""
    cond = F.lit(True)
    for c in ref.child_key:
        cond = cond & given(F.col(c).cast("string"))
    cols = [_norm(ref, c).alias(f"k{i}") for i, c in enumerate(ref.child_key)]
    return df.filter(cond).select("row_id", *cols, (F.col(ref.at) if ref.at else F.lit(None)).cast(_NONE).alias("at"))


def _parent(df: DataFrame, ref: Ref) -> DataFrame:
    cols = [_norm(ref, c).alias(f"k{i}") for i, c in enumerate(ref.parent_key)]
    lo, hi = ref.valid or (None, None)
    end = lambda c: (F.col(c) if c else F.lit(None)).cast(_NONE)
    return df.select(F.col("row_id").alias("parent_id"), *cols, end(lo).alias("lo"), end(hi).alias("hi"))


def _valid() -> Column:
    return F.coalesce((F.col("lo").isNull() | (F.col("lo") <= F.col("at"))) & (F.col("hi").isNull() | (F.col("at") < F.col("hi"))), F.lit(False))


def _lost(kids: DataFrame, elders: DataFrame, dead: DataFrame | None, ref: Ref, skewed: bool) -> DataFrame:
    """Direct and inherited orphans by one edge, one row per row_id."""
    keys = [f"k{i}" for i in range(len(ref.child_key))]
    p = elders
    if dead is None:
        p = p.withColumn("depth", F.lit(None).cast("int"))
    else:
        p = p.join(dead.select(F.col("row_id").alias("parent_id"), "depth"), "parent_id", "left")
    p = p.groupBy(*keys, "lo", "hi").agg(F.max(F.col("depth").isNull()).alias("alive"), F.min("depth").alias("depth"), F.lit(True).alias("__p"))
    on = keys
    if skewed:
        kids, p = salted(kids, p, keys, F.col("row_id"))
        on = [*keys, SALT]
    j = kids.join(p, on, "left")
    ok, there = _valid(), F.coalesce("__p", F.lit(False))
    fate = F.struct(  # one bit or number per question, so that the counts combine on the map side
        F.max(there).alias("any"),
        F.max(there & ok).alias("valid"),
        F.max(there & ok & F.col("alive")).alias("alive"),
        F.min(F.when(ok & ~F.col("alive"), F.col("depth"))).alias("depth"),
        F.max(there & (F.col("hi") <= F.col("at"))).alias("ended"),
        F.max(there & (F.col("lo") > F.col("at"))).alias("begins"),
    )
    f = j.groupBy("row_id").agg(fate.alias("f"), F.max("at").alias("at")).filter(~F.col("f.alive"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~F.col("f.any"), "never").when(F.col("at").isNull(), "undated").when(yes("f.ended") & yes("f.begins"), "between").when(yes("f.ended"), "removed").otherwise("later")
    direct = ~F.col("f.valid")
    return f.select("row_id", F.lit(ref.name).alias("ref"), F.when(direct, "direct").otherwise("inherited").alias("kind"), F.when(direct, reason).otherwise("parent").alias("reason"), F.when(direct, 0).otherwise(F.col("f.depth") + 1).cast("int").alias("depth"), "at")


def _order(nodes: Sequence[str], refs: Sequence[Ref]) -> list[str]:
    left, done = list(nodes), []
    while left:
        free = [n for n in left if not any(r.child == n and r.parent != n and r.parent in left for r in refs)]
        if not free:
            raise ValueError(f"foreign keys form a cycle through {left}; only a table's references to itself may")
        done += free
        left = [n for n in left if n not in free]
    return done


def _fixpoint(df: DataFrame, ref: Ref, mine: DataFrame, keep: Scratch) -> DataFrame:
    """``mine`` and all rows that lose their every parent of the same table."""
    kids, elders = _child(df, ref).dropDuplicates(["row_id"]), _parent(df, ref).drop("__p").dropDuplicates(["parent_id"])
    keys = [f"k{i}" for i in range(len(ref.child_key))]
    edges = keep.save(kids.join(elders, keys).filter(_valid()).select("row_id", "parent_id", "at"))
    known, fresh, depth = mine, mine, 0
    while True:
        depth += 1
        hit = edges.join(fresh.select(F.col("row_id").alias("parent_id")), "parent_id", "left_semi").select("row_id").distinct()
        hit = hit.join(known.select("row_id"), "row_id", "left_anti")
        open_ = edges.join(hit, "row_id", "left_semi").join(known.select(F.col("row_id").alias("parent_id"), F.col("depth").alias("d")), "parent_id", "left")
        gone = open_.groupBy("row_id").agg(F.max(F.col("d").isNull()).alias("alive"), F.min("d").alias("d"), F.max("at").alias("at")).filter("not alive")
        fresh = keep.save(gone.select("row_id", F.lit(ref.name).alias("ref"), F.lit("inherited").alias("kind"), F.lit("parent").alias("reason"), (F.col("d") + 1).cast("int").alias("depth"), "at"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        if depth % 8 == 0:  # the plan must not grow with the chain
            known = keep.save(known)


def orphan_cascade(nodes: dict[str, DataFrame], refs: Sequence[Ref], skewed: Sequence[str] | None = None) -> DataFrame:
    """All orphans: ``child_table, row_id, ref, kind, reason, depth, at``.

    ``kind`` is ``direct`` or ``inherited``; ``depth`` is 0 for direct orphans
    and else one more than the least depth of its lost parents.  A row that is
    direct by one reference and inherited by another counts as direct.  The hot
    keys of ``skewed`` tables (default: all) are salted.
    """
    spark = next(iter(nodes.values())).sparkSession
    keep = Scratch(spark)
    found: dict[str, DataFrame] = {}
    out: list[DataFrame] = []
    for name in _order(list(nodes), refs):
        own = [r for r in refs if r.child == name]
        if not own:
            continue
        parts = [_lost(_child(nodes[name], r), _parent(nodes[r.parent], r), found.get(r.parent) if r.parent != name else None, r, skewed is None or name in skewed) for r in own]
        mine = parts[0]
        for x in parts[1:]:
            mine = mine.unionByName(x)
        mine = keep.save(_once(mine) if len(parts) > 1 else mine)
        for ref in [r for r in own if r.parent == name]:
            mine = _fixpoint(nodes[name], ref, mine, keep)
        found[name] = mine
        out.append(mine.select(F.lit(name).alias("child_table"), "row_id", "ref", "kind", "reason", "depth", "at"))
    if not out:
        return spark.createDataFrame([], "child_table string, " + SCHEMA)
    res = out[0]
    for x in out[1:]:
        res = res.unionByName(x)
    return res


def _once(df: DataFrame) -> DataFrame:
    """One row per id: direct before inherited, then the smallest depth."""
    order = F.when(F.col("kind") == "direct", 0).otherwise(F.lit(1) + F.col("depth")).cast("long")
    best = F.min_by(F.struct("ref", "kind", "reason", "depth", "at"), F.struct(order, "ref")).alias("b")
    return df.groupBy("row_id").agg(best).select("row_id", "b.*")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, reference, month, kind and reason; null times get month null."""
    return (
        orphans.groupBy("child_table", "ref", F.date_format("at", "yyyy-MM").alias("month"), "kind", "reason")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("depth").alias("max_depth"))
    )
