"""Positions: radius joins, neighbours, lattices and surfaces.

Range joins in space are equi-joins on cubes as wide as the radius: a point is
looked up from the 27 cubes around the other.  Where only counts or the nearest
are asked for, blocks of space go to a numpy kernel instead, for the pairs grow
with the square of the points.  A point without all coordinates takes part in
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import neighbours


def distance(ax, ay, az, bx, by, bz) -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (ax, ay, az, bx, by, bz)]
    return F.sqrt((c[0] - c[3]) ** 2 + (c[1] - c[4]) ** 2 + (c[2] - c[5]) ** 2)


def within(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows at most ``radius`` apart, with ``d``.

    ``points`` has x, y, z; ``centres`` cx, cy, cz; other column names must not
    clash.  The centres are repeated into the 27 cubes around them.
    """
    cube = lambda c: F.floor(F.col(c) / radius).cast("long")
    p = points.dropna(subset=["x", "y", "z"]).withColumn("__i", cube("x")).withColumn("__j", cube("y")).withColumn("__k", cube("z"))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    q = centres.dropna(subset=["cx", "cy", "cz"]).withColumn("__n", F.explode(near))
    q = q.withColumn("__i", cube("cx") + F.col("__n.a")).withColumn("__j", cube("cy") + F.col("__n.b")).withColumn("__k", cube("cz") + F.col("__n.c")).drop("__n")
    j = p.join(q, ["__i", "__j", "__k"]).withColumn("d", distance("x", "y", "z", "cx", "cy", "cz"))
    return j.filter(F.col("d") <= radius).drop("__i", "__j", "__k")


def _in_blocks(points: DataFrame, owner: str, key: str, radius: float, kernel: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``kernel(rows, positions, owner codes, asked)`` of every block of space.

    A block is a cube twice the radius wide; it gets its own rows, which are
    asked, and those within the radius of it, so a row goes to eight blocks.
    The rows are sorted by owner and key, nulls last.
    """
    pad = radius * (1 + 1e-6)
    cube = lambda c: F.floor(c / (2 * pad)).cast("long")
    finite = [F.abs(F.col(c)) < float("inf") for c in "xyz"]  # NaN is the greatest
    p = points.filter(F.col(owner).isNotNull() & finite[0] & finite[1] & finite[2])
    asked = F.lit(True)
    for c in "xyz":
        p = p.withColumn(f"__{c}", F.explode(F.sequence(cube(F.col(c) - pad), cube(F.col(c) + pad))))
        asked = asked & (F.col(f"__{c}") == cube(F.col(c)))
    conf = points.sparkSession.conf
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), 4 * points.sparkSession.sparkContext.defaultParallelism)  # work follows the pairs, not the bytes
    block = ["__x", "__y", "__z"]

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(owner, "ascending"), (key, "ascending")], null_placement="at_end"))
        x = np.stack([t[c].to_numpy() for c in "xyz"])
        codes = t[owner].combine_chunks().dictionary_encode().indices.to_numpy()  # in order of appearance, so sorted
        return kernel(t, x, codes, t["__asked"].to_numpy().astype(bool))

    return p.withColumn("__asked", asked).repartition(tasks, *block).groupBy(*block).applyInArrow(run, schema)


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def other_owners(points: DataFrame, owner: str, key: str, radius: float) -> DataFrame:
    """``owner, key, n``: the number of other owners with a point at most
    ``radius`` away, for the points that have any.

    ``points`` has one row per owner and key, and x, y, z.  Pairs are counted in
    numpy and never become rows.
    """

    def count(t: pa.Table, x: np.ndarray, codes: np.ndarray, asked: np.ndarray) -> pa.Table:
        n = neighbours.other_owners(x, codes, asked, radius)
        own = t.select([owner, key]).take(pa.array(np.flatnonzero(asked)[n > 0]))
        return own.append_column("n", pa.array(n[n > 0]))

    return _in_blocks(points.select(owner, key, "x", "y", "z"), owner, key, radius, count, f"`{owner}` {_type(points, owner)}, `{key}` {_type(points, key)}, n long")


def nearest_others(points: DataFrame, owner: str, key: str, value: str, k: int, radius: float) -> DataFrame:
    """``owner, key, value, other, d, rank``: the ``k`` nearest points of other
    owners at most ``radius`` away, with their ``value`` as ``other``.

    ``points`` has one row per owner and key, and x, y, z.  Ties in ``d`` go by
    owner and key, nulls last.
    """

    def search(t: pa.Table, x: np.ndarray, codes: np.ndarray, asked: np.ndarray) -> pa.Table:
        none = np.zeros(0, int)
        got = [(none, none, none.astype(float), none), *neighbours.nearest_others(x, codes, asked, k, radius)]
        a, b, d, rank = (np.concatenate(c) for c in zip(*got, strict=True))
        own, other = t.select([owner, key, value]).take(pa.array(a)), t[value].take(pa.array(b))
        return own.append_column("other", other).append_column("d", pa.array(d)).append_column("rank", pa.array(rank.astype(np.int32)))

    kinds = [f"`{c}` {_type(points, c)}" for c in (owner, key, value)]
    return _in_blocks(points.select(owner, key, value, "x", "y", "z"), owner, key, radius, search, f"{', '.join(kinds)}, other {_type(points, value)}, d double, rank int")


def affine(matrix: Sequence[Sequence[float]], x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """The three coordinates under a 3 x 4 matrix."""
    return [F.col(x) * r[0] + F.col(y) * r[1] + F.col(z) * r[2] + r[3] for r in matrix]


def lattice_points(x: str, step: float, cube: float) -> Column:
    """Lattice coordinates within half a cube of a coordinate."""
    lo, hi = F.ceil((F.col(x) - cube / 2) / step).cast("int"), F.floor((F.col(x) + cube / 2) / step).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.expr("cast(array() as array<int>)"))
