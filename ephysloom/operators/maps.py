"""Time-frequency maps held as one array column (``bands x bins``).

Per-map operators are array expressions without a shuffle; only statistics over
the cohort (per band or patient) group cells.

Defined results: a null map has null results and fails every gate; missing (null
or NaN) cells count in no mean and exceed no threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .quantiles import group_quantiles


def share(a: Column, test) -> Column:
    """Share of the present cells for which ``test(x)`` holds."""
    return A.let(A.present(a), lambda p: F.when(F.size(p) > 0, F.size(F.filter(p, test)) / F.size(p)))


def activity_gate(a: Column, noise: Column, pos: float, neg: float, k: float, share_pos: float, share_neg: float) -> Column:
    """Enough cells above ``max(pos, k noise)`` or below ``min(neg, -k noise)``."""
    n = F.coalesce(noise, F.lit(0.0))
    up, down = F.greatest(F.lit(pos), k * n), F.least(F.lit(neg), -k * n)
    return F.coalesce((share(a, lambda x: x > up) >= share_pos) | (share(a, lambda x: x < down) >= share_neg), F.lit(False))


def columns_of(a: Column, n_bands: int, n_bins: int, lo: int, hi: int) -> Column:
    """The cells of time bins ``lo..hi-1`` in every band."""
    return F.flatten(F.array(*[F.slice(a, F.lit(b * n_bins + lo + 1), F.lit(hi - lo)) for b in range(n_bands)]))


@dataclass(frozen=True)
class Box:
    """Bands and bins (from inclusive, until exclusive) and what it must show:
    ``pos``, ``neg``, ``zero``, ``nonpos`` or ``both`` in at least ``least`` of
    its cells."""

    b0: int
    b1: int
    t0: int
    t1: int
    sign: str = "pos"
    least: float = 0.5


def box_cells(a: Column, box: Box, n_bins: int) -> Column:
    return F.flatten(F.array(*[F.slice(a, F.lit(b * n_bins + box.t0 + 1), F.lit(box.t1 - box.t0)) for b in range(box.b0, box.b1)])) if box.b1 > box.b0 and box.t1 > box.t0 else F.expr("cast(array() as array<double>)")


def box_expresses(a: Column, box: Box, n_bins: int, thr: float) -> Column:
    """Whether the box shows its sign; silence is strict, an empty box shows
    only silence."""
    c = box_cells(a, box, n_bins)
    if box.sign == "zero":
        return F.coalesce(share(c, lambda x: F.abs(x) > thr) < box.least, F.lit(True))
    if box.sign == "nonpos":
        return F.coalesce(share(c, lambda x: x > thr) < box.least, F.lit(True))
    tests = {"pos": lambda x: x > thr, "neg": lambda x: x < -thr, "both": lambda x: F.abs(x) > thr}
    return F.coalesce(share(c, tests[box.sign]) >= box.least, F.lit(False))


def roles(a: Column, table: Sequence[tuple[str, int, str, Sequence[Box]]], n_bins: int, thr: float) -> Column:
    """All matching roles, the most specific first: array of (layer, boxes, role).

    A role is (name, layer, ``all`` or ``any``, boxes); lower layers, then more
    boxes, then the earlier entry come first.
    """
    out = []
    for no, (name, layer, how, boxes) in enumerate(table):
        hit = None
        for b in boxes:
            e = box_expresses(a, b, n_bins, thr)
            hit = e if hit is None else (hit & e if how == "all" else hit | e)
        out.append(F.when(hit, F.struct(F.lit(layer).alias("layer"), F.lit(-len(boxes)).alias("boxes"), F.lit(no).alias("no"), F.lit(name).alias("role"))))
    return F.array_sort(F.array_compact(F.array(*out)))


def ternary(a: Column, n_bands: int, n_bins: int, thr: float, least: int) -> Column:
    """Sign of cells of at least ``thr`` that have ``least`` of their eight
    neighbours of the same sign at ``thr`` too; else 0."""
    signs = F.transform(a, lambda x: F.when(x >= thr, 1).when(x <= -thr, -1).otherwise(0))

    def one(s, x, i):
        b, t = F.call_function("div", i, F.lit(n_bins)).cast("int"), i % n_bins
        same = F.lit(0)
        for db in (-1, 0, 1):
            for dt in (-1, 0, 1):
                if db or dt:
                    inside = (b + db >= 0) & (b + db < n_bands) & (t + dt >= 0) & (t + dt < n_bins)
                    same = same + F.when(inside & (F.get(s, i + db * n_bins + dt) == x), 1).otherwise(0)
        return F.when((x != 0) & (same >= least), x).otherwise(0)

    return A.let(signs, lambda s: F.transform(s, lambda x, i: one(s, x, i)))


def band_z(df: DataFrame, keys: list[str], array: str, n_bins: int, by: Sequence[str]) -> DataFrame:
    """Cells with z over all cells of ``by`` (population sd).

    The statistics are a map-side combined aggregate of a few rows per ``by``
    group joined back, not a window, so a large group is never sorted in a task.
    """
    c = A.cells(df, keys, array, n_bins)
    s = c.groupBy(*by).agg(F.avg("v").alias("__m"), F.stddev_pop("v").alias("__s"))
    return c.join(s, list(by)).withColumn("z", F.when(F.col("__s") > 0, (F.col("v") - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")


def shape_floor(df: DataFrame, keys: list[str], array: str, n_bands: int, n_bins: int) -> DataFrame:
    """Each band over ``sqrt(rms^2 + m^2)`` with ``m`` the cohort's median rms of
    the band: loud bands keep their shape, silent ones are not blown up."""
    rms = lambda b: F.sqrt(A.total(F.transform(A.band(F.col(array), b, n_bins), lambda x: x * x)) / n_bins)
    per = df.select(*keys, F.posexplode(F.array(*[rms(b) for b in range(n_bands)])).alias("band", "rms"))
    med = group_quantiles(per, ["band"], F.col("rms"), {"floor": 0.5}).drop("n")
    c = A.cells(df, keys, array, n_bins).join(per, [*keys, "band"]).join(F.broadcast(med), "band")  # one row a band
    return c.withColumn("shape", F.col("v") / F.sqrt(F.col("rms") ** 2 + F.col("floor") ** 2))


def gaussian(n: int, centre: float, sigma: float, reach: float = 2.0) -> list[float]:
    """Weights on ``n`` bins, zero beyond ``reach`` sigma, summing to 1."""
    import math

    w = [math.exp(-((i - centre) ** 2) / (2 * sigma**2)) if abs(i - centre) <= reach * sigma else 0.0 for i in range(n)]
    s = sum(w)
    return [x / s for x in w] if s else w


def pooled(a: Column, weights: Sequence[float]) -> Column:
    return A.dot(a, F.array(*[F.lit(float(w)) for w in weights]))


def shift_null_p(a: Column, weights: Sequence[float]) -> Column:
    """``(n >= observed + 1) / (n + 1)`` over all circular shifts of the course."""
    obs = F.abs(pooled(a, weights))
    n = len(weights)
    ge = F.lit(0)
    for k in range(1, n):
        rolled = [weights[(i + k) % n] for i in range(n)]
        ge = ge + F.when(F.abs(pooled(a, rolled)) >= obs - 1e-12, 1).otherwise(0)
    return (ge + 1) / (n - 1 + 1)


def timing(y: Column, thr: float, least: int, start: float, step: float) -> Column:
    """Timing record of a course: peak, sustained onset and end, trough, ...

    Onset is the first bin of the first run of at least ``least`` bins at or
    above ``thr``, the end the last bin of the last such run; null if there is
    none.  Centre of mass and area use the positive part.
    """
    parts = F.struct(y.alias("y"), F.transform(y, lambda x: F.greatest(x, F.lit(0.0))).alias("pos"), A.runs(F.transform(y, lambda x: x >= thr), least).alias("r"))
    return A.let(parts, lambda p: _timing(p["y"], p["pos"], p["r"], thr, start, step))


def _timing(y: Column, pos: Column, r: Column, thr: float, start: float, step: float) -> Column:
    at = lambda i: F.lit(start) + i * step
    on, off = F.get(r, F.lit(0))["first"], F.get(r, F.size(r) - 1)["last"]
    mass = A.total(pos)
    com = A.total(F.transform(pos, lambda x, i: x * at(i)))
    return F.struct(
        at(A.argmax(y)).alias("peak_lat"),
        F.array_max(y).alias("peak"),
        at(on).alias("onset_lat"),
        at(off).alias("offset_lat"),
        ((off - on + 1) * step).alias("dur"),
        F.when(mass > 0, com / mass).alias("com"),
        (mass * step).alias("auc"),
        at(A.argmin(y)).alias("trough_lat"),
        F.array_min(y).alias("trough"),
        share(y, lambda x: x >= thr).alias("frac_above"),
    )


def lead_component(w: Column, confident: float) -> Column:
    """Lead component (from 0) with its weight, margin and whether it holds at
    least ``confident`` of the total; null if there is no positive weight."""
    pos = F.transform(w, lambda x: F.greatest(x, F.lit(0.0)))
    s = F.sort_array(pos, asc=False)
    some = A.total(pos) > 0
    return F.struct(
        F.when(some, A.argmax(pos)).alias("lead"),
        F.when(some, F.get(s, F.lit(0))).alias("top"),
        F.when(some, F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))).alias("margin"),
        F.when(some, F.get(s, F.lit(0)) / A.total(pos)).alias("share"),
        F.when(some, F.get(s, F.lit(0)) / A.total(pos) >= confident).alias("confident"),
    )
