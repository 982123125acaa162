"""Array columns as signals and time-frequency maps, JVM-side.

A map is one array in row order, ``bands x bins``.  All functions are expressions
on the array: no explode, no shuffle.  Positions are counted from 0 unless said
otherwise; a null array gives null; NaN elements count as missing where means are
taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated once: an expression captured by a lambda
    would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def present(a: Column) -> Column:
    """Elements neither null nor NaN."""
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def mean(a: Column) -> Column:
    return let(present(a), lambda p: F.when(F.size(p) > 0, total(p) / F.size(p)))


def sd(a: Column, ddof: int = 0) -> Column:
    moved = lambda r: F.transform(r["p"], lambda x: (x - r["m"]) * (x - r["m"]))
    of = lambda r: F.when(F.size(r["p"]) > ddof, F.sqrt(total(moved(r)) / (F.size(r["p"]) - ddof)))
    return let(F.struct(present(a).alias("p"), mean(a).alias("m")), of)


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def unit(a: Column) -> Column:
    """L2-normalised; a zero row stays zero."""
    return let(F.struct(a.alias("a"), norm(a).alias("n")), lambda r: F.transform(r["a"], lambda x: F.when(r["n"] > 0, x / r["n"]).otherwise(x)))


def z(a: Column) -> Column:
    """Zero mean and unit population sd; a flat row gives zeros."""
    one = lambda r: F.transform(r["a"], lambda x: F.when(r["s"] > 1e-12, (x - r["m"]) / r["s"]).otherwise(0.0))
    return let(F.struct(a.alias("a"), mean(a).alias("m"), sd(a).alias("s")), one)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; null if one is flat."""
    centred = lambda y: let(F.struct(y.alias("a"), mean(y).alias("m")), lambda r: F.transform(r["a"], lambda x: x - r["m"]))
    of = lambda r: F.when(norm(r["a"]) * norm(r["b"]) > 1e-12, dot(r["a"], r["b"]) / (norm(r["a"]) * norm(r["b"])))
    return let(F.struct(centred(a).alias("a"), centred(b).alias("b")), of)


def band(a: Column, k: int | Column, n_bins: int) -> Column:
    """Row ``k`` of the map."""
    start = k * n_bins + 1
    return F.slice(a, start if isinstance(start, Column) else F.lit(start), F.lit(n_bins))


def band_means(a: Column, edges: list[tuple[int, int]], n_bins: int) -> Column:
    """Per half-open range of rows and time bin the mean; an empty range gives 0."""
    out = []
    for lo, hi in edges:
        if hi <= lo:
            out.append(F.array(*[F.lit(0.0)] * n_bins))
            continue
        acc = band(a, lo, n_bins)
        for k in range(lo + 1, hi):
            acc = F.zip_with(acc, band(a, k, n_bins), lambda x, y: x + y)
        out.append(_over(acc, hi - lo))
    return F.flatten(F.array(*out))


def _over(a: Column, n: float) -> Column:
    return F.transform(a, lambda x: x / n)


def block_means(a: Column, size: int) -> Column:
    """Means of consecutive blocks of ``size``; the last may be shorter."""
    n = F.ceil(F.size(a) / size).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n), lambda i: mean(F.slice(a, i * size + 1, F.lit(size))))


def argmax(a: Column) -> Column:
    """First position of the greatest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def roll(a: Column, by: int | Column) -> Column:
    """Circular shift to the right."""
    k = F.pmod(by if isinstance(by, Column) else F.lit(by), F.greatest(F.size(a), F.lit(1)))
    return F.when(k == 0, a).otherwise(F.concat(F.slice(a, F.size(a) - k + 1, k), F.slice(a, F.lit(1), F.size(a) - k)))


def diff(a: Column) -> Column:
    return F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def smooth(a: Column, half: int) -> Column:
    """Centred box mean over up to ``2 half + 1`` elements, shorter at the ends."""
    return F.transform(a, lambda x, i: mean(F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, F.size(a) - 1) - F.greatest(i - half, F.lit(0)) + 1)))


def axis(n: int | Column, lo: float, hi: float) -> Column:
    """``n`` points from ``lo``, the end point left out."""
    m = n if isinstance(n, Column) else F.lit(n)
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.lit(lo) + i * (hi - lo) / m)


def trapezoid(y: Column, step: float) -> Column:
    n = F.greatest(F.size(y) - 1, F.lit(0))
    up, low = F.slice(y, F.lit(2), n), F.slice(y, F.lit(1), n)
    return total(F.zip_with(up, low, lambda a, b: (a + b) / 2 * step))


def histogram(a: Column, lo: float, hi: float, bins: int) -> Column:
    """Counts in equal bins; the last bin is closed."""
    k = F.transform(present(a), lambda x: F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.when(x <= hi, F.lit(bins - 1)).otherwise(F.lit(bins))))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(k, lambda x: x == i)))


def interp(a: Column, at: Column) -> Column:
    """Linear interpolation at fractional positions, clamped to the ends."""
    last = F.size(a) - 1

    def one(p):
        q = F.least(F.greatest(p, F.lit(0.0)), last.cast("double"))
        i = F.floor(q).cast("int")
        x, y = F.get(a, i), F.get(a, F.least(i + 1, last))
        return x + (y - x) * (q - i)

    return F.transform(at, one)


def runs(flags: Column, least: int) -> Column:
    """Runs of at least ``least`` true elements: array of (first, last)."""
    empty = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    grown = F.aggregate(
        F.transform(flags, lambda x, i: F.struct(F.coalesce(x, F.lit(False)).alias("on"), i.alias("i"))),
        empty,
        lambda acc, x: F.when(
            x["on"],
            F.when(
                (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] == x["i"] - 1),
                F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["first"].alias("first"), x["i"].alias("last")))),
            ).otherwise(F.concat(acc, F.array(F.struct(x["i"].alias("first"), x["i"].alias("last"))))),
        ).otherwise(acc),
    )
    return F.filter(grown, lambda r: r["last"] - r["first"] + 1 >= least)


def cells(df: DataFrame, keys: list[str], array: str, n_bins: int) -> DataFrame:
    """Long form: ``*keys, band, bin, v``, one row per element."""
    x = df.select(*keys, F.posexplode(array).alias("pos", "v"))
    return x.select(*keys, F.call_function("div", F.col("pos"), F.lit(n_bins)).cast("int").alias("band"), (F.col("pos") % n_bins).alias("bin"), "v")
