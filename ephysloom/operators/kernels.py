"""Numerical kernels on rows: one Arrow-batched Python stage, no shuffle.

A row holds a whole signal or map as an array; a kernel maps it to the values of
further columns.  Rows are independent, so any skew of the keys is harmless.

Defined results: a row whose array is null gets null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from .clusters import centroids
from .quantiles import group_quantiles


def per_row(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], kernel: Callable[..., tuple | None], schema: str) -> DataFrame:
    """``*keep, *schema``: ``kernel(*inputs)`` of every row (arrays as numpy);
    ``None`` gives nulls."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    names = [p.strip().split()[0].split(":")[0] for p in _split(schema)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for values in zip(*[part[f"__in{i}"] for i in range(len(inputs))], strict=True):
                ready = [np.asarray(v) if isinstance(v, (list, np.ndarray)) else v for v in values]
                got = None if any(v is None for v in ready) else kernel(*ready)
                rows.append(got if got is not None else (None,) * len(names))
            out = part[list(keep)].reset_index(drop=True)
            for k, n in enumerate(names):
                out[n] = pd.Series([r[k] for r in rows], dtype=object)
            yield out

    src = df.select(*keep, *[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)])
    return src.mapInPandas(run, f"{kept}, {schema}")


def _split(schema: str) -> list[str]:
    """Top-level parts of a schema string."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def rereference(df: DataFrame, keys: Sequence[str], channel: str, array: str, use: Column, how: str = "mean", least: int = 3) -> DataFrame:
    """Chunks less the mean or median of the reference channels of their group.

    ``keys`` name the chunk (and the array or shaft for a common average);
    ``use`` says which channels make the reference; with fewer than ``least`` the
    chunk stays as it is.  Excluded channels are still referenced.
    """
    good = df.filter(use)
    if how == "mean":
        ref = centroids(good, keys, array)
    else:
        x = good.select(*keys, F.posexplode(array).alias("pos", "v"))
        q = group_quantiles(x, [*keys, "pos"], F.col("v"), {"m": 0.5})
        ref = q.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("c"))
    d = df.join(ref.withColumnRenamed("n", "__n"), list(keys), "left")
    return d.withColumn(array, F.when(F.col("__n") >= least, F.zip_with(array, "c", lambda x, y: x - y)).otherwise(F.col(array))).drop("__n", "c")


def tetrodes(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Wires of a group in fours: ``tetrode`` from 0 and ``wire`` 0..3."""
    i = F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1
    return df.withColumn("tetrode", F.floor(i / 4).cast("int")).withColumn("wire", (i % 4).cast("int"))


def bad_by_z(df: DataFrame, group: Sequence[str], power: str, line: str, z_power: float = 3.5, z_line: float = 3.0) -> DataFrame:
    """Channels whose total power or line ratio stands out in their group, or that are flat."""
    s = df.groupBy(*group).agg(F.avg(power).alias("__pm"), F.stddev_samp(power).alias("__ps"), F.avg(line).alias("__lm"), F.stddev_samp(line).alias("__ls"))
    d = df.join(s, list(group), "left")
    z = lambda c, m, sd: F.when(F.col(sd) > 1e-12, (F.col(c) - F.col(m)) / F.col(sd)).otherwise(0.0)
    bad = F.coalesce((z(power, "__pm", "__ps") > z_power) | (z(line, "__lm", "__ls") > z_line) | (F.col(power) <= 1e-12), F.lit(True))
    return d.withColumn("bad", bad).drop("__pm", "__ps", "__lm", "__ls")


def chunked(df: DataFrame, keys: Sequence[str], array: str, size: int, halo: int) -> DataFrame:
    """Long signals cut to chunks with ``halo`` samples of context on both sides:
    ``*keys, chunk, lead, part`` (``lead`` = context samples before)."""
    n = F.ceil(F.size(array) / size).cast("int")
    x = df.select(*keys, array, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))).alias("chunk"))
    start = F.greatest(F.col("chunk") * size - halo, F.lit(0))
    stop = F.least((F.col("chunk") + 1) * size + halo, F.size(array))
    return x.select(*keys, "chunk", (F.col("chunk") * size - start).alias("lead"), F.slice(array, start + 1, stop - start).alias("part"))


def unit_rows(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn(array, A.unit(F.col(array)))
