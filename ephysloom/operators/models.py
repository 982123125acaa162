"""Models and resampling over bounded matrices.

Clusterings and factorisations of the reference size (thousands of items) are
small; their sweeps, folds, bootstraps and nulls are many.  So the matrix, whose
size is checked, is sent once to every worker, and the grid of tasks is what is
distributed.  A matrix beyond ``most_cells`` is refused: fit on a documented
sample of it and assign all rows by ``assign``, which has no bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def matrix(df: DataFrame, item: str, array: str, extra: Sequence[str] = (), most_cells: int = 8_000_000) -> tuple[np.ndarray, pd.DataFrame]:
    """(rows x features in the order of ``item``, table of item and extra columns).

    The number of cells is counted before anything is collected.
    """
    n = df.agg(F.sum(F.size(array)).alias("n")).first()["n"] or 0
    if n > most_cells:
        raise ValueError(f"{n} cells are more than {most_cells}: fit on a sample and assign the rest")
    p = df.select(item, *extra, F.col(array).alias("__a")).toPandas().sort_values(item, kind="stable").reset_index(drop=True)
    x = np.array(p["__a"].tolist(), float) if len(p) else np.zeros((0, 0))
    return x, p.drop(columns="__a")


def fan_out(df_session, x: np.ndarray, meta: pd.DataFrame, grid: pd.DataFrame, task: Callable, schema: str, tasks: int | None = None) -> DataFrame:
    """``task(x, meta, **row)`` for every row of the grid, in parallel.

    ``task`` yields tuples in the order of ``schema``; the grid's own columns are
    not added.  Results depend on the row alone, so a lost executor only repeats.
    """
    spark = df_session
    sent = spark.sparkContext.broadcast((x, meta))  # at most ``most_cells`` doubles
    cols = list(grid.columns)
    names = [s.strip().split()[0] for s in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, m = sent.value
        for part in parts:
            for row in part[cols].to_dict("records"):
                got = list(task(a, m, **row))
                if got:
                    yield pd.DataFrame.from_records(got, columns=names)

    g = spark.createDataFrame(grid).repartition(tasks or min(len(grid), 4 * spark.sparkContext.defaultParallelism))
    return g.mapInPandas(run, schema)


def assign(df: DataFrame, item: str, array: str, centres: np.ndarray) -> DataFrame:
    """``item, cluster, d``: nearest of a small set of centres, as one expression."""
    each = F.array(*[F.struct(A.distance(F.col(array), F.array(*[F.lit(float(v)) for v in c])).alias("d"), F.lit(k).alias("cluster")) for k, c in enumerate(centres)])
    return df.select(item, F.array_min(each).alias("b")).select(item, "b.cluster", "b.d")
