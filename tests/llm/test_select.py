import math

import numpy as np

import pytest

from ephysloom.llm.select import combine, multiselect

PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def test_unequal_groups_keep_every_percentile(spark):
    """Small large-groups end early and must survive the later rewrites."""
    rng = np.random.default_rng(3)
    sizes = {"a": 40_000, "b": 25_000, "c": 10_000, "d": 6_000, "e": 700, "f": 1}
    rows = {g: rng.normal(size=n).round(4).tolist() for g, n in sizes.items()}
    df = spark.createDataFrame([(g, v) for g, vs in rows.items() for v in vs], "name string, v double").repartition(6)
    got = {(r.name, r.pct): r.value for r in multiselect(df, ["name"], "v", PERCENTS, finish=2_000).collect()}
    want = {(g, p): sorted(vs)[max(1, math.ceil(len(vs) * p / 100)) - 1] for g, vs in rows.items() for p in PERCENTS}
    assert got == want


def test_ties_nulls_and_empty_groups(spark):
    rows = [("a", 1.0)] * 5000 + [("a", 2.0)] * 10 + [("n", None), ("n", float("nan")), ("n", float("inf")), (None, 3.0), ("z", -0.0), ("z", 0.0)]
    df = spark.createDataFrame([(g, v, "x") for g, v in rows], "name string, v double, pct string")
    got = {(r.name, r.pct): (r.value, r.n) for r in multiselect(df, ["name"], "v", (1, 50, 100), finish=100).collect()}
    assert got == {("a", 1): (1.0, 5010), ("a", 50): (1.0, 5010), ("a", 100): (2.0, 5010), (None, 1): (3.0, 1), (None, 50): (3.0, 1), (None, 100): (3.0, 1), ("z", 1): (0.0, 2), ("z", 50): (0.0, 2), ("z", 100): (0.0, 2)}
    assert multiselect(df.limit(0), ["name"], "v", (50,)).count() == 0


def test_combined_parts_keep_the_error_bound(spark):
    rng = np.random.default_rng(4)
    vs = np.concatenate([rng.normal(d, 1, 400 + 300 * d) for d in range(6)])
    day = np.concatenate([[d] * (400 + 300 * d) for d in range(6)])
    df = spark.createDataFrame([("g", int(d), float(v)) for d, v in zip(day, vs, strict=True)], "g string, d int, v double")
    grid = tuple(range(2, 101, 2))
    m = combine(multiselect(df, ["g", "d"], "v", grid), ["g"], ["d"], (5, 50, 95), grid).collect()
    for r in m:
        share = (vs <= r.value).mean()
        assert abs(share - r.pct / 100) <= r.error + 1e-9 and r.n == len(vs)
    with pytest.raises(ValueError):
        combine(df, ["g"], ["d"], (50,), (1, 5, 25))
