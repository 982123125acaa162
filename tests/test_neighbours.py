import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ephysloom.kernels import neighbours
from ephysloom.operators import space


def some_points(rng, case):
    n = int(rng.integers(1, 400))
    x = np.round(rng.normal(0, (3, 8, 20)[case % 3], (3, n)), case % 2)
    if case % 4 == 0:
        x[:, : n // 2] = x[:, :1]  # many at one place
    return x, np.sort(rng.integers(0, (2, 5, 60)[case % 3], n)), rng.random(n) < 0.7


def distances(x, i):
    return np.sqrt((x[0, i] - x[0]) ** 2 + (x[1, i] - x[1]) ** 2 + (x[2, i] - x[2]) ** 2)


def test_nearest_others_against_every_pair():
    rng = np.random.default_rng(6)
    for case in range(24):
        x, owner, asked = some_points(rng, case)
        got = [v for part in neighbours.nearest_others(x, owner, asked, 3, 9.0) for v in zip(*[a.tolist() for a in part], strict=True)]
        want = set()
        for i in np.flatnonzero(asked):
            near = sorted((d, j) for j, d in enumerate(distances(x, i)) if owner[j] != owner[i] and d <= 9)[:3]
            want |= {(i, j, d, r) for r, (d, j) in enumerate(near, 1)}
        assert len(got) == len(set(got)) and set(got) == want


def test_other_owners_against_every_pair():
    rng = np.random.default_rng(8)
    for case in range(24):
        x, owner, asked = some_points(rng, case)
        got = neighbours.other_owners(x, owner, asked, 6.0)
        assert got.tolist() == [len(set(owner[distances(x, i) <= 6]) - {owner[i]}) for i in np.flatnonzero(asked)]


def test_limit_is_where_the_root_ends():
    for r in (6.0, 0.1, 3.3, 1e-9, 1e9):
        q = neighbours.limit(r)
        assert math.sqrt(q) <= r < math.sqrt(math.nextafter(q, math.inf))


def crowd(spark, path, n=4000, patients=200):
    """Contacts crowded into 12 mm across a block's border, and odd ones."""
    rng = np.random.default_rng(7)
    rows = [(f"P{i % patients + 1}", f"A{i // patients + 1}", *map(float, np.round(rng.uniform(-6, 6, 3), 1)), "uvw"[rng.integers(3)]) for i in range(n)]
    rows += [("Q1", None, 0.0, 0.0, 0.0, "u"), ("Q1", "B1", 0.0, 0.0, 0.0, "v"), ("Q2", "B1", 0.0, 0.0, 0.0, None), ("Q3", "B1", None, 0.0, 0.0, "u"), ("Q4", "B1", math.nan, 0.0, 0.0, "u"), ("Q5", "B1", math.inf, 0.0, 0.0, "u"), (None, "B1", 0.0, 0.0, 0.0, "u"), ("Q6", "B1", 80.0, 0.0, 0.0, "u"), ("Q7", "B1", 86.0, 0.0, 0.0, "w"), ("Q8", "B1", -80.0, 0.0, 0.0, "u")]
    df = spark.createDataFrame(rows, "patient string, name string, x double, y double, z double, yeo7_network string")
    df.withColumns({"name_raw": F.col("name"), "hemi": F.lit("L"), "is_wm": F.lit(1), "added_at": F.lit(None).cast("timestamp_ntz")}).write.parquet(f"{path}/contacts.parquet")
    return [r for r in rows if r[0] is not None and all(v is not None and math.isfinite(v) for v in r[2:5])]


def makes_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Join" in plan or "CartesianProduct" in plan


def test_knn_of_a_crowd_makes_no_pairs(spark, tmp_path):
    rows = sorted(crowd(spark, tmp_path), key=lambda r: (r[0], r[1] is None, r[1]))
    x, owner = np.array([r[2:5] for r in rows]).T, np.array([r[0] for r in rows])
    same = defaultdict(list)
    for i, r in enumerate(rows):
        d = distances(x, i)
        d[(owner == r[0]) | (d > 9)] = np.inf
        for j in np.argsort(d, kind="stable")[:3]:
            if d[j] < np.inf and r[5] is not None and rows[j][5] is not None:
                same[r[5]].append(r[5] == rows[j][5])
    df = entry.queries()["knn_other_patients"](spark, str(tmp_path))
    assert {r.network: (r.n, r.same_share) for r in df.collect()} == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in same.items()}
    assert not makes_pairs(df)


def test_other_patients_of_a_crowd_makes_no_pairs(spark, tmp_path):
    rows = crowd(spark, tmp_path)
    x, owner = np.array([r[2:5] for r in rows]).T, np.array([r[0] for r in rows])
    want = {r[:2]: n for i, r in enumerate(rows) if (n := len({*owner[distances(x, i) <= 6]} - {r[0]}))}
    df = entry.queries()["other_patients_within"](spark, str(tmp_path))
    assert {(r.patient, r.contact): r.n_others for r in df.collect()} == want
    assert ("Q6", "B1") in want and ("Q8", "B1") not in want  # 6 mm is within
    assert not makes_pairs(df)


def test_nearest_others_of_nothing(spark):
    p = spark.createDataFrame([("a", "1", 0.0, 0.0, 0.0, 5), ("a", "2", 0.0, 0.0, 1.0, 6)], "o string, k string, x double, y double, z double, v int")
    got = space.nearest_others(p, "o", "k", "v", 2, 3.0)
    assert got.count() == 0 and got.columns == ["o", "k", "v", "other", "d", "rank"]
