import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ephysloom.functions import arrays as A
from ephysloom.functions import ranks as R
from ephysloom.operators import clusters as C
from ephysloom.operators import kernels as K
from ephysloom.operators import maps as M
from ephysloom.operators import models, naming, space, trains, trials
from ephysloom.operators.quantiles import group_quantiles


def test_quantiles_of_large_and_odd_groups(spark):
    rng = random.Random(1)
    groups = {"big": [round(rng.gauss(0, 1), 3) for _ in range(30_000)], "flat": [1.0] * 5000, "one": [2.0], "two": [1.0, 4.0], None: [3.0, 1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("big", None), ("big", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in group_quantiles(df, ["g"], F.col("v"), {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.999, "e": 1.0}, accuracy=100).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, q in zip("abcde", (0, 0.025, 0.5, 0.999, 1), strict=True):
            assert abs(getattr(got[g], name) - np.quantile(vs, q)) < 1e-9, (g, q)
    whole = group_quantiles(df, [], F.col("v"), {"m": 0.5}).first()
    assert abs(whole.m - np.median([v for vs in groups.values() for v in vs])) < 1e-9
    assert group_quantiles(df.limit(0), ["g"], F.col("v"), {"m": 0.5}).count() == 0


def test_array_functions(spark):
    x = [1.0, -2.0, 3.0, 0.5, 0.5]
    df = spark.createDataFrame([(x,), (None,), ([],), ([2.0, 2.0],), ([float("nan"), 1.0],)], "a array<double>")
    a = F.col("a")
    r = df.select(A.mean(a).alias("m"), A.sd(a).alias("s"), A.unit(a).alias("u"), A.z(a).alias("z"), A.runs(F.transform(a, lambda v: v > 0), 2).alias("r"), A.roll(a, 2).alias("roll"), A.correlation(a, a).alias("c")).collect()
    assert abs(r[0].m - np.mean(x)) < 1e-12 and abs(r[0].s - np.std(x)) < 1e-12 and np.allclose(r[0].z, (np.array(x) - np.mean(x)) / np.std(x))
    assert [tuple(v) for v in r[0].r] == [(2, 4)] and r[0].roll == [0.5, 0.5, 1.0, -2.0, 3.0] and abs(r[0].c - 1) < 1e-12
    assert r[1].m is None and r[1].z is None and r[2].m is None and r[2].r == []
    assert r[3].z == [0.0, 0.0] and r[3].c is None and r[4].m == 1.0


def test_timing_record(spark):
    y = [0.0, 1.0, 1.2, 0.1, 2.0, 2.0, 2.0, -1.0]
    df = spark.createDataFrame([(y,), ([0.0] * 8,), ([-1.0] * 8,)], "y array<double>")
    t = [r.t for r in df.select(M.timing(F.col("y"), 0.9, 2, 0.0, 1.0).alias("t")).collect()]
    assert (t[0].peak_lat, t[0].peak, t[0].onset_lat, t[0].offset_lat, t[0].dur, t[0].trough_lat) == (4.0, 2.0, 1.0, 6.0, 6.0, 7.0)
    assert t[1].onset_lat is None and t[1].com is None and t[1].auc == 0 and t[2].frac_above == 0


def test_trials(spark):
    e = spark.createDataFrame([(1, 1.0, None), (2, 9.0, "x"), (3, None, "x")], "i int, v double, s string")
    got = {r.i: r.w for r in e.select("i", trials.first_reason([("a", F.col("v") > 5), ("b", F.col("s").isNull())]).alias("w")).collect()}
    assert got == {1: "b", 2: "a", 3: None}
    rows = [("g", i, 1.0 + i / 1000) for i in range(10)] + [("g", 10 + i, 50.0 + i) for i in range(6)] + [("small", 0, 1.0), ("small", 1, 99.0)]
    d = trials.robust_reject(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "v", ["i"])
    out = [r.i for r in d.filter("rejected").collect()]
    assert sorted(out) == [11, 12, 13, 14, 15]  # the greatest, at most floor(0.34 * 16)
    z = trials.group_z(spark.createDataFrame([("f", 1.0), ("f", 1.0), ("o", None)], "g string, v double"), ["g"], "v")
    assert {r.z for r in z.filter("g = 'f'").collect()} == {0.0}


def test_spans_by_bucket(spark):
    rng = random.Random(2)
    t = [("p", i, a := rng.uniform(0, 1000), a + rng.uniform(0, 30)) for i in range(200)]
    s = [("p", a := rng.uniform(0, 1000), a + rng.uniform(0, 50)) for _ in range(20)] + [("q", 0.0, 1000.0)]
    got = {r.trial_id: r.span_start for r in trials.overlapping_span(spark.createDataFrame(t, "k string, id int, t0 double, t1 double"), spark.createDataFrame(s, "k string, a double, b double"), ["k"], "t0", "t1", "a", "b", "id", 17.0).collect()}
    want = {i: min(a for k, a, b in s if k == "p" and t0 < b and t1 > a) for _, i, t0, t1 in t if any(k == "p" and t0 < b and t1 > a for k, a, b in s)}
    assert got == want


@pytest.mark.parametrize("bucket", [None, 13])
def test_nearest(spark, bucket):
    rng = random.Random(3)
    l = [(k, i, rng.randrange(300), "x") for i in range(80) for k in ("a", "b")] + [("c", 1, 5, "x")]
    r = [("a", rng.randrange(300)) for _ in range(15)] + [("b", 100), ("b", 100), ("b", None), ("d", 1)]
    got = {(x.k, x.i): (x.before, x.after, x.nearest) for x in trains.nearest(spark.createDataFrame(l, "k string, i int, t long, z string"), spark.createDataFrame(r, "k string, r long"), ["k"], "t", "r", bucket).collect()}
    for k, i, t, _ in l:
        own = [v for kk, v in r if kk == k and v is not None]
        b, a = max((v for v in own if v <= t), default=None), min((v for v in own if v >= t), default=None)
        n = b if a is None or (b is not None and t - b <= a - t) else a
        assert got[k, i] == (b, a, n)


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("a", None), (None, 2.0)], "g string, v double")
    got = sorted((r.g or "", r.v or -1, r.r or 0) for r in R.average_rank(df, ["g"], "v", "r").collect())
    assert got == [("", 2.0, 1.0), ("a", -1, 0), ("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 5.0, 3.0)]


def test_silhouette_is_the_pairs_mean(spark):
    rng = np.random.default_rng(4)
    x, lab = rng.normal(size=(40, 3)), [i % 3 for i in range(39)] + [9]
    df = spark.createDataFrame([(i, lab[i], x[i].tolist()) for i in range(40)], "i int, l int, a array<double>")
    got = {r.i: r.s for r in C.squared_silhouette(df, "i", "l", "a").collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(40):
        own = [j for j in range(40) if lab[j] == lab[i] and j != i]
        if not own:
            assert got[i] == 0
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(40) if lab[j] == k]].mean() for k in set(lab) - {lab[i]})
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_consensus_refuses_too_many(spark):
    df = spark.createDataFrame([(0, i, 0) for i in range(20)], "run int, item int, c int")
    assert C.consensus(df, "run", "item", "c").count() == 190
    with pytest.raises(ValueError):
        C.consensus(df, "run", "item", "c", most_items=10)


def test_radius_join(spark):
    rng = np.random.default_rng(5)
    p, q = rng.uniform(-20, 20, (150, 3)), rng.uniform(-20, 20, (60, 3))
    a = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(999, None, 0.0, 0.0)], "i int, x double, y double, z double")
    b = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "j int, cx double, cy double, cz double")
    got = {(r.i, r.j) for r in space.within(a, b, 6.0).collect()}
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 6.0), strict=True)}


def test_names(spark):
    l = spark.createDataFrame([("p", "A1", "X1", 1), ("p", "B1", "RAW", 2), ("p", "C1", "C1", 3), (None, "A1", "A1", 4), ("p", None, None, 5)], "patient string, k string, raw string, i int")
    r = spark.createDataFrame([("p", "A1", "Q"), ("p", "A1", "Q"), ("p", "Z", "RAW")], "patient string, name string, other string")
    got = {x.i: (x.by_key, x.by_fallback) for x in naming.match_flags(l, r, ["patient"], "k", "raw", "name", "other").collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False), 5: (False, False)}


def test_kernels_on_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [])], "i int, a array<double>")
    got = {r.i: (r.n, r.s) for r in K.per_row(df, ["i"], ["a"], lambda a: (len(a), a.tolist()), "n int, s array<double>").collect()}
    assert got == {1: (2, [1.0, 2.0]), 2: (None, None), 3: (0, [])}
    c = K.chunked(spark.createDataFrame([(1, [float(v) for v in range(10)])], "i int, a array<double>"), ["i"], "a", 4, 2).collect()
    assert [(r.chunk, r.lead, r.part[r.lead : r.lead + 4]) for r in sorted(c, key=lambda r: r.chunk)] == [(0, 0, [0, 1, 2, 3]), (1, 2, [4, 5, 6, 7]), (2, 2, [8, 9])]


def test_models_refuse_and_assign(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(10)], "i int, a array<double>")
    with pytest.raises(ValueError):
        models.matrix(df, "i", "a", most_cells=10)
    x, meta = models.matrix(df, "i", "a")
    assert x.shape == (10, 2) and meta["i"].tolist() == list(range(10))
    got = {r.i: r.cluster for r in models.assign(df, "i", "a", np.array([[0.0, 0.0], [1.0, 0.0]])).collect()}
    assert got == {i: i % 2 for i in range(10)}


def test_boxes_and_roles(spark):
    a = [1.0] * 4 + [-1.0] * 4
    df = spark.createDataFrame([(a,)], "a array<double>")
    box = lambda *v: M.box_expresses(F.col("a"), M.Box(*v), 4, 0.5)
    r = df.select(box(0, 1, 0, 4, "pos", 1.0), box(1, 2, 0, 4, "neg", 1.0), box(0, 2, 0, 4, "zero", 0.1), box(1, 2, 0, 4, "nonpos", 0.1), box(0, 0, 0, 4, "pos", 0.1), box(0, 0, 0, 4, "zero", 0.1)).first()
    assert list(r) == [True, True, False, True, False, True]
    assert math.isclose(sum(M.gaussian(16, 4, 2)), 1.0)
