import random

import pytest

from ephysloom.operators.intervals import merge_runs, periods_and_gaps


def _brute(rows, tolerance):
    out = {}
    for e, s, t in rows:
        if s is not None and t is not None and t > s:
            out.setdefault(e, []).append((s, t))
    want = set()
    for e, xs in out.items():
        ps = []
        for s, t in sorted(xs):
            if ps and s <= ps[-1][1] + tolerance:
                ps[-1][1] = max(ps[-1][1], t)
            else:
                ps.append([s, t])
        want |= {(e, "period", a, b) for a, b in ps} | {(e, "gap", p[1], q[0]) for p, q in zip(ps, ps[1:], strict=False)}
    return want


@pytest.mark.parametrize("tolerance", [0, 7, 1000, 60_000_000])
def test_against_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    rows = []
    for e in ("a", "b", None, "hot"):
        for _ in range(400 if e == "hot" else 60):
            s = rng.randrange(-(10**6), 10**6) * max(1, tolerance // 3)
            rows.append((e, s, s + rng.choice([0, -5, 1, 3, tolerance, 3 * tolerance + 1, 90 * max(1, tolerance), 10**4 * max(1, tolerance)])))
    rows += [("a", None, 5), ("a", 5, None), ("a", 10, 10), ("b", 1, 2), ("b", 1, 2), ("c", 0, tolerance + 1), ("c", tolerance + 1 + tolerance, 3 * tolerance + 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "e string, s long, t long, start_us string")
    got = {tuple(r) for r in periods_and_gaps(merge_runs(df, ["e"], "s", "t", tolerance), ["e"]).collect()}
    assert got == _brute(rows, tolerance)


def test_empty(spark):
    df = spark.createDataFrame([], "e string, s long, t long")
    assert merge_runs(df, ["e"], "s", "t").count() == 0
