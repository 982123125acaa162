import random

from ephysloom.llm.packing import fill_report, pack, plan, token_counts


def _check(rows, sizes, capacity):
    per, seen = {}, {}
    for r in rows:
        per[r.container_id] = per.get(r.container_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.piece_no, r.token_from, r.n_tokens))
    assert max(per.values(), default=0) <= capacity
    for d, n in sizes.items():
        ps = sorted(seen[d])
        assert sum(p[2] for p in ps) == (n or 0)
        assert [p[1] for p in ps] == [capacity * i for i in range(len(ps))]
        assert len(ps) == max(1, -(-(n or 0) // capacity))


def test_every_item_once_and_no_container_too_full(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 5, 33, 50, 51, 99, 100, 101, 250, 1000, rng.randrange(1, 100)]) for i in range(1500)} | {9000: None}
    df = spark.createDataFrame([(d, n, "x") for d, n in sizes.items()], "doc_id long, n_tokens long, container_id string")
    for rows_per_bucket in (200_000, 10):
        rows = pack(df, 100, rows_per_bucket).collect()
        _check(rows, sizes, 100)
    used = len({r.container_id for r in rows if r.n_tokens})
    assert used <= -(-sum(n or 0 for n in sizes.values()) // 100) * 1.02 + 1
    r = fill_report(pack(df, 100), 100).first()
    assert r.fullest <= 100 and r.least_containers <= r.n_containers


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(df).count() == 0


def test_plan_is_best_fit_on_counts():
    runs, made = plan({60: 3, 40: 3, 20: 1}, 100)
    assert made == 4 and runs[:, 0].tolist() == [20, 40, 60]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "a" * 300_000, "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1000
