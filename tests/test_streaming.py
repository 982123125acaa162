import datetime as dt

from ephysloom.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def _write(spark, path, batches):
    for n, rows in enumerate(batches):
        d = spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), s, name, v) for i, h, s, name, v in rows], J.MARKS)
        d.coalesce(1).write.mode("append").parquet(path)


def _run(spark, df, tmp_path, name, mode="append"):
    J.to_table(df, str(tmp_path / name), str(tmp_path / f"{name}-ck"), mode).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / name))


BATCHES = [
    [(1, 0, 1, "a", 1.0), (2, 1, 1, "a", 9.0), (3, 2, 1, "b", 0.0), (1, 0, 1, "a", 1.0)],
    [(4, 30, 1, "a", 9.0), (5, 31, 1, "a", 1.0), (6, 3, 2, "a", 9.0)],
    [(7, 400, 1, "a", 1.0), (8, 1, 1, "a", 9.0)],  # the last is late beyond the watermark
    [(9, 401, 2, "a", 1.0)],
    [(10, 900, 3, "a", 0.0)],
]


def test_bursts_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    _write(spark, src, BATCHES)
    got = _run(spark, J.burst_counts(J.marks(spark, src, files_per_batch=1)), tmp_path, "bursts").collect()
    first = [r for r in got if r.session == 1 and r.start == T0]
    assert len(first) == 1 and first[0].n in (4, 5)
    assert sum(1 for r in got if r.session == 1 and r.start == T0 + dt.timedelta(hours=30) and r.n == 2) == 1


def test_windows_merged_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    _write(spark, src, BATCHES)
    J.merged_rates(J.marks(spark, src, files_per_batch=1), str(tmp_path / "m"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.name, r.start): r.n for r in J.read_merged(spark, str(tmp_path / "m")).collect()}
    assert got["a", T0] in (4, 5) and got["a", T0 + dt.timedelta(hours=30)] == 2 and got["b", T0] == 1


def test_edges_keep_their_state_between_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    _write(spark, src, BATCHES)
    e = J.edges(J.once(J.marks(spark, src, files_per_batch=1)), 0.5, 5.0)
    got = [(r.session, r.edge) for r in _run(spark, e, tmp_path, "edges").orderBy("session", "ts").collect()]
    assert [x for s, x in got if s == 1][:2] == ["rise", "fall"] and ("rise" in [x for s, x in got if s == 2])


def test_repeated_rows_count_once(spark, tmp_path):
    src = str(tmp_path / "in")
    _write(spark, src, BATCHES)
    got = _run(spark, J.window_rates(J.once(J.marks(spark, src, files_per_batch=1))), tmp_path, "rates").collect()
    assert {(r.name, r.start): r.n for r in got}["a", T0] in (3, 4)  # 1, 2 and 6, and 8 if it comes before the watermark passed
