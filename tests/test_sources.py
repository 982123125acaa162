import io
import struct

import numpy as np
import pytest

from ephysloom.sources import recordings as R
from ephysloom.sources import sinks as S
from ephysloom.sources import text as X


def nsx(samples, fs=1000, labels=("a1", "photo"), parts=2):
    n = len(labels)
    size = 314 + 66 * n
    b = bytearray(size)
    b[:8] = b"NEURALCD"
    struct.pack_into("<I", b, 10, size)
    struct.pack_into("<II", b, 286, 30000 // fs, 30000)
    struct.pack_into("<I", b, 310, n)
    for k, v in enumerate(labels):
        b[314 + 66 * k + 4 : 314 + 66 * k + 4 + len(v)] = v.encode()
        struct.pack_into("<hhhh", b, 314 + 66 * k + 22, -1000, 1000, -500, 500)
    at = 0
    for p in np.array_split(samples, parts):
        b += struct.pack("<BII", 1, at * 30, len(p)) + np.ascontiguousarray(p, "<i2").tobytes()
        at += len(p)
    return bytes(b)


def test_nsx(spark, tmp_path):
    x = np.stack([np.arange(200), -np.arange(200)], 1)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "r.ns5").write_bytes(nsx(x))
    (tmp_path / "bad.ns5").write_bytes(b"short")
    h = R.nsx_headers(spark, str(tmp_path)).collect()
    assert {(r.label, r.fs, r.seconds, r.n_parts) for r in h if not r.error} == {("a1", 1000.0, 0.2, 2), ("photo", 1000.0, 0.2, 2)}
    assert sum(r.error is not None for r in h) == 1
    c = sorted((r.chunk, r.x) for r in R.nsx_chunks(spark, str(tmp_path / "s"), "^a", 0.05, 0.15, 64).collect())
    assert sum((x for _, x in c), []) == [v * 0.5 for v in range(50, 150)]
    assert [(r.n_files) for r in R.sessions(spark, str(tmp_path)).collect()] == [1, 1]


def test_nev(spark, tmp_path):
    b = bytearray(336)
    b[:8] = b"NEURALEV"
    struct.pack_into("<III", b, 12, 336, 24, 30000)
    for ts, kind, v in ((30000, 0, 7), (60000, 3, 0), (90000, 0, 9)):
        p = bytearray(24)
        struct.pack_into("<IHBBH", p, 0, ts, kind, 1, 0, v)
        b += p
    (tmp_path / "e.nev").write_bytes(bytes(b))
    assert [(r.t, r.kind, r.value) for r in R.nev(spark, str(tmp_path)).collect()] == [(1.0, "digital", 7), (2.0, "spike", 3), (3.0, "digital", 9)]


def test_ncs(spark, tmp_path):
    b = bytearray(R.NCS_HEAD)
    b[:4] = b"####"
    t = 10_000_000
    for k in range(40):
        t += 16_000 if k else 0
        t += 60_000_000 if k == 25 else 0
        r = bytearray(R.NCS_RECORD)
        struct.pack_into("<QIII", r, 0, t, 0, 32000, 512)
        b += r
    (tmp_path / "c.ncs").write_bytes(bytes(b))
    p = R.ncs(spark, str(tmp_path)).first()
    assert abs(p.recorded_s - 40 * 0.016) < 1e-9 and abs(p.span_s - 60.64) < 1e-6
    assert R.ncs_gaps(bytes(b), 1.0) == [(10_000_000 + 25 * 16_000, 10_000_000 + 25 * 16_000 + 60_000_000)]
    with pytest.raises(ValueError):
        R.ncs_probe(b"")


def test_trc(spark, tmp_path):
    n, data = 2, np.arange(20, dtype="<u2").reshape(10, 2)
    b = bytearray(1024)
    b[175] = 4
    struct.pack_into("<IHHHH", b, 138, 1024, n, 0, 512, 2)
    struct.pack_into("<II", b, 184, 640, 4)
    struct.pack_into("<II", b, 200, 700, 256)
    for k in range(n):
        struct.pack_into("<H", b, 640 + 2 * k, k)
        b[702 + 128 * k : 704 + 128 * k] = f"C{k}".encode()
        struct.pack_into("<iiiii", b, 714 + 128 * k, 0, 65535, 4, 0, 65536)
    b += data.tobytes()
    (tmp_path / "p.TRC").write_bytes(bytes(b))
    assert {(r.label, r.fs, r.samples) for r in R.trc(spark, str(tmp_path)).collect()} == {("C0", 512.0, 10), ("C1", 512.0, 10)}
    h = R.trc_header(bytes(b))
    assert R.trc_channel(bytes(b), h, 1, 5).tolist() == [1.0, 11.0]


def test_cubes(spark, tmp_path):
    for name, shape in (("EL1_audio_A1_TN", (2, 3)), ("EL1_audio_B1", (4, 4))):
        f = io.BytesIO()
        np.save(f, np.ones(shape))
        (tmp_path / f"{name}.npy").write_bytes(f.getvalue())
    got = R.cubes(spark, str(tmp_path), 2, 3).collect()
    assert [(r.patient, r.condition, r.electrode, len(r.db)) for r in got] == [("EL1", "audio", "A1", 6)]


def test_trial_tables(spark, tmp_path):
    (tmp_path / "EL1_a.tsv").write_text("sample\tsample_offsets\ttrial_end\tcondition\tresp_accuracy\n10\t20\t30\taudio\tcorrect\n40\t50\t60\taudio\t\n")
    (tmp_path / "EL1_b.tsv").write_text("sample\tsample_offsets\ttrial_end\tcondition\tresp_accuracy\n10\t20\t30\taudio\tcorrect\n40\t50\t60\taudio\t\n")
    (tmp_path / "PAT_2.tsv").write_text('"onset_sample","offset_sample","trial_type"\n7,"8",picture\nbad,9\n')
    (tmp_path / "manual.tsv").write_text("onset_s;offset_s\n1.5;2.5\n")
    (tmp_path / "empty.tsv").write_text("")
    got = {(r.source, r.sample, r.sample_offsets, r.condition_name, r.resp_accuracy) for r in X.trials(spark, str(tmp_path)).collect()}
    assert got == {("EL1_a.tsv", 10, 20, "audio", "correct"), ("EL1_a.tsv", 40, 50, "audio", None), ("PAT_2.tsv", 7, 8, "picture", None), ("PAT_2.tsv", None, 9, None, None)}
    assert [tuple(r) for r in X.manual_triggers(spark, str(tmp_path), 1000.0).collect()] == [("manual.tsv", 1500, 2500)]
    (tmp_path / "x.txt").write_text("1")
    (tmp_path / "x.tsv").write_text("2")
    assert any(r.path.endswith("x.txt") for r in X.onset_files(spark, str(tmp_path)).collect())


def test_logs_and_coordinates(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "run.log").write_text("2024-01-01 10:00:00 patient=7 stage=ersp status=running\n2024-01-01 11:00:00 patient=7 stage=ersp status=done\n2024-01-02 11:00:00 patient=7 stage=ersp status=done\nnoise\n")
    assert [tuple(r) for r in X.newest_finished(spark, str(tmp_path / "l")).collect()] == [("2024-01-02 11:00:00", "7", "ersp", "done")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "EL1_contacts.csv").write_text("name,x,y,z\nA-01,1,2,3\nB1,,2,x\n")
    (tmp_path / "c" / "all_contacts.csv").write_text("name,x,y,z\nA-01,1,2,3\n")
    assert {(r.patient, r.contact, r.x, r.z) for r in X.coordinates(spark, str(tmp_path / "c")).collect()} == {("EL1", "A1", 1.0, 3.0), ("EL1", "B1", None, None)}


def test_runs(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "i int, g string")
    for run in ("r1", "r2"):
        S.save_run(d, str(tmp_path), "kmeans", "hg", run, "v2")
    assert [r.run_id for r in S.newest(spark, str(tmp_path), "v2").collect()] == ["r2"]
    assert S.read_run(spark, str(tmp_path), "kmeans", "hg", "r1", "v2").count() == 2
    with pytest.raises(ValueError):
        S.read_run(spark, str(tmp_path), "kmeans", "hg", "r1", "v3")
    with pytest.raises(FileNotFoundError):
        S.read_run(spark, str(tmp_path), "kmeans", "hg", "r9", "v2")
    t = spark.createDataFrame([("p", "audio", 1), ("p", "picture", 2)], "patient string, condition_name string, sample int")
    S.trials_by_condition(t, str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "out")).count() == 2
