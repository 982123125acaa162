"""Open header formats of recordings as rows.

The readers list files with the engine's binary source and parse headers in
Arrow batches; of a recording only the asked channels and times become rows, in
chunks, so a file of any length is many small rows.  Byte layouts are the
published ones of each format.

Defined results: a file that is too short or has another magic gives a row with
``error`` set and no values; an empty folder gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------- NSx, NEV

#: Magics of the published continuous and event formats.
NSX_MAGIC, NEV_MAGIC = (b"NEURALCD", b"BRSMPGRP"), (b"NEURALEV", b"BREVENTS")


def nsx_header(b: bytes) -> dict:
    """Rate, labels, offset of the data, samples of a continuous file (2.2 and later)."""
    if len(b) < 314 or b[:8] not in NSX_MAGIC:
        raise ValueError("no NSx header")
    size, = struct.unpack_from("<I", b, 10)
    period, clock = struct.unpack_from("<II", b, 286)
    n, = struct.unpack_from("<I", b, 310)
    labels, scales = [], []
    for k in range(n):
        at = 314 + 66 * k
        labels.append(b[at + 4 : at + 20].split(b"\0")[0].decode("latin1"))
        dmin, dmax, amin, amax = struct.unpack_from("<hhhh", b, at + 22)
        scales.append((amax - amin) / (dmax - dmin) if dmax != dmin else 1.0)
    parts, at = [], size
    wide = b[:8] == b"BRSMPGRP"
    head = 13 if wide else 9
    while at + head <= len(b) and b[at] == 1:
        ts, points = struct.unpack_from("<QI" if wide else "<II", b, at + 1)
        parts.append((ts, at + head, points))
        at += head + 2 * n * points
    return {"fs": clock / period, "clock": clock, "labels": labels, "scales": scales, "parts": parts}


def nsx_window(b: bytes, h: dict, channel: int, t0: float, t1: float) -> np.ndarray:
    """Scaled samples of a channel between two times of the joined parts."""
    n, out, at = len(h["labels"]), [], 0
    lo, hi = int(t0 * h["fs"]), int(t1 * h["fs"])
    for _, pos, points in h["parts"]:
        a, e = max(lo - at, 0), min(hi - at, points)
        if a < e:
            x = np.frombuffer(b, "<i2", n * (e - a), pos + 2 * n * a).reshape(-1, n)[:, channel]
            out.append(x * h["scales"][channel])
        at += points
    return np.concatenate(out) if out else np.zeros(0)


def nev_events(b: bytes) -> list[tuple[float, str, int]]:
    """(seconds, kind, value) of the digital words and spikes of an event file."""
    if len(b) < 336 or b[:8] not in NEV_MAGIC:
        raise ValueError("no NEV header")
    size, width, clock = struct.unpack_from("<III", b, 12)
    wide = b[:8] == b"BREVENTS"
    out = []
    for at in range(size, len(b) - width + 1, width):
        ts, = struct.unpack_from("<Q" if wide else "<I", b, at)
        p = at + (8 if wide else 4)
        kind, = struct.unpack_from("<H", b, p)
        if kind == 0:
            value, = struct.unpack_from("<H", b, p + 4)
            out.append((ts / clock, "digital", value))
        else:
            out.append((ts / clock, "spike", kind))
    return out


# ------------------------------------------------------------ NCS, TRC

NCS_HEAD, NCS_RECORD, NCS_SAMPLES = 16384, 1044, 512


def ncs_probe(b: bytes, size: int | None = None) -> dict:
    """Start, end, rate, recorded and elapsed seconds from the first and last record."""
    size = len(b) if size is None else size
    n = (size - NCS_HEAD) // NCS_RECORD
    if not b.startswith(b"####") or n < 1:
        raise ValueError("no NCS records")
    first, _, fs, valid = struct.unpack_from("<QIII", b, NCS_HEAD)
    last, _, _, tail = struct.unpack_from("<QIII", b, NCS_HEAD + (n - 1) * NCS_RECORD)
    end = last + tail * 1e6 / fs
    return {"start_us": first, "end_us": int(end), "fs": float(fs), "recorded_s": ((n - 1) * valid + tail) / fs, "span_s": (end - first) / 1e6, "n_records": n}


def ncs_gaps(b: bytes, least_s: float) -> list[tuple[int, int]]:
    """(start, end) in microseconds of the pauses, by bisection over the records."""
    from ..kernels.signals import first_gap

    p = ncs_probe(b)
    step = NCS_SAMPLES * 1e6 / p["fs"]
    at = lambda i: struct.unpack_from("<Q", b, NCS_HEAD + i * NCS_RECORD)[0]
    return [(int(at(i) + step), at(i + 1)) for i, _ in first_gap(at, p["n_records"], step, least_s * 1e6)]


def trc_header(b: bytes) -> dict:
    """Rate, channels, bytes per sample and data offset of a type-4 file."""
    if len(b) < 640 or b[175] != 4:
        raise ValueError("no type 4 TRC header")
    offset, n, _, fs, width = struct.unpack_from("<IHHHH", b, 138)
    code, _ = struct.unpack_from("<II", b, 176 + 8)
    elec, _ = struct.unpack_from("<II", b, 192 + 8)
    labels, scales = [], []
    for k in range(n):
        number, = struct.unpack_from("<H", b, code + 2 * k)
        at = elec + 128 * number
        labels.append(b[at + 2 : at + 8].split(b"\0")[0].decode("latin1"))
        lmin, lmax, lgnd, pmin, pmax = struct.unpack_from("<iiiii", b, at + 14)
        scales.append(((pmax - pmin) / (lmax - lmin + 1) if lmax > lmin else 1.0, lgnd))
    return {"fs": float(fs), "labels": labels, "scales": scales, "offset": offset, "width": width, "samples": (len(b) - offset) // (n * width) if n and width else 0}


def trc_channel(b: bytes, h: dict, channel: int, step: int = 1) -> np.ndarray:
    """Scaled samples of a channel; ``step`` averages blocks (decimation)."""
    n = len(h["labels"])
    kind = {1: "u1", 2: "<u2", 4: "<u4"}[h["width"]]
    x = np.frombuffer(b, kind, n * h["samples"], h["offset"]).reshape(-1, n)[:, channel].astype(float)
    x = (x - h["scales"][channel][1]) * h["scales"][channel][0]
    return x[: len(x) // step * step].reshape(-1, step).mean(1) if step > 1 else x


# --------------------------------------------------------------- sources


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def _parsed(df: DataFrame, parse, schema: str) -> DataFrame:
    """Rows of ``parse(content)`` per file, or one row with the error."""
    names = [s.strip().split()[0] for s in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows += [(path, None, *r) for r in parse(bytes(content))]
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    rows.append((path, str(e)[:200], *[None] * len(names)))
            yield pd.DataFrame(rows, columns=["path", "error", *names], dtype=object)

    return df.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def nsx_headers(spark: SparkSession, path: str, pattern: str = "*.ns[1-9]") -> DataFrame:
    """One row per file and channel."""
    def parse(b):
        h = nsx_header(b)
        n = sum(p[2] for p in h["parts"])
        return [(k, v, h["fs"], n / h["fs"], len(h["parts"])) for k, v in enumerate(h["labels"])]

    return _parsed(files(spark, path, pattern), parse, "channel int, label string, fs double, seconds double, n_parts int")


def nsx_chunks(spark: SparkSession, path: str, label: str, t0: float, t1: float, size: int = 4096, pattern: str = "*.ns[1-9]") -> DataFrame:
    """Samples of the channels whose label fits a pattern, in chunks."""
    import re

    def parse(b):
        h = nsx_header(b)
        out = []
        for k, name in enumerate(h["labels"]):
            if re.search(label, name):
                x = nsx_window(b, h, k, t0, t1)
                out += [(name, h["fs"], i // size, x[i : i + size].tolist()) for i in range(0, len(x), size)]
        return out

    return _parsed(files(spark, path, pattern), parse, "label string, fs double, chunk int, x array<double>")


def nev(spark: SparkSession, path: str, pattern: str = "*.nev") -> DataFrame:
    return _parsed(files(spark, path, pattern), nev_events, "t double, kind string, value int")


def ncs(spark: SparkSession, path: str, pattern: str = "*.ncs") -> DataFrame:
    """One row per file: start, end, rate, recorded and elapsed time."""
    def parse(b):
        p = ncs_probe(b)
        return [(p["start_us"], p["end_us"], p["fs"], p["recorded_s"], p["span_s"])]

    return _parsed(files(spark, path, pattern), parse, "start_us long, end_us long, fs double, recorded_s double, span_s double")


def trc(spark: SparkSession, path: str, pattern: str = "*.TRC") -> DataFrame:
    """One row per file and channel."""
    def parse(b):
        h = trc_header(b)
        return [(k, v, h["fs"], h["samples"]) for k, v in enumerate(h["labels"])]

    return _parsed(files(spark, path, pattern), parse, "channel int, label string, fs double, samples long")


def sessions(spark: SparkSession, path: str, pattern: str = "*.{ncs,ns5,ns6,nev,TRC}") -> DataFrame:
    """Folders that hold recordings directly: ``folder, n_files, bytes``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return f.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def cubes(spark: SparkSession, path: str, n_freq: int, n_time: int, pattern: str = "*.npy") -> DataFrame:
    """Saved maps by their file names (``patient_condition_electrode``); other shapes are left out."""
    import io

    def parse(b):
        a = np.load(io.BytesIO(b), allow_pickle=False)
        return [(int(a.shape[0]), int(a.shape[1]), a.astype(float).ravel().tolist())] if a.shape == (n_freq, n_time) else []

    d = _parsed(files(spark, path, pattern), parse, "n_freq int, n_time int, db array<double>")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.npy$", "")
    stem = F.regexp_replace(stem, r"(?i)([_-](TN|CLEAN|TF|RT))+$", "")
    part = lambda i: F.regexp_extract(stem, r"^([A-Za-z]+_?\d+)_([a-z]+)_(.+)$", i)
    return d.select(part(1).alias("patient"), part(2).alias("condition"), part(3).alias("electrode"), "n_freq", "n_time", "db", "error")
