"""Connected regions of maps."""

from __future__ import annotations

import numpy as np


def components(mask: np.ndarray) -> np.ndarray:
    """Labels (from 1) of 8-connected regions, 0 outside."""
    lab = np.zeros(mask.shape, int)
    n = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if lab[start]:
            continue
        n += 1
        lab[start] = n
        todo = [start]
        while todo:
            r, c = todo.pop()
            for i in range(max(0, r - 1), min(mask.shape[0], r + 2)):
                for j in range(max(0, c - 1), min(mask.shape[1], c + 2)):
                    if mask[i, j] and not lab[i, j]:
                        lab[i, j] = n
                        todo.append((i, j))
    return lab


def clusters(a: np.ndarray, thr: float, least: int) -> list[dict]:
    """Regions above ``thr`` and below ``-thr`` of at least ``least`` cells."""
    out = []
    for sign in (1, -1):
        lab = components(np.nan_to_num(a) * sign > thr)
        for k in range(1, lab.max() + 1):
            m = lab == k
            if m.sum() >= least:
                out.append({"sign": sign, "size": int(m.sum()), "peak": float((a[m] * sign).max() * sign)})
    return out


def valley_blobs(a: np.ndarray, core: float, merge: float, least_mean: float, most: int) -> list[dict]:
    """Regions above ``merge`` that hold a core, by their score
    ``|mean| * area / (1 + 3 * relative frequency)``, the ``most`` best."""
    a = np.nan_to_num(a)
    out = []
    for sign in (1, -1):
        v = a * sign
        lab = components(v > merge)
        for k in range(1, lab.max() + 1):
            m = lab == k
            if v[m].max() <= core or v[m].mean() < least_mean:
                continue
            r, c = np.nonzero(m)
            mean = float(v[m].mean())
            out.append({
                "sign": sign, "mean": mean, "area": int(m.sum()), "row": float(r.mean()), "col": float(c.mean()), "row_half": float(max(2 * r.std(), 1.5)), "col_half": float(max(2 * c.std(), 1.5)),
                "first": int(c.min()), "last": int(c.max()), "score": float(mean * m.sum() / (1 + 3 * r.mean() / max(1, a.shape[0] - 1))),
            })
    return sorted(out, key=lambda b: (-b["score"], b["row"], b["col"]))[:most]


FEATURES = ("sign", "mean", "area", "row", "col", "row_half", "col_half", "score")


def blob_vector(blobs: list[dict], most: int) -> np.ndarray:
    """Eight features a blob, zeros where there are fewer."""
    out = np.zeros(most * len(FEATURES))
    for n, b in enumerate(blobs[:most]):
        out[n * len(FEATURES) : (n + 1) * len(FEATURES)] = [b[f] for f in FEATURES]
    return out


def blob_distance(a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> float:
    w = np.ones(len(a)) if weights is None else np.resize(weights, len(a))
    return float(np.sqrt((w * (a - b) ** 2).sum()))


def painted(a: np.ndarray, blobs_of, bins: int, dead: float) -> np.ndarray:
    """Signs of the blobs' cells, averaged to ``bins`` columns, small means 0."""
    lab = np.zeros(a.shape)
    for sign, thr in blobs_of:
        lab[np.nan_to_num(a) * sign > thr] = sign
    n = a.shape[1] // bins
    m = lab[:, : n * bins].reshape(a.shape[0], bins, n).mean(2)
    return np.where(m > dead, 1, np.where(m < -dead, -1, 0))
