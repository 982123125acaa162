"""Kernel and model queries over ``embeddings`` and ``events``; no SQL says them,
the kernels are tested against numpy and hand-made cases."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..kernels import blobs as B
from ..kernels import models as N
from ..kernels import signals as G
from ..operators import kernels as R
from ..operators import models as M
from .maps import BANDS, BINS, EM, courses, maps
from .registry import query

FS = 1000.0


def signals(spark, sf):
    """A longer trace for every vector: its values as the amplitudes of 64 tones,
    with line hum on every third and a burst in the middle."""
    def make(a, label, vec_id):
        t = np.arange(2048) / FS
        x = (np.asarray(a)[:, None] * np.sin(2 * np.pi * (3 + 4 * np.arange(64))[:, None] * t)).sum(0)
        x = x + (2.0 if vec_id % 3 == 0 else 0.02) * np.sin(2 * np.pi * 50 * t) + np.where((t > 0.8) & (t < 1.2), 1.5, 0.0) * np.sin(2 * np.pi * (90 + label) * t)
        return (x.tolist(),)

    m = maps(spark, sf).withColumn("id", F.col("vec_id"))
    return R.per_row(m, ["vec_id", "electrode", "patient", "condition", "label"], ["a", "label", "id"], make, "x array<double>")


@query("spectrogram")
def spectrogram(spark, sf):
    """Frames, rows and total power of every trace's spectrogram."""
    def k(x):
        f, t, s = G.spectrogram(x, FS, fmax=200)
        return len(f), len(t), float(round(10 * np.log10(s.sum()), 4))

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "n_freq int, n_time int, total_db double")


@query("resample")
def resample(spark, sf):
    """Traces at half and at three quarters of the rate."""
    def k(x):
        return len(G.resample(x, FS, 500)), len(G.resample(x, FS, 750)), float(round(G.resample(x, FS, 500).std(), 4))

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "n_half int, n_three_quarters int, sd double")


@query("ersp_maps")
def ersp_maps(spark, sf):
    """Baseline-subtracted maps on a common axis with their halves' noise."""
    def k(x):
        m, a, b = G.ersp(x, FS, [400, 500, 600], [700, 800, 900], [1100, 1300, 1500], 60)
        return m.round(4).ravel().tolist(), m.shape[0], float(round((a - b).std() / 2, 4)), float(round(G.trial_score(m), 4))

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "db array<double>, n_freq int, noise double, score double")


@query("psd_bad_channels")
def psd_bad_channels(spark, sf):
    """Channels that stand out in total power or line ratio within their patient."""
    def k(x):
        f, p = G.welch(x, FS)
        return float(round(10 * np.log10(p.sum()), 6)), float(round(p[(f >= 49) & (f <= 51)].sum() / p.sum(), 6))

    d = R.per_row(signals(spark, sf), ["vec_id", "patient"], ["x"], k, "power_db double, line_ratio double")
    return R.bad_by_z(d.withColumn("power", 10 ** (F.col("power_db") / 10)), ["patient"], "power", "line_ratio").select("vec_id", "power_db", "line_ratio", "bad")


@query("notch_audit")
def notch_audit(spark, sf):
    """Every harmonic with its height before and after the notch."""
    def k(x):
        _, audit = G.notch_harmonics(x[:1024], FS, 50, 200)
        return ([(a["hz"], round(a["z_before"], 3), a["removed"], round(a["z_after"], 3)) for a in audit],)

    d = R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "audit array<struct<hz:double,z_before:double,removed:boolean,z_after:double>>")
    return d.select("vec_id", F.explode("audit").alias("a")).select("vec_id", "a.*")


@query("spectrum_interpolation")
def spectrum_interpolation(spark, sf):
    """Line height before and after interpolation of the spectrum."""
    def k(x):
        y = G.spectrum_interpolate(x, FS, [(48, 52)])
        (f, p), (_, q) = G.welch(x, FS), G.welch(y, FS)
        return float(round(G.peak_z(f, p, 50), 3)), float(round(G.peak_z(f, q, 50), 3))

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "z_before double, z_after double")


@query("unexplained_peaks")
def unexplained_peaks(spark, sf):
    """Peaks of the median-free spectrum, on or off the comb, and the best comb."""
    def k(x):
        p = G.unexplained_peaks(x, FS)
        b, s = G.fit_comb([q["hz"] for q in p], [50.0, 60.0, 16.7])
        return ([(q["hz"], round(q["z"], 3), q["on_comb"]) for q in p], b, round(s, 4))

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "peaks array<struct<hz:double,z:double,on_comb:boolean>>, comb double, share double")


_RE = ", s as (select electrode, condition, patient, label, vec_id, band * 16 + bin as pos, v from cl)"


@query("rereference_mean", f"with {EM}{_RE}, r as (select patient, condition, pos, avg(v) as r, count(*) as n from s where label < 6 group by all) select vec_id, cast(s.pos as int) as pos, round(case when n >= 3 then v - r else v end, 6) as v from s left join r using (patient, condition, pos)")
def rereference_mean(spark, sf):
    """Channels less the mean of their patient's reference channels."""
    d = R.rereference(maps(spark, sf), ["patient", "condition"], "electrode", "a", F.col("label") < 6)
    return d.select("vec_id", F.posexplode("a").alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


@query("rereference_median", f"with {EM}{_RE}, r as (select patient, condition, pos, median(v) as r, count(*) as n from s where label < 6 group by all) select vec_id, cast(s.pos as int) as pos, round(case when n >= 3 then v - r else v end, 6) as v from s left join r using (patient, condition, pos)")
def rereference_median(spark, sf):
    d = R.rereference(maps(spark, sf), ["patient", "condition"], "electrode", "a", F.col("label") < 6, "median")
    return d.select("vec_id", F.posexplode("a").alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


@query("common_average", f"with {EM}{_RE}, r as (select patient, condition, label % 2 as g, pos, avg(v) as r, count(*) as n from s where electrode % 7 <> 0 group by all) select vec_id, cast(s.pos as int) as pos, round(case when n >= 3 then v - r else v end, 6) as v from s left join r on r.patient = s.patient and r.condition = s.condition and r.g = s.label % 2 and r.pos = s.pos")
def common_average(spark, sf):
    """Common average per array; bad channels are left out of it but referenced."""
    d = maps(spark, sf).withColumn("g", F.col("label") % 2)
    d = R.rereference(d, ["patient", "condition", "g"], "electrode", "a", F.col("electrode") % 7 != 0)
    return d.select("vec_id", F.posexplode("a").alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


@query("tetrodes", f"with {EM}, r as (select vec_id, patient, row_number() over (partition by patient order by vec_id) - 1 as i from em) select vec_id, patient, cast(i // 4 as int) as tetrode, cast(i % 4 as int) as wire from r")
def tetrodes(spark, sf):
    return R.tetrodes(maps(spark, sf).select("vec_id", "patient"), ["patient"], "vec_id")


@query("band_envelope_z")
def band_envelope_z(spark, sf):
    """Peak and mean of the high band's envelope over its baseline."""
    def k(x):
        z = G.band_envelope_z(x, FS, 70, 150, (100, 600))
        return float(round(z.max(), 4)), int(z.argmax())

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "peak_z double, peak_at int")


@query("epochs_cut")
def epochs_cut(spark, sf):
    """Complete epochs around the onsets and their mean energy."""
    def k(x):
        e = G.epochs(x, [50, 600, 1000, 2000], 100, 200)
        return len(e), float(round(np.mean([v.std() for v in e]), 5))

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "n int, sd double")


@query("photodiode_edges")
def photodiode_edges(spark, sf):
    """Onsets and offsets of a square mark hidden in each trace."""
    def k(x):
        mark = np.zeros(len(x))
        for o in (300, 900, 1500):
            mark[o : o + 250] = 30.0
        on, off = G.onsets_by_derivative(mark + np.asarray(x) * 0.3, FS, 1.5)
        return on, off

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "onsets array<int>, offsets array<int>")


@query("hysteresis_edges")
def hysteresis_edges(spark, sf):
    """High states of each course between two thresholds."""
    def k(y):
        return ([(a, b) for a, b in G.hysteresis(y, 0.0, 0.8, 2)],)

    d = R.per_row(courses(spark, sf), ["vec_id"], ["y"], k, "s array<struct<first:int,last:int>>")
    return d.select("vec_id", F.explode("s").alias("x")).select("vec_id", "x.*")


@query("cue_and_pulses")
def cue_and_pulses(spark, sf):
    """Longest typical stretch, pulses outside the clock's levels, median-filtered peak."""
    def k(x):
        x = np.asarray(x)
        a, b = G.cue_region(x, FS, 0.2)
        return a, b, len(G.serial_pulses(np.round(np.sign(x) + (np.abs(x) > 3 * x.std()) * 4))), float(round(G.despike(x[:512], 3).max(), 5))

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "first_bin int, last_bin int, n_pulses int, despiked_max double")


@query("signal_metrics")
def signal_metrics(spark, sf):
    """Spike-window and speech descriptors of every trace."""
    def k(x):
        w, s = G.window_metrics(x, FS, 4.0), G.speech_metrics(x, FS)
        return *(float(round(w[c], 5)) for c in ("rms", "saturated", "mains", "spike")), *(float(round(s[c], 5)) for c in ("crest", "silence", "envelope", "range_db"))

    return R.per_row(signals(spark, sf), ["vec_id"], ["x"], k, "rms double, saturated double, mains double, spike double, crest double, silence double, envelope double, range_db double")


@query("xcorr_lag")
def xcorr_lag(spark, sf):
    """Delay between the first two conditions of an electrode."""
    s = signals(spark, sf).groupBy("electrode").agg(F.max(F.when(F.col("condition") == "audio", F.col("x"))).alias("u"), F.max(F.when(F.col("condition") == "picture", F.col("x"))).alias("v")).dropna()
    return R.per_row(s, ["electrode"], ["u", "v"], lambda u, v: (G.lag(u, v, FS, 0.5),), "lag_s double")


def _grid(a):
    return np.asarray(a).reshape(BANDS, BINS)


@query("map_clusters")
def map_clusters(spark, sf):
    """8-connected regions beyond a threshold."""
    def k(a):
        return ([(c["sign"], c["size"], round(c["peak"], 6)) for c in B.clusters(_grid(a), 0.12, 2)],)

    d = R.per_row(maps(spark, sf), ["vec_id"], ["a"], k, "c array<struct<sign:int,size:int,peak:double>>")
    return d.select("vec_id", F.explode("c").alias("x")).select("vec_id", "x.*")


@query("valley_blobs")
def valley_blobs(spark, sf):
    """The best blobs of every map with their ellipse, and the gate on the score."""
    cols = ("sign", "mean", "area", "row", "col", "row_half", "col_half", "first", "last", "score")

    def k(a):
        return ([tuple(round(b[c], 6) for c in cols) for b in B.valley_blobs(_grid(a), 0.2, 0.08, 0.1, 3)],)

    kinds = ",".join(f"{c}:{'int' if c in ('sign', 'area', 'first', 'last') else 'double'}" for c in cols)
    d = R.per_row(maps(spark, sf), ["vec_id"], ["a"], k, f"b array<struct<{kinds}>>")
    d = d.select("vec_id", F.posexplode("b").alias("no", "x")).select("vec_id", "no", "x.*")
    from ..operators.quantiles import group_quantiles

    top = d.filter("no = 0")
    gate = group_quantiles(top, [], F.col("score"), {"gate": 0.5}).select("gate")
    return d.join(F.broadcast(gate)).withColumn("strong", F.col("score") >= F.col("gate")).drop("gate")  # one row


@query("blob_distances")
def blob_distances(spark, sf):
    """Each map's blob features against its condition's mean features."""
    def k(a):
        return (B.blob_vector(B.valley_blobs(_grid(a), 0.2, 0.08, 0.1, 3), 3).tolist(),)

    from ..operators.clusters import centroids

    d = R.per_row(maps(spark, sf), ["vec_id", "condition"], ["a"], k, "v array<double>")
    c = centroids(d, ["condition"], "v").select("condition", "c")
    return d.join(F.broadcast(c), "condition").select("vec_id", "condition", F.round(A.distance(F.col("v"), F.col("c")), 6).alias("d"))  # one row a condition


@query("painted_map")
def painted_map(spark, sf):
    """Maps painted with the signs of what exceeds the threshold, at half the bins."""
    def k(a):
        return (B.painted(_grid(a), ((1, 0.12), (-1, 0.12)), 8, 0.25).ravel().tolist(),)

    d = R.per_row(maps(spark, sf), ["vec_id"], ["a"], k, "s array<int>")
    return d.select("vec_id", F.posexplode("s").alias("pos", "s"))


# ---------------------------------------------------------------- models


def _items(spark, sf):
    """One row per electrode: its conditions' mean map, the label and patient."""
    from ..operators.clusters import centroids

    c = centroids(maps(spark, sf), ["electrode"], "a").select("electrode", F.col("c").alias("a"))
    k = maps(spark, sf).groupBy("electrode").agg(F.min("label").alias("label"), F.min("patient").alias("patient"))
    return c.join(k, "electrode")


def _matrix(spark, sf):
    return M.matrix(_items(spark, sf), "electrode", "a", ["label", "patient"])


def _grid_of(**axes):
    return pd.DataFrame(list(itertools.product(*axes.values())), columns=list(axes))


def _sweep(spark, sf, grid, task, schema):
    x, meta = _matrix(spark, sf)
    return M.fan_out(spark, x, meta, grid, task, schema)


@query("kmeans_sweep")
def kmeans_sweep(spark, sf):
    """Inertia, silhouette and gap of every K."""
    def task(x, meta, k):
        lab, _, inertia = N.kmeans(x, k, 7)
        yield k, float(round(inertia, 6)), float(round(N.silhouette(x, lab), 6)), float(round(N.gap(x, k, 3), 6))

    return _sweep(spark, sf, _grid_of(k=range(2, 9)), task, "k int, inertia double, silhouette double, gap double")


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    """Every map assigned to the centres fitted on the electrodes' mean maps."""
    x, _ = _matrix(spark, sf)
    _, c, _ = N.kmeans(x, 4, 7)
    return M.assign(maps(spark, sf), "vec_id", "a", c).withColumn("d", F.round("d", 6))


@query("ward_labels")
def ward_labels(spark, sf):
    """Hierarchical labels with the medoid of each cluster, three linkages."""
    def task(x, meta, how):
        m = N.linkage(x, how)
        lab = N.cut(m, len(x), 5)
        med = N.medoids(x, lab)
        for e, c in zip(meta["electrode"], lab, strict=True):
            yield how, int(e), int(c), int(meta["electrode"][med[int(c)]])

    return _sweep(spark, sf, _grid_of(how=["ward", "average", "complete"]), task, "how string, electrode long, cluster int, medoid long")


@query("kmedoids_labels")
def kmedoids_labels(spark, sf):
    def task(x, meta, seed):
        d = 1 - np.corrcoef(x)
        lab, m, cost = N.kmedoids(d, 4, seed)
        for e, c in zip(meta["electrode"], lab, strict=True):
            yield seed, int(e), int(meta["electrode"][m[c]]), float(round(cost, 6))

    return _sweep(spark, sf, _grid_of(seed=[1, 2]), task, "seed int, electrode long, medoid long, cost double")


@query("cnmf_loadings")
def cnmf_loadings(spark, sf):
    """Loadings of the electrodes, and of single maps projected on the components."""
    x, meta = _matrix(spark, sf)
    g, f = N.convex_nmf(x, 4, 7)
    sent = f

    def k(a):
        return (N.nnls(sent, np.asarray(a)[None])[0].round(6).tolist(),)

    p = R.per_row(maps(spark, sf), ["vec_id"], ["a"], k, "w array<double>")
    return p.select("vec_id", F.posexplode("w").alias("component", "w"))


@query("bicv_curve")
def bicv_curve(spark, sf):
    """Held-out explained variance per K, method and fold of rows and columns."""
    def task(x, meta, k, method, r, c):
        row = np.arange(len(x)) % 4 == r
        col = np.arange(x.shape[1]) % 4 == c
        fit = N.convex_nmf if method == "cnmf" else N.kmeans
        yield method, k, float(round(N.bicv(x, k, row, col, fit), 6))

    g = _grid_of(k=[2, 4, 6], method=["kmeans", "cnmf"], r=range(4), c=range(4))
    d = _sweep(spark, sf, g, task, "method string, k int, r2 double")
    return d.groupBy("method", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r2"), 6).alias("r2"), F.round(F.min("r2"), 6).alias("worst"))


@query("bootstrap_jaccard")
def bootstrap_jaccard(spark, sf):
    """Stability of each cluster: best overlap on in-bag rows, with a surrogate null."""
    def task(x, meta, b, null):
        x = N.surrogate(x, b) if null else x
        base, _, _ = N.kmeans(x, 4, 7)
        rng = np.random.default_rng(b)
        pats = meta["patient"].unique()
        bag = np.flatnonzero(np.isin(meta["patient"], rng.choice(pats, len(pats))))
        lab, _, _ = N.kmeans(x[bag], 4, b)
        for c in np.unique(base):
            own = base[bag] == c
            j = max(((own & (lab == k)).sum() / max(1, (own | (lab == k)).sum()) for k in np.unique(lab)), default=0.0)
            yield bool(null), int(c), float(j)

    d = _sweep(spark, sf, _grid_of(b=range(12), null=[False, True]), task, "surrogate boolean, cluster int, j double")
    return d.groupBy("surrogate", "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("j"), 6).alias("jaccard"))


@query("leave_one_patient_out")
def leave_one_patient_out(spark, sf):
    """Agreement of the rest, placement of the left-out and its chance, per patient."""
    def task(x, meta, patient):
        full, _, _ = N.kmeans(x, 4, 7)
        out = (meta["patient"] == patient).to_numpy()
        lab, c, _ = N.kmeans(x[~out], 4, 7)
        same = N.ari(full[~out], lab)
        to = N.match_labels(lab, full[~out])
        got = np.array([to.get(int(k), -1) for k in ((x[out][:, None] - c[None]) ** 2).sum(2).argmin(1)])
        acc = float((got == full[out]).mean())
        chance = float((full[out] == np.bincount(full[~out]).argmax()).mean())
        pseudo = np.random.default_rng(int(patient)).permutation(out)
        lab2, _, _ = N.kmeans(x[~pseudo], 4, 7)
        yield int(patient), float(round(same, 6)), float(round(N.ari(full[~pseudo], lab2), 6)), acc, chance, float(acc - chance), len(np.unique(lab)) < 2

    return _sweep(spark, sf, _grid_of(patient=range(10)), task, "patient int, ari double, pseudo_ari double, accuracy double, chance double, lift double, degenerate boolean")


@query("split_half")
def split_half(spark, sf):
    """Correlation of best-matched components between halves of the patients."""
    def task(x, meta, k, rep):
        pats = np.random.default_rng(rep).permutation(meta["patient"].unique())
        a = np.isin(meta["patient"], pats[: len(pats) // 2])
        _, f = N.convex_nmf(x[a], k, rep)
        _, g = N.convex_nmf(x[~a], k, rep)
        c = np.corrcoef(f, g)[:k, k:]
        m = N.assignment(-c)
        yield k, float(round(np.mean([c[i, m[i]] for i in range(k)]), 6))

    d = _sweep(spark, sf, _grid_of(k=[2, 3, 4], rep=range(4)), task, "k int, r double")
    return d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("r"))


@query("mmd_pairs")
def mmd_pairs(spark, sf):
    """Discrepancy of each pair of labels with labels shuffled within patients."""
    def task(x, meta, a, b):
        lab, pat = meta["label"].to_numpy() % 4, meta["patient"].to_numpy()
        rows = np.flatnonzero((lab == a) | (lab == b))
        if min((lab[rows] == a).sum(), (lab[rows] == b).sum()) < 2:
            return
        obs = N.mmd2(x[rows][lab[rows] == a], x[rows][lab[rows] == b])
        rng, ge, n = np.random.default_rng(a * 10 + b), 0, 19
        for _ in range(n):
            s = lab[rows].copy()
            for p in np.unique(pat[rows]):
                i = np.flatnonzero(pat[rows] == p)
                s[i] = s[rng.permutation(i)]
            if min((s == a).sum(), (s == b).sum()) >= 2:
                ge += N.mmd2(x[rows][s == a], x[rows][s == b]) >= obs
        yield a, b, float(round(obs, 8)), float((ge + 1) / (n + 1))

    g = pd.DataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], columns=["a", "b"])
    return _sweep(spark, sf, g, task, "a int, b int, mmd2 double, p double")


@query("decode_labels")
def decode_labels(spark, sf):
    """Grouped cross-validation of a classifier against permuted labels."""
    def task(x, meta, perm):
        y = (meta["label"].to_numpy() % 3).astype(int)
        if perm:
            y = np.random.default_rng(perm).permutation(y)
        g, chosen = N.grouped_cv(x * 8, y, meta["patient"].to_numpy(), 5, (0.1, 1.0))
        yield perm, float(round(N.balanced_accuracy(y, g), 6)), float(round((g == y).mean(), 6)), float(np.median(chosen)) if chosen else None

    d = _sweep(spark, sf, _grid_of(perm=range(10)), task, "perm int, balanced double, accuracy double, penalty double")
    o = d.filter("perm = 0").select(F.col("balanced").alias("o"))
    return d.join(F.broadcast(o)).agg(F.max("o").alias("observed"), F.round(F.avg(F.when(F.col("perm") > 0, F.col("balanced"))), 6).alias("chance"), ((F.count(F.when((F.col("perm") > 0) & (F.col("balanced") >= F.col("o")), 1)) + 1) / F.count(F.lit(1))).alias("p"))  # one row


@query("feature_importance")
def feature_importance(spark, sf):
    """Absolute weights of a classifier summed by band and bin."""
    x, meta = _matrix(spark, sf)
    y = (meta["label"].to_numpy() % 3).astype(int)
    w = np.abs(N.logistic(x * 8, y, 3)[:, :-1]).sum(0)
    d = spark.createDataFrame([(i // BINS, i % BINS, float(v)) for i, v in enumerate(w)], "band int, bin int, w double")
    return d.groupBy("band").agg(F.round(F.sum("w"), 6).alias("importance"), F.max_by("bin", "w").alias("best_bin"))


@query("paired_tests")
def paired_tests(spark, sf):
    """Sign and signed-rank tests of two conditions per patient."""
    m = maps(spark, sf).groupBy("patient", "electrode").pivot("condition", ["audio", "picture"]).agg(F.first("a"))
    d = m.dropna().select("patient", (A.norm(F.slice("audio", 1, 16)) - A.norm(F.slice("picture", 1, 16))).alias("d"))
    g = d.groupBy("patient").agg(F.sort_array(F.collect_list("d")).alias("d"))  # one number an electrode
    return R.per_row(g, ["patient"], ["d"], lambda v: (len(v), float(round(N.sign_test(v), 6)), float(round(N.wilcoxon(v), 6))), "n int, p_sign double, p_rank double")


@query("spin_test")
def spin_test(spark, sf):
    """Means over the sphere against rotated positions, per label."""
    def k(x, v):
        pts = np.asarray(x).reshape(-1, 3)
        pts = pts / np.maximum(np.linalg.norm(pts, axis=1, keepdims=True), 1e-9)
        return len(pts), float(N.spin_p(pts, np.asarray(v), lambda q: q[:, 2] + 0.2 * q[:, 0], 49))

    m = maps(spark, sf).groupBy("label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.slice("a", 1, 3).alias("p")))), lambda r: r["p"])).alias("x"), F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.get("a", F.lit(5)).alias("v")))), lambda r: r["v"]).alias("v"))
    return R.per_row(m, ["label"], ["x", "v"], k, "n int, p double")
