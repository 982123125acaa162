"""Map queries over ``embeddings``: 64 values as 4 bands x 16 bins.

Three consecutive vectors are the three conditions of an electrode, every tenth
electrode belongs to a patient, ``label`` is the region or cluster.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import maps as M
from ..session import table
from .registry import query

BANDS, BINS = 4, 16
CONDITIONS = ("audio", "picture", "reading")

EM = """em as (select vec_id, vec_id // 3 as electrode, ['audio', 'picture', 'reading'][cast(vec_id % 3 as int) + 1] as condition, (vec_id // 3) % 10 as patient, label, embedding from embeddings),
cl as (select vec_id, electrode, condition, patient, label, cast((i - 1) // 16 as int) as band, cast((i - 1) % 16 as int) as bin, cast(v as double) as v
       from (select *, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from em))"""
HG = EM + ", hg as (select vec_id, electrode, condition, patient, label, bin, avg(v) * 10 as y from cl where band between 1 and 2 group by all)"


def maps(spark, sf):
    """vec_id, electrode, condition, patient, label, a (array of double)."""
    e = table(spark, sf, "embeddings")
    el = F.call_function("div", F.col("vec_id"), F.lit(3).cast("long"))
    cond = F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), (F.col("vec_id") % 3).cast("int") + 1)
    return e.select("vec_id", el.alias("electrode"), cond.alias("condition"), (el % 10).alias("patient"), "label", A.doubles(F.col("embedding")).alias("a"))


def courses(spark, sf):
    """maps with ``y``, the course of the closed band range 1..2, times ten."""
    mid = F.zip_with(A.band(F.col("a"), 1, BINS), A.band(F.col("a"), 2, BINS), lambda x, y: (x + y) / 2 * 10)
    return maps(spark, sf).withColumn("y", mid)


def _long(df, array, name, *keys):
    return df.select(*keys, F.posexplode(array).alias("pos", "x")).select(*keys, "pos", F.round("x", 6).alias(name))


@query("cell_long", f"with {EM} select vec_id, band, bin, round(v, 6) as v from cl")
def cell_long(spark, sf):
    """Maps as rows of band, bin and value."""
    return A.cells(maps(spark, sf), ["vec_id"], "a", BINS).select("vec_id", "band", "bin", F.round("v", 6).alias("v"))


@query("band_means", f"with {EM}, g as (select unnest([0, 1, 2]) as g) select vec_id, g * 16 + bin as pos, round(coalesce(avg(v) filter ((g = 0 and band < 2) or (g = 1 and band = 3)), 0), 6) as x from cl cross join g group by vec_id, g, bin")
def band_means(spark, sf):
    """Means of half-open row ranges per bin; an empty range gives 0."""
    return _long(maps(spark, sf), A.band_means(F.col("a"), [(0, 2), (3, 4), (4, 4)], BINS), "x", "vec_id")


@query("hg_line", f"with {HG} select vec_id, bin as pos, round(y, 6) as y from hg")
def hg_line(spark, sf):
    """The band course, closed at both ends."""
    return _long(courses(spark, sf), F.col("y"), "y", "vec_id")


@query("unit_norm", f"with {EM}, s as (select *, v * (label % 3) as w from cl), n as (select vec_id, sqrt(sum(w * w)) as n from s group by all) select vec_id, band * 16 + bin as pos, round(case when n > 0 then w / n else w end, 6) as x from s join n using (vec_id)")
def unit_norm(spark, sf):
    """Rows of length 1; zero rows stay zero."""
    a = F.transform("a", lambda x: x * (F.col("label") % 3))
    return _long(maps(spark, sf), A.unit(a), "x", "vec_id")


@query("row_z", f"with {EM} select vec_id, band * 16 + bin as pos, round((v - avg(v) over w) / stddev_pop(v) over w, 6) as z from cl window w as (partition by vec_id)")
def row_z(spark, sf):
    return _long(maps(spark, sf), A.z(F.col("a")), "z", "vec_id")


@query("band_z_cohort", f"with {EM} select vec_id, band, bin, round((v - avg(v) over w) / stddev_pop(v) over w, 6) as z from cl window w as (partition by band)")
def band_z_cohort(spark, sf):
    """One mean and population sd a band over the whole cohort."""
    return M.band_z(maps(spark, sf), ["vec_id"], "a", BINS, ["band"]).select("vec_id", "band", "bin", F.round("z", 6).alias("z"))


@query("patient_z", f"with {EM} select vec_id, band, bin, round((v - avg(v) over w) / stddev_pop(v) over w, 6) as z from cl window w as (partition by patient, band, bin)")
def patient_z(spark, sf):
    """Each feature within its patient, population sd."""
    return M.band_z(maps(spark, sf), ["vec_id", "patient"], "a", BINS, ["patient", "band", "bin"]).select("vec_id", "band", "bin", F.round("z", 6).alias("z"))


@query("band_shape_floor", f"with {EM}, r as (select vec_id, band, sqrt(avg(v * v)) as rms from cl group by all), m as (select band, median(rms) as f from r group by all) select vec_id, band, bin, round(v / sqrt(rms * rms + f * f), 6) as shape from cl join r using (vec_id, band) join m using (band)")
def band_shape_floor(spark, sf):
    return M.shape_floor(maps(spark, sf), ["vec_id"], "a", BANDS, BINS).select("vec_id", "band", "bin", F.round("shape", 6).alias("shape"))


@query(
    "ternary_map",
    f"""with {EM}, s as (select vec_id, band, bin, case when v >= 0.1 then 1 when v <= -0.1 then -1 else 0 end as s from cl)
    select a.vec_id, a.band, a.bin, cast(case when a.s <> 0 and count(b.s) >= 2 then a.s else 0 end as int) as s from s a left join s b
    on a.vec_id = b.vec_id and abs(a.band - b.band) <= 1 and abs(a.bin - b.bin) <= 1 and (a.band <> b.band or a.bin <> b.bin) and a.s = b.s group by a.vec_id, a.band, a.bin, a.s""",
)
def ternary_map(spark, sf):
    """Signs above threshold that two of eight neighbours share."""
    t = maps(spark, sf).withColumn("t", M.ternary(F.col("a"), BANDS, BINS, 0.1, 2))
    return A.cells(t, ["vec_id"], "t", BINS).select("vec_id", "band", "bin", F.col("v").cast("int").alias("s"))


_NOISE = ", nz as (select electrode, stddev_pop(x.v - y.v) / 2 as noise from cl x join cl y using (electrode, band, bin) where x.condition = 'audio' and y.condition = 'picture' group by all)"


@query(
    "activity_gate",
    f"with {EM}{_NOISE} select vec_id, coalesce(avg(case when v > greatest(0.15, 1.5 * coalesce(noise, 0)) then 1.0 else 0.0 end) >= 0.1 or avg(case when v < least(-0.2, -1.5 * coalesce(noise, 0)) then 1.0 else 0.0 end) >= 0.06, false) as high from cl left join nz using (electrode) group by vec_id, noise",
)
def activity_gate(spark, sf):
    """Maps with enough cells beyond thresholds that respect the noise between halves."""
    m = maps(spark, sf)
    h = m.groupBy("electrode").agg(F.max(F.when(F.col("condition") == "audio", F.col("a"))).alias("h1"), F.max(F.when(F.col("condition") == "picture", F.col("a"))).alias("h2"))
    h = h.select("electrode", (A.sd(F.zip_with("h1", "h2", lambda x, y: x - y)) / 2).alias("noise"))
    return m.join(h, "electrode", "left").select("vec_id", M.activity_gate(F.col("a"), F.col("noise"), 0.15, -0.2, 1.5, 0.1, 0.06).alias("high"))


@query("window_gate", f"with {EM} select vec_id, avg(case when v > 0.15 then 1.0 else 0.0 end) >= 0.12 or avg(case when v < -0.2 then 1.0 else 0.0 end) >= 0.08 as high from cl where bin >= 4 and bin < 12 group by vec_id")
def window_gate(spark, sf):
    """The gate on a window of time alone."""
    w = M.columns_of(F.col("a"), BANDS, BINS, 4, 12)
    return maps(spark, sf).select("vec_id", M.activity_gate(w, F.lit(0.0), 0.15, -0.2, 0.0, 0.12, 0.08).alias("high"))


#: role, layer, all or any, boxes
ROLES = (
    ("early", 2, "all", (M.Box(0, 4, 0, 8, "pos", 0.15),)),
    ("late", 2, "all", (M.Box(0, 4, 8, 16, "pos", 0.15),)),
    ("suppressed", 1, "any", (M.Box(0, 2, 0, 16, "neg", 0.18), M.Box(2, 4, 0, 16, "neg", 0.18))),
    ("late_only", 1, "all", (M.Box(0, 4, 8, 16, "both", 0.25), M.Box(0, 4, 0, 8, "nonpos", 0.12))),
    ("silent", 3, "all", (M.Box(1, 3, 0, 16, "zero", 0.2),)),
)
_THR = 0.15


def _box_sql():
    rows = ", ".join(f"({no}, {i}, {b.b0}, {b.b1}, {b.t0}, {b.t1}, '{b.sign}', {b.least})" for no, r in enumerate(ROLES) for i, b in enumerate(r[3]))
    roles = ", ".join(f"({no}, '{r[0]}', {r[1]}, '{r[2]}', {len(r[3])})" for no, r in enumerate(ROLES))
    return f"""{EM}, bx(no, i, b0, b1, t0, t1, sign, least) as (values {rows}), ro(no, role, layer, how, n) as (values {roles}),
    ex as (select vec_id, no, i, case any_value(sign) when 'pos' then avg((v > {_THR})::int) >= any_value(least) when 'neg' then avg((v < -{_THR})::int) >= any_value(least)
       when 'both' then avg((abs(v) > {_THR})::int) >= any_value(least) when 'zero' then avg((abs(v) > {_THR})::int) < any_value(least) else avg((v > {_THR})::int) < any_value(least) end as ok
       from cl join bx on band >= b0 and band < b1 and bin >= t0 and bin < t1 group by all),
    rm as (select vec_id, no, case when any_value(how) = 'all' then bool_and(ok) else bool_or(ok) end as ok from ex join ro using (no) group by all),
    rr as (select vec_id, role, row_number() over (partition by vec_id order by layer, -n, no) as rn from rm join ro using (no) where ok)"""


def _roled(spark, sf):
    return maps(spark, sf).withColumn("roles", M.roles(F.col("a"), ROLES, BINS, _THR))


@query("roi_gate", f"with {_box_sql()} select vec_id, no, i, ok from ex")
def roi_gate(spark, sf):
    """Whether each box shows its sign in each map."""
    each = F.array(*[F.struct(F.lit(no).alias("no"), F.lit(i).alias("i"), M.box_expresses(F.col("a"), b, BINS, _THR).alias("ok")) for no, r in enumerate(ROLES) for i, b in enumerate(r[3])])
    return maps(spark, sf).select("vec_id", F.explode(each).alias("x")).select("vec_id", "x.*")


@query("role_table", f"with {_box_sql()} select vec_id, max(case when rn = 1 then role end) as role, string_agg(role, ';' order by rn) as roles_matched, count(*) as n_roles from rr group by all")
def role_table(spark, sf):
    """The most specific role of each map, and all roles that match."""
    r = _roled(spark, sf).filter(F.size("roles") > 0)
    return r.select("vec_id", F.get("roles", F.lit(0))["role"].alias("role"), F.array_join(F.transform("roles", lambda x: x["role"]), ";").alias("roles_matched"), F.size("roles").cast("long").alias("n_roles"))


@query("role_counts", f"with {_box_sql()} select role, count(*) as n_matched, count(*) filter (rn = 1) as n_primary from rr group by all")
def role_counts(spark, sf):
    r = _roled(spark, sf).select(F.posexplode("roles").alias("i", "x"))
    return r.groupBy(F.col("x.role").alias("role")).agg(F.count(F.lit(1)).alias("n_matched"), F.count(F.when(F.col("i") == 0, 1)).alias("n_primary"))


@query("role_cooccurrence", f"with {_box_sql()} select a.role as role_a, b.role as role_b, count(*) as n from rr a join rr b using (vec_id) group by all")
def role_cooccurrence(spark, sf):
    """Maps that have both roles; pairs within one map's few roles."""
    r = _roled(spark, sf).select("roles", F.explode("roles").alias("a")).select("a", F.explode("roles").alias("b"))
    return r.groupBy(F.col("a.role").alias("role_a"), F.col("b.role").alias("role_b")).agg(F.count(F.lit(1)).alias("n"))


@query("role_onset", f"""with {_box_sql()}, hg as (select vec_id, bin, avg(v) * 10 as y from cl where band between 1 and 2 group by all), m as (select role, bin, avg(y) as y from rr join hg using (vec_id) group by all)
    select role, cast(min(bin) filter (abs(y) > 0.5) as int) as onset_bin from m group by all""")
def role_onset(spark, sf):
    """First bin at which a role's mean course exceeds 0.5; null if none does."""
    r = courses(spark, sf).withColumn("roles", M.roles(F.col("a"), ROLES, BINS, _THR))
    r = r.select(F.explode("roles").alias("r"), F.col("y")).select(F.col("r.role").alias("role"), F.posexplode("y").alias("bin", "y"))
    m = r.groupBy("role", "bin").agg(F.avg("y").alias("y"))
    return m.groupBy("role").agg(F.min(F.when(F.abs("y") > 0.5, F.col("bin"))).alias("onset_bin"))


ZONES = {"stim": M.gaussian(BINS, 4, 2), "resp": M.gaussian(BINS, 11, 2.5), "box": [1 / 6 if 5 <= i < 11 else 0.0 for i in range(BINS)]}


def _zones_sql():
    return ", zw(zone, bin, w) as (values " + ", ".join(f"('{z}', {i}, {w!r}::double)" for z, ws in ZONES.items() for i, w in enumerate(ws)) + ")"


@query("pool_table", f"with {EM}{_zones_sql()} select vec_id, condition, zone, cast(band as int) as band_idx, round(sum(v * w), 6) as pooled, sum(v * w) > 0.05 as qual_pos, sum(v * w) < -0.05 as qual_neg from cl join zw using (bin) group by all")
def pool_table(spark, sf):
    """Weighted mean of each band in each zone, with the qualifying sign."""
    each = F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(b).alias("band_idx"), M.pooled(A.band(F.col("a"), b, BINS), w).alias("p")) for z, w in ZONES.items() for b in range(BANDS)])
    p = maps(spark, sf).select("vec_id", "condition", F.explode(each).alias("x"))
    return p.select("vec_id", "condition", "x.zone", "x.band_idx", F.round("x.p", 6).alias("pooled"), (F.col("x.p") > 0.05).alias("qual_pos"), (F.col("x.p") < -0.05).alias("qual_neg"))


@query("pool_qualifiers", f"with {EM}{_zones_sql()}, p as (select vec_id, condition, zone, band, sum(v * w) as p from cl join zw using (bin) group by all) select condition, zone, count(distinct vec_id) filter (p > 0.05) as n_pos, count(distinct vec_id) filter (p < -0.05) as n_neg, count(distinct vec_id) as n from p group by all")
def pool_qualifiers(spark, sf):
    """Contacts that qualify per condition and zone, by sign."""
    each = F.array(*[F.struct(F.lit(z).alias("zone"), F.exists(F.array(*[M.pooled(A.band(F.col("a"), b, BINS), w) for b in range(BANDS)]), lambda x: x > 0.05).alias("pos"), F.exists(F.array(*[M.pooled(A.band(F.col("a"), b, BINS), w) for b in range(BANDS)]), lambda x: x < -0.05).alias("neg")) for z, w in ZONES.items()])
    p = maps(spark, sf).select("condition", F.explode(each).alias("x"))
    return p.groupBy("condition", "x.zone").agg(F.count(F.when(F.col("x.pos"), 1)).alias("n_pos"), F.count(F.when(F.col("x.neg"), 1)).alias("n_neg"), F.count(F.lit(1)).alias("n"))


@query("shift_null", f"""with {HG}{_zones_sql()}, k as (select unnest(range(0, 16)) as k), p as (select vec_id, k, abs(sum(y * w)) as p from hg cross join k join zw on zone = 'stim' and zw.bin = (hg.bin + k) % 16 group by all)
    select a.vec_id, (count(*) filter (b.p >= a.p - 1e-12) + 1) / 16.0 as p from p a join p b using (vec_id) where a.k = 0 and b.k > 0 group by a.vec_id""")
def shift_null(spark, sf):
    """Share of circular shifts whose pooled power reaches the observed one."""
    return courses(spark, sf).select("vec_id", M.shift_null_p(F.col("y"), ZONES["stim"]).alias("p"))


_RUNS = """, fl as (select *, case when y >= 0.8 then 1 else 0 end as f, bin - row_number() over (partition by vec_id, y >= 0.8 order by bin) as grp from hg),
isl as (select vec_id, min(bin) as a, max(bin) as b from fl where f = 1 group by vec_id, grp having count(*) >= 2), on_ as (select vec_id, min(a) as on_bin, max(b) as off_bin from isl group by all)"""
_TF = HG + _RUNS + """, tf as (select hg.vec_id, patient, condition, label, -0.5e0 + 0.1e0 * arg_max(bin, (y, -bin)) as peak_lat, max(y) as peak, -0.5e0 + 0.1e0 * any_value(on_bin) as onset_lat, -0.5e0 + 0.1e0 * any_value(off_bin) as offset_lat,
 (any_value(off_bin) - any_value(on_bin) + 1) * 0.1e0 as dur, sum(greatest(y, 0) * (-0.5 + 0.1 * bin)) / nullif(sum(greatest(y, 0)), 0) as com, sum(greatest(y, 0)) * 0.1 as auc,
 -0.5e0 + 0.1e0 * arg_min(bin, (y, bin)) as trough_lat, min(y) as trough, avg((y >= 0.8)::int) as frac_above from hg left join on_ using (vec_id) group by all)"""
_TF_COLS = ("peak_lat", "peak", "onset_lat", "offset_lat", "dur", "com", "auc", "trough_lat", "trough", "frac_above")


def _timed(spark, sf):
    t = courses(spark, sf).withColumn("t", M.timing(F.col("y"), 0.8, 2, -0.5, 0.1))
    return t.select("vec_id", "electrode", "patient", "condition", "label", *[F.col(f"t.{c}").alias(c) for c in _TF_COLS])


@query("timing_features", f"with {_TF} select vec_id, {', '.join(f'round({c}, 6) as {c}' for c in _TF_COLS)} from tf")
def timing_features(spark, sf):
    """Peak, sustained onset and end, duration, centre of mass, area and trough."""
    return _timed(spark, sf).select("vec_id", *[F.round(c, 6).alias(c) for c in _TF_COLS])


@query(
    "flagship_timing",
    f"""with {_TF}, g as (select condition, label, count(*) as n_responding, median(onset_lat) as group_onset, median(peak_lat) as group_peak from tf where onset_lat is not null group by all)
    select vec_id, patient, condition, label, round(peak, 6) as peak, round(peak_lat, 6) as peak_lat, round(onset_lat, 6) as onset_lat, n_responding, round(group_onset, 6) as group_onset, round(group_peak, 6) as group_peak,
    round(onset_lat - group_onset, 6) as onset_vs_group from tf left join g using (condition, label) where onset_lat is not null""",
)
def flagship_timing(spark, sf):
    """Responding electrodes with peak and onset, against their group's medians."""
    from ..operators.quantiles import group_quantiles

    t = _timed(spark, sf).filter("onset_lat is not null")
    on = group_quantiles(t, ["condition", "label"], F.col("onset_lat"), {"group_onset": 0.5}).withColumnRenamed("n", "n_responding")
    pk = group_quantiles(t, ["condition", "label"], F.col("peak_lat"), {"group_peak": 0.5}).drop("n")
    d = t.join(on, ["condition", "label"], "left").join(pk, ["condition", "label"], "left")
    r = lambda c: F.round(c, 6).alias(c)
    return d.select("vec_id", "patient", "condition", "label", r("peak"), r("peak_lat"), r("onset_lat"), "n_responding", r("group_onset"), r("group_peak"), F.round(F.col("onset_lat") - F.col("group_onset"), 6).alias("onset_vs_group"))


_CT = HG + """, mc as (select label, condition, bin, avg(y) as y from hg group by all),
lg as (select *, coalesce(lag(y) over (partition by label, condition order by bin) >= 0.15, false) as before from mc),
ct as (select label, condition, min(bin) filter (y >= 0.15) as first_any, min(bin) filter (y >= 0.15 and bin < 8) as first_stim, min(bin) filter (y >= 0.15 and bin >= 8) as first_resp,
 coalesce(bool_or(y >= 0.15) filter (bin = 7), false) as carried from mc group by all)"""


def _crossings(spark, sf):
    m = courses(spark, sf).select("label", "condition", F.posexplode("y").alias("bin", "y")).groupBy("label", "condition", "bin").agg(F.avg("y").alias("y"))
    up = F.col("y") >= 0.15
    first = lambda c: F.min(F.when(c, F.col("bin")))
    return m, m.groupBy("label", "condition").agg(first(up).alias("first_any"), first(up & (F.col("bin") < 8)).alias("first_stim"), first(up & (F.col("bin") >= 8)).alias("first_resp"), F.coalesce(F.bool_or(F.when(F.col("bin") == 7, up)), F.lit(False)).alias("carried"))


@query("cluster_timing", f"with {_CT} select label, condition, first_any, first_stim, first_resp, carried from ct")
def cluster_timing(spark, sf):
    """First crossing of each cluster's mean course: overall, per half, null if never."""
    return _crossings(spark, sf)[1]


@query("onset_rank", f"with {_CT}, o as (select label, avg(first_any) as m from ct group by all) select label, round(m, 6) as mean_onset, rank() over (order by m nulls last, label) as no from o")
def onset_rank(spark, sf):
    """Clusters in order of their mean onset over conditions."""
    o = _crossings(spark, sf)[1].groupBy("label").agg(F.avg("first_any").alias("m"))
    return o.select("label", F.round("m", 6).alias("mean_onset"), F.rank().over(W.orderBy(F.col("m").asc_nulls_last(), "label")).cast("long").alias("no"))


@query("onset_matrix", f"with {_CT} select label, max(case when condition = 'audio' then first_any end) as audio, max(case when condition = 'picture' then first_any end) as picture, max(case when condition = 'reading' then first_any end) as reading from ct group by all")
def onset_matrix(spark, sf):
    return _crossings(spark, sf)[1].groupBy("label").pivot("condition", list(CONDITIONS)).agg(F.max("first_any"))


@query("region_cascade", f"""with {HG}, mc as (select label, bin, avg(y) as y, count(distinct vec_id) as n from hg group by all having count(distinct vec_id) >= 30),
  p as (select label, n, max(y) as peak, arg_max(bin, (y, -bin)) as peak_bin from mc group by all) select label, n, round(peak, 6) as peak, peak_bin, row_number() over (order by peak_bin, label) as no from p""")
def region_cascade(spark, sf):
    """Regions with enough contacts, ordered by the peak of their mean course."""
    m = courses(spark, sf).select("label", F.posexplode("y").alias("bin", "y")).groupBy("label", "bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).filter("n >= 30")
    p = m.groupBy("label", "n").agg(F.max("y").alias("peak"), F.max_by("bin", F.struct("y", -F.col("bin"))).alias("peak_bin"))
    return p.select("label", "n", F.round("peak", 6).alias("peak"), "peak_bin", F.row_number().over(W.orderBy("peak_bin", "label")).cast("long").alias("no"))


_LD = EM + ", ld as (select vec_id, patient, band, greatest(sum(v), 0) as w from cl group by all)"


@query("argmax_margin", f"""with {_LD}, s as (select vec_id, sum(w) as t, max(w) as top, arg_max(band, (w, -band)) as lead, list_sort(list(w), 'DESC')[2] as second from ld group by all)
  select vec_id, case when t > 0 then lead end as lead, round(case when t > 0 then top end, 6) as top, round(case when t > 0 then top - second end, 6) as margin, case when t > 0 then top / t >= 0.5 end as confident from s""")
def argmax_margin(spark, sf):
    """Lead component with weight, margin and confidence."""
    w = F.array(*[A.total(A.band(F.col("a"), b, BINS)) for b in range(BANDS)])
    d = maps(spark, sf).withColumn("x", M.lead_component(w, 0.5))
    return d.select("vec_id", "x.lead", F.round("x.top", 6).alias("top"), F.round("x.margin", 6).alias("margin"), "x.confident")


@query("mixture_summary", f"""with {_LD}, s as (select vec_id, patient, max(w) / nullif(sum(w), 0) as sh from ld group by all)
  select patient, count(*) as n, round(avg(case when sh >= 0.8 then 1.0 else 0.0 end), 6) as dominant, round(avg(case when sh >= 0.5 and sh < 0.8 then 1.0 else 0.0 end), 6) as contested, round(avg(case when sh < 0.5 then 1.0 else 0.0 end), 6) as no_majority from s group by all""")
def mixture_summary(spark, sf):
    """Shares of maps with a dominant, a contested and no majority component."""
    w = F.array(*[A.total(A.band(F.col("a"), b, BINS)) for b in range(BANDS)])
    s = F.col("x.share")
    d = maps(spark, sf).withColumn("x", M.lead_component(w, 0.5))
    part = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return d.groupBy("patient").agg(F.count(F.lit(1)).alias("n"), part(s >= 0.8).alias("dominant"), part((s >= 0.5) & (s < 0.8)).alias("contested"), part(s < 0.5).alias("no_majority"))


@query("muscle_signature", f"""with {EM}, m as (select electrode, condition, avg(v) filter (band = 2) as hg, avg(v) filter (band = 3) as hi from cl group by all)
  select electrode, bool_or(hg >= 0.02 and hi >= 0.015 and hi >= 0.4 * hg) as muscle from m group by all""")
def muscle_signature(spark, sf):
    """Electrodes with a broad high-frequency response in any condition."""
    hg, hi = A.mean(A.band(F.col("a"), 2, BINS)), A.mean(A.band(F.col("a"), 3, BINS))
    return maps(spark, sf).groupBy("electrode").agg(F.bool_or((hg >= 0.02) & (hi >= 0.015) & (hi >= 0.4 * hg)).alias("muscle"))


@query("multi_label_tags", f"""with {EM}, m as (select vec_id, band, avg(v) as x from cl group by all) select vec_id, max_by(band, (x, -band)) as main, string_agg(band::varchar, ';' order by x desc, band) as tags from m where x > 0.01 group by all""")
def multi_label_tags(spark, sf):
    """All bands above threshold as tags, the strongest as the main one."""
    m = F.array(*[F.struct((-A.mean(A.band(F.col("a"), b, BINS))).alias("x"), F.lit(b).alias("b")) for b in range(BANDS)])
    s = F.array_sort(F.filter(m, lambda x: -x["x"] > 0.01))
    d = maps(spark, sf).withColumn("s", s).filter(F.size("s") > 0)
    return d.select("vec_id", F.get("s", F.lit(0))["b"].alias("main"), F.array_join(F.transform("s", lambda x: x["b"].cast("string")), ";").alias("tags"))


@query("time_resize", f"with {EM} select vec_id, cast(band * 4 + bin // 4 as int) as pos, round(avg(v), 6) as x from cl group by all")
def time_resize(spark, sf):
    """Blocks of four bins averaged."""
    return _long(maps(spark, sf), A.block_means(F.col("a"), 4), "x", "vec_id")


@query("log_power", f"with {EM} select vec_id, band, bin, round(10 * log10(greatest(v * v * (label % 2), 1e-20)), 6) as db from cl")
def log_power(spark, sf):
    """Decibels of power, floored."""
    d = maps(spark, sf).withColumn("a", F.transform("a", lambda x: 10 * F.log10(F.greatest(x * x * (F.col("label") % 2), F.lit(1e-20)))))
    return A.cells(d, ["vec_id"], "a", BINS).select("vec_id", "band", "bin", F.round("v", 6).alias("db"))


@query("clip_quantise", f"with {EM} select vec_id, band, bin, cast(round_even(least(greatest(v * 1000, -127), 127), 0) as int) as q from cl")
def clip_quantise(spark, sf):
    """Rounded half to even within a signed byte."""
    d = maps(spark, sf).withColumn("a", F.transform("a", lambda x: F.bround(F.least(F.greatest(x * 1000, F.lit(-127.0)), F.lit(127.0)))))
    return A.cells(d, ["vec_id"], "a", BINS).select("vec_id", "band", "bin", F.col("v").cast("int").alias("q"))


@query("smoothed_course", f"with {HG} select vec_id, bin as pos, round(avg(y) over (partition by vec_id order by bin rows between 2 preceding and 2 following), 6) as y from hg")
def smoothed_course(spark, sf):
    """Box smoothing, shorter windows at the ends."""
    return _long(courses(spark, sf), A.smooth(F.col("y"), 2), "y", "vec_id")


@query(
    "array_functions",
    f"""with {HG}, l as (select vec_id, list(y order by bin) as y from hg group by all)
    select vec_id, round(list_sum(list_transform(range(1, 16), lambda i: (y[i] + y[i + 1]) / 2 * 0.1)), 6) as area, round(list_max(list_transform(range(1, 16), lambda i: y[i + 1] - y[i])), 6) as steepest,
    round(y[4], 6) as rolled_first, round(y[3] + (y[4] - y[3]) * 0.25, 6) as at_2_25, list_transform(range(0, 4), lambda k: cast(len(list_filter(y, lambda x: x >= -2 + k and (x < -1 + k or (k = 3 and x <= 2)))) as int))::varchar as hist from l""",
)
def array_functions(spark, sf):
    """Trapezoid, differences, rotation, interpolation and histogram of courses."""
    y = F.col("y")
    h = A.histogram(y, -2.0, 2.0, 4)
    return courses(spark, sf).select(
        "vec_id",
        F.round(A.trapezoid(y, 0.1), 6).alias("area"),
        F.round(F.array_max(A.diff(y)), 6).alias("steepest"),
        F.round(F.get(A.roll(y, -3), F.lit(0)), 6).alias("rolled_first"),
        F.round(F.get(A.interp(y, F.array(F.lit(2.25))), F.lit(0)), 6).alias("at_2_25"),
        F.concat(F.lit("["), F.array_join(F.transform(h, lambda x: x.cast("string")), ", "), F.lit("]")).alias("hist"),
    )


@query("axes", "select i as pos, round(-0.5 + i * 2.5 / 16, 6) as t, round(i * 398.4375 / 3, 6) as hz, cast(case when i < 4 then i + 1 end as int) as row_1based from (select cast(unnest(range(0, 16)) as int) as i)")
def axes(spark, sf):
    """Time axis without its end, frequency axis and rows of the map."""
    d = spark.range(1).select(A.axis(BINS, -0.5, 2.0).alias("t"))
    d = d.select(F.posexplode("t").alias("pos", "t"))
    return d.select("pos", F.round("t", 6).alias("t"), F.round(F.col("pos") * 398.4375 / 3, 6).alias("hz"), F.when(F.col("pos") < BANDS, F.col("pos") + 1).alias("row_1based"))


@query("band_index", f"with {EM}, e(k, lo, hi) as (values (0, 0.0, 1.5), (1, 1.5, 2.5), (2, 2.5, 4.0)) select k as band_k, count(*) as n, round(avg(v), 6) as m from cl join e on band >= lo and band < hi group by all")
def band_index(spark, sf):
    """Rows of the map in half-open ranges of frequency."""
    k = F.when(F.col("band") < 1.5, 0).when(F.col("band") < 2.5, 1).when(F.col("band") < 4.0, 2)
    return A.cells(maps(spark, sf), ["vec_id"], "a", BINS).groupBy(k.alias("band_k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("m"))
