"""Trial queries over ``events`` (trials), ``lineitem`` (scores) and ``trial_raw``.

In ``events`` the user is the patient, the type the condition, ``value`` the
stimulus and ``k`` of ``props`` the response.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import trials as T
from ..operators.quantiles import group_quantiles
from ..session import table
from .registry import query


def events(spark, sf):
    """event_id, patient, condition, t0, stim, post, t1, accuracy."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("patient"), F.col("event_type").alias("condition"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("value") / 10).alias("stim"), (k / 20).alias("post"), F.when(k % 7 == 0, "wrong").when(k % 11 == 0, F.lit(None)).otherwise("correct").alias("accuracy"))
    t0 = F.round(F.col("us") / 1e6, 3)
    return e.withColumn("t0", t0).withColumn("t1", F.round(t0 + F.col("stim") + F.col("post"), 3))


EV = """
ev0 as (select event_id, user_id as patient, event_type as condition, epoch_us(ts) as us, value / 10 as stim, cast(json_extract(props, '$.k') as int) as k from events),
ev as (select *, k / 20 as post, case when k % 7 = 0 then 'wrong' when k % 11 = 0 then null else 'correct' end as accuracy, round(us / 1e6, 3) as t0,
       round(round(us / 1e6, 3) + stim + k / 20, 3) as t1 from ev0)"""

#: A bad span of a patient: the minute after each of its errors over 60.
_SPANS = ", sp as (select patient, t0 as a, t0 + 60 as b from ev where condition = 'error' and stim > 6)"


def _spans(ev):
    return ev.filter("condition = 'error' and stim > 6").select("patient", F.col("t0").alias("a"), (F.col("t0") + 60).alias("b"))


def _judged(spark, sf):
    ev = events(spark, sf)
    hit = T.overlapping_span(ev.withColumn("from", F.col("t0") - 1.0), _spans(ev), ["patient"], "from", "t1", "a", "b", "event_id", 600.0)
    ev = ev.join(hit.withColumnRenamed("trial_id", "event_id"), "event_id", "left")
    return ev.withColumn("reason", T.validity("t0", "t1", "stim", "post", "accuracy", F.col("span_start").isNotNull(), ["correct", "valid", "1"], 0.2, 0.25, 4.5))


_JUDGED = (
    EV
    + _SPANS
    + """, hit as (select event_id, min(a) as span_start from ev join sp using (patient) where t0 - 1.0 < b and t1 > a group by all),
jd as (select ev.*, span_start, case when span_start is not null then 'bad_span' when coalesce(accuracy, '') not in ('correct', 'valid', '1') then 'accuracy'
  when stim < 0.2 then 'stim_short' when post < 0.25 then 'post_short' when post > 4.5 then 'post_long' end as reason from ev left join hit using (event_id))"""
)


@query("trial_reasons", f"with {_JUDGED} select event_id, reason from jd")
def trial_reasons(spark, sf):
    """First failing reason of every trial, null for the kept."""
    return _judged(spark, sf).select("event_id", "reason")


@query("trial_bad_spans", f"with {_JUDGED} select event_id, round(span_start, 3) as span_start from hit")
def trial_bad_spans(spark, sf):
    """Trials that overlap a bad span, with the first such span."""
    ev = events(spark, sf)
    hit = T.overlapping_span(ev.withColumn("from", F.col("t0") - 1.0), _spans(ev), ["patient"], "from", "t1", "a", "b", "event_id", 600.0)
    return hit.select(F.col("trial_id").alias("event_id"), F.round("span_start", 3).alias("span_start"))


@query(
    "trial_annotation_errors",
    """select distinct seg_id, case when end_ts <= start_ts then 'offset_not_after_onset' else 'end_before_offset' end as error from recording_segments where end_ts <= start_ts or acq_closed < end_ts""",
)
def trial_annotation_errors(spark, sf):
    """Recordings whose marks are out of order."""
    return T.annotation_errors(table(spark, sf, "recording_segments"), "start_ts", "end_ts", "acq_closed").select("seg_id", "error").distinct()


def _fenced(spark, sf, how, low, high):
    ok = _judged(spark, sf).filter("reason is null")
    f = T.fences(ok, ["condition"], "stim", how, low, high)
    out = ok.join(f, "condition")
    out = out.groupBy("condition").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), F.sum(((F.col("stim") < F.col("lo")) | (F.col("stim") > F.col("hi"))).cast("long")).alias("n_out"))
    return out.select("condition", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", "n_out")


def _fence_sql(lo, hi):
    return f"""with {_JUDGED}, ok as (select * from jd where reason is null), f as (select condition, count(stim) as n, {lo} as lo, {hi} as hi from ok group by all)
    select condition, round(lo, 6) as lo, round(hi, 6) as hi, n, cast(sum(case when stim < lo or stim > hi then 1 else 0 end) as bigint) as n_out from ok join f using (condition) group by all"""


_Q1, _Q3 = "quantile_cont(stim, 0.25)", "quantile_cont(stim, 0.75)"


@query("trial_iqr_fences", _fence_sql(f"{_Q1} - 1.0 * ({_Q3} - {_Q1})", f"{_Q3} + 1.5 * ({_Q3} - {_Q1})"))
def trial_iqr_fences(spark, sf):
    """Quartile fences of the survivors (own factor below) and what lies outside."""
    return _fenced(spark, sf, "iqr", 1.0, 1.5)


@query("trial_z_fences", _fence_sql("avg(stim) - 2 * stddev_pop(stim)", "avg(stim) + 2 * stddev_pop(stim)"))
def trial_z_fences(spark, sf):
    return _fenced(spark, sf, "z", 2.0, 2.0)


@query("trial_pct_fences", _fence_sql("quantile_cont(stim, 0.02)", "quantile_cont(stim, 0.98)"))
def trial_pct_fences(spark, sf):
    return _fenced(spark, sf, "pct", 0.02, 0.98)


@query(
    "trial_stats",
    f"""with {_JUDGED} select patient, condition, count(*) as n_in, count(*) filter (reason is null) as n_kept, round(min(stim) filter (reason is null), 6) as stim_min,
    round(quantile_cont(stim, 0.5) filter (reason is null), 6) as stim_median, round(max(stim) filter (reason is null), 6) as stim_max,
    {", ".join(f"count(*) filter (reason = '{r}') as n_{r}" for r in ("bad_span", "accuracy", "stim_short", "post_short", "post_long"))} from jd group by all""",
)
def trial_stats(spark, sf):
    """One row per patient and condition: trials in, kept, durations, dropped by reason."""
    j = _judged(spark, sf)
    ok = F.col("reason").isNull()
    a = j.groupBy("patient", "condition").agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count(F.when(ok, 1)).alias("n_kept"),
        F.round(F.min(F.when(ok, F.col("stim"))), 6).alias("stim_min"),
        F.round(F.max(F.when(ok, F.col("stim"))), 6).alias("stim_max"),
        *[F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}") for r in ("bad_span", "accuracy", "stim_short", "post_short", "post_long")],
    )
    m = group_quantiles(j.filter(ok), ["patient", "condition"], F.col("stim"), {"m": 0.5})
    return a.join(m.select("patient", "condition", F.round("m", 6).alias("stim_median")), ["patient", "condition"], "left")


@query("trial_order", f"with {EV} select event_id, row_number() over (partition by patient order by case when k % 5 = 0 then null else k end nulls last, us, event_id) as no from ev")
def trial_order(spark, sf):
    """Trials in order of their trial number (missing last), then of time."""
    k = F.col("post") * 20
    n = F.when(F.round(k).cast("int") % 5 != 0, F.round(k).cast("int"))
    w = W.partitionBy("patient").orderBy(n.asc_nulls_last(), "us", "event_id")
    return events(spark, sf).select("event_id", F.row_number().over(w).cast("long").alias("no"))


@query("trial_iti", f"with {EV} select event_id, round(lead(t0) over (partition by patient, condition order by t0, event_id) - t1, 3) as iti from ev")
def trial_iti(spark, sf):
    """Interval to the next trial of the condition."""
    return T.next_gap(events(spark, sf), ["patient", "condition"], "t0", "t1", ["event_id"]).select("event_id", F.round("iti", 3).alias("iti"))


@query(
    "mad_reject_capped",
    f"""with {EV}, m as (select patient, condition, median(stim) as med, count(*) as n, avg(stim) as mu, stddev_samp(stim) as sd from ev group by all),
    d as (select ev.*, med, n, mu, sd, median(abs(stim - med)) over (partition by patient, condition) as mad from ev join m using (patient, condition)),
    h as (select *, coalesce(n >= 4 and ((mad > 1e-6 and stim > med + 2.5 * 1.4826 * mad) or (sd > 1e-9 and (stim - mu) / sd > 2.5)), false) as hit from d),
    r as (select *, row_number() over (partition by patient, condition order by hit desc, stim desc, event_id) as rn from h)
    select event_id, hit, hit and rn <= floor(0.34 * n) as rejected from r""",
)
def mad_reject_capped(spark, sf):
    """Trials out by the robust or the z arm, at most about a third of a group."""
    d = T.robust_reject(events(spark, sf), ["patient", "condition"], "stim", ["event_id"], 2.5, 2.5)
    return d.select("event_id", "hit", "rejected")


@query("channel_z", "with z as (select l_orderkey, l_linenumber, l_quantity, avg(l_quantity) over w as m, stddev_samp(l_quantity) over w as sd from lineitem window w as (partition by l_suppkey, l_returnflag)) select l_orderkey, l_linenumber, round(case when coalesce(sd, 0) <= 1e-9 then 0 else (l_quantity - m) / sd end, 6) as z from z")
def channel_z(spark, sf):
    """z of each score within its channel and condition (sample sd, flat: 0)."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    return T.group_z(l, ["l_suppkey", "l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


_SWEEP_Z, _SWEEP_F = (1.0, 1.5, 2.0), (0.2, 0.4, 0.6)


@query(
    "trial_drop_sweep",
    f"""with z as (select l_orderkey, l_returnflag, abs(case when coalesce(stddev_samp(l_quantity) over w, 0) <= 1e-9 then 0 else (l_quantity - avg(l_quantity) over w) / stddev_samp(l_quantity) over w end) as az
      from lineitem window w as (partition by l_suppkey, l_returnflag)),
    g as (select unnest([{", ".join(map(str, _SWEEP_Z))}]) as z_thr), t as (select l_orderkey, l_returnflag, z_thr, avg(case when az > z_thr then 1.0 else 0.0 end) as share from z cross join g group by all),
    f as (select unnest([{", ".join(map(str, _SWEEP_F))}]) as frac)
    select l_returnflag, cast(z_thr as double) as z_thr, cast(frac as double) as frac, count(*) as n_trials, count(*) filter (share > frac) as n_dropped from t cross join f group by all""",
)
def trial_drop_sweep(spark, sf):
    """Trials dropped for each z threshold and share of channels above it."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    z = T.group_z(l, ["l_suppkey", "l_returnflag"], "l_quantity").withColumn("az", F.abs("z"))
    t = z.groupBy("l_orderkey", "l_returnflag").agg(*[F.avg((F.col("az") > x).cast("double")).alias(f"s{i}") for i, x in enumerate(_SWEEP_Z)])
    grid = F.array(*[F.struct(F.lit(x).alias("z_thr"), F.lit(f).alias("frac"), (F.col(f"s{i}") > f).alias("out")) for i, x in enumerate(_SWEEP_Z) for f in _SWEEP_F])
    g = t.select("l_returnflag", F.explode(grid).alias("x")).select("l_returnflag", "x.*")
    return g.groupBy("l_returnflag", "z_thr", "frac").agg(F.count(F.lit(1)).alias("n_trials"), F.sum(F.col("out").cast("long")).alias("n_dropped"))


@query(
    "halves_average",
    f"""with {EV}, n as (select *, row_number() over (partition by patient, condition order by us, event_id) - 1 as i from ev)
    select patient, condition, round(avg(stim) filter (i % 2 = 0), 6) as half1, round(avg(stim) filter (i % 2 = 1), 6) as half2, round((avg(stim) filter (i % 2 = 0) - avg(stim) filter (i % 2 = 1)) / 2, 6) as noise from n group by all""",
)
def halves_average(spark, sf):
    """Averages over even and odd trials, and half their difference."""
    i = F.row_number().over(W.partitionBy("patient", "condition").orderBy("us", "event_id")) - 1
    d = events(spark, sf).withColumn("i", i)
    h = lambda r: F.avg(F.when(F.col("i") % 2 == r, F.col("stim")))
    return d.groupBy("patient", "condition").agg(F.round(h(0), 6).alias("half1"), F.round(h(1), 6).alias("half2"), F.round((h(0) - h(1)) / 2, 6).alias("noise"))


@query(
    "noise_ratio",
    """with s as (select l_returnflag, l_suppkey, stddev_samp(l_extendedprice) as sd from lineitem group by all)
    select l_returnflag, l_suppkey, round(sd / median(sd) over (partition by l_returnflag), 6) as ratio from s""",
)
def noise_ratio(spark, sf):
    """Each contact's sd over the median sd of its montage."""
    s = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.stddev_samp("l_extendedprice").alias("sd"))
    m = group_quantiles(s, ["l_returnflag"], F.col("sd"), {"m": 0.5}).drop("n")
    return s.join(m, "l_returnflag").select("l_returnflag", "l_suppkey", F.round(F.col("sd") / F.col("m"), 6).alias("ratio"))


@query(
    "rollup_patient_condition",
    f"with {EV} select patient, condition, cast(grouping(patient) as int) as all_patients, cast(grouping(condition) as int) as all_conditions, count(*) as n, round(avg(stim), 9) as stim_mean from ev group by rollup (patient, condition)",
)
def rollup_patient_condition(spark, sf):
    """Per condition, per patient and overall in one pass."""
    return events(spark, sf).rollup("patient", "condition").agg(F.grouping("patient").cast("int").alias("all_patients"), F.grouping("condition").cast("int").alias("all_conditions"), F.count(F.lit(1)).alias("n"), F.round(F.avg("stim"), 9).alias("stim_mean"))


@query("cohort_all_conditions", f"with {EV} select patient, count(*) as n, round(max(stim), 6) as strongest from ev where patient % 10 <> 3 group by all having count(distinct condition) = 5 and max(stim) > 4")
def cohort_all_conditions(spark, sf):
    """Patients with every condition, one strong trial and no exclusion."""
    e = events(spark, sf)
    gone = e.select("patient").distinct().filter("patient % 10 = 3")
    a = e.groupBy("patient", "condition").agg(F.count(F.lit(1)).alias("n"), F.max("stim").alias("s")).groupBy("patient").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.max("s").alias("s"))
    return a.filter("c = 5 and s > 4").join(gone, "patient", "left_anti").select("patient", "n", F.round("s", 6).alias("strongest"))


_CH = "select user_id as patient, event_type as channel from events where dayofmonth(ts) "


@query("set_difference_channels", f"{_CH} <= 5 except {_CH} > 20")
def set_difference_channels(spark, sf):
    """Channels seen in the first days and not in the last."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("patient"), F.col("event_type").alias("channel"), F.dayofmonth("ts").alias("d"))
    return e.filter("d <= 5").drop("d").subtract(e.filter("d > 20").drop("d"))


@query("set_intersection_patients", f"{_CH} <= 5 intersect {_CH} > 25")
def set_intersection_patients(spark, sf):
    """Channels seen in the first and in the last days."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("patient"), F.col("event_type").alias("channel"), F.dayofmonth("ts").alias("d"))
    return e.filter("d <= 5").drop("d").intersect(e.filter("d > 25").drop("d"))


@query("union_of_runs", "select 'events' as run, event_type as kind, cast(value as double) as score, null::varchar as flag from events union all select 'lineitem', null, l_quantity, l_returnflag from lineitem")
def union_of_runs(spark, sf):
    """Tables of different runs under one schema; missing columns are null."""
    a = table(spark, sf, "events").select(F.lit("events").alias("run"), F.col("event_type").alias("kind"), F.col("value").alias("score"))
    b = table(spark, sf, "lineitem").select(F.lit("lineitem").alias("run"), F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("flag"))
    return a.unionByName(b, allowMissingColumns=True)


@query("dedup_content", "select md5(payload) as digest, min(file_id) as first_file, count(*) as n_copies from trial_raw group by all")
def dedup_content(spark, sf):
    """One row per content digest, kept under its first file."""
    t = table(spark, sf, "trial_raw")
    return t.groupBy(F.md5(F.encode("payload", "UTF-8")).alias("digest")).agg(F.min("file_id").alias("first_file"), F.count(F.lit(1)).alias("n_copies"))
