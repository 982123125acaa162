"""Event train, clock and recording queries over ``events`` and ``recording_segments``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keyed import uniform, uniform_sql
from ..operators import trains as T
from ..operators.intervals import latest_version, micros
from ..operators.quantiles import group_quantiles
from ..session import table
from .registry import query

HOUR = 3_600_000_000


def marks(spark, sf):
    """event_id, session (user), name (type), us, value."""
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("name"), micros(F.col("ts")).alias("us"), "value")


_M = "m as (select event_id, user_id as session, event_type as name, epoch_us(ts) as us, value from events)"
_B = _M + f", g as (select *, case when us - lag(us) over w > {12 * HOUR} then 1 else 0 end as f from m window w as (partition by session order by us, event_id)), b as (select session, burst, min(us) as s, max(us) as e, count(*) as n from (select *, sum(f) over (partition by session order by us, event_id) as burst from g) group by all)"


@query("gap_bursts", f"with {_B} select session, cast(burst as bigint) as burst, s as start_us, e as end_us, n from b")
def gap_bursts(spark, sf):
    """Bursts of marks separated by more than twelve hours."""
    b = T.bursts(marks(spark, sf), ["session"], "us", 12 * HOUR, ["event_id"])
    return b.select("session", "burst", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


@query("session_bursts", f"with {_B} select session, s as start_us, n from b")
def session_bursts(spark, sf):
    """The same by the engine's session window."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("us"))
    s = e.groupBy("session", F.session_window("ts", "12 hours 1 microsecond").alias("w")).agg(F.min("us").alias("start_us"), F.count(F.lit(1)).alias("n"))
    return s.select("session", "start_us", "n")


@query("train_regularity", f"with {_M}, i as (select session, name, us - lag(us) over (partition by session, name order by us, event_id) as d from m) select session, name, count(d) as n, round(median(d) / 1e6, 7) as median_s, round(stddev_samp(d) / avg(d), 6) as cv, coalesce(stddev_samp(d) / avg(d) < 0.9, false) as regular from i where d is not null group by all")
def train_regularity(spark, sf):
    """Median interval and variation of each train."""
    w = W.partitionBy("session", "name").orderBy("us", "event_id")
    i = marks(spark, sf).withColumn("d", F.col("us") - F.lag("us").over(w)).filter("d is not null")
    cv = F.stddev_samp("d") / F.avg("d")
    a = i.groupBy("session", "name").agg(F.round(cv, 6).alias("cv"), F.coalesce(cv < 0.9, F.lit(False)).alias("regular"))
    q = group_quantiles(i, ["session", "name"], F.col("d"), {"m": 0.5})
    return a.join(q, ["session", "name"]).select("session", "name", "n", F.round(F.col("m") / 1e6, 7).alias("median_s"), "cv", "regular")


_NEAR = _M + """, l as (select * from m where name = 'error'), r as (select session, us as r from m where name = 'click'),
bf as (select event_id, max(r) as before from l join r using (session) where r <= us group by all), af as (select event_id, min(r) as after from l join r using (session) where r >= us group by all),
nr as (select l.*, before, after, case when after is null or us - before <= after - us then before else after end as nearest from l left join bf using (event_id) left join af using (event_id))"""


def _nearest(spark, sf):
    m = marks(spark, sf)
    return T.nearest(m.filter("name = 'error'"), m.filter("name = 'click'").select("session", F.col("us").alias("r")), ["session"], "us", "r", bucket=24 * HOUR)


@query("asof_nearest", f"with {_NEAR} select event_id, before, after, nearest - us as signed_us from nr")
def asof_nearest(spark, sf):
    """Each burst's nearest pulse of the same session, with the signed difference."""
    return _nearest(spark, sf).select("event_id", "before", "after", (F.col("nearest") - F.col("us")).alias("signed_us"))


_OFFS = tuple(range(-4, 5))


@query("offset_search", f"with {_M}, o as (select unnest({list(_OFFS)}) as o), l as (select session, us // {HOUR} as h from m where name = 'error'), r as (select distinct session, us // {HOUR} as h from m where name = 'click'), c as (select l.session, o, count(*) as n, count(r.h) as hit from l cross join o left join r on r.session = l.session and r.h = l.h + o group by all) select session, arg_max(o, (hit, -abs(o), -o)) as best_offset_h, round(max(hit / n), 9) as share from c group by all")
def offset_search(spark, sf):
    """The offset of a grid under which most bursts fall on a pulse."""
    m = marks(spark, sf).withColumn("h", F.call_function("div", F.col("us"), F.lit(HOUR).cast("long")))
    l = m.filter("name = 'error'").select("session", "h", F.explode(F.array(*[F.lit(o) for o in _OFFS])).alias("o")).withColumn("at", F.col("h") + F.col("o"))
    r = m.filter("name = 'click'").select("session", F.col("h").alias("at")).distinct().withColumn("hit", F.lit(1))
    c = l.join(r, ["session", "at"], "left").groupBy("session", "o").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k"))
    return c.groupBy("session").agg(F.max_by("o", F.struct("k", -F.abs("o"), -F.col("o"))).alias("best_offset_h"), F.round(F.max(F.col("k") / F.col("n")), 9).alias("share"))


@query("two_clock_fit", f"with {_NEAR}, x as (select session, us / 1e6 - 1704067200 as x, (nearest + session * 1000000) / 1e6 - 1704067200 as y from nr where nearest is not null), f as (select session, count(*) as n, regr_slope(y, x) as a, regr_intercept(y, x) as b from x group by all having count(*) >= 3) select session, n, round(a, 6) as slope, round(b, 3) as intercept_s, round(max(abs(y - a * x - b)), 3) as worst_s from x join f using (session) group by session, n, a, b")
def two_clock_fit(spark, sf):
    """One clock as a straight line of the other, with the largest residual."""
    x = _nearest(spark, sf).filter("nearest is not null").select("session", (F.col("us") / 1e6 - 1704067200).alias("x"), ((F.col("nearest") + F.col("session") * 1000000) / 1e6 - 1704067200).alias("y"))
    f = T.affine_fit(x, ["session"], "x", "y").filter("n >= 3")
    return f.select("session", "n", F.round("slope", 6).alias("slope"), F.round("offset", 3).alias("intercept_s"), F.round("worst", 3).alias("worst_s"))


_SEG = """sg as (select seg_id, session_id, stream, family, split_no, epoch_us(coalesce(start_ts, acq_created)) as s, epoch_us(coalesce(end_ts, acq_closed)) as e, span_s from
 (select *, row_number() over (partition by seg_id order by ingested_at desc nulls last, session_id desc, stream desc, family desc, split_no desc, start_ts desc nulls last, end_ts desc nulls last, acq_created desc nulls last, acq_closed desc nulls last, span_s desc nulls last) as rn from recording_segments) where rn = 1)"""


def segments(spark, sf):
    s = latest_version(table(spark, sf, "recording_segments"), "seg_id", "ingested_at", ["session_id", "stream", "family", "split_no", "start_ts", "end_ts", "acq_created", "acq_closed", "span_s"])
    return s.select("seg_id", "session_id", "stream", "family", "split_no", micros(F.coalesce("start_ts", "acq_created")).alias("s"), micros(F.coalesce("end_ts", "acq_closed")).alias("e"), "span_s")


@query("part_starts", f"with {_SEG} select seg_id, round(coalesce(sum(span_s) over (partition by session_id, stream order by split_no, s nulls first, seg_id rows between unbounded preceding and 1 preceding), 0), 3) as start_s from sg where span_s is not null")
def part_starts(spark, sf):
    """Start of each part on the clock of the joined recording."""
    s = segments(spark, sf).filter("span_s is not null")
    return T.running_starts(s, ["session_id", "stream"], ["split_no", "s", "seg_id"], "span_s").select("seg_id", F.round("start", 3).alias("start_s"))


@query("concat_parts", f"with {_SEG}, f as (select session_id, stream, split_no, string_agg(distinct family, '+' order by family) as fam, sum(span_s) as span from sg where span_s is not null group by all) select session_id, stream, count(*) as n_parts, round(sum(span), 3) as total_s, count(distinct fam) = 1 as joinable from f group by all")
def concat_parts(spark, sf):
    """Parts of a recording joined on the time axis; refused where their families differ."""
    s = segments(spark, sf).filter("span_s is not null")
    f = s.groupBy("session_id", "stream", "split_no").agg(F.array_join(F.array_sort(F.collect_set("family")), "+").alias("fam"), F.sum("span_s").alias("span"))
    return f.groupBy("session_id", "stream").agg(F.count(F.lit(1)).alias("n_parts"), F.round(F.sum("span"), 3).alias("total_s"), (F.count_distinct("fam") == 1).alias("joinable"))


@query("recorded_span_rollup", f"with {_SEG} select session_id, stream, cast(grouping(session_id) as int) as g_session, cast(grouping(stream) as int) as g_stream, cast(sum(e - s) as bigint) as recorded_us, max(e) - min(s) as span_us, count(*) as n from sg where e > s group by rollup (session_id, stream)")
def recorded_span_rollup(spark, sf):
    """Recorded against elapsed time per session and stream, per session and overall."""
    s = segments(spark, sf).filter("e > s")
    return s.rollup("session_id", "stream").agg(F.grouping("session_id").cast("int").alias("g_session"), F.grouping("stream").cast("int").alias("g_stream"), F.sum(F.col("e") - F.col("s")).alias("recorded_us"), (F.max("e") - F.min("s")).alias("span_us"), F.count(F.lit(1)).alias("n"))


@query("time_to_part", f"with {_SEG}, x as (select seg_id, session_id, stream, s + 90000000 as t from sg where s is not null), p as (select x.seg_id, max(sg.s) as part_start from x join sg on sg.session_id = x.session_id and sg.stream = x.stream and sg.s <= t group by all) select seg_id, part_start from p")
def time_to_part(spark, sf):
    """The part a time falls into: the last start at or before it."""
    s = segments(spark, sf).filter("s is not null")
    x = s.select("seg_id", "session_id", "stream", (F.col("s") + 90_000_000).alias("t"))
    n = T.nearest(x, s.select("session_id", "stream", F.col("s").alias("r")), ["session_id", "stream"], "t", "r")
    return n.select("seg_id", F.col("before").alias("part_start"))


@query("splice_crossing", f"with {_SEG}, x as (select seg_id, session_id, stream, e - 2000000 as a, e + 2000000 as b from sg where e is not null) select x.seg_id, count(*) > 0 as crosses from x join sg on sg.session_id = x.session_id and sg.stream = x.stream and sg.s > a and sg.s < b group by all")
def splice_crossing(spark, sf):
    """Windows that a start of another part falls into."""
    s = segments(spark, sf)
    x = s.filter("e is not null").select("seg_id", "session_id", "stream", (F.col("e") - 2_000_000).alias("a"), (F.col("e") + 2_000_000).alias("b"))
    m = T.nearest(x.withColumn("b1", F.col("b") - 1), s.filter("s is not null").select("session_id", "stream", F.col("s").alias("r")), ["session_id", "stream"], "b1", "r")
    return m.filter("before > a").select("seg_id", F.lit(True).alias("crosses"))


@query("rate_curve", f"with {_M}, h as (select name, us // {6 * HOUR} as k, count(*) as n from m group by all), c as (select name, k, sum(n) over (partition by name order by k) as c from h) select name, k, cast(c - coalesce(lag(c) over (partition by name order by k), 0) as bigint) as n, round((c - coalesce(lag(c) over (partition by name order by k), 0)) / (6 * 3600.0::double), 9) as rate_hz from c")
def rate_curve(spark, sf):
    """Cumulative counts on a grid, differenced to a rate."""
    h = marks(spark, sf).groupBy("name", F.call_function("div", F.col("us"), F.lit(6 * HOUR).cast("long")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("name").orderBy("k")
    c = h.withColumn("c", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = F.col("c") - F.coalesce(F.lag("c").over(w), F.lit(0))
    return c.select("name", "k", d.alias("n"), F.round(d / (6 * 3600.0), 9).alias("rate_hz"))


_LAGS = tuple(range(-6, 7))


@query("lag_profile", f"with {_M}, h as (select us // {HOUR} as k, count(*) filter (name = 'click') as a, count(*) filter (name = 'view') as b from m group by all), l as (select unnest({list(_LAGS)}) as lag) select lag, count(*) as n, round(corr(x.a, y.b), 6) as r from l join h x on true join h y on y.k = x.k + lag group by all")
def lag_profile(spark, sf):
    """Correlation of two hourly rates at every lag, on their overlap."""
    h = marks(spark, sf).groupBy(F.call_function("div", F.col("us"), F.lit(HOUR).cast("long")).alias("k")).agg(F.count(F.when(F.col("name") == "click", 1)).alias("a"), F.count(F.when(F.col("name") == "view", 1)).alias("b"))
    x = h.select("a", "k", F.explode(F.array(*[F.lit(v) for v in _LAGS])).alias("lag")).select("a", "lag", (F.col("k") + F.col("lag")).alias("k"))
    j = x.join(h.select("k", "b"), "k")
    return j.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("a", "b"), 6).alias("r"))


@query("window_labels", f"with {_M}, w as (select session, us // {24 * HOUR} as day, count(*) as n, avg(value) as m, max(value) as top, count(distinct name) as k from m group by all) select session, day, case when top >= 99 then 'saturated' when n < 2 then 'empty' when k = 1 then 'mains' when m > 60 then 'noisy' when m > 20 then 'signal' else 'unclear' end as label from w")
def window_labels(spark, sf):
    """Label of every fixed window by ordered rules."""
    d = marks(spark, sf).groupBy("session", F.call_function("div", F.col("us"), F.lit(24 * HOUR).cast("long")).alias("day"))
    w = d.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.max("value").alias("top"), F.count_distinct("name").alias("k"))
    label = F.when(F.col("top") >= 99, "saturated").when(F.col("n") < 2, "empty").when(F.col("k") == 1, "mains").when(F.col("m") > 60, "noisy").when(F.col("m") > 20, "signal").otherwise("unclear")
    return w.select("session", "day", label.alias("label"))


@query("tumbling_windows", f"with {_M} select name, us // {6 * HOUR} * {6 * HOUR} as start_us, count(*) as n, round(sum(value), 4) as total from m group by all")
def tumbling_windows(spark, sf):
    """Fixed windows by the engine's window function."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")
    w = e.groupBy("name", F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("name", F.unix_micros("w.start").alias("start_us"), "n", "total")


@query("even_sampling", f"with {_SEG}, k as (select seg_id, e - s as d, least(greatest((e - s) // 600000000, 1), 5) as k from sg where e > s), i as (select seg_id, d, k, unnest(range(0, k)) as i from k) select distinct seg_id, case when k = 1 then 0 else (i * ((d - 1000000) // (k - 1))) end as offset_us from i where d > 1000000")
def even_sampling(spark, sf):
    """One to five evenly spaced window starts by the recorded length."""
    d = segments(spark, sf).filter("e > s").select("seg_id", (F.col("e") - F.col("s")).alias("d")).filter("d > 1000000")
    k = F.least(F.greatest(F.call_function("div", F.col("d"), F.lit(600_000_000).cast("long")), F.lit(1)), F.lit(5))
    d = d.withColumn("k", k)
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.when(F.col("k") == 1, F.lit(0)).otherwise(i * F.call_function("div", F.col("d") - 1_000_000, F.greatest(F.col("k") - 1, F.lit(1)))))
    return d.select("seg_id", F.explode(F.array_distinct(at)).alias("offset_us"))


@query("block_anchors", f"with {_M}, b as (select session, us // {24 * HOUR} as block, min(us) as anchor, count(*) as n from m group by all) select session, block, anchor, n, anchor - lag(anchor) over (partition by session order by block) as since_previous from b")
def block_anchors(spark, sf):
    """Each block anchored at its first onset."""
    b = marks(spark, sf).groupBy("session", F.call_function("div", F.col("us"), F.lit(24 * HOUR).cast("long")).alias("block")).agg(F.min("us").alias("anchor"), F.count(F.lit(1)).alias("n"))
    return b.withColumn("since_previous", F.col("anchor") - F.lag("anchor").over(W.partitionBy("session").orderBy("block")))


@query("snap_bounds", f"with {_M}, g as (select session, us as right_us, lag(us) over (partition by session order by us, event_id) as left_us from m), l as (select session, (left_us + right_us) // 2 as mid from g where right_us - left_us > {8 * HOUR}), b as (select session, (min(us) + max(us)) // 2 as bound from m group by all), d as (select b.session, bound, mid, row_number() over (partition by b.session order by abs(mid - bound), mid) as rn from b left join l on l.session = b.session) select session, bound, mid as snapped from d where rn = 1")
def snap_bounds(spark, sf):
    """Nominal block bounds moved to the middle of the nearest large gap."""
    m = marks(spark, sf)
    g = m.withColumn("left_us", F.lag("us").over(W.partitionBy("session").orderBy("us", "event_id"))).filter(F.col("us") - F.col("left_us") > 8 * HOUR)
    g = g.select("session", F.call_function("div", F.col("left_us") + F.col("us"), F.lit(2).cast("long")).alias("mid"))
    b = m.groupBy("session").agg(F.call_function("div", F.min("us") + F.max("us"), F.lit(2).cast("long")).alias("bound"))
    j = T.nearest(b, g.withColumnRenamed("mid", "r"), ["session"], "bound", "r")
    return j.select("session", "bound", F.col("nearest").alias("snapped"))


@query("top_marks", f"with {_M}, r as (select *, row_number() over (partition by session, name order by value desc, event_id) as no from m) select session, name, no, event_id, value from r where no <= 3")
def top_marks(spark, sf):
    """The three strongest marks of each train (a top-k report)."""
    w = W.partitionBy("session", "name").orderBy(F.desc("value"), "event_id")
    r = marks(spark, sf).withColumn("no", F.row_number().over(w).cast("long"))
    return r.filter("no <= 3").select("session", "name", "no", "event_id", "value")


@query("newest_mark", f"with {_M} select session, name, max(us) as us, arg_max(event_id, (us, event_id)) as event_id from m group by all")
def newest_mark(spark, sf):
    return marks(spark, sf).groupBy("session", "name").agg(F.max("us").alias("us"), F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))


@query("active_marginal", f"with {_M}, x as (select name, unnest(range(us // {HOUR}, (us + cast(value * 60000000 as bigint)) // {HOUR} + 1)) as hour from m) select name, hour, count(*) as n from x group by all")
def active_marginal(spark, sf):
    """Active intervals per hour."""
    h = lambda c: F.call_function("div", c, F.lit(HOUR).cast("long"))
    x = marks(spark, sf).select("name", F.explode(F.sequence(h(F.col("us")), h(F.col("us") + F.round(F.col("value") * 60000000).cast("long")))).alias("hour"))
    return x.groupBy("name", "hour").agg(F.count(F.lit(1)).alias("n"))


@query("log_lines", f"with {_M}, l as (select strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') || ' patient=' || session || ' stage=' || name || ' status=' || case when value > 50 then 'done' else 'running' end as line from m), p as (select regexp_extract(line, 'patient=([0-9]+)', 1)::bigint as patient, regexp_extract(line, 'stage=([a-z]+)', 1) as stage, regexp_extract(line, 'status=([a-z]+)', 1) as status, substr(line, 1, 19) as ended from l) select patient, stage, max(ended) as finished_at from p where status = 'done' group by all")
def log_lines(spark, sf):
    """Run logs parsed to rows; the newest finished one per patient and stage."""
    m = marks(spark, sf)
    line = F.concat(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss"), F.lit(" patient="), F.col("session").cast("string"), F.lit(" stage="), F.col("name"), F.lit(" status="), F.when(F.col("value") > 50, "done").otherwise("running"))
    from ..sources.text import parse_log

    p = parse_log(m.select(line.alias("value")))
    return p.filter("status = 'done'").groupBy(F.col("patient").cast("long").alias("patient"), "stage").agg(F.max("at").alias("finished_at"))


@query("nearest_fill", "with t0 as (select timing_id, any_value(condition_name) as c, any_value(run_day) as d, max(case when isnan(peak_lat) then null else peak_lat end) as v from timing group by all), f as (select timing_id, coalesce(v, last_value(v ignore nulls) over (partition by c, d order by timing_id rows unbounded preceding), first_value(v ignore nulls) over (partition by c, d order by timing_id rows between current row and unbounded following)) as v from t0) select timing_id, v from f")
def nearest_fill(spark, sf):
    """Missing readings filled from the last before, else the first after."""
    v = F.when(~F.isnan("peak_lat"), F.col("peak_lat"))
    t = table(spark, sf, "timing").groupBy("timing_id").agg(F.first("condition_name", True).alias("c"), F.first("run_day", True).alias("d"), F.max(v).alias("v"))
    w = W.partitionBy("c", "d").orderBy("timing_id")
    return t.select("timing_id", T.fill_nearest(F.col("v"), w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)).alias("v"))


@query("detrended", f"with {_M} select event_id, round(value - median(value) over (partition by session order by us, event_id rows between 5 preceding and 5 following), 6) as d from m")
def detrended(spark, sf):
    """Values without their centred running median."""
    w = W.partitionBy("session").orderBy("us", "event_id").rowsBetween(-5, 5)
    return marks(spark, sf).select("event_id", F.round(F.col("value") - F.percentile("value", 0.5).over(w), 6).alias("d"))


@query("time_formats", "select event_id, epoch_us(date_trunc('second', ts)) as us, cast(extract(hour from ts) * 60 + extract(minute from ts) as int) as minute_of_day from events")
def time_formats(spark, sf):
    """Times read from three spellings."""
    e = table(spark, sf, "events").select("event_id", "ts")
    f = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss"))
    s = e.select("event_id", f.alias("s"))
    t = F.coalesce(*[F.try_to_timestamp("s", F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyyMMdd'T'HHmmss")])
    s = s.withColumn("t", t)
    return s.select("event_id", F.unix_micros("t").alias("us"), (F.hour("t") * 60 + F.minute("t")).alias("minute_of_day"))


_BOOT = 40


@query("boot_slope", f"with {_M}, x as (select name, event_id, us / 1e6 - 1704067200 as x, value as y from m), b as (select unnest(range(0, {_BOOT})) as b), w as (select name, b, x, y, -ln({uniform_sql('slope', 'b', 'event_id')}) as w from x cross join b), s as (select name, b, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) as slope from w group by all) select name, round(quantile_cont(slope, 0.025) * 1e6, 4) as lo, round(quantile_cont(slope, 0.975) * 1e6, 4) as hi from s group by all")
def boot_slope(spark, sf):
    """Interval of a slope under exponential weights of the rows, summed in one pass."""
    x = marks(spark, sf).select("name", "event_id", (F.col("us") / 1e6 - 1704067200).alias("x"), F.col("value").alias("y"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(_BOOT - 1))).alias("b")).withColumn("w", -F.log(uniform("slope", F.col("b"), F.col("event_id"))))
    w, a, b = F.col("w"), F.col("x"), F.col("y")
    s = x.groupBy("name", "b").agg(((F.sum(w) * F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b)) / (F.sum(w) * F.sum(w * a * a) - F.sum(w * a) ** 2)).alias("slope"))
    q = group_quantiles(s, ["name"], F.col("slope"), {"lo": 0.025, "hi": 0.975})
    return q.select("name", F.round(F.col("lo") * 1e6, 4).alias("lo"), F.round(F.col("hi") * 1e6, 4).alias("hi"))


@query("near_threshold", f"with {_M}, d as (select *, value - 30 as margin from m), i as (select name, event_id, 'inside' as side, margin, row_number() over (partition by name order by margin, event_id) as no from d where margin >= 0), o as (select name, event_id, 'outside' as side, margin, row_number() over (partition by name order by margin desc, event_id) as no from d where margin < 0) select name, side, no, event_id, round(margin, 6) as margin from i where no <= 4 union all select name, side, no, event_id, round(margin, 6) from o where no <= 4")
def near_threshold(spark, sf):
    """The four rows nearest a threshold on either side (a top-k report)."""
    m = F.col("value") - 30
    d = marks(spark, sf).withColumn("margin", m).withColumn("side", F.when(m >= 0, "inside").otherwise("outside"))
    r = d.withColumn("no", F.row_number().over(W.partitionBy("name", "side").orderBy(F.abs("margin"), "event_id")).cast("long"))
    return r.filter("no <= 4").select("name", "side", "no", "event_id", F.round("margin", 6).alias("margin"))


_CFG = (("stim", 10.0, 40.0, 2.0), ("resp", 55.0, 50.0, 2.0), ("late", -5.0, 20.0, 1.0), ("box", 0.0, 100.0, 0.0))


@query("window_validation", "with c(zone, lo, hi, sigma) as (values " + ", ".join(map(str, _CFG)) + ") select zone, case when lo < 0 or hi > 100 then 'out_of_range' when lo >= hi then 'empty' when sigma <= 0 then 'no_width' end as problem from c")
def window_validation(spark, sf):
    """Configured windows and what is wrong with them."""
    c = spark.createDataFrame(list(_CFG), "zone string, lo double, hi double, sigma double")
    return c.select("zone", F.when((F.col("lo") < 0) | (F.col("hi") > 100), "out_of_range").when(F.col("lo") >= F.col("hi"), "empty").when(F.col("sigma") <= 0, "no_width").alias("problem"))


_ROI = (("a", 70.0, 150.0, 19, 39), ("b", 4.0, 8.0, 2, 3), ("c", 13.0, 30.0, 4, 12))


@query("roi_grid_check", "with r(roi, lo, hi, row_lo, row_hi) as (values " + ", ".join(map(str, _ROI)) + "), x as (select *, cast(ceil(lo / 3.90625) as int) + 1 as want_lo, cast(floor(hi / 3.90625) as int) + 1 as want_hi from r) select roi, want_lo, want_hi, row_lo <> want_lo or row_hi <> want_hi as mismatch from x")
def roi_grid_check(spark, sf):
    """Boxes given in Hz and in rows that do not agree."""
    r = spark.createDataFrame(list(_ROI), "roi string, lo double, hi double, row_lo int, row_hi int")
    r = r.withColumn("want_lo", (F.ceil(F.col("lo") / 3.90625) + 1).cast("int")).withColumn("want_hi", (F.floor(F.col("hi") / 3.90625) + 1).cast("int"))
    return r.select("roi", "want_lo", "want_hi", ((F.col("row_lo") != F.col("want_lo")) | (F.col("row_hi") != F.col("want_hi"))).alias("mismatch"))
