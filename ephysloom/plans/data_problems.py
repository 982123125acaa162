"""Orphan references, interval coverage and schema drift on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import entity_key, entity_key_sql, given_sql
from ..operators import drift, intervals, orphans
from ..session import table
from .registry import query

# ------------------------------------------------------------ 1: orphans


def _graph(spark, sf, everything: bool):
    t = lambda n: table(spark, sf, n)
    nodes = {
        "patients": t("patients").withColumn("row_id", F.col("patient_no")),
        "contacts": t("contacts").withColumn("row_id", orphans.row_hash("patient", "name", "name_raw", "added_at", "removed_at")),
        "name_match_unmatched_recorded": t("name_match_unmatched_recorded").withColumn("row_id", F.col("rec_id")),
        "timing": t("timing").withColumn("row_id", F.col("timing_id")),
    }
    bounds = ("added_at", "removed_at")
    refs = [
        orphans.Ref("prior_patient_id", "patients", ["prior_patient_id"], "patients", ["patient_id"], entity_key, "enrolled_at"),
        orphans.Ref("patient", "contacts", ["patient"], "patients", ["patient_id"], entity_key, "added_at"),
        orphans.Ref("contact", "name_match_unmatched_recorded", ["patient_id", "electrode"], "contacts", ["patient", "name"], entity_key, "recorded_at", bounds),
        orphans.Ref("contact", "timing", ["patient_id", "electrode"], "contacts", ["patient", "name"], entity_key, "computed_at", bounds),
    ]
    if everything:
        nodes["recording_segments"] = t("recording_segments").withColumn("row_id", F.col("seg_id")).withColumn("at", F.coalesce("start_ts", "acq_created"))
        nodes["cluster_patients"] = t("cluster_patients").withColumn("row_id", orphans.row_hash("run_id", "cluster_no"))
        refs += [
            orphans.Ref("patient", "recording_segments", ["patient_id"], "patients", ["patient_id"], entity_key, "at", None),
            orphans.Ref("top_patient", "cluster_patients", ["top_patient"], "patients", ["patient_no"]),
        ]
    return orphans.orphan_cascade(nodes, refs, None if everything else ("timing", "name_match_unmatched_recorded"))


def _direct_sql(t: str, i: str, at: str) -> str:
    pk, ek = entity_key_sql("c.patient_id"), entity_key_sql("c.electrode")
    return f"""
    select distinct '{t}' as child_table, c.{i} as row_id from {t} c
    where {given_sql("c.patient_id")} and {given_sql("c.electrode")} and not exists (
      select 1 from contacts p where {entity_key_sql("p.patient")} = {pk} and {entity_key_sql("p.name")} = {ek}
        and (p.added_at is null or p.added_at <= c.{at}) and (p.removed_at is null or c.{at} < p.removed_at))"""


@query("p1_found", _direct_sql("name_match_unmatched_recorded", "rec_id", "recorded_at") + " union all " + _direct_sql("timing", "timing_id", "computed_at"))
def p1_found(spark, sf):
    """Rows of the two recording tables whose contact is not registered then."""
    o = _graph(spark, sf, everything=False)
    o = o.filter((F.col("kind") == "direct") & F.col("child_table").isin("name_match_unmatched_recorded", "timing"))
    return o.select("child_table", "row_id")


_CASES = """
pk as (select distinct patient_no, {pid} as key, case when {prior_given} then {prior} end as prior, enrolled_at as tm from patients),
rp as (with recursive r(patient_no, key, tm, depth) as (
    select patient_no, key, tm, 0 from pk where prior is not null and prior not in (select key from pk where key is not null)
    union all select c.patient_no, c.key, c.tm, r.depth + 1 from r join pk c on c.prior = r.key) select patient_no, any_value(key) as key, max(tm) as tm, min(depth) as depth from r group by patient_no),
o1 as (select 'patients' as child_table, 'prior_patient_id' as ref, patient_no::varchar as id, tm, case when depth = 0 then 'direct' else 'inherited' end as kind, case when depth = 0 then 'never' else 'parent' end as reason, depth from rp),
ck as (select distinct patient, name, name_raw, added_at, removed_at, {cp} as pkey, {cn} as nkey from contacts),
o2 as (select ck.*, case when pkey in (select key from pk where key is not null) then 'inherited' else 'direct' end as kind, case when rp.depth is null then 0 else rp.depth + 1 end as depth
  from ck left join rp on rp.key = pkey where {cg} and (pkey not in (select key from pk where key is not null) or rp.depth is not null)),
kids as (select distinct 'name_match_unmatched_recorded' as child_table, rec_id as id, {rk} as pkey, {re} as nkey, recorded_at as tm from name_match_unmatched_recorded where {rg}
  union select distinct 'timing', timing_id, {rk}, {re}, computed_at from timing where {rg}),
cs as (select ck.pkey, ck.nkey, ck.added_at as lo, ck.removed_at as hi, min(o2.depth) as depth from ck left join o2 on ck.patient is not distinct from o2.patient and ck.name is not distinct from o2.name and ck.name_raw is not distinct from o2.name_raw
  and ck.added_at is not distinct from o2.added_at and ck.removed_at is not distinct from o2.removed_at group by all),
f as (select child_table, id, max(tm) as tm, count(lo is null) filter (cs.pkey is not null) as n, count(*) filter (cs.pkey is not null and (lo is null or lo <= tm) and (hi is null or tm < hi)) as valid,
  count(*) filter (cs.pkey is not null and (lo is null or lo <= tm) and (hi is null or tm < hi) and depth is null) as alive, min(depth) filter ((lo is null or lo <= tm) and (hi is null or tm < hi)) as depth,
  count(*) filter (hi <= tm) as ended, count(*) filter (lo > tm) as begins from kids left join cs using (pkey, nkey) group by all),
o3 as (select child_table, 'contact' as ref, tm, case when valid = 0 then 'direct' else 'inherited' end as kind, case when valid > 0 then 'parent' when n = 0 then 'never' when tm is null then 'undated' when ended > 0 and begins > 0 then 'between' when ended > 0 then 'removed' else 'later' end as reason,
  case when valid = 0 then 0 else depth + 1 end as depth from f where alive = 0),
sk as (select distinct on (seg_id) seg_id, {sp} as pkey, coalesce(start_ts, acq_created) as tm from recording_segments where {sg} order by seg_id, coalesce(start_ts, acq_created) desc nulls last),
o4 as (select sk.tm as tm, case when rp.depth is null then 'direct' else 'inherited' end as kind, case when rp.depth is null then 0 else rp.depth + 1 end as depth from sk left join rp on rp.key = pkey where pkey not in (select key from pk where key is not null) or rp.depth is not null),
o5 as (select distinct run_id, cluster_no, case when rp.depth is null then 'direct' else 'inherited' end as kind, case when rp.depth is null then 0 else rp.depth + 1 end as depth from cluster_patients left join rp on rp.patient_no = top_patient
  where top_patient is not null and (top_patient not in (select patient_no from pk) or rp.depth is not null)),
al as (select child_table, ref, tm, kind, reason, depth from o1 union all select 'contacts', 'patient', added_at, kind, case when kind = 'direct' then 'never' else 'parent' end, depth from o2 union all select * from o3
  union all select 'recording_segments', 'patient', tm, kind, case when kind = 'direct' then 'never' else 'parent' end, depth from o4
  union all select 'cluster_patients', 'top_patient', null::timestamp, kind, case when kind = 'direct' then 'never' else 'parent' end, depth from o5)
""".format(pid=entity_key_sql("patient_id"), prior=entity_key_sql("prior_patient_id"), prior_given=given_sql("prior_patient_id"), cp=entity_key_sql("patient"), cn=entity_key_sql("name"), cg=given_sql("patient"), rk=entity_key_sql("patient_id"), re=entity_key_sql("electrode"), rg=f"{given_sql('patient_id')} and {given_sql('electrode')}", sp=entity_key_sql("patient_id"), sg=given_sql("patient_id"))


@query("p1_orphans_by_month", f"with {_CASES} select child_table, ref, strftime(tm, '%Y-%m') as month, kind, reason, count(*) as n_rows, cast(max(depth) as int) as max_depth from al group by all")
def p1_orphans_by_month(spark, sf):
    """Direct and inherited orphans per table, reference and month, whole graph."""
    return orphans.orphan_report(_graph(spark, sf, everything=True))


# ---------------------------------------------------------- 2: intervals

TOLERANCE = 60_000_000


def _segments(spark, sf):
    s = table(spark, sf, "recording_segments")
    v = intervals.latest_version(s, "seg_id", "ingested_at", ["session_id", "stream", "start_ts", "end_ts", "acq_created", "acq_closed"])
    return v.select(
        "session_id",
        "stream",
        intervals.micros(F.coalesce("start_ts", "acq_created")).alias("s"),
        intervals.micros(F.coalesce("end_ts", "acq_closed")).alias("e"),
    )


_P2 = """
with v as (select *, row_number() over (partition by seg_id order by ingested_at desc nulls last, start_ts desc nulls last) as rn from recording_segments),
i as (select session_id, stream, epoch_us(coalesce(start_ts, acq_created)) as s, epoch_us(coalesce(end_ts, acq_closed)) as e from v where rn = 1),
o as (select *, max(e) over (partition by session_id, stream order by s, e rows between unbounded preceding and 1 preceding) as pe from i where e > s),
g as (select *, sum(case when pe is null or s > pe + 60000000 then 1 else 0 end) over (partition by session_id, stream order by s, e rows unbounded preceding) as g from o),
p as (select session_id, stream, g, min(s) as start_us, max(e) as end_us from g group by all),
n as (select *, lag(end_us) over (partition by session_id, stream order by start_us) as prev from p)
"""


@query("p2_found", _P2 + "select session_id, stream, 'period' as kind, start_us, end_us from n union all select session_id, stream, 'gap', prev, start_us from n where prev is not null")
def p2_found(spark, sf):
    """Continuous recorded periods per session and stream, and the gaps."""
    p = intervals.merge_runs(_segments(spark, sf), ["session_id", "stream"], "s", "e", TOLERANCE)
    return intervals.periods_and_gaps(p, ["session_id", "stream"]).select("session_id", "stream", "kind", "start_us", "end_us")


@query(
    "p2_coverage",
    _P2 + """select session_id, stream, count(*) as n_periods, cast(sum(end_us - start_us) as bigint) as recorded_us,
    cast(max(end_us) - min(start_us) as bigint) as span_us, cast(coalesce(max(start_us - prev), 0) as bigint) as longest_gap_us from n group by all""",
)
def p2_coverage(spark, sf):
    """Recorded against elapsed time per session and stream."""
    p = intervals.merge_runs(_segments(spark, sf), ["session_id", "stream"], "s", "e", TOLERANCE)
    g = intervals.periods_and_gaps(p, ["session_id", "stream"])
    length = F.col("end_us") - F.col("start_us")
    period, gap = F.col("kind") == "period", F.col("kind") == "gap"
    return g.groupBy("session_id", "stream").agg(
        F.sum(period.cast("long")).alias("n_periods"),
        F.sum(F.when(period, length)).alias("recorded_us"),
        (F.max(F.when(period, F.col("end_us"))) - F.min(F.when(period, F.col("start_us")))).alias("span_us"),
        F.coalesce(F.max(F.when(gap, length)), F.lit(0)).alias("longest_gap_us"),
    )


# -------------------------------------------------------------- 4: drift

TRIAL_FIELDS = {
    "sample": "long",
    "sample_offsets": "long",
    "trial_end": "long",
    "trial_idx": "long",
    "condition_name": "string",
    "resp_accuracy": "string",
    "onset": "double",
    "onset_duration": "double",
}


def _p4_changes(spark, sf):
    t, known = table(spark, sf, "trial_raw"), table(spark, sf, "trial_field_names")
    stats = drift.field_stats(drift.path_values(t, ["series_id", "file_id"]), ["series_id", "file_id"], known)
    return drift.schema_changes(stats, drift.file_order(t, "series_id", "file_id", "written_at"), "series_id", "file_id")


_P4 = r"""
with f as (select series_id, file_id, min(written_at) as w from trial_raw group by all),
o as (select *, row_number() over (partition by series_id order by w, file_id) as no, lead(file_id) over (partition by series_id order by w, file_id) as nxt from f),
k as (select distinct series_id, file_id, payload, unnest(json_keys(payload)) as name from trial_raw),
l as (select *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as plain, json_type(json_extract(payload, '$."' || name || '"')) as jt from k),
m as (select regexp_replace(lower(known_name), '[^a-z0-9]', '', 'g') as plain, min(field) as known from trial_field_names group by all),
s as (select series_id, file_id, coalesce(known, l.plain) as field, string_agg(distinct l.plain, '+' order by l.plain) as names,
        case when max((jt = 'VARCHAR')::int) = 1 then 'text' when max((jt = 'BOOLEAN')::int) = 1 then 'bool' when max((jt = 'DOUBLE')::int) = 1 then 'float' else 'int' end as ty
      from l left join m on l.plain = m.plain group by all),
d as (select s.*, no, nxt, lag(no) over w as pno, lag(names) over w as pn, lag(ty) over w as pt, lead(no) over w as nno
      from s join o using (series_id, file_id) window w as (partition by series_id, field order by no))
select file_id, field, 'added' as change from d where no > 1 and coalesce(pno, 0) <> no - 1
union all select nxt, field, 'removed' from d where nxt is not null and coalesce(nno, 0) <> no + 1
union all select file_id, field, 'renamed' from d where pno = no - 1 and pn <> names
union all select file_id, field, 'retyped' from d where pno = no - 1 and pt <> ty
"""


@query("p4_found", _P4)
def p4_found(spark, sf):
    """Each change between successive files of a series."""
    return _p4_changes(spark, sf).select(F.col("file").alias("file_id"), "field", "change").distinct()


_TYPED = """
u as (select distinct series_id, file_id, line_no, payload from trial_raw),
n as (select series_id, file_id, line_no, payload, unnest(json_keys(payload)) as name, generate_subscripts(json_keys(payload), 1) as pos from u),
v as (select *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as plain, json_extract_string(payload, '$."' || name || '"') as val from n),
kn as (select regexp_replace(lower(known_name), '[^a-z0-9]', '', 'g') as plain, min(field) as known from trial_field_names where field in ({fields}) group by all),
w as (select series_id, file_id, line_no, payload, coalesce(known, v.plain) as f, arg_min(val, pos) as val from v left join kn using (plain) where val is not null group by all),
c as (select *, trim(regexp_replace(val, '\\s*[A-Za-zµ]+\\s*$', '')) as t0 from w),
d as (select *, regexp_replace(case when regexp_matches(t0, '^-?\\d{{1,3}}(,\\d{{3}})+$') then replace(t0, ',', '') else t0 end, '\\.0*$', '') as tl, case when regexp_matches(t0, '^-?\\d+,\\d+$') then replace(t0, ',', '.') else t0 end as td from c),
e as (select *, case when regexp_matches(tl, '^-?\\d{{1,18}}$') then cast(tl as bigint) end as l, case when regexp_matches(td, '^-?\\d+(\\.\\d*)?([eE][+-]?\\d+)?$') then cast(td as double) end as g from d),
ty as (select u.series_id, u.file_id, u.line_no, u.payload, {casts},
  coalesce('{{' || string_agg(case when f not in ({fields}) then '"' || f || '":"' || val || '"' end, ',' order by f) || '}}', '{{}}') as extra, {failed} as failed
  from u left join e using (series_id, file_id, line_no, payload) group by all),
tr as (select distinct series_id, file_id, line_no, {names}, extra, failed from ty)
""".format(
    fields=", ".join(f"'{f}'" for f in TRIAL_FIELDS),
    casts=", ".join(f"max({dict(long='l', double='g', string='val')[t]}) filter (f = '{f}') as {f}" for f, t in TRIAL_FIELDS.items()),
    names=", ".join(TRIAL_FIELDS),
    failed="concat_ws('; ', " + ", ".join(f"max(case when f = '{f}' and {dict(long='l', double='g', string='val')[t]} is null then '{f}=' || val end)" for f, t in TRIAL_FIELDS.items()) + ")",
)


def _typed(spark, sf):
    t, known = table(spark, sf, "trial_raw"), table(spark, sf, "trial_field_names")
    keys = ["series_id", "file_id", "line_no"]
    return drift.typed_rows(drift.path_values(t, keys, once=True), keys, known, TRIAL_FIELDS)


@query("p4_trials", f"with {_TYPED} select * from tr")
def p4_trials(spark, sf):
    """One table of trials: canonical typed fields, other names, failed casts."""
    return _typed(spark, sf).withColumn("failed", F.array_join("failed", "; ")).distinct()


@query("p4_cast_failures", f"with {_TYPED}, x as (select series_id, file_id, unnest(string_split(failed, '; ')) as x from tr where failed <> '') select series_id, file_id, split_part(x, '=', 1) as field, count(*) as n_failed, min(x) as example from x group by all")
def p4_cast_failures(spark, sf):
    """Failed casts per series, file and field."""
    f = _typed(spark, sf).withColumn("failed", F.array_join("failed", "; ")).distinct()
    f = f.select("series_id", "file_id", F.explode(F.split("failed", "; ")).alias("x")).filter("x <> ''")
    return f.groupBy("series_id", "file_id", F.substring_index("x", "=", 1).alias("field")).agg(F.count(F.lit(1)).alias("n_failed"), F.min("x").alias("example"))
