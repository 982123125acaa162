"""Name and position queries over ``contacts``, the recorded rows and ``timing``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import naming as N
from ..operators import space as S
from ..operators.quantiles import group_quantiles
from ..session import table
from .registry import query

_EK = K.entity_key_sql


def contacts(spark, sf):
    """One row per patient and name key: the latest registration."""
    c = table(spark, sf, "contacts").select(K.entity_key(F.col("patient")).alias("patient"), K.entity_key(F.col("name")).alias("contact"), K.entity_key(F.col("name_raw")).alias("raw"), "hemi", "x", "y", "z", "is_wm", F.col("yeo7_network").alias("network"), "added_at")
    cols = ["raw", "hemi", "x", "y", "z", "is_wm", "network", "added_at"]
    return c.groupBy("patient", "contact").agg(F.max(F.struct(F.coalesce(F.unix_micros(F.col("added_at").cast("timestamp")), F.lit(-1)).alias("o"), *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"s_{k}") for k in ("x", "y", "z", "hemi", "network", "raw", "is_wm")], *cols)).alias("b")).select("patient", "contact", *[f"b.{k}" for k in cols])


_CON = f"""c0 as (select {_EK('patient')} as patient, {_EK('name')} as contact, {_EK('name_raw')} as raw, hemi, x, y, z, is_wm, yeo7_network as network, added_at from contacts),
con as (select patient, contact, raw, hemi, x, y, z, is_wm, network, added_at from (select *, row_number() over (partition by patient, contact order by coalesce(epoch_us(added_at), -1) desc, coalesce(x::varchar, '') desc, coalesce(y::varchar, '') desc, coalesce(z::varchar, '') desc, coalesce(hemi, '') desc, coalesce(network, '') desc, coalesce(raw, '') desc, coalesce(is_wm::varchar, '') desc) as rn from c0) where rn = 1)"""


def recorded(spark, sf):
    """Recorded rows once per rec_id, with both keys."""
    r = table(spark, sf, "name_match_unmatched_recorded").groupBy("rec_id").agg(F.max(F.struct("ingested_at", "patient_id", "electrode", "norm", "excluded_patient", "filtered", "n_high")).alias("b")).select("rec_id", "b.*")
    return r.select("rec_id", K.entity_key(F.col("patient_id")).alias("patient"), K.entity_key(F.col("electrode")).alias("contact"), K.entity_key(F.col("norm")).alias("raw"), "excluded_patient", "filtered", "n_high", "ingested_at")


_REC = f"""rec as (select rec_id, {_EK('patient_id')} as patient, {_EK('electrode')} as contact, {_EK('norm')} as raw, excluded_patient, filtered, n_high, ingested_at
  from (select *, row_number() over (partition by rec_id order by ingested_at desc, patient_id desc, electrode desc, norm desc) as rn from name_match_unmatched_recorded) where rn = 1)"""


@query("label_normalise", f"select distinct name, upper(regexp_replace(name, '[_-]', '', 'g')) as lenient, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') as strict, {_EK('name')} as key from contacts")
def label_normalise(spark, sf):
    """The lenient, the strict and the key form of every name."""
    n = F.col("name")
    return table(spark, sf, "contacts").select("name", K.label_key(n).alias("lenient"), K.strict_key(n).alias("strict"), K.entity_key(n).alias("key")).distinct()


@query("canonical_label", r"""with t as (select distinct patient, patient || '_' || name || '+' as label from contacts where patient is not null and name is not null), b as (select *, regexp_replace(upper(trim(label)), '[^A-Z0-9+-]', '', 'g') as bare, regexp_replace(upper(patient), '[^A-Z0-9]', '', 'g') as p from t)
  select patient, label, regexp_replace(regexp_replace(case when starts_with(bare, p) then substr(bare, length(p) + 1) else bare end, '[+-]+$', ''), '[^A-Z0-9]', '', 'g') as canonical from b""")
def canonical_label(spark, sf):
    """Labels without patient prefix, polarity and separators."""
    t = table(spark, sf, "contacts").dropna(subset=["patient", "name"]).select("patient", F.concat("patient", F.lit("_"), "name", F.lit("+")).alias("label")).distinct()
    return t.select("patient", "label", K.canonical_label(F.col("label"), F.col("patient")).alias("canonical"))


@query("shaft_split", rf"with n as (select distinct {_EK('name')} as key from contacts) select key, regexp_extract(key, '^(.*?)\d*$', 1) as shaft, cast(nullif(regexp_extract(key, '(\d{{1,9}})$', 1), '') as int) as number from n")
def shaft_split(spark, sf):
    k = F.col("key")
    return table(spark, sf, "contacts").select(K.entity_key(F.col("name")).alias("key")).distinct().select("key", K.shaft(k).alias("shaft"), K.contact_number(k).alias("number"))


@query("condition_canonical", "with t as (select distinct event_type from events union select upper(event_type) || '_block' from events) select event_type, case when lower(trim(event_type)) = 'click' then 'picture' when starts_with(lower(trim(event_type)), 'view') then 'reading' when starts_with(lower(trim(event_type)), 'err') then 'audio' else event_type end as condition from t")
def condition_canonical(spark, sf):
    """Conditions by table, then by prefix, else unchanged."""
    e = table(spark, sf, "events").select("event_type").distinct()
    e = e.union(e.select(F.concat(F.upper("event_type"), F.lit("_block")))).distinct()
    return e.select("event_type", K.canonical_condition(F.col("event_type"), {"click": "picture"}, {"view": "reading", "err": "audio"}).alias("condition"))


@query("patient_centre", "select case when upper(trim(patient_id)) like 'EL%' then 'EL' when upper(trim(patient_id)) like 'PAT%' then 'PAT' when upper(trim(patient_id)) like 'MICRO%' then 'MICRO' else 'OTHER' end as centre, count(distinct patient_no) as n from patients where patient_id is not null group by all")
def patient_centre(spark, sf):
    p = table(spark, sf, "patients").dropna(subset=["patient_id"]).select("patient_no", K.centre(F.col("patient_id")).alias("centre")).distinct()
    return p.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))


@query("file_name_parts", r"with f as (select distinct file_name from trial_raw where file_name is not null) select file_name, regexp_extract(file_name, '^([A-Za-z_]+\d+)_', 1) as patient, cast(nullif(regexp_extract(file_name, '_(\d+)\.', 1), '') as int) as split_no, regexp_extract(file_name, '\.([a-z0-9]+)$', 1) as extension from f")
def file_name_parts(spark, sf):
    """Patient, split number and extension out of file names."""
    n = F.col("file_name")
    f = table(spark, sf, "trial_raw").select("file_name").dropna().distinct()
    return f.select("file_name", F.regexp_extract(n, r"^([A-Za-z_]+\d+)_", 1).alias("patient"), F.nullif(F.regexp_extract(n, r"_(\d+)\.", 1), F.lit("")).cast("int").alias("split_no"), F.regexp_extract(n, r"\.([a-z0-9]+)$", 1).alias("extension"))


@query("stream_kind", "select session_id, case when bool_or(family like '%micro%' or family like 'csc%') and bool_or(family like 'lead%') then 'both' when bool_or(family like '%micro%' or family like 'csc%') then 'micro' else 'macro' end as kind, count(distinct family) as n_families from recording_segments group by all")
def stream_kind(spark, sf):
    """Kind of a session by the families of its files."""
    micro = F.bool_or(F.col("family").contains("micro") | F.col("family").startswith("csc"))
    macro = F.bool_or(F.col("family").startswith("lead"))
    f = table(spark, sf, "recording_segments").groupBy("session_id").agg(micro.alias("a"), macro.alias("b"), F.count_distinct("family").alias("n_families"))
    return f.select("session_id", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "micro").otherwise("macro").alias("kind"), "n_families")


@query("non_neural_channels", f"select upper(trim(electrode)) as label, regexp_matches(upper(trim(electrode)), '{K.NON_NEURAL.replace('+', '[+]').replace(chr(92), '')}') as non_neural, count(distinct entry_id) as n from name_match_candidates where electrode is not null group by all")
def non_neural_channels(spark, sf):
    c = table(spark, sf, "name_match_candidates").dropna(subset=["electrode"]).select(F.upper(F.trim("electrode")).alias("label"), "entry_id").distinct()
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", K.non_neural(F.col("label")).alias("non_neural"), "n")


@query("hemisphere_mirror", f"with {_CON} select patient, contact, case when x < 0 then 'L' when x >= 0 then 'R' end as side, round(-abs(x), 3) as mirrored, case when x is null or hemi is null then null else (x < 0) <> (upper(substr(hemi, 1, 1)) = 'L') end as disagrees from con")
def hemisphere_mirror(spark, sf):
    """Side from x, the coordinate mirrored to one side, and codes that disagree."""
    x = F.col("x")
    bad = F.when(x.isNull() | F.col("hemi").isNull(), None).otherwise((x < 0) != (F.upper(F.substring("hemi", 1, 1)) == "L"))
    return contacts(spark, sf).select("patient", "contact", F.when(x < 0, "L").when(x >= 0, "R").alias("side"), F.round(-F.abs(x), 3).alias("mirrored"), bad.alias("disagrees"))


_AFF = ((0.9975, -0.0073, 0.0176, -0.0429), (0.0146, 1.0009, -0.0024, 1.5496), (-0.0130, -0.0093, 0.9971, 1.1840))


@query("affine_positions", f"with {_CON} select patient, contact, " + ", ".join(f"round(x * {r[0]}::double + y * {r[1]}::double + z * {r[2]}::double + {r[3]}::double, 6) as {n}" for r, n in zip(_AFF, ("tx", "ty", "tz"), strict=True)) + " from con")
def affine_positions(spark, sf):
    return contacts(spark, sf).select("patient", "contact", *[F.round(c, 6).alias(n) for c, n in zip(S.affine(_AFF), ("tx", "ty", "tz"), strict=True)])


def _matched(spark, sf):
    return N.match_flags(recorded(spark, sf), contacts(spark, sf), ["patient"], "contact", "raw", "contact", "raw")


_MF = f"""{_CON}, {_REC}, mf as (select r.*, coalesce(r.contact in (select contact from con where con.patient = r.patient and contact <> ''), false) as by_key,
  coalesce(r.raw in (select raw from con where con.patient = r.patient and raw <> ''), false) as by_raw from rec r)"""


@query("match_report", f"with {_MF}, a as (select patient, count(*) as n_recorded, count(*) filter (by_key) as n_matched, count(*) filter (not by_key and by_raw) as n_raw_only, count(*) filter (not by_key and not by_raw) as n_unmatched from mf group by all), b as (select patient, count(*) as n_contacts from con group by all) select patient, coalesce(n_recorded, 0) as n_recorded, coalesce(n_matched, 0) as n_matched, coalesce(n_raw_only, 0) as n_raw_only, coalesce(n_unmatched, 0) as n_unmatched, coalesce(n_contacts, 0) as n_contacts from a full join b using (patient)")
def match_report(spark, sf):
    """Per patient what is recorded, matched, matched by the raw name alone, unmatched, registered."""
    m = _matched(spark, sf)
    one = lambda c: F.count(F.when(c, 1))
    k, r = F.col("by_key"), F.col("by_fallback")
    a = m.groupBy("patient").agg(F.count(F.lit(1)).alias("n_recorded"), one(k).alias("n_matched"), one(r).alias("n_raw_only"), one(~k & ~r).alias("n_unmatched"))
    b = contacts(spark, sf).groupBy(F.col("patient").alias("p")).agg(F.count(F.lit(1)).alias("n_contacts"))
    j = a.join(b, F.col("patient") == F.col("p"), "full")
    return j.select(F.coalesce("patient", "p").alias("patient"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_recorded", "n_matched", "n_raw_only", "n_unmatched", "n_contacts")])


_NUM = r"cast(nullif(regexp_extract({c}, '(\d{{1,9}})$', 1), '') as int)"


@query(
    "alias_candidates",
    f"""with {_MF}, u as (select distinct patient, contact, {_NUM.format(c='contact')} as number from mf where not by_key and not by_raw and contact <> ''), n as (select distinct patient, contact as name, {_NUM.format(c='contact')} as number from con where contact <> ''),
    s as (select u.patient, u.number, u.contact, n.name, 1 - levenshtein(u.contact, n.name) / greatest(length(u.contact), length(n.name)) as sim from u join n using (patient, number)),
    r as (select *, row_number() over (partition by patient, number, contact order by sim desc, name) as no from s) select patient, number, contact, name, round(sim, 6) as similarity, no from r where no <= 3""",
)
def alias_candidates(spark, sf):
    """The three most similar registered names for every unmatched recorded one."""
    m = _matched(spark, sf).filter("not by_key and not by_fallback and contact <> ''").withColumn("number", K.contact_number(F.col("contact")))
    n = contacts(spark, sf).filter("contact <> ''").select("patient", F.col("contact").alias("name"), K.contact_number(F.col("contact")).alias("number"))
    c = N.candidates(m.dropna(subset=["number"]), n.dropna(subset=["number"]), ["patient", "number"], "contact", "name", 3)
    return c.select("patient", "number", "contact", "name", F.round("similarity", 6).alias("similarity"), F.col("no").cast("long").alias("no"))


_ALIAS = (("HIPPANTL", "HANTL"), ("HIPPANTR", "HANTR"), ("INSDORSR", "IDR"))


@query("alias_left_join", rf"with {_REC}, al(shaft, alias) as (values {', '.join(map(str, _ALIAS))}), r as (select rec_id, regexp_extract(contact, '^(.*?)\d*$', 1) as shaft, {_NUM.format(c='contact')} as number from rec) select rec_id, coalesce(alias, r.shaft) || coalesce(number::varchar, '') as label from r left join al using (shaft)")
def alias_left_join(spark, sf):
    """Shafts renamed by a table, the contact number kept."""
    al = spark.createDataFrame(list(_ALIAS), "shaft string, alias string")
    r = recorded(spark, sf).select("rec_id", K.shaft(F.col("contact")).alias("shaft"), K.contact_number(F.col("contact")).alias("number"))
    return r.join(F.broadcast(al), "shaft", "left").select("rec_id", F.concat(F.coalesce("alias", "shaft"), F.coalesce(F.col("number").cast("string"), F.lit(""))).alias("label"))


@query("channel_order", rf"with {_REC}, r as (select patient, contact, min(rec_id) as pos from rec group by all), s as (select *, regexp_extract(contact, '^(.*?)\d*$', 1) as shaft, {_NUM.format(c='contact')} as number from r), f as (select *, min(pos) over (partition by patient, shaft) as first from s) select patient, contact, row_number() over (partition by patient order by first, number nulls last, contact) as no from f")
def channel_order(spark, sf):
    """Shafts by first appearance, contacts by number."""
    s = recorded(spark, sf).groupBy("patient", "contact").agg(F.min("rec_id").alias("pos")).withColumn("shaft", K.shaft(F.col("contact"))).withColumn("number", K.contact_number(F.col("contact")))
    f = s.withColumn("first", F.min("pos").over(W.partitionBy("patient", "shaft")))
    w = W.partitionBy("patient").orderBy("first", F.col("number").asc_nulls_last(), "contact")
    return f.select("patient", "contact", F.row_number().over(w).cast("long").alias("no"))


@query("exclusion_roster", f"with {_REC}, x as (select patient, 'excluded' as reason from rec where excluded_patient union all select patient, 'filtered' from rec where filtered union all select patient, 'no_high' from rec group by patient having max(n_high) = 0 union all select patient, 'unknown_id' from rec where patient not in (select {_EK('patient_id')} from patients where patient_id is not null)) select patient, string_agg(distinct reason, ';' order by reason) as reasons from x where patient is not null group by all")
def exclusion_roster(spark, sf):
    """Every rule that names a patient, one row per patient."""
    r = recorded(spark, sf).dropna(subset=["patient"])
    known = table(spark, sf, "patients").select(K.entity_key(F.col("patient_id")).alias("patient")).dropna().distinct()
    say = lambda d, why: d.select("patient", F.lit(why).alias("reason"))
    x = say(r.filter("excluded_patient"), "excluded").union(say(r.filter("filtered"), "filtered"))
    x = x.union(say(r.groupBy("patient").agg(F.max("n_high").alias("m")).filter("m = 0"), "no_high")).union(say(r.select("patient").distinct().join(known, "patient", "left_anti"), "unknown_id"))
    return x.distinct().groupBy("patient").agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"))


@query("cohort_version_diff", f"with {_REC}, o as (select patient, count(*) as n from rec where ingested_at < timestamp '2025-01-01' group by all), w as (select patient, count(*) as n from rec group by all) select coalesce(o.patient, w.patient) as patient, coalesce(o.n, 0) as n_old, coalesce(w.n, 0) as n_new, coalesce(w.n, 0) - coalesce(o.n, 0) as delta from o full join w on o.patient = w.patient")
def cohort_version_diff(spark, sf):
    """Counts per patient of an older and the present state, and their difference."""
    r = recorded(spark, sf)
    o = r.filter(F.col("ingested_at") < F.lit("2025-01-01").cast("timestamp_ntz")).groupBy("patient").agg(F.count(F.lit(1)).alias("a"))
    w = r.groupBy(F.col("patient").alias("p")).agg(F.count(F.lit(1)).alias("b"))
    z = F.lit(0).cast("long")
    j = o.join(w, F.col("patient") == F.col("p"), "full")
    a, b = F.coalesce("a", z), F.coalesce("b", z)
    return j.select(F.coalesce("patient", "p").alias("patient"), a.alias("n_old"), b.alias("n_new"), (b - a).alias("delta"))


_TIM = f"tim as (select timing_id, {_EK('patient_id')} as patient, {_EK('electrode')} as contact, condition_name, onset_lat, computed_at from (select *, row_number() over (partition by timing_id order by ingested_at desc) as rn from timing) where rn = 1)"


def timings(spark, sf):
    b = F.max_by(F.struct("patient_id", "electrode", "condition_name", "onset_lat", "computed_at"), "ingested_at").alias("b")
    return table(spark, sf, "timing").groupBy("timing_id").agg(b).select("timing_id", K.entity_key(F.col("b.patient_id")).alias("patient"), K.entity_key(F.col("b.electrode")).alias("contact"), "b.condition_name", "b.onset_lat", "b.computed_at")


@query(
    "timing_joined",
    f"""with {_CON}, {_REC}, {_TIM}, d as (select patient, condition_name, count(*) as n_cond from tim where condition_name is not null group by all), h as (select patient, contact, max(n_high) as n_high from rec group by all)
    select timing_id, coalesce(network, 'unknown') as region, con.patient is not null as has_contact, h.n_high as n_high, d.n_cond as n_cond, round(con.x, 3) as x from tim left join con using (patient, contact) left join h using (patient, contact) left join d using (patient, condition_name)""",
)
def timing_joined(spark, sf):
    """Timing rows with region, gate and condition counts: three left joins, hot patients salted."""
    from ..functions.skew import SALT, salted

    t = timings(spark, sf)
    c = contacts(spark, sf).select("patient", "contact", "network", "x", F.lit(True).alias("there"))
    h = recorded(spark, sf).groupBy("patient", "contact").agg(F.max("n_high").alias("n_high"))
    d = t.dropna(subset=["condition_name"]).groupBy("patient", "condition_name").agg(F.count(F.lit(1)).alias("n_cond"))
    both = c.join(h, ["patient", "contact"], "full")
    l, both = salted(t, both, ["patient", "contact"], F.col("timing_id"))
    j = l.join(both, ["patient", "contact", SALT], "left").drop(SALT)
    l, d = salted(j, d, ["patient", "condition_name"], F.col("timing_id"))
    j = l.join(d, ["patient", "condition_name", SALT], "left")
    return j.select("timing_id", F.coalesce("network", F.lit("unknown")).alias("region"), F.coalesce("there", F.lit(False)).alias("has_contact"), "n_high", "n_cond", F.round("x", 3).alias("x"))


@query("label_match_rate", f"with {_CON}, {_TIM}, j as (select tim.condition_name, coalesce(network, 'unknown') as region from tim left join con using (patient, contact)) select condition_name, count(*) as n, round(avg((region = 'unknown')::int), 9) as unknown_share, avg((region = 'unknown')::int) > 0.3 as warn from j group by all")
def label_match_rate(spark, sf):
    """Share of rows without a region, with the warning level."""
    j = timing_joined(spark, sf).select("timing_id", "region").join(timings(spark, sf).select("timing_id", "condition_name"), "timing_id")
    u = F.avg((F.col("region") == "unknown").cast("double"))
    return j.groupBy("condition_name").agg(F.count(F.lit(1)).alias("n"), F.round(u, 9).alias("unknown_share"), (u > 0.3).alias("warn"))


@query("stale_outputs", f"with {_CON}, {_TIM}, n as (select patient, max(added_at) as newest from con group by all) select patient, count(*) as n, count(*) filter (computed_at < newest) as n_stale from tim join n using (patient) group by all")
def stale_outputs(spark, sf):
    """Outputs older than the newest registration of their patient."""
    n = contacts(spark, sf).groupBy("patient").agg(F.max("added_at").alias("newest"))
    return timings(spark, sf).join(n, "patient").groupBy("patient").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("computed_at") < F.col("newest"), 1)).alias("n_stale"))


@query("tree_legality", f"with {_CON}, {_TIM} select distinct tim.patient, tim.contact from tim where not exists (select 1 from con where con.patient = tim.patient and con.contact = tim.contact) and tim.patient is not null and tim.contact is not null")
def tree_legality(spark, sf):
    """What is there but would not be written now."""
    return timings(spark, sf).select("patient", "contact").dropna().distinct().join(contacts(spark, sf), ["patient", "contact"], "left_anti")


@query("run_labels_outer", "with c as (select distinct * from cluster_patients), a as (select cluster_no, max(n) as n from c where feature_set = 'concat_hg' group by all), b as (select cluster_no, max(n) as n from c where feature_set = 'concat_bands' group by all) select coalesce(a.cluster_no, b.cluster_no) as cluster_no, a.n as n_hg, b.n as n_bands from a full join b on a.cluster_no = b.cluster_no")
def run_labels_outer(spark, sf):
    """Label tables of several runs merged by full outer joins."""
    c = table(spark, sf, "cluster_patients").distinct()
    of = lambda f, n: c.filter(F.col("feature_set") == f).groupBy("cluster_no").agg(F.max("n").alias(n))
    return of("concat_hg", "n_hg").join(of("concat_bands", "n_bands"), "cluster_no", "full")


@query("newest_run", "select feature_set, k, max(run_id) as run_id from cluster_patients group by all")
def newest_run(spark, sf):
    return table(spark, sf, "cluster_patients").groupBy("feature_set", "k").agg(F.max("run_id").alias("run_id"))


@query("json_round_trip", "select seg_id, session_id as s, epoch_us(min(start_ts)) as t from recording_segments where start_ts is not null group by all")
def json_round_trip(spark, sf):
    """Typed rows written as JSON and read back."""
    r = table(spark, sf, "recording_segments").dropna(subset=["start_ts"]).groupBy("seg_id", "session_id").agg(F.min(F.unix_micros(F.col("start_ts").cast("timestamp"))).alias("t"))
    j = r.select("seg_id", F.to_json(F.struct(F.col("session_id").alias("s"), "t")).alias("j"))
    return j.select("seg_id", F.from_json("j", "s string, t long").alias("x")).select("seg_id", "x.s", "x.t")


# -------------------------------------------------------------- positions

_VX = "vx as (select i * 20.0::double as cx, j * 20.0::double as cy, k * 20.0::double as cz from (select unnest(range(-4, 5)) as i), (select unnest(range(-4, 4)) as j), (select unnest(range(-2, 3)) as k))"


def vertices(spark):
    """A fixed lattice as stand-in for a surface: 9 x 8 x 5 points."""
    ax = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    d = spark.range(1).select(ax(-4, 4).alias("i")).select("i", ax(-4, 3).alias("j")).select("i", "j", ax(-2, 2).alias("k"))
    return d.select((F.col("i") * 20.0).alias("cx"), (F.col("j") * 20.0).alias("cy"), (F.col("k") * 20.0).alias("cz"))


_D = "sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))"


@query("vertex_counts", f"with {_CON}, {_VX} select cx, cy, cz, count(*) as n_contacts, count(distinct patient) as n_patients from con join vx on {_D} <= 12 group by all")
def vertex_counts(spark, sf):
    """Contacts and patients within 12 mm of each vertex."""
    j = S.within(contacts(spark, sf).select("patient", "x", "y", "z"), vertices(spark), 12.0)
    p = j.groupBy("cx", "cy", "cz", "patient").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("cx", "cy", "cz").agg(F.sum("n").alias("n_contacts"), F.count(F.lit(1)).alias("n_patients"))


@query("surface_projection", f"with {_CON}, {_VX}, e as (select cx, cy, cz, exp(-({_D} * {_D}) / (2 * 36)) as w, length(contact) as v from con join vx on {_D} <= 12) select cx, cy, cz, round(sum(w * v) / sum(w), 6) as value from e group by all")
def surface_projection(spark, sf):
    """Values spread to the vertices with Gaussian weights within a radius."""
    j = S.within(contacts(spark, sf).select(F.length("contact").alias("v"), "x", "y", "z"), vertices(spark), 12.0)
    w = F.exp(-(F.col("d") ** 2) / (2 * 36))
    return j.groupBy("cx", "cy", "cz").agg(F.round(F.sum(w * F.col("v")) / F.sum(w), 6).alias("value"))


@query("nearest_vertex", f"with {_CON}, {_VX}, r as (select patient, contact, cx, cy, cz, {_D} as d, row_number() over (partition by patient, contact order by {_D}, cx, cy, cz) as rn from con join vx on {_D} <= 18) select patient, contact, cx, cy, cz, round(d, 6) as d from r where rn = 1")
def nearest_vertex(spark, sf):
    """Each contact's nearest vertex (no lattice point is farther than 18 mm inside it)."""
    j = S.within(contacts(spark, sf).select("patient", "contact", "x", "y", "z"), vertices(spark), 18.0)
    b = j.groupBy("patient", "contact").agg(F.min(F.struct("d", "cx", "cy", "cz")).alias("b"))
    return b.select("patient", "contact", "b.cx", "b.cy", "b.cz", F.round("b.d", 6).alias("d"))


@query(
    "knn_other_patients",
    f"""with {_CON}, p as (select * from con where x is not null and y is not null and z is not null), r as (select a.patient, a.contact, a.network, b.network as other, row_number() over (partition by a.patient, a.contact order by sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), b.patient, b.contact) as rn
      from p a join p b on a.patient <> b.patient and abs(a.x - b.x) <= 9 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 9)
    select network, count(*) as n, round(avg((network = other)::int), 9) as same_share from r where rn <= 3 and network is not null and other is not null group by all""",
)
def knn_other_patients(spark, sf):
    """Share of the three nearest neighbours of other patients (within 9 mm) with the same region."""
    r = S.nearest_others(contacts(spark, sf), "patient", "contact", "network", 3, 9.0).filter("network is not null and other is not null")
    return r.groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("network") == F.col("other")).cast("double")), 9).alias("same_share"))


@query("other_patients_within", f"with {_CON} select a.patient, a.contact, count(distinct b.patient) as n_others from con a join con b on a.patient <> b.patient and abs(a.x - b.x) <= 6 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 6 group by all")
def other_patients_within(spark, sf):
    """Other patients with a contact within 6 mm."""
    return S.other_owners(contacts(spark, sf), "patient", "contact", 6.0).withColumnRenamed("n", "n_others")


@query(
    "compactness",
    f"""with {_CON}, p as (select network, -abs(x) as x, y, z from con where x is not null and y is not null and z is not null and network is not null), c as (select network, avg(x) as cx, avg(y) as cy, avg(z) as cz from p group by all), d as (select network, {_D} as d from p join c using (network))
    select network, count(*) as n, round(avg(d), 6) as mean_d, round(median(d), 6) as median_d, round(max(d), 6) as max_d from d group by all""",
)
def compactness(spark, sf):
    """Distance of a region's contacts to its centre, mirrored to one side."""
    p = contacts(spark, sf).dropna(subset=["x", "y", "z", "network"]).select("network", (-F.abs("x")).alias("x"), "y", "z")
    c = p.groupBy("network").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    d = p.join(F.broadcast(c), "network").select("network", S.distance("x", "y", "z", "cx", "cy", "cz").alias("d"))  # one row a region
    a = d.groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean_d"), F.round(F.max("d"), 6).alias("max_d"))
    return a.join(group_quantiles(d, ["network"], F.col("d"), {"m": 0.5}).select("network", F.round("m", 6).alias("median_d")), "network")


@query("voxel_stamping", f"with {_CON}, s as (select patient, unnest(range(ceil((x - 6) / 8)::int, floor((x + 6) / 8)::int + 1)) as i, y, z from con), t as (select patient, i, unnest(range(ceil((y - 6) / 8)::int, floor((y + 6) / 8)::int + 1)) as j, z from s), u as (select patient, i, j, unnest(range(ceil((z - 6) / 8)::int, floor((z + 6) / 8)::int + 1)) as k from t) select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, count(*) as n, count(distinct patient) as n_patients from u group by all having count(*) >= 2")
def voxel_stamping(spark, sf):
    """Lattice points (8 mm) with the contacts whose 12 mm cube covers them."""
    d = contacts(spark, sf).dropna(subset=["x", "y", "z"])
    for a, n in (("x", "i"), ("y", "j"), ("z", "k")):
        d = d.withColumn(n, F.explode(S.lattice_points(a, 8.0, 12.0)))
    p = d.groupBy("i", "j", "k", "patient").agg(F.count(F.lit(1)).alias("c"))
    return p.groupBy("i", "j", "k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_patients")).filter("n >= 2")


@query("volume_lookup", f"with {_CON}, v as (select unnest(range(0, 8)) as i, 1 as one), vol as (select a.i, b.i as j, (a.i * 8 + b.i) as tissue from v a join v b using (one)) select patient, contact, cast(tissue as int) as tissue from (select *, floor((x + 60) / 15)::bigint as i, floor((y + 60) / 15)::bigint as j from con) left join vol using (i, j)")
def volume_lookup(spark, sf):
    """Value of the voxel a contact lies in, null outside the volume."""
    vol = spark.range(64).select((F.col("id") / 8).cast("long").alias("i"), (F.col("id") % 8).alias("j"), F.col("id").cast("int").alias("tissue"))
    c = contacts(spark, sf).withColumn("i", F.floor((F.col("x") + 60) / 15)).withColumn("j", F.floor((F.col("y") + 60) / 15))
    return c.join(F.broadcast(vol), ["i", "j"], "left").select("patient", "contact", "tissue")


@query("shaft_depth", rf"with {_CON}, s as (select patient, contact, regexp_extract(contact, '^(.*?)\d*$', 1) as shaft, {_NUM.format(c='contact')} as number, x, y, z from con where x is not null and y is not null and z is not null), d as (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 + (z - lag(z) over w) ** 2), 0) as step from s where number is not null window w as (partition by patient, shaft order by number, contact)) select patient, contact, round(sum(step) over (partition by patient, shaft order by number, contact), 6) as depth from d")
def shaft_depth(spark, sf):
    """Running distance along a shaft."""
    s = contacts(spark, sf).dropna(subset=["x", "y", "z"]).withColumn("shaft", K.shaft(F.col("contact"))).withColumn("number", K.contact_number(F.col("contact"))).filter("number is not null")
    w = W.partitionBy("patient", "shaft").orderBy("number", "contact")
    step = F.coalesce(S.distance("x", "y", "z", F.lag("x").over(w), F.lag("y").over(w), F.lag("z").over(w)), F.lit(0.0))
    return s.withColumn("step", step).select("patient", "contact", F.round(F.sum("step").over(w), 6).alias("depth"))


@query("tissue_fraction", f"with {_CON}, n as (select a.patient, a.contact, avg(b.is_wm) as wm, count(*) as n from con a join con b on abs(a.x - b.x) <= 5 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 5 group by all) select patient, contact, n, round(wm, 9) as white_share from n")
def tissue_fraction(spark, sf):
    """Share of white matter among the samples within 5 mm of a contact."""
    c = contacts(spark, sf)
    q = c.select("patient", "contact", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    j = S.within(c.select("is_wm", "x", "y", "z"), q, 5.0)
    return j.groupBy("patient", "contact").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("is_wm"), 9).alias("white_share"))
