"""Label queries over ``embeddings`` (clusters), ``cluster_patients`` and ``contacts``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import ranks as R
from ..functions.keyed import uniform, uniform_sql
from ..operators import clusters as C
from ..operators.quantiles import group_quantiles
from ..session import table
from .maps import BANDS, BINS, EM, maps
from .registry import query

LB = EM + ", lb as (select vec_id, electrode, condition, patient, label, arg_max(band, (s, -band)) as lead from (select vec_id, electrode, condition, patient, label, band, sum(v) as s from cl group by all) group by all)"


def leads(spark, sf):
    """maps with ``lead``, the band with the greatest sum."""
    w = F.array(*[A.total(A.band(F.col("a"), b, BINS)) for b in range(BANDS)])
    return maps(spark, sf).withColumn("lead", A.let(w, A.argmax))


@query("centroids", f"with {EM} select label, band * 16 + bin as pos, round(avg(v), 6) as m, count(*) as n from cl group by all")
def centroids(spark, sf):
    c = C.centroids(maps(spark, sf), ["label"], "a")
    return c.select("label", "n", F.posexplode("c").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("m"), "n")


@query("weighted_centroids", f"with {EM}, w as (select vec_id, greatest(sum(v), 0.01) as w from cl group by all) select label, band * 16 + bin as pos, round(sum(v * w) / sum(w), 6) as m from cl join w using (vec_id) group by all")
def weighted_centroids(spark, sf):
    """Centroids weighted by each member's loading."""
    m = maps(spark, sf).withColumn("w", F.greatest(A.total(F.col("a")), F.lit(0.01)))
    return C.centroids(m, ["label"], "a", "w").select("label", F.posexplode("c").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("m"))


@query("cluster_sizes", f"with {EM} select label, count(*) as n, count(distinct patient) as n_patients, count(distinct case when patient < 4 then 'EL' when patient < 8 then 'PAT' else 'MICRO' end) as n_centres from em group by all")
def cluster_sizes(spark, sf):
    """Members, patients and centres of each cluster."""
    centre = F.when(F.col("patient") < 4, "EL").when(F.col("patient") < 8, "PAT").otherwise("MICRO")
    p = maps(spark, sf).groupBy("label", "patient").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_patients"), F.size(F.collect_set(centre)).cast("long").alias("n_centres"))


_CEN = ", cen as (select label, pos, avg(v) as c from (select *, band * 16 + bin as pos from cl) group by all), sz as (select label, count(*) as n from em group by all)"


@query(
    "silhouette",
    f"""with {EM}{_CEN}, q as (select vec_id, label, sum(v * v) as q from cl group by all), mq as (select label, avg(q) as mq from q group by all),
    xc as (select cl.vec_id, cen.label as cl2, sum(v * c) as d from cl join cen on cen.pos = cl.band * 16 + cl.bin group by all),
    f as (select vec_id, q.label as own, xc.cl2, q.q - 2 * xc.d + mq.mq as d, sz.n from xc join q using (vec_id) join mq on mq.label = xc.cl2 join sz on sz.label = xc.cl2),
    s as (select vec_id, own as label, max(case when own = cl2 then d * n / nullif(n - 1, 0) end) as a, min(case when own <> cl2 then d end) as b, max(case when own = cl2 then n end) as n from f group by all)
    select vec_id, label, round(case when n <= 1 then 0 else (b - a) / greatest(a, b) end, 6) as s from s""",
)
def silhouette(spark, sf):
    """Silhouette of every item with squared distances, in closed form."""
    return C.squared_silhouette(maps(spark, sf), "vec_id", "label", "a").select("vec_id", "label", F.round("s", 6).alias("s"))


@query(
    "cluster_dispersion",
    f"""with {EM}{_CEN}, g as (select pos, avg(v) as g from (select *, band * 16 + bin as pos from cl) group by all),
    r as (select vec_id, cl.label, sum((v - c) * (v - c)) as r2 from cl join cen on cen.label = cl.label and cen.pos = cl.band * 16 + cl.bin group by all),
    s as (select label, avg(sqrt(r2)) as spread, sum(r2) as within from r group by all),
    b as (select label, sum((c - g) * (c - g)) as d2 from cen join g using (pos) group by all),
    p as (select a.label as a, b.label as b, sqrt(sum((a.c - b.c) * (a.c - b.c))) as d from cen a join cen b using (pos) where a.label <> b.label group by all),
    w as (select p.a, max((x.spread + y.spread) / d) as w from p join s x on x.label = p.a join s y on y.label = p.b group by all),
    t as (select count(*) as k, cast(sum(n) as bigint) as n, sum(within) as within, sum(n * d2) as between from s join sz using (label) join b using (label))
    select k, n, round(within, 6) as within, round(between, 6) as between, round((between / (k - 1)) / (within / (n - k)), 6) as calinski, round((select avg(w) from w), 6) as davies from t""",
)
def cluster_dispersion(spark, sf):
    """Calinski-Harabasz and Davies-Bouldin of the labels."""
    d = C.dispersion(maps(spark, sf), "label", "a")
    return d.select("k", "n", *[F.round(c, 6).alias(c) for c in ("within", "between", "calinski", "davies")])


_CO = LB + ", co as (select label as a, lead as b, count(*) as n from lb group by all), ra as (select a, sum(n) as n from co group by all), rb as (select b, sum(n) as n from co group by all)"


@query("contingency", f"with {_CO} select a, b, n from co")
def contingency(spark, sf):
    return C.contingency(leads(spark, sf), "label", "lead")


@query("crosstab", f"with {LB} select label, {', '.join(f'count(*) filter (lead = {b}) as b{b}' for b in range(4))} from lb group by all")
def crosstab(spark, sf):
    d = leads(spark, sf).groupBy("label").pivot("lead", list(range(BANDS))).count()
    return d.select("label", *[F.coalesce(str(b), F.lit(0).cast("long")).alias(f"b{b}") for b in range(BANDS)])


@query(
    "cluster_agreement",
    f"""with {_CO}, t as (select (select sum(n * (n - 1) / 2.0) from co) as s, (select sum(n * (n - 1) / 2.0) from ra) as sa, (select sum(n * (n - 1) / 2.0) from rb) as sb, (select sum(n)::double from co) as n,
      (select sum(n * ln(n)) from co) as lab, (select sum(n * ln(n)) from ra) as la, (select sum(n * ln(n)) from rb) as lbb, (select sum(m) from (select max(n) as m from co group by a)) as m)
    select round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) as ari, round((ln(n) + (lab - la - lbb) / n) / ((2 * ln(n) - la / n - lbb / n) / 2), 6) as nmi, round(m / n, 6) as purity, false as degenerate from t""",
)
def cluster_agreement(spark, sf):
    """Adjusted Rand index, normalised mutual information and purity."""
    a = C.agreement(C.contingency(leads(spark, sf), "label", "lead"))
    return a.select(F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"), F.round("purity", 6).alias("purity"), "degenerate")


@query("jaccard_best", f"with {_CO}, j as (select a, b, co.n / (ra.n + rb.n - co.n) as j from co join ra using (a) join rb using (b)) select a, arg_max(b, (j, -b)) as b, round(max(j), 6) as jaccard from j group by all")
def jaccard_best(spark, sf):
    """Each cluster's best partner in the other solution."""
    return C.best_jaccard(C.contingency(leads(spark, sf), "label", "lead")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("ruzicka", f"with {EM}, s as (select patient, pos, sum(greatest(v, 0)) filter (label < 5) as x, sum(greatest(v, 0)) filter (label >= 5) as y from (select *, band * 16 + bin as pos from cl) group by all) select patient, round(sum(least(coalesce(x, 0), coalesce(y, 0))) / sum(greatest(coalesce(x, 0), coalesce(y, 0))), 6) as ruzicka from s group by all")
def ruzicka(spark, sf):
    """Weighted Jaccard of two groups' positive profiles."""
    x = maps(spark, sf).select("patient", "label", F.posexplode("a").alias("pos", "v")).withColumn("v", F.greatest("v", F.lit(0.0)))
    s = x.groupBy("patient", "pos").agg(F.coalesce(F.sum(F.when(F.col("label") < 5, F.col("v"))), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.when(F.col("label") >= 5, F.col("v"))), F.lit(0.0)).alias("y"))
    return s.groupBy("patient").agg(F.round(F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y")), 6).alias("ruzicka"))


@query(
    "entropy_purity",
    f"""with {LB}, c as (select label, lead, count(*) as n from lb where lead <> 3 group by all), t as (select *, sum(n) over (partition by label) as t, row_number() over (partition by label order by n desc, lead) as rn from c)
    select label, cast(sum(n) as bigint) as n, round(sum(-(n / t) * log2(n / t)), 6) as entropy, round(max(n / t), 6) as purity, string_agg(lead::varchar, ';' order by rn) filter (rn <= 3) as top3 from t group by all""",
)
def entropy_purity(spark, sf):
    """Entropy, modal share and the three most frequent regions, unknown (3) left out."""
    c = leads(spark, sf).filter("lead <> 3").groupBy("label", "lead").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("label").agg(F.sum("n").alias("t"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "lead"))).alias("xs"))
    share = lambda x: -x["m"] / F.col("t")
    return t.select("label", F.col("t").alias("n"), F.round(A.total(F.transform("xs", lambda x: -share(x) * F.log2(share(x)))), 6).alias("entropy"), F.round(share(F.get("xs", F.lit(0))), 6).alias("purity"), F.array_join(F.transform(F.slice("xs", 1, 3), lambda x: x["lead"].cast("string")), ";").alias("top3"))


@query("patient_dominance", f"with {EM}, c as (select label, patient, count(*) as c from em group by all) select label, cast(sum(c) as bigint) as n, count(*) as n_patients, arg_max(patient, (c, -patient)) as top_patient, round(max(c) / sum(c), 6) as top_share, max(c) / sum(c) <= 0.12 as shared from c group by all")
def patient_dominance(spark, sf):
    """Largest share of one patient in each cluster, and the rule on it."""
    d = C.dominance(maps(spark, sf), "label", "patient")
    return d.select("label", "n", "n_patients", "top_patient", F.round("top_share", 6).alias("top_share"), (F.col("top_share") <= 0.12).alias("shared"))


@query("one_patient_share_by_k", "with c as (select distinct * from cluster_patients) select run_id, k, count(*) as n_clusters, count(*) filter (top_share > 0.5) as n_dominated, cast(coalesce(sum(n) filter (top_share > 0.5), 0) as bigint) as n_electrodes, round(sum(top_share * n) / sum(n), 9) as mean_share, round(sqrt(greatest(sum(top_share * top_share * n) / sum(n) - (sum(top_share * n) / sum(n)) ** 2, 0)), 6) as sd_share from c where n > 0 and top_share is not null group by all")
def one_patient_share_by_k(spark, sf):
    """Clusters and electrodes above the limit per run and K, size-weighted share."""
    c = table(spark, sf, "cluster_patients").distinct().filter("n > 0 and top_share is not null")
    over = F.col("top_share") > 0.5
    m = F.sum(F.col("top_share") * F.col("n")) / F.sum("n")
    sd = F.sqrt(F.greatest(F.sum(F.col("top_share") ** 2 * F.col("n")) / F.sum("n") - m * m, F.lit(0.0)))
    return c.groupBy("run_id", "k").agg(F.count(F.lit(1)).alias("n_clusters"), F.count(F.when(over, 1)).alias("n_dominated"), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("n_electrodes"), F.round(m, 9).alias("mean_share"), F.round(sd, 6).alias("sd_share"))


@query("enrichment", f"with {LB}, t as (select avg((lead = 1)::int) as base from lb) select label, round(avg((lead = 1)::int), 9) as inside, round(avg((lead = 1)::int) / max(base), 6) as enrichment from lb cross join t group by all")
def enrichment(spark, sf):
    """Share inside a map per cluster over the share in the cohort."""
    c = leads(spark, sf).groupBy("label").agg(F.sum((F.col("lead") == 1).cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    t = c.agg((F.sum("k") / F.sum("n")).alias("base"))
    return c.join(F.broadcast(t)).select("label", F.round(F.col("k") / F.col("n"), 9).alias("inside"), F.round(F.col("k") / F.col("n") / F.col("base"), 6).alias("enrichment"))


@query("mutual_information", f"with {LB}, c as (select patient, label, (lead = 1)::int as i, count(*) as n from lb group by all), t as (select *, sum(n) over (partition by patient, label) as a, sum(n) over (partition by patient, i) as b, sum(n) over (partition by patient) as t from c) select patient, round(sum(n / t * log2((n / t) / ((a / t) * (b / t)))), 6) as mi_bits from t group by all")
def mutual_information(spark, sf):
    """Bits shared by cluster membership and being inside the map, per patient."""
    c = leads(spark, sf).groupBy("patient", "label", (F.col("lead") == 1).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda *k: F.sum("n").over(W.partitionBy("patient", *k))
    t = c.select("patient", "n", of("label").alias("a"), of("i").alias("b"), of().alias("t"))  # counts of labels, not items
    p = F.col("n") / F.col("t")
    return t.groupBy("patient").agg(F.round(F.sum(p * F.log2(p / ((F.col("a") / F.col("t")) * (F.col("b") / F.col("t"))))), 6).alias("mi_bits"))


# ------------------------------------------------------- classification

_PR = EM + ", pr as (select vec_id, patient, label as t, case when vec_id % 3 > 0 then label else cast((label + vec_id) % 10 as int) end as g, cast(embedding[1] as double) + label * 0.02 as score from em)"


def _predicted(spark, sf):
    g = F.when(F.col("vec_id") % 3 > 0, F.col("label")).otherwise(((F.col("label") + F.col("vec_id")) % 10).cast("int"))
    return maps(spark, sf).select("vec_id", "patient", F.col("label").alias("t"), g.alias("g"), (F.get("a", F.lit(0)) + F.col("label") * 0.02).alias("score"))


@query("confusion", f"with {_PR} select t, g, count(*) as n from pr group by all")
def confusion(spark, sf):
    return _predicted(spark, sf).groupBy("t", "g").agg(F.count(F.lit(1)).alias("n"))


_CC = _PR + ", cc as (select c as cls, count(*) filter (t = c) as support, count(*) filter (g = c) as guessed, count(*) filter (t = c and g = c) as hits from pr cross join (select unnest(range(0, 10)) as c) group by all), cr as (select *, case when guessed = 0 then 0 else hits / guessed end as p, case when support = 0 then 0 else hits / support end as r from cc where support + guessed > 0)"


@query("class_metrics", f"with {_CC} select cast(cls as int) as cls, support, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from cr")
def class_metrics(spark, sf):
    """Precision, recall and F1 per class; 0 over nothing."""
    c = C.class_counts(_predicted(spark, sf), "t", "g")
    p, r = C.safe(F.col("hits"), F.col("guessed")), C.safe(F.col("hits"), F.col("support"))
    return c.select("cls", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(C.safe(2 * p * r, p + r), 6).alias("f1"))


@query("balanced_accuracy", f"with {_CC} select round(avg(r), 6) as balanced, round(cast(sum(hits) as double) / sum(support), 6) as accuracy, round(max(support) / sum(support), 6) as chance, round((cast(sum(hits) as double) / sum(support)) / (max(support) / sum(support)), 6) as lift from cr where support > 0")
def balanced_accuracy(spark, sf):
    """Balanced accuracy, and accuracy with its chance and lift."""
    c = C.class_counts(_predicted(spark, sf), "t", "g").filter("support > 0")
    acc, ch = F.sum("hits") / F.sum("support"), F.max("support") / F.sum("support")
    return c.agg(F.round(F.avg(F.col("hits") / F.col("support")), 6).alias("balanced"), F.round(acc, 6).alias("accuracy"), F.round(ch, 6).alias("chance"), F.round(acc / ch, 6).alias("lift"))


@query("auc_ovr", f"with {_PR}, r as (select t, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from pr), n as (select count(*) as n from pr) select t as cls, round((sum(r) - count(*) * (count(*) + 1) / 2.0) / (count(*) * (max(n) - count(*))), 6) as auc from r cross join n group by t")
def auc_ovr(spark, sf):
    """Area under the curve of each class against the rest, by rank sums."""
    p = R.average_rank(_predicted(spark, sf), [], "score", "r")
    c = p.groupBy(F.col("t").alias("cls")).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("k"))
    n = c.agg(F.sum("k").alias("n"))
    k = F.col("k")
    return c.join(F.broadcast(n)).select("cls", F.round((F.col("s") - k * (k + 1) / 2) / (k * (F.col("n") - k)), 6).alias("auc"))


# ---------------------------------------------------- ranks and p values

_PV = EM + ", pv as (select vec_id, label, case when vec_id % 17 = 0 then null else (((vec_id * 7919) % 1009) / 1009.0::double) ** 2 end as p from em)"


def _pvalues(spark, sf):
    x = (F.col("vec_id") * 7919 % 1009) / 1009.0
    return maps(spark, sf).select("vec_id", "label", F.when(F.col("vec_id") % 17 != 0, x * x).alias("p"))


@query("bh_adjust", f"with {_PV}, r as (select *, row_number() over (partition by label order by p nulls last, vec_id) as rk, count(p) over (partition by label) as n from pv) select vec_id, round(case when p is not null then least(min(p * n / rk) over (partition by label order by rk desc rows unbounded preceding), 1) end, 9) as p_adj from r")
def bh_adjust(spark, sf):
    """Benjamini-Hochberg adjusted p per family; nulls kept."""
    return R.bh_adjusted(_pvalues(spark, sf), ["label"], "p", ["vec_id"]).select("vec_id", F.round("p_adj", 9).alias("p_adj"))


@query("bh_mask", f"with {_PV}, r as (select *, row_number() over (partition by label order by p nulls last, vec_id) as rk, count(p) over (partition by label) as n from pv) select vec_id, coalesce(p <= max(case when p <= 0.1 * rk / n then p end) over (partition by label), false) as significant from r")
def bh_mask(spark, sf):
    return R.bh_mask(_pvalues(spark, sf), ["label"], "p", ["vec_id"], 0.1).select("vec_id", "significant")


_AR = "rank() over (partition by {b} order by {v}) + (count(*) over (partition by {b}, {v}) - 1) / 2.0::double"


@query("spearman_map", f"with {EM}, r as (select band, bin, {_AR.format(b='band, bin', v='v')} as rv, {_AR.format(b='band, bin', v='label')} as rl from cl) select band, bin, count(*) as n, round(corr(rv, rl), 6) as rho from r group by all")
def spearman_map(spark, sf):
    """Rank correlation of every cell with the electrode's value."""
    c = A.cells(maps(spark, sf), ["vec_id", "label"], "a", BINS)
    # the label's ranks are the same in every cell
    l = R.average_rank(maps(spark, sf).select("vec_id", "label"), [], "label", "rl").select("vec_id", "rl")
    d = R.average_rank(c, ["band", "bin"], "v", "rv").join(l, "vec_id")
    return d.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rv", "rl"), 6).alias("rho"))


@query("pearson_map", f"with {EM} select band, bin, count(*) as n, round(corr(v, label), 6) as r from cl group by all")
def pearson_map(spark, sf):
    return A.cells(maps(spark, sf), ["label"], "a", BINS).groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("v", F.col("label").cast("double")), 6).alias("r"))


_T = "t0 as (select distinct on (timing_id) timing_id, condition_name, regexp_replace(upper(patient_id), '[^A-Z0-9]', '', 'g') as patient, peak_lat as x, onset_lat as y, dur as z from timing order by timing_id, ingested_at desc), t as (select * from t0 where isfinite(x) and isfinite(y) and isfinite(z))"


def _readings(spark, sf):
    """One reading per id with the three values, finite only."""
    t = table(spark, sf, "timing").groupBy("timing_id").agg(F.max_by(F.struct("condition_name", "patient_id", "peak_lat", "onset_lat", "dur"), "ingested_at").alias("b"))
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    t = t.select("timing_id", "b.condition_name", F.regexp_replace(F.upper("b.patient_id"), "[^A-Z0-9]", "").alias("patient"), F.col("b.peak_lat").alias("x"), F.col("b.onset_lat").alias("y"), F.col("b.dur").alias("z"))
    return t.filter(ok("x") & ok("y") & ok("z"))


@query("spearman_by_condition", f"with {_T}, r as (select condition_name, {_AR.format(b='condition_name', v='x')} as rx, {_AR.format(b='condition_name', v='y')} as ry from t) select condition_name, count(*) as n, round(corr(rx, ry), 6) as rho from r group by all having count(*) >= 5")
def spearman_by_condition(spark, sf):
    """Rank correlation of peak and onset, groups of at least five."""
    d = R.average_rank(R.average_rank(_readings(spark, sf), ["condition_name"], "x", "rx"), ["condition_name"], "y", "ry")
    return d.groupBy("condition_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho")).filter("n >= 5")


@query(
    "partial_spearman",
    f"""with {_T}, r as (select condition_name as c, {_AR.format(b='condition_name', v='x')} as rx, {_AR.format(b='condition_name', v='y')} as ry, {_AR.format(b='condition_name', v='z')} as rz from t)
    select c as condition_name, round((corr(rx, ry) - corr(rx, rz) * corr(ry, rz)) / sqrt((1 - corr(rx, rz) ** 2) * (1 - corr(ry, rz) ** 2)), 6) as rho from r group by all having count(*) >= 5""",
)
def partial_spearman(spark, sf):
    """Rank correlation with the ranks of a third value held fixed."""
    d = _readings(spark, sf)
    for v in "xyz":
        d = R.average_rank(d, ["condition_name"], v, f"r{v}")
    a = d.groupBy("condition_name").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("xy"), F.corr("rx", "rz").alias("xz"), F.corr("ry", "rz").alias("yz")).filter("n >= 5")
    return a.select("condition_name", F.round((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)), 6).alias("rho"))


@query(
    "within_type_rho",
    f"""with {_T}, r as (select ({_AR.format(b='condition_name', v='x')}) / count(*) over (partition by condition_name) as rx, ({_AR.format(b='condition_name', v='y')}) / count(*) over (partition by condition_name) as ry from t)
    select count(*) as n, round(corr(rx, ry), 6) as rho from r""",
)
def within_type_rho(spark, sf):
    """Ranks scaled within each type, pooled, then correlated."""
    d = R.average_rank(R.average_rank(_readings(spark, sf), ["condition_name"], "x", "rx"), ["condition_name"], "y", "ry")
    n = d.groupBy("condition_name").agg(F.count(F.lit(1)).alias("m"))
    n = n.withColumnRenamed("condition_name", "c")
    d = d.join(F.broadcast(n), F.col("condition_name").eqNullSafe(F.col("c"))).select((F.col("rx") / F.col("m")).alias("rx"), (F.col("ry") / F.col("m")).alias("ry"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


@query(
    "group_median_rank",
    f"""with {_T}, g as (select condition_name, patient, median(y) as m, count(*) as n from t where condition_name is not null group by all having count(*) >= 5)
    select condition_name, patient, round(m, 6) as med, round((rank() over (partition by condition_name order by m) + (count(*) over (partition by condition_name, m) - 1) / 2.0) / count(*) over (partition by condition_name), 6) as pct from g""",
)
def group_median_rank(spark, sf):
    """Percentile rank of each patient's median onset within the condition."""
    g = group_quantiles(_readings(spark, sf).filter("condition_name is not null"), ["condition_name", "patient"], F.col("y"), {"m": 0.5}).filter("n >= 5").drop("n")
    d = R.average_rank(g, ["condition_name"], "m", "r")
    n = d.groupBy("condition_name").agg(F.count(F.lit(1)).alias("k"))
    return d.join(F.broadcast(n), "condition_name").select("condition_name", "patient", F.round("m", 6).alias("med"), F.round(F.col("r") / F.col("k"), 6).alias("pct"))


# ----------------------------------------------------------- resampling

RUNS, K = 12, 4
_DRAW = f", items as (select distinct electrode, patient from em), runs as (select unnest(range(0, {RUNS})) as run), lab as (select run, electrode as item, cast(floor({uniform_sql('cluster', 'run', 'electrode // 4')} * {K}) as int) as c from items cross join runs where {uniform_sql('draw', 'run', 'patient')} < 0.8)"


def _draws(spark, sf):
    items = maps(spark, sf).select("electrode", "patient").distinct()
    d = items.select("*", F.explode(F.array(*[F.lit(r) for r in range(RUNS)])).alias("run")).filter(uniform("draw", F.col("run"), F.col("patient")) < 0.8)
    quarter = F.call_function("div", F.col("electrode"), F.lit(4).cast("long"))
    return d.select("run", F.col("electrode").alias("item"), F.floor(uniform("cluster", F.col("run"), quarter) * K).cast("int").alias("c"))


_CP = EM + _DRAW + ", cp as (select a.item as i, b.item as j, cast(sum((a.c = b.c)::int) as bigint) as together, count(*) as sampled from lab a join lab b on a.run = b.run and a.item < b.item group by all)"


@query("consensus_pairs", f"with {_CP} select i, j, together, sampled, round(together / sampled, 6) as consensus from cp")
def consensus_pairs(spark, sf):
    """How often two items fall together when both are drawn; patients are drawn."""
    return C.consensus(_draws(spark, sf), "run", "item", "c").select("i", "j", "together", "sampled", F.round("consensus", 6).alias("consensus"))


@query("pac", f"with {_CP} select count(*) as n_pairs, round(avg((together / sampled > 0.1 and together / sampled < 0.9)::int), 6) as pac, round(1 - avg(together / sampled), 6) as cdf_area from cp")
def pac(spark, sf):
    """Share of ambiguous pairs and the area under the consensus distribution."""
    p = C.consensus(_draws(spark, sf), "run", "item", "c")
    c = F.col("consensus")
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(((c > 0.1) & (c < 0.9)).cast("double")), 6).alias("pac"), F.round(1 - F.avg(c), 6).alias("cdf_area"))


@query("item_consensus", f"with {_CP}, l as (select electrode as item, min(label) as label from em group by all), b as (select i, j, together / sampled as c from cp union all select j, i, together / sampled from cp) select i as item, round(avg(c) filter (x.label = y.label), 6) as inside, round(avg(c) filter (x.label <> y.label), 6) as outside from b join l x on x.item = i join l y on y.item = j group by all")
def item_consensus(spark, sf):
    """Mean consensus of an item with its own and with other clusters."""
    p = C.consensus(_draws(spark, sf), "run", "item", "c")
    l = maps(spark, sf).groupBy(F.col("electrode").alias("item")).agg(F.min("label").alias("label"))
    b = p.select(F.explode(F.array(F.struct(F.col("i").alias("item"), F.col("j").alias("other")), F.struct(F.col("j").alias("item"), F.col("i").alias("other")))).alias("x"), "consensus").select("x.*", "consensus")
    b = b.join(l, "item").join(l.select(F.col("item").alias("other"), F.col("label").alias("lo")), "other")
    return b.groupBy("item").agg(F.round(F.avg(F.when(F.col("label") == F.col("lo"), F.col("consensus"))), 6).alias("inside"), F.round(F.avg(F.when(F.col("label") != F.col("lo"), F.col("consensus"))), 6).alias("outside"))


PERMS = 39


@query(
    "within_patient_permutation",
    f"""with {EM}, x as (select vec_id, patient, label % 3 as g, cast(embedding[1] as double) * 10 + label * 0.1 as y from em), k as (select unnest(range(0, {PERMS + 1})) as k),
    s as (select k, patient, vec_id, y, row_number() over (partition by k, patient order by vec_id) as rn from x cross join k),
    l as (select k, patient, g, row_number() over (partition by k, patient order by case when k = 0 then 0 else {uniform_sql('perm', 'k', 'vec_id')} end, vec_id) as rn from x cross join k),
    m as (select k, g, avg(y) as m from s join l using (k, patient, rn) group by all), t as (select k, max(m) - min(m) as spread from m group by all)
    select round(max(case when k = 0 then spread end), 6) as observed, (count(*) filter (k > 0 and spread >= (select spread from t where k = 0) - 1e-12) + 1) / {PERMS + 1}.0::double as p from t""",
)
def within_patient_permutation(spark, sf):
    """Spread of group means against labels shuffled within each patient."""
    x = maps(spark, sf).select("vec_id", "patient", (F.col("label") % 3).alias("g"), (F.get("a", F.lit(0)) * 10 + F.col("label") * 0.1).alias("y"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(PERMS))).alias("k"))
    w = W.partitionBy("k", "patient")
    u = F.when(F.col("k") == 0, 0.0).otherwise(uniform("perm", F.col("k"), F.col("vec_id")))
    s = x.select("k", "patient", "y", F.row_number().over(w.orderBy("vec_id")).alias("rn"))
    l = x.withColumn("u", u).select("k", "patient", "g", F.row_number().over(w.orderBy("u", "vec_id")).alias("rn"))
    m = s.join(l, ["k", "patient", "rn"]).groupBy("k", "g").agg(F.avg("y").alias("m"))
    t = m.groupBy("k").agg((F.max("m") - F.min("m")).alias("d"))
    o = t.agg(F.max(F.when(F.col("k") == 0, F.col("d"))).alias("o"))
    return t.join(F.broadcast(o)).agg(F.round(F.max("o"), 6).alias("observed"), ((F.count(F.when((F.col("k") > 0) & (F.col("d") >= F.col("o") - 1e-12), 1)) + 1) / float(PERMS + 1)).alias("p"))


BOOTS = 60


@query(
    "patient_bootstrap_ci",
    f"""with {EM}, p as (select label, patient, sum(cast(embedding[1] as double)) as s, count(*) as n from em group by all), b as (select unnest(range(0, {BOOTS})) as b),
    w as (select b, patient, -ln({uniform_sql('boot', 'b', 'patient')}) as w from (select distinct patient from em) cross join b),
    e as (select label, b, sum(w * s) / sum(w * n) as e from p join w using (patient) group by all)
    select label, round(quantile_cont(e, 0.025), 6) as lo, round(median(e), 6) as mid, round(quantile_cont(e, 0.975), 6) as hi from e group by all""",
)
def patient_bootstrap_ci(spark, sf):
    """Interval of each cluster's mean with patients reweighted, not electrodes."""
    p = maps(spark, sf).groupBy("label", "patient").agg(F.sum(F.get("a", F.lit(0))).alias("s"), F.count(F.lit(1)).alias("n"))
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(BOOTS - 1))).alias("b")).withColumn("w", -F.log(uniform("boot", F.col("b"), F.col("patient"))))
    e = p.groupBy("label", "b").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("e"))
    q = group_quantiles(e, ["label"], F.col("e"), {"lo": 0.025, "mid": 0.5, "hi": 0.975})
    return q.select("label", *[F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")])


@query(
    "bayes_ranks",
    f"""with {EM}, p as (select label, patient, sum(cast(embedding[2] as double)) as s, count(*) as n from em group by all), b as (select unnest(range(0, {BOOTS})) as b),
    w as (select b, patient, -ln({uniform_sql('bayes', 'b', 'patient')}) as w from (select distinct patient from em) cross join b),
    e as (select label, b, sum(w * s) / sum(w * n) as e from p join w using (patient) group by all), r as (select label, b, rank() over (partition by b order by e desc) as r from e)
    select label, round(avg(r), 6) as mean_rank, round(avg((r = 1)::int), 6) as p_first from r group by all""",
)
def bayes_ranks(spark, sf):
    """Rank of each cluster under exponential (Dirichlet) weights of the patients."""
    p = maps(spark, sf).groupBy("label", "patient").agg(F.sum(F.get("a", F.lit(1))).alias("s"), F.count(F.lit(1)).alias("n"))
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(BOOTS - 1))).alias("b")).withColumn("w", -F.log(uniform("bayes", F.col("b"), F.col("patient"))))
    e = p.groupBy("label", "b").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("e"))
    r = e.withColumn("r", F.rank().over(W.partitionBy("b").orderBy(F.desc("e"))))
    return r.groupBy("label").agg(F.round(F.avg("r"), 6).alias("mean_rank"), F.round(F.avg((F.col("r") == 1).cast("double")), 6).alias("p_first"))


@query("grouped_folds", f"with {EM}, p as (select patient, count(*) as n from em group by all), r as (select *, row_number() over (order by n desc, patient) - 1 as i from p) select patient, n, cast(case when (i // 5) % 2 = 0 then i % 5 else 4 - i % 5 end as int) as fold from r")
def grouped_folds(spark, sf):
    """Folds of whole patients, dealt back and forth by size."""
    p = maps(spark, sf).groupBy("patient").agg(F.count(F.lit(1)).alias("n"))
    i = F.row_number().over(W.orderBy(F.desc("n"), "patient")) - 1  # one row a patient
    p = p.withColumn("i", i)
    return p.select("patient", "n", F.when(F.floor(F.col("i") / 5) % 2 == 0, F.col("i") % 5).otherwise(4 - F.col("i") % 5).cast("int").alias("fold"))


@query(
    "cross_k_lineage",
    f"""with {EM}, l as (select vec_id, k, label % k as c from em cross join (select unnest([3, 4, 5]) as k)), co as (select b.k, b.c as child, a.c as parent, count(*) as n from l a join l b on a.vec_id = b.vec_id and b.k = a.k + 1 group by all),
    s as (select k, c, count(*) as n from l group by all), j as (select co.k, child, parent, co.n / (x.n + y.n - co.n) as j from co join s x on x.k = co.k and x.c = child join s y on y.k = co.k - 1 and y.c = parent)
    select k, child, arg_max(parent, (j, -parent)) as parent, round(max(j), 6) as jaccard from j group by all""",
)
def cross_k_lineage(spark, sf):
    """Each cluster's best parent in the solution with one cluster less."""
    l = maps(spark, sf).select("label", F.explode(F.array(F.lit(4), F.lit(5))).alias("k"))
    c = l.groupBy("k", (F.col("label") % F.col("k")).alias("child"), (F.col("label") % (F.col("k") - 1)).alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda x: F.sum("n").over(W.partitionBy("k", x))  # noqa: E731  # counts of clusters, not items
    j = c.withColumn("j", F.col("n") / (of("child") + of("parent") - F.col("n")))
    return j.groupBy("k", "child").agg(F.max_by("parent", F.struct("j", -F.col("parent"))).alias("parent"), F.round(F.max("j"), 6).alias("jaccard"))


@query("best_k", "with c as (select distinct * from cluster_patients), k as (select run_id, k, max(top_share) as worst, round(avg(top_share), 9) as mean_share, count(*) as n from c where top_share is not null group by all) select run_id, arg_max(k, (-mean_share, -k)) as best_k, arg_max(k, (-mean_share, -k)) filter (worst <= 0.6) as chosen_k from k group by all")
def best_k(spark, sf):
    """K with the best score, and the best one that meets the dominance rule."""
    c = table(spark, sf, "cluster_patients").distinct().filter("top_share is not null")
    k = c.groupBy("run_id", "k").agg(F.max("top_share").alias("worst"), F.round(F.avg("top_share"), 9).alias("m"))
    best = F.struct(-F.col("m"), -F.col("k"))
    return k.groupBy("run_id").agg(F.max_by("k", best).alias("best_k"), F.max_by(F.when(F.col("worst") <= 0.6, F.col("k")), F.when(F.col("worst") <= 0.6, best)).alias("chosen_k"))


@query("area_running_max", "with c as (select distinct * from cluster_patients), a as (select run_id, k, avg(top_share) as area from c where top_share is not null group by all), m as (select *, max(area) over (partition by run_id order by k rows between unbounded preceding and 1 preceding) as before from a) select run_id, k, round(area, 6) as area, round(case when before is null then area else (area - before) / before end, 6) as delta from m")
def area_running_max(spark, sf):
    """Relative gain over the greatest area at any smaller K."""
    c = table(spark, sf, "cluster_patients").distinct().filter("top_share is not null")
    a = c.groupBy("run_id", "k").agg(F.avg("top_share").alias("area"))
    before = F.max("area").over(W.partitionBy("run_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    a = a.withColumn("before", before)
    return a.select("run_id", "k", F.round("area", 6).alias("area"), F.round(F.when(F.col("before").isNull(), F.col("area")).otherwise((F.col("area") - F.col("before")) / F.col("before")), 6).alias("delta"))


@query("condition_similarity", f"with {EM}, m as (select electrode, condition, band * 16 + bin as pos, v from cl) select x.condition as cond_a, y.condition as cond_b, count(distinct electrode) as n, round(corr(x.v, y.v), 6) as r from m x join m y using (electrode, pos) where x.condition < y.condition group by all")
def condition_similarity(spark, sf):
    """Correlation of the same electrodes' maps between conditions."""
    m = maps(spark, sf).groupBy("electrode").pivot("condition", ["audio", "picture", "reading"]).agg(F.first("a"))
    pairs = [("audio", "picture"), ("audio", "reading"), ("picture", "reading")]
    each = F.array(*[F.struct(F.lit(a).alias("cond_a"), F.lit(b).alias("cond_b"), F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")).alias("xy")) for a, b in pairs])
    d = m.select("electrode", F.explode(each).alias("p")).filter("p.xy is not null").select("electrode", "p.cond_a", "p.cond_b", F.explode("p.xy").alias("v"))
    g = d.select("electrode", "cond_a", "cond_b", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    return g.groupBy("cond_a", "cond_b").agg(F.call_function("div", F.count(F.lit(1)), F.lit(64).cast("long")).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("candidates_nearest_centroid", f"with {EM}, c as (select label, band, bin, avg(v) as c from cl group by all), s as (select cl.vec_id, cl.label, sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) as cosine from cl join c using (label, band, bin) group by all), r as (select *, row_number() over (partition by label order by cosine desc, vec_id) as no from s) select label, no, vec_id, round(cosine, 6) as cosine from r where no <= 3")
def candidates_nearest_centroid(spark, sf):
    """The three members most like each centroid (a top-k report)."""
    m = maps(spark, sf)
    c = C.centroids(m, ["label"], "a").select("label", "c")
    s = m.join(F.broadcast(c), "label").withColumn("cosine", A.dot(F.col("a"), F.col("c")) / (A.norm(F.col("a")) * A.norm(F.col("c"))))  # one row a cluster
    r = s.withColumn("no", F.row_number().over(W.partitionBy("label").orderBy(F.desc("cosine"), "vec_id")))
    return r.filter("no <= 3").select("label", F.col("no").cast("long").alias("no"), "vec_id", F.round("cosine", 6).alias("cosine"))


DRAWS = 25


@query(
    "size_matched_null",
    f"""with {EM}, it as (select electrode, min(patient) as patient, min(label) as label from em group by electrode), n as (select label, count(*) as n, count(distinct patient) as pats from it group by all), d as (select unnest(range(0, {DRAWS})) as d),
    r as (select d, patient, row_number() over (partition by d order by {uniform_sql('matched', 'd', 'electrode')}, electrode) as rn from it cross join d),
    c as (select label, d, patient, count(*) as c from n join r on rn <= n group by all), s as (select label, d, count(*) as pats, max(c) / sum(c) as top from c group by all)
    select label, n.n, n.pats as n_patients, round(avg(s.pats), 6) as null_patients, round(avg(top), 6) as null_share from n join s using (label) group by all""",
)
def size_matched_null(spark, sf):
    """Patients and top share of as many electrodes drawn without replacement."""
    it = maps(spark, sf).groupBy("electrode").agg(F.min("patient").alias("patient"), F.min("label").alias("label"))
    n = it.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient").alias("n_patients"))
    r = it.select("electrode", "patient", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("d"))
    r = r.withColumn("rn", F.row_number().over(W.partitionBy("d").orderBy(uniform("matched", F.col("d"), F.col("electrode")), "electrode")))
    c = r.join(F.broadcast(n), F.col("rn") <= F.col("n")).groupBy("label", "n", "n_patients", "d", "patient").agg(F.count(F.lit(1)).alias("c"))  # one row a cluster
    s = c.groupBy("label", "n", "n_patients", "d").agg(F.count(F.lit(1)).alias("p"), (F.max("c") / F.sum("c")).alias("top"))
    return s.groupBy("label", "n", "n_patients").agg(F.round(F.avg("p"), 6).alias("null_patients"), F.round(F.avg("top"), 6).alias("null_share"))


ROLLS = 29


@query(
    "shaft_shift_null",
    f"""with {EM}, x as (select vec_id, (vec_id // 3) % 40 as shaft, label, cast(embedding[1] as double) as y, row_number() over (partition by (vec_id // 3) % 40 order by vec_id) - 1 as i, count(*) over (partition by (vec_id // 3) % 40) as n from em),
    k as (select unnest(range(0, {ROLLS + 1})) as k), m as (select k, x.shaft, x.label, case when k = 0 then x.i else (x.i + cast(floor({uniform_sql('roll', 'k', 'x.shaft')} * x.n) as bigint)) % x.n end as j from x cross join k),
    r as (select k, corr(m.label, x.y) as r from m join x on x.shaft = m.shaft and x.i = m.j group by all)
    select round(max(case when k = 0 then r end), 6) as observed, round(avg(r) filter (k > 0), 6) as null_mean, round((max(case when k = 0 then r end) - avg(r) filter (k > 0)) / stddev_samp(r) filter (k > 0), 4) as z from r""",
)
def shaft_shift_null(spark, sf):
    """A correlation against labels rotated along each shaft by a random offset."""
    w = W.partitionBy("shaft")
    x = maps(spark, sf).select("vec_id", (F.col("electrode") % 40).alias("shaft"), F.col("label").cast("double").alias("label"), F.get("a", F.lit(0)).alias("y"))
    x = x.withColumn("i", F.row_number().over(w.orderBy("vec_id")).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(w))
    m = x.select("shaft", "label", "i", "n", F.explode(F.sequence(F.lit(0), F.lit(ROLLS))).alias("k"))
    by = F.floor(uniform("roll", F.col("k"), F.col("shaft")) * F.col("n"))
    m = m.select("k", "shaft", "label", F.when(F.col("k") == 0, F.col("i")).otherwise((F.col("i") + by) % F.col("n")).alias("i"))
    r = m.join(x.select("shaft", "i", "y"), ["shaft", "i"]).groupBy("k").agg(F.corr("label", "y").alias("r"))
    o, null = F.max(F.when(F.col("k") == 0, F.col("r"))), F.when(F.col("k") > 0, F.col("r"))
    return r.agg(F.round(o, 6).alias("observed"), F.round(F.avg(null), 6).alias("null_mean"), F.round((o - F.avg(null)) / F.stddev_samp(null), 4).alias("z"))


@query(
    "reference_cluster",
    """with c as (select distinct on (timing_id) condition_name as c, timing_id % 12 as cluster, onset_lat as y from timing where isfinite(onset_lat) and condition_name is not null order by timing_id, ingested_at desc),
    m as (select cluster, c, avg(y) as y, count(*) as n from c where y < 0.9 group by all having avg(y) < 0.55), w as (select cluster, max(case when c = 'audio' then y end) as audio, max(case when c = 'picture' then y end) as picture, max(case when c = 'reading' then y end) as reading from m group by all)
    select coalesce(arg_min(cluster, (audio, cluster)) filter (audio is not null and picture is null and reading is null), arg_min(cluster, (audio, cluster)) filter (audio is not null)) as cluster, count(*) filter (audio is not null and picture is null and reading is null) as n_strict, count(*) filter (audio is not null) as n_relaxed from w""",
)
def reference_cluster(spark, sf):
    """The earliest cluster active for sound alone, else the earliest active for sound."""
    t = table(spark, sf, "timing").filter(F.col("onset_lat").isNotNull() & ~F.isnan("onset_lat") & (F.abs("onset_lat") != float("inf")) & F.col("condition_name").isNotNull())
    t = t.groupBy("timing_id").agg(F.max_by(F.struct("condition_name", "onset_lat"), "ingested_at").alias("b")).select((F.col("timing_id") % 12).alias("cluster"), F.col("b.condition_name").alias("c"), F.col("b.onset_lat").alias("y"))
    m = t.filter("y < 0.9").groupBy("cluster", "c").agg(F.avg("y").alias("y")).filter("y < 0.55")
    w = m.groupBy("cluster").pivot("c", ["audio", "picture", "reading"]).agg(F.max("y"))
    strict = F.col("audio").isNotNull() & F.col("picture").isNull() & F.col("reading").isNull()
    first = lambda ok: F.min_by(F.when(ok, F.col("cluster")), F.when(ok, F.struct("audio", "cluster")))
    return w.agg(F.coalesce(first(strict), first(F.col("audio").isNotNull())).alias("cluster"), F.count(F.when(strict, 1)).alias("n_strict"), F.count("audio").alias("n_relaxed"))


@query(
    "consensus_placement",
    f"""with {_CP}, p as (select electrode as item, min(patient) as patient, min(label) as label from em group by all), b as (select i, j, together / sampled as c from cp union all select j, i, together / sampled from cp),
    a as (select x.patient, avg(c) as consensus from b join p x on x.item = i group by all), q as (select patient, avg((label < 5)::int) as placed from p group by all), m as (select * from a join q using (patient)),
    r as (select rank() over (order by consensus) + (count(*) over (partition by consensus) - 1) / 2.0 as ra, rank() over (order by placed) + (count(*) over (partition by placed) - 1) / 2.0 as rb from m)
    select count(*) as n, round(case when count(*) >= 5 then corr(ra, rb) end, 6) as rho from r""",
)
def consensus_placement(spark, sf):
    """Rank correlation of the patients' mean consensus with their share placed."""
    p = C.consensus(_draws(spark, sf), "run", "item", "c")
    who = maps(spark, sf).groupBy(F.col("electrode").alias("item")).agg(F.min("patient").alias("patient"), F.min("label").alias("label"))
    b = p.select(F.explode(F.array("i", "j")).alias("item"), "consensus").join(who, "item")
    a = b.groupBy("patient").agg(F.avg("consensus").alias("consensus"))
    q = who.groupBy("patient").agg(F.avg((F.col("label") < 5).cast("double")).alias("placed"))
    m = R.average_rank(R.average_rank(a.join(q, "patient"), [], "consensus", "ra"), [], "placed", "rb")
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.when(F.count(F.lit(1)) >= 5, F.corr("ra", "rb")), 6).alias("rho"))
