"""Splits, percentiles, containers, leaks and text quality over the whole tables."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from ..functions.keys import entity_key, entity_key_sql
from ..plans.registry import ORACLES, QUERIES, query  # noqa: F401
from ..session import Scratch, table
from . import leakage, mapping, packing, quality, select, splits

# ------------------------------------------------------------ 3: splits

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _patient_roots(spark, sf, keep):
    """Roster with key, and the component of every patient key."""
    p, m = table(spark, sf, "patients"), table(spark, sf, "name_match_unmatched_recorded")
    key = lambda c: F.nullif(entity_key(F.col(c)), F.lit(""))
    roster = p.select("patient_no", "patient_id", key("patient_id").alias("node"), key("prior_patient_id").alias("prior")).distinct()
    used = keep.save(m.select(key("patient_id").alias("node"), "source_file").distinct())
    links = roster.select(F.col("node").alias("a"), F.col("prior").alias("b")).unionByName(splits.star_links(used, "node", "source_file"))
    return roster, splits.components(roster.select("node").unionByName(used.select("node")), links, keep)


_P3 = f"""
with recursive pk as (select distinct patient_id, {entity_key_sql("patient_id")} as k, nullif({entity_key_sql("prior_patient_id")}, '') as p from patients),
u as (select distinct nullif({entity_key_sql("patient_id")}, '') as k, source_file from name_match_unmatched_recorded where source_file is not null and nullif({entity_key_sql("patient_id")}, '') is not null),
e as (select k as a, p as b from pk where p is not null and k <> '' union select x.k, y.k from (select source_file, min(k) as k from u group by all) x join u y using (source_file)),
b as (select a, b from e where a <> b union select b, a from e where a <> b),
r(a, b) as (select a, b from b union select r.a, b.b from r join b on b.a = r.b)
select distinct x.patient_id as patient_a, y.patient_id as patient_b from pk x join pk y on x.patient_id < y.patient_id where x.k = y.k or exists (select 1 from r where r.a = x.k and r.b = y.k)
"""


@query("p3_found", _P3)
def p3_found(spark, sf):
    """Pairs of roster patients that must share a split."""
    roster, roots = _patient_roots(spark, sf, Scratch(spark))
    r = roster.select("patient_id", "node").distinct().join(roots, "node").select("patient_id", "root")
    a, b = r.select("root", F.col("patient_id").alias("patient_a")), r.select("root", F.col("patient_id").alias("patient_b"))
    return a.join(b, "root").filter("patient_a < patient_b").select("patient_a", "patient_b").distinct()


@query("p3_splits")
def p3_splits(spark, sf):
    """Split of every record; records without a patient are dealt one by one."""
    keep = Scratch(spark)
    roster, roots = _patient_roots(spark, sf, keep)
    m = table(spark, sf, "name_match_unmatched_recorded").select(F.col("rec_id").cast("string").alias("record"), F.nullif(entity_key(F.col("patient_id")), F.lit("")).alias("node"), "source_file")
    # a record whose patient is blank goes with the other records of its file
    by_file = m.dropna(subset=["source_file"]).groupBy("source_file").agg(F.min("node").alias("other"))
    m = m.join(by_file, "source_file", "left").select("record", F.coalesce("node", "other", F.concat(F.lit("file "), "source_file")).alias("node"))
    number = roster.filter("node is not null").groupBy("patient_no").agg(F.min("node").alias("node"))
    c = table(spark, sf, "cluster_patients").select(F.concat_ws("/", "run_id", "cluster_no").alias("record"), F.col("top_patient").alias("patient_no"))
    c = c.join(number, "patient_no", "left").select("record", F.coalesce("node", F.concat(F.lit("no "), F.col("patient_no").cast("string"))).alias("node"))
    t = m.withColumn("source_table", F.lit("name_match_unmatched_recorded")).unionByName(c.withColumn("source_table", F.lit("cluster_patients"))).distinct()
    t = t.join(roots, "node", "left").select("source_table", "record", F.coalesce("root", "node", F.concat_ws(" ", F.lit("record"), "source_table", "record")).alias("root"))
    t = keep.save(t)
    dealt = splits.deal(t.groupBy("root").agg(F.count(F.lit(1)).alias("n")), SHARES)
    return t.join(dealt, "root").select("source_table", "record", "root", "split")


# ------------------------------------------------------- 5: percentiles

PERCENTS = (1, 5, 25, 50, 75, 95, 99)
FEATURES = ("peak_lat", "onset_lat", "dur")

_P5 = f"""
with t as (select distinct on (timing_id) timing_id, condition_name, {entity_key_sql("patient_id")} as patient, {", ".join(FEATURES)} from timing),
f as ({" union all ".join(f"select '{c}' as feature, condition_name, patient, {c} as v from t" for c in FEATURES)}),
x as (select feature, 'condition' as grouping, condition_name as key, v from f where isfinite(v) union all select feature, 'patient', patient, v from f where isfinite(v)),
r as (select *, row_number() over (partition by feature, grouping, key order by v) as rn, count(*) over (partition by feature, grouping, key) as n from x),
p as (select unnest([{", ".join(map(str, PERCENTS))}]) as pct)
select feature, grouping, key, cast(pct as int) as pct, v as value, n, rn as rank, cast(0 as int) as rank_error
from r, p where rn = greatest(1, (n * pct + 99) // 100)
"""


@query("p5_percentiles", _P5)
def p5_percentiles(spark, sf):
    """Percentiles of the timing readings per condition and per patient; exact."""
    t = table(spark, sf, "timing").select("timing_id", "condition_name", entity_key(F.col("patient_id")).alias("patient"), *FEATURES)
    t = Scratch(spark).save(t.dropDuplicates(["timing_id"]).drop("timing_id"))
    each = [
        F.struct(F.lit(c).alias("feature"), F.lit(g).alias("grouping"), F.col(k).alias("key"), F.col(c).cast("double").alias("v"))
        for c in FEATURES
        for g, k in (("condition", "condition_name"), ("patient", "patient"))
    ]
    values = t.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return select.multiselect(values, ["feature", "grouping", "key"], "v", PERCENTS).withColumn("rank_error", F.lit(0))


DAY_GRID = tuple(range(2, 101, 2))


@query("p5_from_days")
def p5_from_days(spark, sf):
    """The percentiles per condition merged from summaries of separate run_days,
    with their rank error bound and the exact value beside them."""
    keep = Scratch(spark)
    t = table(spark, sf, "timing").select("timing_id", "condition_name", "run_day", *FEATURES).dropDuplicates(["timing_id"])
    each = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in FEATURES]
    v = keep.save(t.select("condition_name", "run_day", F.explode(F.array(*each)).alias("x")).select("condition_name", "run_day", "x.*"))
    days = select.multiselect(v, ["feature", "condition_name", "run_day"], "v", DAY_GRID)
    merged = select.combine(keep.save(days), ["feature", "condition_name"], ["run_day"], PERCENTS, DAY_GRID)
    exact = select.multiselect(v, ["feature", "condition_name"], "v", PERCENTS).select(F.col("feature").alias("f"), F.col("condition_name").alias("c"), F.col("pct").alias("p"), F.col("value").alias("exact"))
    same = (F.col("feature") == F.col("f")) & F.col("condition_name").eqNullSafe(F.col("c")) & (F.col("pct") == F.col("p"))
    return merged.join(exact, same).select("feature", "condition_name", "pct", "value", "exact", "n", "error")


# ------------------------------------------------------ 6: free entries


def _mapped(spark, sf):
    return mapping.map_entries(table(spark, sf, "name_match_candidates"), table(spark, sf, "shaft_reference"))


@query("p6_found")
def p6_found(spark, sf):
    """The reference entry each typed electrode means, 0 for none."""
    return _mapped(spark, sf).select("entry_id", F.col("reference_id").alias("shaft_id"))


@query("p6_unmatched")
def p6_unmatched(spark, sf):
    """Typed electrodes that mean no reference entry, with the number of entries."""
    e = table(spark, sf, "name_match_candidates").groupBy("entry_id").agg(F.min("electrode").alias("electrode"))
    m = _mapped(spark, sf).filter("reference_id = 0").join(e, "entry_id")
    return m.groupBy("electrode").agg(F.count(F.lit(1)).alias("n_entries"), F.round(F.max("score"), 4).alias("best_score"))


# -------------------------------------------------------- 7: containers


def _packed(spark, sf):
    return packing.pack(packing.token_counts(table(spark, sf, "documents")))


@query("p7_containers")
def p7_containers(spark, sf):
    """Container of every text, or of every piece of a text longer than one."""
    return _packed(spark, sf)


@query("p7_fill")
def p7_fill(spark, sf):
    """Containers made, the least possible number, and the share filled."""
    return packing.fill_report(_packed(spark, sf))


# ------------------------------------------------------------- 8: leaks


@query("p8_found")
def p8_found(spark, sf):
    """Every document with the evaluation items it leaks."""
    return leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


# ----------------------------------------------------------- 9: quality


def _shares(spark, sf):
    docs, common = table(spark, sf, "documents"), defaultdict(set)
    for r in table(spark, sf, "common_words").select("lang", "word").collect():  # a fixed table
        common[r.lang].add(r.word)
    return docs, common, quality.label_shares(docs, quality.train(docs, dict(common)))


@query("p9_found")
def p9_found(spark, sf):
    """Documents that are mainly not natural prose."""
    shares = _shares(spark, sf)[2]
    return shares.filter(quality.not_prose(shares)).select("doc_id").distinct()


_P9 = r"""
with c as (select list(distinct word) as cw from common_words), w as (select cw, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '\p{L}+') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s', ' ', 'g')) <> '') as ls from documents cross join c)
select doc_id, cast(len(ws) as bigint) as n_words, round(length(regexp_replace(t, '\P{L}', '', 'g')) / nullif(len(ws), 0), 6) as mean_word_len, round(length(regexp_replace(t, '[\p{L}\p{N}\s]', '', 'g')) / nullif(length(t), 0), 6) as symbol_share,
  round(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…]\s*$'))) / nullif(len(ls), 0), 6) as punct_line_share, round(len(list_filter(ws, lambda x: list_contains(cw, lower(x)))) / nullif(len(ws), 0), 6) as common_share from w
"""


@query("p9_statistics", _P9)
def p9_statistics(spark, sf):
    """The five statistics of every document."""
    words = sorted({r.word for r in table(spark, sf, "common_words").select("word").distinct().collect()})  # a fixed table
    s = quality.text_stats(table(spark, sf, "documents"), words)
    return s.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("mean_word_len", "symbol_share", "punct_line_share", "common_share")])


@query("p9_quality")
def p9_quality(spark, sf):
    """Statistics of every document, its shares by kind of line, and the verdict."""
    docs, common, shares = _shares(spark, sf)
    stats = quality.text_stats(docs, sorted(set().union(*common.values())))
    shares = shares.withColumn("not_prose", quality.not_prose(shares))
    return stats.join(shares, "doc_id", "left").withColumn("not_prose", F.coalesce("not_prose", F.lit(False)))
