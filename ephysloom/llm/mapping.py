"""Mapping free entries to a reference list by repairing their tokens.

Reference entries have a label and names in several languages, each a *form*;
entries that differ in the side alone share their forms (a *concept*).  The words
of all forms, the side words and the words that announce a contact number make
the vocabulary.

1. Texts are folded (case, accents, elisions) and taken once each; the work is
   on distinct texts and distinct tokens, whatever number of entries has them.
2. Every distinct token is joined to the vocabulary by edit distance: two words
   are an edit apart when they agree after deleting at most one letter of each
   (a letter dropped, added, exchanged or moved), an equi-join on the deletion
   variants; long tokens without such a word are tried with two.  An
   abbreviation is joined on the prefixes of the vocabulary's words.
3. Corrected tokens are combined by soft TF-IDF with each form they reach:
   ``sum(sim * idf^2) / (|text| * |form|)``, where tokens without a correction
   weigh as the rarest word.  Labels may be split by blanks, so up to ``merged``
   neighbouring tokens are also read as one.
4. The best concept counts if its score is at least ``least`` and ahead of the
   next by ``margin``; with the side (a side word before a single letter before
   a letter glued to the label) it gives the reference entry.

Defined results: null and blank texts have no row; a text that reaches no form,
two concepts equally, or gives no side or both sides, maps to 0; repeated
entries are mapped once by their id (if an id has several texts, by the smallest
that is not blank); an empty reference maps all to 0; numbers do not count; texts
of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import given
from ..functions.skew import SALT, salted
from ..session import Scratch

#: Side words and words before a contact number.
SIDES = {"L": ("l", "left", "gauche", "links", "li", "lt"), "R": ("r", "right", "droit", "droite", "rechts", "re", "rt")}
MARKS = ("plot", "kontakt", "contact")

_FROM = "àáâãåçèéêëìíîïñòóôõùúûýÿ"
_TO = "aaaaaceeeeiiiinoooouuuyy"


def folded(c: Column, umlaut: bool = False) -> Column:
    """Lower case without accents and elisions; umlauts as one letter or two."""
    t = F.lower(F.regexp_replace(c, r"\p{Z}", " "))
    t = F.regexp_replace(t, r"(^|[^\p{L}])[ld]['’ʼ]", "$1")
    if umlaut:
        for a, b in (("a", "ae"), ("o", "oe"), ("u", "ue")):
            t = F.regexp_replace(t, f"{'äöü'['aou'.index(a)]}|{a}̈", b)
    t = F.regexp_replace(F.translate(t, "äöü", "aou"), r"\p{M}", "")
    for a, b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, _FROM, _TO)


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([a-z]+)"), F.lit(1))


def _shorter(c: Column) -> Column:
    """The text without each of its letters in turn."""
    n = F.length(c)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))


def _variants(c: Column, edits: int) -> Column:
    out = F.array(c)
    grown = out
    for _ in range(edits):
        grown = F.array_distinct(F.flatten(F.transform(grown, _shorter)))
        out = F.array_union(out, grown)
    return out


def vocabulary(reference: DataFrame, label: str, side: str, names: Sequence[str], key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``concept, side, id``; ``form, concept, kind, word, idf, norm``;
    ``word, kind, side``) of the reference list."""
    r = reference.filter(given(F.col(label)) & F.col(key).isNotNull())
    stem = F.regexp_replace(F.regexp_replace(folded(F.col(label)), "[^a-z]", ""), "[lr]$", "")
    r = r.select(F.col(key).cast("long").alias("id"), F.upper(F.trim(side)).alias("side"), stem.alias("concept"), *[F.col(c).alias(f"__n{i}") for i, c in enumerate(names)])
    entries = r.groupBy("concept", "side").agg(F.min("id").alias("id"))
    texts = F.array(F.struct(F.lit("label").alias("kind"), F.col("concept").alias("text")), *[F.struct(F.lit("name").alias("kind"), folded(F.col(f"__n{i}"), u).alias("text")) for i in range(len(names)) for u in (False, True)])
    forms = r.select("concept", F.explode(texts).alias("x")).select("concept", "x.kind", "x.text").filter(given(F.col("text"))).distinct()
    forms = forms.select(F.xxhash64("concept", "kind", "text").alias("form"), "concept", "kind", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("word"))
    n = forms.agg(F.count_distinct("form").alias("n"))
    df = forms.groupBy("word").agg(F.count_distinct("form").alias("df"))
    idf = df.join(F.broadcast(n)).select("word", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # one row of counts
    forms = forms.join(idf, "word")
    norm = forms.groupBy("form").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    forms = forms.join(norm, "form").select("form", "concept", "kind", "word", "idf", "norm")
    spark = reference.sparkSession
    fixed = [(w, "side", s) for s, ws in SIDES.items() for w in ws] + [(w, "mark", None) for w in MARKS]
    none = F.lit(None).cast("string")
    glued = forms.filter("kind = 'label'").select(F.explode(F.array(*[F.struct(F.concat("word", F.lit(s.lower())).alias("word"), F.lit(s).alias("side"), F.col("word").alias("base")) for s in SIDES])).alias("x"))
    words = forms.select("word", "kind", none.alias("side"), F.col("word").alias("base")).distinct()
    words = words.unionByName(glued.select("x.word", F.lit("label").alias("kind"), "x.side", "x.base"))
    words = words.unionByName(spark.createDataFrame(fixed, "word string, kind string, side string").withColumn("base", F.col("word")))
    return entries, forms, words


def repair(tokens: DataFrame, words: DataFrame, shortest: int = 4, two_from: int = 9, prefix_from: int = 3) -> DataFrame:
    """``token, word, sim`` of every vocabulary word a token may stand for."""
    w = words.select("word").distinct()
    same = tokens.join(w, F.col("token") == F.col("word")).select("token", "word", F.lit(1.0).alias("sim"))
    longer = F.greatest(F.length("token"), F.length("word"))

    def near(ts: DataFrame, least: int, edits: int) -> DataFrame:
        a = ts.filter(F.length("token") >= least).select("token", F.explode(_variants(F.col("token"), edits)).alias("v"))
        b = w.filter(F.length("word") >= least).select("word", F.explode(_variants(F.col("word"), edits)).alias("v"))
        return a.join(b, "v").filter("token <> word").select("token", "word").distinct().withColumn("sim", 1 - F.lit(float(edits)) / longer)

    one = near(tokens, shortest, 1)
    begun = w.filter(F.length("word") > prefix_from).select("word", F.explode(F.sequence(F.lit(prefix_from), F.length("word") - 1)).alias("n"))
    begun = begun.select("word", F.substring("word", F.lit(1), F.col("n")).alias("token"))
    short = tokens.join(begun, "token").select("token", "word", (0.8 + 0.2 * F.length("token") / F.length("word")).alias("sim"))
    found = same.unionByName(one).unionByName(short)
    two = near(tokens.join(found.select("token").distinct(), "token", "left_anti"), two_from, 2)
    return found.unionByName(two).groupBy("token", "word").agg(F.max("sim").alias("sim"))


def map_entries(
    entries: DataFrame,
    reference: DataFrame,
    entry_id: str = "entry_id",
    text: str = "electrode",
    label: str = "shaft_label",
    side: str = "side",
    names: Sequence[str] = ("region_en", "region_fr", "region_de"),
    key: str = "shaft_id",
    least: float = 0.72,
    margin: float = 0.02,
    merged: int = 4,
) -> DataFrame:
    """``entry_id, reference_id, score`` of every entry with a text; 0 for none."""
    keep = Scratch(entries.sparkSession)
    e = entries.filter(F.col(entry_id).isNotNull() & given(F.col(text))).groupBy(F.col(entry_id).alias("entry_id")).agg(F.min(text).alias("t"))
    e = e.select("entry_id", folded(F.col("t")).alias("t"))
    e = keep.save(e.select("entry_id", "t", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit("second"), "t").alias("k2")))
    k = ["k1", "k2"]
    texts = e.groupBy(*k).agg(F.first("t").alias("t")).select(*k, _tokens(F.col("t")).alias("ts"))
    heads, forms, words = (keep.save(x) for x in vocabulary(reference, label, side, names, key))

    spans = F.transform(F.sequence(F.lit(1), F.size("ts")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(merged), F.size("ts") - i + 1)), lambda n: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice("ts", i, n), "").alias("token"))))
    occ = keep.save(texts.filter(F.size("ts") > 0).select(*k, F.explode(F.flatten(spans)).alias("x")).select(*k, "x.*"))
    rep = repair(occ.select("token").distinct(), words)
    rep = keep.save(rep.join(words, "word").select("token", "base", "kind", "side", "sim"))

    # what each single token is: its best word decides its weight
    idf = forms.select(F.col("word").alias("base"), "idf").distinct()
    rarest = forms.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("top"))
    # a side word counts before a word of a name, a prefix of a side word does not
    best = rep.filter("kind <> 'side' or sim = 1 or length(token) >= 4").join(idf, "base", "left").groupBy("token").agg(F.max_by(F.struct("kind", "side", "idf"), F.struct("sim", F.col("kind") == "side", F.coalesce("idf", F.lit(0.0)), "base")).alias("b"))
    one = occ.filter("n = 1")
    one, b = salted(one, best, ["token"], F.struct(*k, "pos"))
    one = one.join(b, ["token", SALT], "left").join(F.broadcast(rarest))  # one row
    weight = F.when(F.col("b.kind").isin("side", "mark"), 0.0).otherwise(F.pow(F.coalesce("b.idf", "top"), 2))
    said = lambda s: F.max(F.when((F.col("b.kind") == "side") & (F.col("b.side") == s), F.when(F.length("token") > 1, 2).otherwise(1)).otherwise(0))
    per = keep.save(one.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", weight.alias("w")))), lambda x: x["w"]).alias("ws"), F.sum(weight).alias("all2"), said("L").alias("l"), said("R").alias("r")))

    # soft TF-IDF with the forms reached
    hits, r = salted(occ, rep.filter("kind in ('label', 'name')"), ["token"], F.struct(*k, "pos"))
    hits = hits.join(r, ["token", SALT]).filter("n = 1 or kind = 'label'")
    f = forms.select("form", "concept", F.col("word").alias("base"), "idf", "norm", "kind")
    hits = keep.save(hits.select(*k, "pos", "n", "base", "kind", "side", "sim").join(f, ["base", "kind"]))
    named = hits.filter("kind = 'name'").groupBy(*k, "form", "concept", "norm", "pos").agg(F.max(F.struct("sim", "idf", "base")).alias("m"))
    named = named.groupBy(*k, "form", "concept", "norm", "m.base").agg(F.max(F.col("m.sim") * F.col("m.idf") * F.col("m.idf")).alias("d"))
    named = named.groupBy(*k, "form", "concept", "norm").agg(F.sum("d").alias("d")).join(per.select(*k, "all2"), k)
    named = named.select(*k, "concept", F.lit(None).cast("string").alias("side"), (F.col("d") / (F.col("norm") * F.sqrt(F.greatest("all2", F.lit(1e-9))))).alias("score"))
    labelled = hits.filter("kind = 'label'").join(per.select(*k, "all2", "ws"), k)
    covered = F.aggregate(F.slice("ws", F.col("pos"), F.col("n")), F.lit(0.0), lambda a, x: a + x)
    labelled = labelled.select(*k, "concept", "side", (F.col("sim") * F.col("idf") / F.sqrt(F.pow("idf", 2) + F.greatest(F.col("all2") - covered, F.lit(0.0)))).alias("score"))
    s = named.unionByName(labelled).withColumn("score", F.least(F.round("score", 6), F.lit(1.0)))
    top = s.groupBy(*k, "concept").agg(F.max("score").alias("score"), F.max(F.when(F.col("side") == "L", F.col("score"))).alias("sl"), F.max(F.when(F.col("side") == "R", F.col("score"))).alias("sr"))
    rank = W.partitionBy(*k).orderBy(F.desc("score"), "concept")
    top = top.withColumn("no", F.row_number().over(rank)).withColumn("next", F.lead("score").over(rank)).filter("no = 1").drop("no")
    top = top.join(per.select(*k, "l", "r"), k)
    sl, sr, z = F.coalesce("sl", F.lit(0.0)), F.coalesce("sr", F.lit(0.0)), F.lit(0)
    glued = F.when((sl >= F.col("score")) & (sr < sl), "L").when((sr >= F.col("score")) & (sl < sr), "R")
    told = F.when((F.col("l") > F.col("r")), "L").when(F.col("r") > F.col("l"), "R")
    chosen = F.when(F.greatest("l", "r", z) > 0, told).otherwise(glued)
    sure = (F.col("score") >= least) & (F.coalesce("next", F.lit(0.0)) <= F.col("score") - margin)
    top = top.select(*k, "concept", "score", F.when(sure, chosen).alias("side")).join(heads, ["concept", "side"], "left")
    return e.join(top.select(*k, "id", "score"), k, "left").select("entry_id", F.coalesce("id", F.lit(0).cast("long")).alias("reference_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
