"""Labels: sizes, centroids, agreement, purity and quality of clusterings.

Everything is closed form over counts, sums and centroids; no pairs of items are
made except in ``consensus``, whose result is a table of pairs and whose input
is bounded (``most_items``, else it raises).

Defined results: null labels are a label of their own unless said otherwise;
empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def centroids(df: DataFrame, by: Sequence[str], array: str, weight: str | None = None) -> DataFrame:
    """``*by, n, c``: mean (or weighted mean) of the arrays, position by position."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = df.select(*by, w.alias("__w"), F.posexplode(array).alias("pos", "v"))
    m = x.groupBy(*by, "pos").agg((F.sum(F.col("v") * F.col("__w")) / F.sum("__w")).alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("c"))


def squared_silhouette(df: DataFrame, item: str, label: str, array: str) -> DataFrame:
    """``item, label, s`` with squared Euclidean distances, without pairs.

    The mean squared distance to a cluster is ``|x|^2 - 2 x.c + mean |y|^2``;
    the own cluster leaves the item out; a singleton gets 0.
    """
    d = df.select(item, F.col(label).alias("__l"), F.col(array).alias("__a"), A.dot(F.col(array), F.col(array)).alias("__q"))
    c = centroids(d, ["__l"], "__a").join(d.groupBy("__l").agg(F.avg("__q").alias("mq")), "__l")
    all_ = c.agg(F.array_sort(F.collect_list(F.struct(F.col("__l").alias("l"), "n", "c", "mq"))).alias("cs"))  # one row a cluster
    x = d.join(F.broadcast(all_))
    far = F.transform("cs", lambda r: F.struct((r["l"] == F.col("__l")).alias("own"), r["n"].alias("n"), (F.col("__q") - 2 * A.dot(F.col("__a"), r["c"]) + r["mq"]).alias("d")))
    x = x.select(item, F.col("__l").alias(label), far.alias("f"))
    own = F.get(F.filter("f", lambda r: r["own"]), F.lit(0))
    b = F.array_min(F.transform(F.filter("f", lambda r: ~r["own"]), lambda r: r["d"]))
    x = x.withColumn("n", own["n"]).withColumn("a", own["d"] * own["n"] / F.nullif(own["n"] - 1, F.lit(0))).withColumn("b", b)
    return x.select(item, label, F.when(F.col("n") <= 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def dispersion(df: DataFrame, label: str, array: str) -> DataFrame:
    """One row: ``k, n, within, between, calinski, davies`` (Calinski-Harabasz
    and Davies-Bouldin)."""
    c = centroids(df, [label], array)
    g = centroids(df.withColumn("__g", F.lit(1)), ["__g"], array).select(F.col("c").alias("gc"))
    d = df.join(F.broadcast(c), label)  # one row a cluster
    r = A.distance(F.col(array), F.col("c"))
    s = d.groupBy(label).agg(F.avg(r).alias("spread"), F.sum(r * r).alias("within"))
    c = c.join(s, label).join(F.broadcast(g)).withColumn("between", F.col("n") * A.distance(F.col("c"), F.col("gc")) ** 2)
    cs = c.agg(F.collect_list(F.struct(F.col(label).alias("l"), "c", "spread")).alias("cs"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("within").alias("within"), F.sum("between").alias("between"))
    worst = F.transform("cs", lambda a: F.array_max(F.transform(F.filter("cs", lambda b: b["l"] != a["l"]), lambda b: (a["spread"] + b["spread"]) / A.distance(a["c"], b["c"]))))
    return cs.select("k", "n", "within", "between", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("calinski"), (A.total(worst) / F.size("cs")).alias("davies"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n``."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement(cont: DataFrame) -> DataFrame:
    """One row from ``a, b, n``: adjusted Rand index, normalised mutual
    information (arithmetic mean), purity; degenerate tables flagged."""
    ra = cont.groupBy("a").agg(F.sum("n").alias("n"))
    rb = cont.groupBy("b").agg(F.sum("n").alias("n"))
    two = lambda n: F.sum(n * (n - 1) / 2)
    ln = lambda n: F.sum(n * F.log(n))
    c = cont.agg(two(F.col("n")).alias("s"), F.sum("n").alias("n"), ln(F.col("n")).alias("lab"))
    a = ra.agg(two(F.col("n")).alias("sa"), ln(F.col("n")).alias("la"), F.count(F.lit(1)).alias("ka"))
    b = rb.agg(two(F.col("n")).alias("sb"), ln(F.col("n")).alias("lb"), F.count(F.lit(1)).alias("kb"))
    p = cont.groupBy("a").agg(F.max("n").alias("m")).agg(F.sum("m").alias("m"))
    d = c.join(F.broadcast(a)).join(F.broadcast(b)).join(F.broadcast(p))  # one row each
    n = F.col("n")
    chance = F.col("sa") * F.col("sb") / (n * (n - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2
    ha, hb = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    mi = F.log(n) + (F.col("lab") - F.col("la") - F.col("lb")) / n
    return d.select(
        F.when(top == chance, 1.0).otherwise((F.col("s") - chance) / (top - chance)).alias("ari"),
        F.when(ha + hb == 0, 1.0).otherwise(mi / ((ha + hb) / 2)).alias("nmi"),
        (F.col("m") / n).alias("purity"),
        ((F.col("ka") < 2) | (F.col("kb") < 2)).alias("degenerate"),
    )


def best_jaccard(cont: DataFrame) -> DataFrame:
    """Per ``a`` the ``b`` with the greatest Jaccard overlap: ``a, b, jaccard``."""
    ra = cont.groupBy("a").agg(F.sum("n").alias("na"))
    rb = cont.groupBy("b").agg(F.sum("n").alias("nb"))
    j = cont.join(ra, "a").join(rb, "b").withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    best = F.max_by(F.struct("b", "jaccard"), F.struct("jaccard", -F.col("b"))).alias("x")
    return j.groupBy("a").agg(best).select("a", "x.b", "x.jaccard")


def consensus(labels: DataFrame, run: str, item: str, cluster: str, most_items: int = 5000) -> DataFrame:
    """``i, j, together, sampled, consensus`` of all pairs of items ever drawn
    together.  The result is quadratic in the items, so their number is checked;
    each run is one array, paired inside its row."""
    n = labels.select(item).distinct().count()
    if n > most_items:
        raise ValueError(f"{n} items; a consensus table of more than {most_items} is not made, group the items first")
    runs = labels.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(cluster).alias("c")))).alias("xs"))
    left = runs.select("xs", F.explode("xs").alias("x"))
    pairs = left.select(F.col("x.i").alias("i"), F.col("x.c").alias("c"), F.explode(F.filter("xs", lambda y: y["i"] > F.col("x.i"))).alias("y"))
    p = pairs.groupBy("i", F.col("y.i").alias("j")).agg(F.sum((F.col("c") == F.col("y.c")).cast("long")).alias("together"), F.count(F.lit(1)).alias("sampled"))
    return p.withColumn("consensus", F.col("together") / F.col("sampled"))


def dominance(df: DataFrame, label: str, patient: str) -> DataFrame:
    """Per label the patient with the greatest share: ``label, n, n_patients,
    top_patient, top_share``."""
    p = df.groupBy(label, patient).agg(F.count(F.lit(1)).alias("c"))
    return p.groupBy(label).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_patients"), F.max_by(patient, F.struct("c", -F.col(patient))).alias("top_patient"), (F.max("c") / F.sum("c")).alias("top_share"))


def class_counts(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class support, hits and guesses, from the confusion counts."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(F.struct(F.col("t").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("g").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hits")))
    x = c.select(F.explode(each).alias("x")).select("x.*")
    return x.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))


def safe(a: Column, b: Column) -> Column:
    """Quotient, 0 where the divisor is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)
