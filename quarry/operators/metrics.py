"""Evaluation metrics of predictions, rankings and clusterings; each is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import state


def regression(df: DataFrame, y: str, p: str, features: int = 1) -> DataFrame:
    """mae, mse, rmse, mape, r2, adjusted_r2, explained_variance, pearson and concordance."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    e = a - b
    s = df.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.abs(F.try_divide(e, a))).alias("mape"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.var_pop(e).alias("ve"), F.corr(a, b).alias("pearson"), F.covar_pop(a, b).alias("c"), F.avg(a).alias("ma"), F.avg(b).alias("mb"))
    r2 = F.when(F.col("va") > 0, 1 - F.col("mse") / F.col("va"))
    n = F.col("n")
    return s.select("mae", "mse", F.sqrt("mse").alias("rmse"), "mape", r2.alias("r2"), F.when(n > features + 1, 1 - (1 - r2) * (n - 1) / (n - features - 1)).alias("adjusted_r2"), F.when(F.col("va") > 0, 1 - F.col("ve") / F.col("va")).alias("explained_variance"), "pearson", (2 * F.col("c") / (F.col("va") + F.col("vb") + (F.col("ma") - F.col("mb")) ** 2)).alias("concordance"))


def binary(df: DataFrame, y: str, p: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 of 0/1 columns; 0 where undefined."""
    c = lambda a, b: F.sum(((F.col(y) == a) & (F.col(p) == b)).cast("long"))
    s = df.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    z = lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return s.select("tp", "fp", "fn", "tn", z(tp + tn, tp + fp + fn + tn).alias("accuracy"), z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """precision, recall and f1 of every class."""
    t = df.select(F.explode(F.array(F.struct(F.col(y).alias("c"), (F.col(y) == F.col(p)).cast("long").alias("tp"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col(p).alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("x")).select("x.*")
    s = t.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("a").alias("actual"), F.sum("b").alias("predicted"))
    z = lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    return s.select(F.col("c").alias("class"), z(F.col("tp"), F.col("predicted")).alias("precision"), z(F.col("tp"), F.col("actual")).alias("recall"), z(2 * F.col("tp"), F.col("actual") + F.col("predicted")).alias("f1"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, descending; the window runs over distinct scores."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(y) > 0.5).cast("long")).alias("p"), F.sum((F.col(y) <= 0.5).cast("long")).alias("q"))
    r = state.attach(state.running_sums(g, "threshold", {"tp": "p", "fp": "q"}, descending=True), g.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q")), [])
    return r.select("threshold", F.try_divide("tp", "_p").alias("tpr"), F.try_divide("fp", "_q").alias("fpr"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks of distinct scores."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(y) > 0.5).cast("long")).alias("p"), F.count("*").alias("n"))
    r = state.running_sums(g, "s", {"r": "n"}).withColumn("r", F.col("r") - (F.col("n") - 1) / 2)
    s = r.agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return s.select(((F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def precision_recall_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(y) > 0.5).cast("long")).alias("p"), F.count("*").alias("n"))
    r = state.attach(state.running_sums(g, "threshold", {"tp": "p", "said": "n"}, descending=True), g.agg(F.sum("p").alias("_p")), [])
    return r.select("threshold", (F.col("tp") / F.col("said")).alias("precision"), F.try_divide("tp", "_p").alias("recall"))


def calibration(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """(bin, mean_predicted, fraction_positive, n) of equal widths on [0, 1]; empty bins hold zeros."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.where(F.col(p).between(0, 1)).groupBy(b.alias("bin")).agg(F.avg(p).alias("m"), F.avg(F.col(y).cast("double")).alias("f"), F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(g, "bin", "left").select("bin", F.coalesce("m", F.lit(0.0)).alias("mean_predicted"), F.coalesce("f", F.lit(0.0)).alias("fraction_positive"), F.coalesce("n", F.lit(0)).alias("n"))


def ranking(df: DataFrame, sample: str, label: str, y: str, score: str) -> DataFrame:
    """Coverage error, label ranking loss and LRAP over samples (ties: by label; in the loss a tie is an error)."""
    w = Window.partitionBy(sample).orderBy(F.desc(score), label)
    r = df.withColumn("r", F.row_number().over(w)).withColumn("hits", F.sum(y).over(w))
    tied = Window.partitionBy(sample).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("above", F.sum(1 - F.col(y)).over(tied))  # irrelevant labels with at least this score
    s = r.groupBy(sample).agg(
        F.max(F.when(F.col(y) == 1, F.col("r"))).alias("coverage"),
        F.avg(F.when(F.col(y) == 1, F.col("hits") / F.col("r"))).alias("lrap"),
        F.try_divide(F.sum(F.when(F.col(y) == 1, F.col("above"))), F.sum(y) * F.sum(1 - F.col(y))).alias("loss"),
    )
    return s.agg(F.avg(F.coalesce("coverage", F.lit(0))).alias("coverage_error"), F.avg("lrap").alias("lrap"), F.avg("loss").alias("ranking_loss"))


def clustering(df: DataFrame, truth: str, found: str) -> DataFrame:
    """ari, fmi, homogeneity, completeness, v_measure, mi, nmi (arithmetic; 0 when both entropies are 0)."""
    n = df.groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count("*").cast("double").alias("n"))
    pair = lambda c: c * (c - 1) / 2
    h = lambda c, t: -F.sum(c / t * F.log(c / t))
    total = n.agg(F.sum("n").alias("total"))
    a = n.groupBy("t").agg(F.sum("n").alias("a"))
    b = n.groupBy("f").agg(F.sum("n").alias("b"))
    one = F.broadcast(total)  # one row
    s = n.join(a, "t").join(b, "f").crossJoin(one).agg(F.sum(pair(F.col("n"))).alias("ij"), F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"), F.first("total").alias("total"))
    sa = a.crossJoin(one).agg(F.sum(pair(F.col("a"))).alias("pa"), h(F.col("a"), F.col("total")).alias("ha"))
    sb = b.crossJoin(one).agg(F.sum(pair(F.col("b"))).alias("pb"), h(F.col("b"), F.col("total")).alias("hb"))
    x = s.crossJoin(sa).crossJoin(sb)  # one row each
    e = F.col("pa") * F.col("pb") / pair(F.col("total"))
    hom = F.when(F.col("ha") == 0, 1.0).otherwise(F.col("mi") / F.col("ha"))
    com = F.when(F.col("hb") == 0, 1.0).otherwise(F.col("mi") / F.col("hb"))
    top = (F.col("pa") + F.col("pb")) / 2 - e
    return x.select(F.when(top == 0, 1.0).otherwise((F.col("ij") - e) / top).alias("ari"), F.coalesce(F.try_divide("ij", F.sqrt(F.col("pa") * F.col("pb"))), F.lit(0.0)).alias("fmi"), hom.alias("homogeneity"), com.alias("completeness"), F.coalesce(F.try_divide(2 * hom * com, hom + com), F.lit(0.0)).alias("v_measure"), "mi", F.coalesce(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2), F.lit(0.0)).alias("nmi"))


def demographic_parity(df: DataFrame, group: str, p: str) -> DataFrame:
    """Rate of positive predictions by group, and its distance from the largest."""
    g = df.groupBy(group).agg(F.avg(F.col(p).cast("double")).alias("rate"))
    return g.crossJoin(F.broadcast(g.agg(F.max("rate").alias("_m")))).select(group, "rate", (F.col("_m") - F.col("rate")).alias("gap"))  # one row


def psi(df: DataFrame, x: str, new: str, bins: int = 10) -> DataFrame:
    """Population stability index of x where ``new`` is true against where it is false."""
    r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    w = ((r.b or 0) - (r.a or 0)) / bins or 1.0
    g = df.where(F.col(x).isNotNull()).groupBy(F.least(F.floor((F.col(x) - r.a) / w), F.lit(bins - 1)).alias("bin")).agg(F.sum(F.col(new).cast("long")).alias("n"), F.sum((~F.col(new)).cast("long")).alias("o"))
    t = F.broadcast(g.agg(F.sum("n").alias("_new"), F.sum("o").alias("_old")))  # one row
    p, q = F.greatest(F.col("n") / F.col("_new"), F.lit(1e-6)), F.greatest(F.col("o") / F.col("_old"), F.lit(1e-6))
    return g.crossJoin(t).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def one_vs_one(df: DataFrame, y: str, p: str) -> DataFrame:
    """(a, b, accuracy, precision, recall, f1) of each pair of true classes a < b, over the rows that truly are one of them; a counts as positive.

    From the confusion table, so pairs are of classes, never of rows.
    """
    c = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("t"), F.col(p).alias("f")).agg(F.count("*").alias("n"))
    classes = c.select(F.col("t").alias("k")).distinct()
    pairs = classes.select(F.col("k").alias("a")).join(F.broadcast(classes.select(F.col("k").alias("b"))), F.expr("a < b"))  # classes
    j = pairs.join(c, (F.col("t") == F.col("a")) | (F.col("t") == F.col("b")))
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    is_ = lambda u, v: (F.col("t") == F.col(u)) & F.coalesce(F.col("f") == F.col(v), F.lit(False))
    g = j.groupBy("a", "b").agg(F.sum("n").alias("n"), s(is_("a", "a")).alias("tp"), s(is_("b", "b")).alias("tn"), s(is_("b", "a")).alias("fp"), s(F.col("t") == F.col("a")).alias("pos"))
    z = lambda u, v: F.coalesce(F.try_divide(u, v), F.lit(0.0))
    pr, re = z(F.col("tp"), F.col("tp") + F.col("fp")), z(F.col("tp"), F.col("pos"))
    return g.select("a", "b", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), pr.alias("precision"), re.alias("recall"), z(2 * pr * re, pr + re).alias("f1"))


def nmi(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Normalised mutual information by the arithmetic, geometric, least and greatest mean of both entropies; 0 where that mean is 0."""
    n = df.groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count("*").cast("double").alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("z")))  # one row
    a, b = n.groupBy("t").agg(F.sum("n").alias("a")), n.groupBy("f").agg(F.sum("n").alias("b"))
    mi = n.join(a, "t").join(b, "f").crossJoin(total).agg(F.sum(F.col("n") / F.col("z") * F.log(F.col("n") * F.col("z") / (F.col("a") * F.col("b")))).alias("mi"))
    h = lambda d, c: d.crossJoin(total).agg((-F.sum(F.col(c) / F.col("z") * F.log(F.col(c) / F.col("z")))).alias(f"h{c}"))
    x = mi.crossJoin(F.broadcast(h(a, "a"))).crossJoin(F.broadcast(h(b, "b")))  # one row each
    over = lambda m: F.coalesce(F.try_divide("mi", m), F.lit(0.0))
    ha, hb = F.col("ha"), F.col("hb")
    return x.select(over((ha + hb) / 2).alias("arithmetic"), over(F.sqrt(ha * hb)).alias("geometric"), over(F.least(ha, hb)).alias("least"), over(F.greatest(ha, hb)).alias("greatest"))
