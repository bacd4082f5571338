"""Evaluation statistics.

Each metric is an aggregate to a few sufficient sums and a formula over them; the
rows are read once, and the driver sees nothing but results.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, gold: str, pred: str, labels: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """A10: ``label, tp, fp, fn, support, precision, recall, f1`` (0 where undefined).

    ``labels`` states the label universe; without it that of the gold labels.
    """
    c = confusion(df, gold, pred)
    cells = c.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col(gold).eqNullSafe(F.col(pred)), 0).otherwise(F.col("n")).alias("fn")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col(gold).eqNullSafe(F.col(pred)), 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    sums = cells.where("label IS NOT NULL").groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    universe = (labels if labels is not None else df.select(F.col(gold).alias("label"))).where("label IS NOT NULL").distinct()
    j = universe.join(sums, "label", "left").na.fill(0, ["tp", "fp", "fn"]).withColumn("support", F.col("tp") + F.col("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    j = j.withColumn("_p", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("_r", safe(F.col("tp"), F.col("support")))
    f1 = safe(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return j.select("label", "tp", "fp", "fn", "support", F.round("_p", digits).alias("precision"), F.round("_r", digits).alias("recall"), F.round(f1, digits).alias("f1"))


def macro(classes: DataFrame, supported_only: bool = False, digits: int = 6) -> DataFrame:
    """Accuracy over the classes' supports, and unweighted means; only of classes with support if asked."""
    c = classes.where("support > 0") if supported_only else classes
    return c.agg(F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"), F.round(F.avg("precision"), digits).alias("macro_precision"), F.round(F.avg("recall"), digits).alias("macro_recall"), F.round(F.avg("f1"), digits).alias("macro_f1"), F.count("*").alias("n_labels"))


def binary(df: DataFrame, gold: Column, pred: Column, digits: int = 6) -> DataFrame:
    """A12."""
    d = df.select(gold.cast("int").alias("y"), pred.cast("int").alias("p"))
    c = d.agg(F.count("*").alias("n"), *[F.count_if((F.col("y") == y) & (F.col("p") == p)).alias(k) for k, y, p in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))])
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall, spec = safe(tp, tp + fn), safe(tn, tn + fp)
    r = lambda c, k: F.round(c, digits).alias(k)
    mcc = safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select("n", "tp", "tn", "fp", "fn", r(safe(tp + fn, F.col("n")), "prevalence"), r(safe(tp + tn, F.col("n")), "accuracy"), r(safe(tp, tp + fp), "precision"), r(recall, "recall"), r(spec, "specificity"), r((recall + spec) / 2, "balanced_accuracy"), r(safe(2 * tp, 2 * tp + fp + fn), "f1"), r(mcc, "mcc"))


def _curve(df: DataFrame, gold: Column, score: Column) -> DataFrame:
    """Per distinct score the positives and negatives, with running totals from the top: a global sort of distinct scores only."""
    return df.select(gold.cast("int").alias("y"), score.cast("double").alias("s")).groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))


#: Ranges that a global order is cut into.
RANGES = 64


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, inclusive: bool = True) -> DataFrame:
    """``df`` with running totals ``sums[new] = column`` in the order of ``order``, rows of equal values together.

    Rows are cut into ranges by quantiles, summed within each and moved on by the totals of the ranges before: no task
    sorts all rows.  ``order`` should hold few rows of one value (count them first).
    """
    bounds = df.agg(F.percentile_approx(order, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(1000)).alias("b")).scalar()
    ranged = df.withColumn("_bounds", bounds).withColumn("_range", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(order))), F.lit(0))).drop("_bounds")
    way = F.desc if descending else F.asc
    inner = Window.partitionBy("_range").orderBy(way(order))
    inner = inner if inclusive else inner.rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(outer), F.lit(0)).alias(f"_{n}") for n in sums])
    within = ranged.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(n) for n, c in sums.items()]).join(F.broadcast(before), "_range")
    return within.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def auroc(df: DataFrame, gold: Column, score: Column, digits: int = 6) -> DataFrame:
    """By average ranks; ties count half."""
    c = running(_curve(df, gold, score), "s", {"below": "neg"}, inclusive=False)
    return c.agg(F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), digits).alias("auroc"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"))


def average_precision(df: DataFrame, gold: Column, score: Column, digits: int = 6) -> DataFrame:
    """The sum over distinct scores of recall gained times precision."""
    c = running(_curve(df, gold, score), "s", {"tp": "pos", "k": "n"}, descending=True)
    return c.agg(F.round(F.sum(F.col("pos") * F.col("tp") / F.col("k")) / F.sum("pos"), digits).alias("average_precision"))


def calibration_bins(df: DataFrame, gold: Column, prob: Column, bins: int = 10) -> DataFrame:
    """``bin, n, observed, predicted`` over equal widths [lo, hi), the last one closed; edges are k / bins."""
    p = prob.cast("double")
    at = F.least(F.lit(bins - 1), F.size(F.filter(F.array(*[F.lit(k / bins) for k in range(1, bins)]), lambda e: e <= p)))
    return df.select(gold.cast("int").alias("y"), p.alias("p"), at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("observed"), F.avg("p").alias("predicted"))


def ece(df: DataFrame, gold: Column, prob: Column, bins: int = 10, digits: int = 6) -> DataFrame:
    """Expected calibration error and Brier score."""
    b = calibration_bins(df, gold, prob, bins)
    e = b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n"), digits).alias("ece"), F.sum("n").alias("n"))
    d = prob.cast("double") - gold.cast("int")
    return e.join(df.agg(F.round(F.avg(d * d), digits).alias("brier")))


def recall_at(ranking: Column, gold: Column, k: int) -> Column:
    """A15."""
    at = F.array_position(ranking, gold)
    return F.when((at > 0) & (at <= k), 1.0).otherwise(0.0)


def reciprocal_rank(ranking: Column, gold: Column) -> Column:
    """A15."""
    at = F.array_position(ranking, gold)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def error_kind(gold: Column, pred: Column, candidates: Column) -> Column:
    """Correct, abstained, missed by retrieval, or wrongly chosen."""
    return F.when(pred.isNull(), "abstain").when(gold == pred, "correct").when(~F.array_contains(candidates, gold), "retrieval_miss").otherwise("classifier_error")


def poisson_weight(*key: Column) -> Column:
    """A Poisson(1) draw hashed from a key, by inversion; the same wherever it is computed."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(16**12))
    edges, c = [], 0.0
    for k in range(18):
        c += math.exp(-1) / math.factorial(k)
        edges.append(c)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= u))


def replicates(clusters: DataFrame, cluster: str, n: int, seed: int = 0) -> DataFrame:
    """``clusters`` (one row of sufficient sums each) for each of n replicates with its weight; weight 0 left out."""
    d = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return d.withColumn("weight", poisson_weight(F.lit(str(seed)), F.col(cluster).cast("string"), F.col("replicate").cast("string"))).where("weight > 0")


def cluster_bootstrap_accuracy(df: DataFrame, cluster: str, gold: str, pred: str, n: int = 1000, seed: int = 0, level: float = 0.95, digits: int = 6) -> DataFrame:
    """The accuracy and its percentile interval, whole clusters resampled: rows shrink to two sums a cluster first."""
    c = df.groupBy(cluster).agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(pred)).alias("hit"))
    r = replicates(c, cluster, n, seed).groupBy("replicate").agg((F.sum(F.col("hit") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("a"))
    q = (1 - level) / 2
    ci = r.agg(F.round(F.percentile("a", q), digits).alias("low"), F.round(F.percentile("a", 1 - q), digits).alias("high"), F.count("*").alias("n_replicates"))
    return c.agg(F.round(F.sum("hit") / F.sum("n"), digits).alias("accuracy")).join(ci)


def cluster_bootstrap_macro_f1(df: DataFrame, cluster: str, gold: str, pred: str, n: int = 1000, seed: int = 0, level: float = 0.95, digits: int = 6) -> DataFrame:
    """Macro F1 over the gold labels; a cluster's sums are its confusion cells."""
    cells = df.groupBy(cluster, gold, pred).agg(F.count("*").alias("n"))
    w = replicates(cells.select(cluster).distinct(), cluster, n, seed)
    c = cells.join(w, cluster).groupBy("replicate", gold, pred).agg(F.sum(F.col("n") * F.col("weight")).alias("n"))
    tp, g, p = (c.groupBy("replicate", F.col(k).alias("label")).agg(F.sum(v).alias(a)) for k, v, a in ((gold, F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0), "tp"), (gold, F.col("n"), "g"), (pred, F.col("n"), "p")))
    f = g.join(tp, ["replicate", "label"], "left").join(p, ["replicate", "label"], "left").na.fill(0)
    r = f.groupBy("replicate").agg(F.avg(2 * F.col("tp") / (F.col("g") + F.col("p"))).alias("m"))
    q = (1 - level) / 2
    return r.agg(F.round(F.percentile("m", q), digits).alias("low"), F.round(F.percentile("m", 1 - q), digits).alias("high"), F.count("*").alias("n_replicates"))


def mcnemar_p(b: int, c: int) -> float:
    """The exact two-sided p value of b against c discordant pairs."""
    n, k = b + c, min(b, c)
    if not n:
        return 1.0
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * tail)


def mcnemar(df: DataFrame, gold: Column, a: Column, b: Column, digits: int = 6) -> DataFrame:
    """Discordant counts, continuity-corrected chi-square, and Cohen's h of the two accuracies."""
    ra, rb = (a == gold).cast("int"), (b == gold).cast("int")
    c = df.agg(F.count("*").alias("n"), F.count_if((ra == 1) & (rb == 0)).alias("only_a"), F.count_if((ra == 0) & (rb == 1)).alias("only_b"), F.avg(ra).alias("_pa"), F.avg(rb).alias("_pb"))
    d = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double")
    chi = F.when(F.col("only_a") + F.col("only_b") > 0, d * d / (F.col("only_a") + F.col("only_b"))).otherwise(0.0)
    h = 2 * F.asin(F.sqrt("_pa")) - 2 * F.asin(F.sqrt("_pb"))
    return c.select("n", "only_a", "only_b", F.round(chi, digits).alias("chi_square"), F.round(h, digits).alias("cohens_h"))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean: counts per distinct value first."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    c = running(c, value, {"_before": "_c"}, inclusive=False)
    return df.join(c.select(value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(out)), value)


def correlations(df: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """Pearson of ln(x) and y, Spearman of x and y, over rows with x above 0."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x > 0 AND y IS NOT NULL")
    ranks = average_rank(average_rank(d, "x", "rx"), "y", "ry")
    return ranks.agg(F.count("*").alias("n"), F.round(F.corr(F.log("x"), "y"), digits).alias("pearson_log"), F.round(F.corr("rx", "ry"), digits).alias("spearman"))


def kappa(df: DataFrame, a: Column, b: Column, digits: int = 6) -> DataFrame:
    """Cohen's kappa, quadratic-weighted kappa and mean absolute error of two integer ratings."""
    d = df.select(a.cast("int").alias("a"), b.cast("int").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    o = d.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = o.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.col("n") * F.pow(F.col("a") - F.col("b"), F.lit(2))).alias("square"), F.sum(F.col("n") * F.abs(F.col("a") - F.col("b"))).alias("off"))
    ma, mb = o.groupBy("a").agg(F.sum("n").alias("na")), o.groupBy("b").agg(F.sum("n").alias("nb"))  # ratings: a few values
    e = ma.join(F.broadcast(mb)).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * F.col("nb")).otherwise(0)).alias("e_same"), F.sum(F.col("na") * F.col("nb") * F.pow(F.col("a") - F.col("b"), F.lit(2))).alias("e_square"))
    j = total.join(e)
    t = F.col("t").cast("double")
    po, pe = F.col("same") / t, F.col("e_same") / (t * t)
    return j.select(F.col("t").alias("n"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), digits).alias("kappa"), F.round(F.when(F.col("e_square") > 0, 1 - F.col("square") * t / F.col("e_square")).otherwise(1.0), digits).alias("quadratic_kappa"), F.round(F.col("off") / t, digits).alias("mae"))


def token_f1(gold: Column, pred: Column) -> Column:
    """F1 of two token sets; 1 if both are empty."""
    a, b = F.array_distinct(gold), F.array_distinct(pred)
    both, n = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * both / n)


def abstention(df: DataFrame, pred: Column, gold: Column, digits: int = 6) -> DataFrame:
    """A23."""
    none = pred.isNull()
    return df.agg(F.count("*").alias("n"), F.round(F.avg(none.cast("int")), digits).alias("abstention_rate"), F.round(F.avg((~none).cast("int")), digits).alias("coverage"), F.round(F.avg(F.when(none, gold.cast("int"))), digits).alias("positive_rate_abstained"))


def rollup_any(df: DataFrame, doc: str, flags: list[str]) -> DataFrame:
    """Per document whether any row has each flag."""
    return df.groupBy(doc).agg(*[F.max(F.col(f).cast("int")).alias(f"any_{f}") for f in flags], F.count("*").alias("n"))


def strict_majority(votes: DataFrame, key: str, answer: str, order: str, expected: int, unsure: str = "DON'T KNOW") -> DataFrame:
    """``key, answer, agreement``: the answer of more than half of the expected passes; missing ones abstain; one pass agrees with nothing."""
    n = votes.groupBy(key, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = n.groupBy(key).agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("f"), F.col(answer).alias("a"))).alias("m"))
    total = F.lit(float(expected))
    clear = 2 * F.col("m.n") > total
    return top.select(key, F.when(clear, F.col("m.a")).otherwise(unsure).alias("answer"), F.when(F.lit(expected) <= 1, 0.0).otherwise(F.round(F.col("m.n") / total, 6)).alias("agreement"))


def plurality(votes: DataFrame, key: str, answer: str, order: str, allowed: list | None = None) -> DataFrame:
    """The most frequent allowed answer, first seen at a tie."""
    v = votes.where(F.col(answer).isin(*allowed)) if allowed else votes
    n = v.groupBy(key, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(key).agg(F.max_by(F.struct(answer, "n"), F.struct(F.col("n"), -F.col("first"))).alias("m")).select(key, f"m.{answer}", "m.n")


def summary_row(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Per key the row that is largest by ``order``, later columns deciding ties."""
    return df.groupBy(key).agg(F.max(F.struct(*order, value)).alias("m")).select(key, *[F.col(f"m.{c}") for c in order], F.col(f"m.{value}").alias(value))


def checks(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """A row per named test: how many rows fail it, and whether all pass."""
    n = df.agg(*[F.count_if(~F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_failed"), (F.col(k) == 0).alias("passed")) for k in tests])).alias("c")).select("c.*")


def gate(table: DataFrame) -> DataFrame:
    """One row: whether all checks passed, and the names of those that didn't."""
    return table.agg(F.bool_and("passed").alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("blockers"))


def fit_calibration(df: DataFrame, x: str, y: str, least: int = 30, least_each: int = 10, rounds: int = 25):
    """(slope, intercept) of a one-feature logistic model by Newton steps; None if a sample gate fails.

    A step is an aggregate of five sums over rows.
    """
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("p")).first()
    if n["n"] < least or min(n["p"], n["n"] - n["p"]) < least_each:
        return None
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col(x) + F.lit(b))))
        v, r = p * (1 - p), F.col(y) - p
        s = df.agg(*[F.sum(c).alias(k) for k, c in (("g1", r * F.col(x)), ("g0", r), ("h11", v * F.col(x) * F.col(x)), ("h10", v * F.col(x)), ("h00", v))]).first()
        det = s["h11"] * s["h00"] - s["h10"] ** 2 + 1e-12
        da, db = (s["g1"] * s["h00"] - s["g0"] * s["h10"]) / det, (s["g0"] * s["h11"] - s["g1"] * s["h10"]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def calibrated(score: Column, model: tuple[float, float] | None, *gates: Column) -> Column:
    """The probability, or null unless there is a model and every gate holds."""
    if model is None:
        return F.lit(None).cast("double")
    z = F.lit(model[0]) * score + F.lit(model[1])
    ok = score.between(0.0, 1.0)
    for g in gates:
        ok = ok & F.coalesce(g, F.lit(False))
    return F.when(ok, F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z))))


def first_problem(problems: dict[str, Column]) -> Column:
    """The code of the first problem that a row has, or null."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in problems.items()])


def all_problems(problems: dict[str, Column]) -> Column:
    """The codes of all problems of a row."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in problems.items()]))


def edges(bins: int) -> list[tuple[float, float]]:
    return list(pairwise(k / bins for k in range(bins + 1)))
