"""Metrics from columns of truth and prediction; everything is an aggregation over the cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: list[str]) -> DataFrame:
    """All pairs of the given labels, with 0 where none occurs: a pivot over the fixed labels, so no cross join."""
    base = df.sparkSession.createDataFrame([(x,) for x in labels], "y_true string")
    wide = confusion(df, true, pred).groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n"))
    return base.join(wide, "y_true", "left").fillna(0).unpivot(["y_true"], labels, "y_pred", "n")


def class_scores(df: DataFrame, true: str, pred: str) -> DataFrame:
    """class, tp, support, predicted, precision, recall, f1 over all classes in truth or prediction; 0 for 0 / 0."""
    c = confusion(df, true, pred)
    t = c.groupBy(F.col("y_true").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("y_pred").alias("class")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, "class", "full").fillna(0)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, s, q = F.col("tp"), F.col("support"), F.col("predicted")
    return j.select("class", "tp", "support", "predicted", div(tp, q).alias("precision"), div(tp, s).alias("recall"), div(2 * tp, s + q).alias("f1"))


def multiclass(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: accuracy, macro_f1."""
    return class_scores(df, true, pred).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def binary(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: accuracy, precision, recall, f1 of 0/1 columns."""
    y, p = F.col(true), F.col(pred)
    tp, pp, pos = F.count_if((y == 1) & (p == 1)), F.count_if(p == 1), F.count_if(y == 1)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.agg(F.avg((y == p).cast("double")).alias("accuracy"), div(tp, pp).alias("precision"), div(tp, pos).alias("recall"), div(2 * tp, pp + pos).alias("f1"))


def ranking(df: DataFrame, true: str, score: str) -> DataFrame:
    """One row: roc_auc (ties by average rank; null with one class) and avg_precision (stepwise).

    Running totals go over distinct scores, not rows.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(true) == 1).alias("p"), F.count_if(F.col(true) == 0).alias("n"))
    down = W.orderBy(F.desc("s"))
    c = per.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "pos": F.sum("p").over(W.partitionBy()), "neg": F.sum("n").over(W.partitionBy())})
    pairs = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2.0))
    auc = F.when((F.max("pos") > 0) & (F.max("neg") > 0), pairs / (F.max("pos") * F.max("neg")))
    ap = F.sum(F.when(F.col("pos") > 0, F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0))
    return c.agg(auc.alias("roc_auc"), ap.alias("avg_precision"))


def regression(df: DataFrame, true: str, pred: str) -> DataFrame:
    y, e = F.col(true).cast("double"), F.col(true) - F.col(pred)
    sse, n = F.sum(e * e), F.count(F.lit(1))
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(sse / n).alias("rmse"), F.when(sst > 0, 1 - sse / sst).otherwise(0.0).alias("r2"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: kappa; null if chance agreement is 1."""
    c = confusion(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    total = c.agg(F.sum("n").cast("double").alias("t"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("same"))
    ra = c.groupBy(F.col("y_true").alias("k")).agg(F.sum("n").alias("x"))
    rb = c.groupBy(F.col("y_pred").alias("k")).agg(F.sum("n").alias("y"))
    chance = ra.join(rb, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    pe = F.col("xy") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(F.when(pe < 1, (F.col("same") / F.col("t") - pe) / (1 - pe)).alias("kappa"))  # one row each


def agreement_by_class(df: DataFrame, rule: str, other: str) -> DataFrame:
    return df.groupBy(rule).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(rule) == F.col(other)).cast("double")).alias("agreement"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label (ties: the first), and the accuracy of always predicting it."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col(label).alias("label")))
    return per.agg(best.alias("b"), F.sum("n").alias("total")).select(F.col("b.label").alias("label"), (-F.col("b.minus") / F.col("total")).alias("accuracy"))


def keyword_baseline(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: coverage, metrics with abstentions as 0, and accuracy where the rule speaks."""
    full = binary(df.withColumn("_p", F.coalesce(F.col(pred), F.lit(0))), true, "_p")
    part = df.agg(F.avg(F.col(pred).isNotNull().cast("double")).alias("coverage"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("covered_accuracy"))
    return full.crossJoin(part)  # one row each


def cv_summary(folds: DataFrame) -> DataFrame:
    """Per (representation, model): the deviation of F1 is of the population, that of accuracy of a sample."""
    return folds.groupBy("representation", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("macro_f1").alias("f1_mean"), F.stddev_pop("macro_f1").alias("f1_std"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"),
    )


def best_by(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def named_model(results: DataFrame, keys: list[str], name: str = "boosted_trees") -> DataFrame:
    """For each key the row of the named model; where it is missing, that of the first model by name."""
    first = F.struct((F.col("model") != name).alias("other"), "model", F.struct(*results.columns).alias("r"))
    return results.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(first).alias("b")).select("b.r.*")


def pivot_max(df: DataFrame, index: str, columns: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(index).pivot(columns, names).agg(F.max(value))


def paired(folds: DataFrame, a: str, b: str, value: str = "macro_f1", model: str | None = None) -> DataFrame:
    """One row: n, mean difference, t (null with fewer than two folds or no spread) over folds that both have."""
    f = folds.where(F.col("model") == model) if model else folds
    x = f.where(F.col("representation") == a).select("fold", F.col(value).alias("x"))
    y = f.where(F.col("representation") == b).select("fold", F.col(value).alias("y"))
    d = F.col("x") - F.col("y")
    return x.join(y, "fold").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), (F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)) * F.sqrt(F.count(F.lit(1)))).alias("t"))


def paired_tests(folds: DataFrame, comparisons: list[tuple[str, str]], value: str = "macro_f1", model: str = "logistic_regression") -> DataFrame:
    """One row a comparison (a, b): n, mean of b less a, t and its p-value, Wilcoxon's p-value; error where folds don't match.

    Reads one number a fold, so the tests run on the driver.
    """
    spark, rows = folds.sparkSession, []
    found: dict[str, dict[int, float]] = {}
    for r in folds.where(F.col("model") == model).select("representation", "fold", value).collect():
        found.setdefault(r[0], {})[r[1]] = r[2]
    for a, b in comparisons:
        x, y = found.get(a, {}), found.get(b, {})
        if not x or x.keys() != y.keys():
            rows.append((a, b, model, None, None, None, None, None, f"unmatched fold counts ({len(x)} vs {len(y)})"))
            continue
        d = [y[f] - x[f] for f in sorted(x)]
        n, mean = len(d), sum(d) / len(d)
        sd = math.sqrt(sum((v - mean) ** 2 for v in d) / (n - 1)) if n > 1 else 0.0
        t = mean / sd * math.sqrt(n) if sd > 0 else None
        rows.append((a, b, model, n, mean, t, None if t is None else t_p_value(t, n - 1), wilcoxon_p_value(d), None))
    kinds = "rep_a string, rep_b string, model string, n long, mean_diff double, t double, t_p_value double, wilcoxon_p_value double, error string"
    return spark.createDataFrame(rows, kinds)


def t_p_value(t: float, df: int) -> float:
    """Two-sided p of Student's t, by Simpson's rule on the density over [0, |t|]."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    n, h = 2000, abs(t) / 2000
    f = [c * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
    area = h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
    return max(0.0, 1 - 2 * area)


def wilcoxon_p_value(differences: list[float]) -> float:
    """Exact two-sided signed-rank p by enumeration of rank sums; zeros are left out, ties get average ranks."""
    d = sorted((x for x in differences if x), key=abs)
    ranks: list[float] = []
    i = 0
    while i < len(d):
        j = i
        while j < len(d) and abs(d[j]) == abs(d[i]):
            j += 1
        ranks += [(i + j + 1) / 2] * (j - i)
        i = j
    if not d:
        return 1.0
    low = min(sum(r for r, x in zip(ranks, d, strict=True) if x > 0), sum(r for r, x in zip(ranks, d, strict=True) if x < 0))
    ways: dict[float, int] = {0.0: 1}
    for r in ranks:
        new = dict(ways)
        for s, n in ways.items():
            new[s + r] = new.get(s + r, 0) + n
        ways = new
    return min(1.0, 2 * sum(n for s, n in ways.items() if s <= low) / 2 ** len(d))
