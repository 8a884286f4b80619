"""Model metrics on scored rows.

Exact ROC AUC (ties at mid-rank, Mann-Whitney) and average precision (step sum, ties grouped) both
need running totals over scores in order.  They are computed from one distributed prefix sum:

* aggregate to one row per (cell, distinct score) with positive/negative counts (partial agg);
* range-partition these rows on (score, cell), which cuts the score axis into buckets;
* per-bucket totals (one row per bucket and cell) become offsets;
* a window inside each (cell, bucket) adds the local running sum to the offset
  (``operators.ordered.running_before``).

No window ever spans a whole cell, so a cell holding most of the rows is still spread over tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlab.functions.exprs import join_on
from synthlab.operators.ordered import running_before  # noqa: F401  (re-exported)

EPS = 2.220446049250313e-16  # fixed value: double machine epsilon (MAPE denominator floor)


def score_table(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (cell, distinct score): pos, neg, pos_before, neg_before (ascending score)."""
    g = scored.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                       F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    return running_before(g, by, score, ["pos", "neg"])


def auc_ap(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """W3 + W4 per cell: auc_roc, avg_precision, n_pos, n_neg (NULL when a class is missing)."""
    t = score_table(scored, score, label, by)
    per_cell = t.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_u"))
    # AP needs the cell totals: tp(s) = P - pos_before, fp(s) = N - neg_before
    t2 = join_on(t, per_cell.select(*by, "n_pos", "n_neg"), by)
    tp = F.col("n_pos") - F.col("pos_before")
    fp = F.col("n_neg") - F.col("neg_before")
    ap = t2.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * F.try_divide(tp, tp + fp)).alias("avg_precision"))
    res = join_on(per_cell, ap, by)
    return res.select(*by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                  F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc_roc"),
                      F.when(F.col("n_pos") > 0, F.col("avg_precision")).alias("avg_precision"),
                      F.col("n_pos").cast("long"), F.col("n_neg").cast("long"))


def f1_minority(scored: DataFrame, score: str, label: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """M8: F1 of class 1 with prediction = score > threshold; 0 when undefined."""
    pred = (F.col(score) > F.lit(threshold)).cast("long")
    y = F.col(label).cast("long")
    g = scored.groupBy(*by).agg(F.sum(pred * y).alias("tp"), F.sum(pred * (1 - y)).alias("fp"),
                                F.sum((1 - pred) * y).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.select(*by, F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0)).alias("f1_minority"),
                    F.col("tp").cast("long"), F.col("fp").cast("long"), F.col("fn").cast("long"))


def regression_metrics(pred: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """M9: MAPE = mean(|y - yhat| / max(|y|, eps)) and R^2 = 1 - SS_res / SS_tot (stable variance)."""
    ape = F.abs(F.col(y) - F.col(yhat)) / F.greatest(F.abs(F.col(y)), F.lit(EPS))
    g = pred.groupBy(*by).agg(F.avg(ape).alias("mape"),
                              F.sum((F.col(y) - F.col(yhat)) ** 2).alias("_ssr"),
                              (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"))
    return g.select(*by, "mape", F.when(F.col("_sst") > 0, 1 - F.col("_ssr") / F.col("_sst")).alias("r2"))


def balanced_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """M7: weight = n / (k * n_class).  The class table has one row per class (joined back; AQE
    broadcasts it), so no window is partitioned by a class."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    counts = counts.select(target, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias(name))
    return join_on(df, counts, [target])


def best_f1_threshold(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """threshold (a distinct score, predict score >= t) maximizing F1; ties -> highest threshold."""
    t = score_table(scored, score, label, by)
    cell = t.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    t = join_on(t, cell, by)
    tp = F.col("_P") - F.col("pos_before")
    fp = F.col("_N") - F.col("neg_before")
    f1 = F.try_divide(2.0 * tp, tp + F.col("_P") + fp)
    t = t.withColumn("_f1", f1)
    best = t.groupBy(*by).agg(F.max(F.struct(F.col("_f1"), F.col(score))).alias("_b"))
    return best.select(*by, F.col("_b." + score).alias("threshold"), F.col("_b._f1").alias("best_f1"))


def calibration_bins(scored: DataFrame, score: str, label: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """mean score vs observed rate per equal-width score bin."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return scored.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
