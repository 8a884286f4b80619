"""Reporting over long-format results.

Inputs are result tables with columns (dataset, n, seed, method, condition, alpha, metric).
Everything is ``groupBy`` + conditional aggregation; per-group arg-max uses ``max(struct)``
(a partial aggregate) instead of a window.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlab.functions.exprs import join_on


#: columns that name the generator of an arm; a baseline has none of its own
GENERATOR = ("method", "generator")


def _baseline_key(by: Sequence[str]) -> list[str]:
    return [c for c in by if c not in GENERATOR]


def alpha_means(res: DataFrame, by: Sequence[str], metric: str = "auc") -> DataFrame:
    """Seed means per (cell, generator, alpha) of the augmented arm."""
    own = [c for c in GENERATOR if c in res.columns and c not in by]
    return res.filter(F.col("condition") == "augmented").groupBy(*by, *own, "alpha").agg(F.avg(metric).alias("mean"))


def best_alpha(res: DataFrame, by: Sequence[str], metric: str = "auc") -> DataFrame:
    """Best seed-mean over generators and alpha, and its alpha; ties -> the lowest alpha."""
    m = alpha_means(res, by, metric)
    best = m.groupBy(*by).agg(F.max(F.struct(F.col("mean"), (-F.col("alpha")).alias("na"))).alias("_b"))
    return best.select(*by, F.col("_b.mean").alias("best_mean"), (-F.col("_b.na")).alias("best_alpha"))


def baseline_means(res: DataFrame, by: Sequence[str], metric: str = "auc") -> DataFrame:
    return res.filter(F.col("condition") == "real_only").groupBy(*by).agg(F.avg(metric).alias("baseline_mean"))


def best_gain(res: DataFrame, by: Sequence[str], metric: str = "auc") -> DataFrame:
    """Best over generators and alpha of (seed-mean - baseline seed-mean); with the generator in
    ``by``, one row of each against the baseline of its cell."""
    base = baseline_means(res, _baseline_key(by), metric)
    b = join_on(best_alpha(res, by, metric), base, _baseline_key(by))
    return b.withColumn("best_gain", F.col("best_mean") - F.col("baseline_mean"))


def max_gain(gains: DataFrame, by: Sequence[str], method: str = "method") -> DataFrame:
    """The largest best gain of each group and the generator that has it (ties: the larger name)."""
    best = gains.groupBy(*by).agg(F.max(F.struct("best_gain", method)).alias("_b"))
    return best.select(*by, F.col("_b.best_gain").alias("max_gain"), F.col(f"_b.{method}").alias(method))


def tstr_gap(real: DataFrame, tstr: DataFrame, by: Sequence[str], metric: str = "auc") -> DataFrame:
    """Gap % = (baseline - tstr) / baseline * 100 per group, from unrounded means."""
    b = real.groupBy(*by).agg(F.avg(metric).alias("baseline"))
    t = tstr.groupBy(*by).agg(F.avg(metric).alias("tstr"))
    return b.join(t, list(by), "inner").withColumn(
        "gap_pct", F.when(F.col("baseline") != 0, (F.col("baseline") - F.col("tstr")) / F.col("baseline") * 100))


def summary_table(res: DataFrame, by: Sequence[str], metric: str = "auc") -> DataFrame:
    """Baseline, TSTR, best augmented, best alpha, delta.  With the generator in ``by``, one row
    per generator against the baseline of its cell."""
    base = baseline_means(res, _baseline_key(by), metric)
    arms = res.filter(F.col("condition") != "real_only") if _baseline_key(by) != list(by) else res
    tstr = arms.groupBy(*by).agg(F.avg(F.when(F.col("condition") == "synthetic_only", F.col(metric))).alias("tstr"))
    t = join_on(join_on(tstr, base, _baseline_key(by), "left"), best_alpha(res, by, metric), by, "left")
    return t.select(*by, F.col("baseline_mean").alias("baseline"), "tstr", F.col("best_mean").alias("best_augmented"),
                    "best_alpha", (F.col("best_mean") - F.col("baseline_mean")).alias("delta"))


def recovery(dense: Column, sparse: Column, best: Column) -> Column:
    """(best - sparse) / (dense - sparse) * 100; NULL when dense == sparse."""
    return F.when(dense != sparse, (best - sparse) / (dense - sparse) * 100)


def decision_text(reject: Column, delta: Column) -> Column:
    """Headline survives FDR -> text."""
    return (F.when(reject & (delta > 0), F.lit("significant gain"))
            .when(reject & (delta < 0), F.lit("significant loss"))
            .otherwise(F.lit("no FDR-significant difference")))


# fixed values: positive-rate bands and alpha ranges; the codes are ours
RECOMMEND_BANDS = [
    (0.005, "augment", "0.1-0.3"),
    (0.01, "augment_small_then_validate", "0.1-0.3"),
    (0.10, "validate_first", None),
    (None, "skip", None),
]


def recommend(pos_rate: Column) -> tuple[Column, Column]:
    """Advice and alpha range for a positive rate."""
    advice = alpha = None
    for upper, text, rng in RECOMMEND_BANDS:
        a_val = F.lit(rng).cast("string")
        if upper is None:
            advice, alpha = advice.otherwise(F.lit(text)), alpha.otherwise(a_val)
        elif advice is None:
            advice, alpha = F.when(pos_rate < upper, F.lit(text)), F.when(pos_rate < upper, a_val)
        else:
            advice, alpha = advice.when(pos_rate < upper, F.lit(text)), alpha.when(pos_rate < upper, a_val)
    return advice, alpha


# fixed values: limits of the decision framework; the codes are ours
LOW_RATE = 0.10
SMALL_GROUP = 5_000
VERY_SMALL = 200
MANY_ROWS = 50_000
BALANCED_RATE = 0.40


def recommend_profile(goal: Column, pos_rate: Column, n: Column, n_min_group: Column, named_features: Column) -> Column:
    """E12 on a whole profile: the goal, then the rate, the smallest group, and the size decide, in this order.

    ``goal`` is "share", "uplift" or anything else (predict); ``named_features``: feature names carry a
    meaning.  A NULL rate, size or flag never meets its condition."""
    def met(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))
    return (F.when(met(goal == "share"), "share_copies_and_test_privacy")
            .when(met(pos_rate < LOW_RATE), "oversample_minority")
            .when(met(n_min_group < VERY_SMALL) & met(named_features), "language_model_small_alpha")
            .when(met(n_min_group < VERY_SMALL), "fit_statistical_generator")
            .when(met(n_min_group < SMALL_GROUP), "fit_generator_and_grow_2x_to_5x")
            .when(met(goal == "uplift"), "known_process_only")
            .when(met(n > MANY_ROWS) & met(pos_rate.between(BALANCED_RATE, 1 - BALANCED_RATE)), "real_rows_suffice")
            .otherwise("sweep_alpha_0.1_to_0.5"))


# fixed values: deploy if >= 2 AUC points or >= 5 % MAPE reduction
MIN_AUC_GAIN = 0.02
MIN_MAPE_REDUCTION = 0.05


def gain_to_cost(auc_gain: Column, mape_reduction: Column) -> Column:
    """Deploy when the gain is meaningful."""
    return (F.coalesce(auc_gain >= MIN_AUC_GAIN, F.lit(False)) |
            F.coalesce(mape_reduction >= MIN_MAPE_REDUCTION, F.lit(False)))


def pm_text(mean: Column, half: Column) -> Column:
    """S13: "0.548 ± 0.092"."""
    return F.format_string("%.3f ± %.3f", mean, half)


def signed_pts(x: Column) -> Column:
    """Signed points, "+5.84"."""
    return F.format_string("%+.2f", x * 100)


def wins_text(wins: Column, n: Column) -> Column:
    """S13: "4/5"."""
    return F.concat_ws("/", wins.cast("string"), n.cast("string"))
