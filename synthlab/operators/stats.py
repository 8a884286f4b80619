"""Statistics over long-format results.

All tests are aggregates over (cell, seed) rows: one ``groupBy`` per family, closed-form t
distribution from ``functions.tdist``.  Drop-one (jackknife) and leave-one-out regressions use
"totals minus own contribution", so they need neither windows over raw rows nor cross joins.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlab.functions.exprs import join_on
from synthlab.functions.tdist import t_cdf, t_crit, t_two_sided_p
from synthlab.operators.ordered import tie_ranks


def ci95(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and t-based 95 % half-width of non-NULL values; NULL half-width when n < 2."""
    g = df.groupBy(*by).agg(F.count(value).alias("n_valid"), F.avg(value).alias("mean"),
                            F.stddev_samp(value).alias("_sd"))
    half = F.when(F.col("n_valid") >= 2,
                  t_crit(F.col("n_valid") - 1) * F.col("_sd") / F.sqrt(F.col("n_valid").cast("double")))
    return g.select(*by, F.col("n_valid").cast("long"), "mean", half.alias("ci95"),
                    (F.col("mean") - half).alias("ci_lo"), (F.col("mean") + half).alias("ci_hi"))


RUN_KEYS = ("run_id", "holdout_id")


def pair(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "auc",
         a_name: str = "base", b_name: str = "meth", keep: Sequence[str] = ()) -> DataFrame:
    """Inner equi-join of two arms on the pairing key (cell + seed).  Rows of different runs or
    holdouts never pair (``keep``: further columns of ``a``): ``RUN_KEYS`` that both arms have join the key by themselves."""
    on = [*on, *[c for c in RUN_KEYS if c in a.columns and c in b.columns and c not in on]]
    return join_on(a.select(*on, *keep, F.col(value).alias(a_name)), b.select(*on, F.col(value).alias(b_name)), on)


def pairing_mismatch(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys present in only one arm, with the side that has them."""
    ka = a.select(*on).distinct().withColumn("_a", F.lit(True))
    kb = b.select(*on).distinct().withColumn("_b", F.lit(True))
    missing = (join_on(ka, kb, on, "left_anti").select(*on, F.lit("only_baseline").alias("side")))
    return missing.unionByName(join_on(kb, ka, on, "left_anti").select(*on, F.lit("only_method").alias("side")))


def paired_stats(pairs: DataFrame, by: Sequence[str], base: str = "base", meth: str = "meth",
                 bound: float = 0.005) -> DataFrame:
    """A14-A17 + W2 per cell from paired rows (one per seed).

    Columns follow the published per-cell table: means, independent CIs (both with the paired
    t_crit of n-1), paired CI, sd of delta, d_z, wins, t, p, TOST p at +-bound, jackknife range."""
    d = F.col(meth) - F.col(base)
    g = pairs.withColumn("_d", d).groupBy(*by).agg(
        F.count("_d").alias("n_seeds"),
        F.avg(base).alias("baseline_mean"), F.stddev_samp(base).alias("_sb"),
        F.avg(meth).alias("method_mean"), F.stddev_samp(meth).alias("_sm"),
        F.avg("_d").alias("delta_mean"), F.stddev_samp("_d").alias("delta_sd"),
        F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("wins"),
        F.sum("_d").alias("_sum"), F.min("_d").alias("_dmin"), F.max("_d").alias("_dmax"))
    n = F.col("n_seeds")
    nd = n.cast("double")
    tc = t_crit(n - 1)
    sem = F.col("delta_sd") / F.sqrt(nd)
    ok = sem > 0
    t = F.col("delta_mean") / sem
    t_lo = (F.col("delta_mean") + F.lit(bound)) / sem
    t_hi = (F.lit(bound) - F.col("delta_mean")) / sem
    jmin = (F.col("_sum") - F.col("_dmax")) / (nd - 1)
    jmax = (F.col("_sum") - F.col("_dmin")) / (nd - 1)
    return g.select(
        *by, n.cast("long").alias("n_seeds"),
        "baseline_mean", (tc * F.col("_sb") / F.sqrt(nd)).alias("baseline_ci95_indep"),
        "method_mean", (tc * F.col("_sm") / F.sqrt(nd)).alias("method_ci95_indep"),
        "delta_mean", (tc * sem).alias("delta_ci95_paired"), "delta_sd",
        F.when(F.col("delta_sd") > 0, F.col("delta_mean") / F.col("delta_sd")).alias("cohen_dz"),
        F.col("wins").cast("long").alias("wins"),
        F.when(ok, t).alias("t_stat"),
        F.when(ok, t_two_sided_p(t, n - 1)).alias("p_paired"),
        F.when(ok, F.greatest(F.lit(1.0) - t_cdf(t_lo, n - 1), F.lit(1.0) - t_cdf(t_hi, n - 1))).alias("p_tost"),
        F.when(n >= 2, jmin).alias("jack_delta_min"), F.when(n >= 2, jmax).alias("jack_delta_max"),
        F.when(n >= 2, (jmin * jmax) > 0).alias("jack_sign_stable"))


def bh_fdr(tests: DataFrame, p: str = "p_paired", q: float = 0.10, family: Sequence[str] = (),
           out: str = "p_fdr_bh", reject: str = "fdr_reject") -> DataFrame:
    """Benjamini-Hochberg adjusted p (p*m/rank, reverse running min, clip 1) and reject flag.

    The window spans one test family (one row per test, e.g. 16 or 45 rows)."""
    fam = list(family)
    t = (tests.withColumn("_v", F.col(p).isNotNull())
         .withColumn("_rank", F.row_number().over(Window.partitionBy(*fam, "_v").orderBy(F.col(p))))
         .withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*fam, "_v")))
         .withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank")))
    w_tail = Window.partitionBy(*fam, "_v").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_adj", F.least(F.min("_raw").over(w_tail), F.lit(1.0)))
    return (t.withColumn(out, F.when(F.col("_v"), F.col("_adj")))
            .withColumn(reject, F.when(F.col("_v"), F.col("_adj") <= F.lit(q)))
            .drop("_v", "_rank", "_m", "_raw", "_adj"))


def bonferroni(tests: DataFrame, p: str = "p_paired", family: Sequence[str] = (),
               out: str = "p_bonferroni") -> DataFrame:
    """min(p * m, 1) with m = number of non-NULL p in the family."""
    m = F.count(F.col(p)).over(Window.partitionBy(*family))
    return tests.withColumn(out, F.least(F.col(p) * m, F.lit(1.0)))


# ---- A19-A21: regression of gain on imbalance ---------------------------------------------------

def _ols_from_moments(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column) -> dict:
    nd = n.cast("double")
    cxx = sxx - F.try_divide(sx * sx, nd)
    cxy = sxy - F.try_divide(sx * sy, nd)
    cyy = syy - F.try_divide(sy * sy, nd)
    slope = F.try_divide(cxy, cxx)
    intercept = F.try_divide(sy - slope * sx, nd)
    r2 = F.try_divide(cxy * cxy, cxx * cyy)
    se = F.sqrt(F.try_divide(F.try_divide(cyy - slope * cxy, nd - 2), cxx))
    t = F.try_divide(slope, se)
    p = t_two_sided_p(t, n - 2)
    return {"slope": slope, "intercept": intercept, "r2": r2, "se_slope": se, "p_slope": p}


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Simple regression y ~ x per group: slope, intercept, R^2, SE, p (n-2 df)."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
                            F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
                            F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
                            F.regr_sxy(y, x).alias("_sxy"))
    se = F.sqrt(F.try_divide(F.try_divide(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.col("n") - 2), F.col("_sxx")))
    return g.select(*by, F.col("n").cast("long"), "slope", "intercept", "r2", se.alias("se_slope"),
                    F.when(F.col("n") > 2, t_two_sided_p(F.try_divide(F.col("slope"), se), F.col("n") - 2)).alias("p_slope"))


def loo_ols(df: DataFrame, id_col: str, x: str, y: str) -> DataFrame:
    """The regression refitted without each point, from totals minus the point's moments."""
    # centred first: raw sums of squares lose the digits of large values
    mean = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    df = (df.crossJoin(F.broadcast(mean)).withColumn(x, F.col(x) - F.col("_mx"))
          .withColumn(y, F.col(y) - F.col("_my")).drop("_mx", "_my"))
    tot = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_sx"), F.sum(y).alias("_sy"),
                 F.sum(F.col(x) * F.col(x)).alias("_sxx"), F.sum(F.col(x) * F.col(y)).alias("_sxy"),
                 F.sum(F.col(y) * F.col(y)).alias("_syy"))
    j = df.crossJoin(F.broadcast(tot))  # one-row totals
    m = _ols_from_moments(F.col("_n") - 1, F.col("_sx") - F.col(x), F.col("_sy") - F.col(y),
                          F.col("_sxx") - F.col(x) * F.col(x), F.col("_sxy") - F.col(x) * F.col(y),
                          F.col("_syy") - F.col(y) * F.col(y))
    return j.select(F.col(id_col).alias("left_out"), m["slope"].alias("slope"), m["r2"].alias("r2"),
                    m["p_slope"].alias("p_slope"))


def mid_rank(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Average rank of ties (1-based); a frequent value is spread over tasks."""
    r = tie_ranks(df, by, col)
    return r.select(*df.columns, (F.col("_before") + (F.col("_equal") + 1) / 2.0).alias(name or f"{col}_rank"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman rho = Pearson correlation of mid-ranks."""
    r = mid_rank(mid_rank(df, x, by, "_rx"), y, by, "_ry")
    return r.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman_rho"), F.count(F.lit(1)).cast("long").alias("n"))
