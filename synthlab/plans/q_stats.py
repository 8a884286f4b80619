"""Registered queries: statistics layer on the per-seed result table."""
from __future__ import annotations

from pyspark.sql import functions as F

from synthlab.functions.exprs import r6
from synthlab.functions.tdist import sql_t_cdf, sql_t_table_cte, sql_t_two_sided_p
from synthlab.operators import stats as ST
from synthlab.plans import fixtures as X
from synthlab.plans.registry import register
from synthlab.sources.tables import load

R = X.SQL_RESULTS_LONG
TT = sql_t_table_cte()
BOUND = 0.005   # fixed value: equivalence bound, 0.5 AUC points
FDR_Q = 0.10    # fixed value: false-discovery level


def _round_all(df, keep):
    return df.select(*[F.col(c) if c in keep or t not in ("double", "float") else r6(c).alias(c)
                       for c, t in df.dtypes])


# ---- ci95 (A8) ------------------------------------------------------------------------------------

@register("ci95", f"""
WITH {TT}, r AS ({R}),
g AS (SELECT dataset, n, method, alpha, count(auc) AS k, avg(auc) AS m, stddev_samp(auc) AS sd FROM r GROUP BY ALL),
h AS (SELECT g.*, CASE WHEN k >= 2 THEN tt.t_crit * sd / sqrt(k) END AS half FROM g LEFT JOIN t_table tt ON tt.nu = g.k - 1)
SELECT dataset, n, method, alpha, CAST(k AS BIGINT) AS n_valid, round(m, 6) AS mean, round(half, 6) AS ci95,
       round(m - half, 6) AS ci_lo, round(m + half, 6) AS ci_hi FROM h""")
def q_ci95(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    return _round_all(ST.ci95(r, "auc", ["dataset", "n", "method", "alpha"]), [])


# ---- paired stats family (J1 A14-A17 W2) ---------------------------------------------------------------

SQL_PAIRS = f"""r AS ({R}),
b AS (SELECT dataset, n, seed, auc AS base FROM r WHERE method = 'baseline'),
m AS (SELECT dataset, n, seed, alpha, auc AS meth FROM r WHERE method = 'method'),
p AS (SELECT m.dataset, m.n, m.alpha, m.seed, b.base, m.meth, m.meth - b.base AS d
      FROM m JOIN b ON m.dataset = b.dataset AND m.n = b.n AND m.seed = b.seed),
g AS (SELECT dataset, n, alpha, count(d) AS k, avg(base) AS bm, stddev_samp(base) AS sb, avg(meth) AS mm,
             stddev_samp(meth) AS sm, avg(d) AS dm, stddev_samp(d) AS sd,
             sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS wins, sum(d) AS sumd, min(d) AS dmin, max(d) AS dmax
      FROM p GROUP BY dataset, n, alpha),
h AS (SELECT g.*, tt.t_crit AS tc, sd / sqrt(k) AS sem, dm / (sd / sqrt(k)) AS ts,
             (dm + {BOUND}::DOUBLE) / (sd / sqrt(k)) AS tlo, ({BOUND}::DOUBLE - dm) / (sd / sqrt(k)) AS thi,
             (sumd - dmax) / (k - 1) AS jmin, (sumd - dmin) / (k - 1) AS jmax
      FROM g LEFT JOIN t_table tt ON tt.nu = g.k - 1),
ps AS (SELECT dataset, n, alpha, CAST(k AS BIGINT) AS n_seeds,
       round(bm, 6) AS baseline_mean, round(tc * sb / sqrt(k), 6) AS baseline_ci95_indep,
       round(mm, 6) AS method_mean, round(tc * sm / sqrt(k), 6) AS method_ci95_indep,
       round(dm, 6) AS delta_mean, round(tc * sem, 6) AS delta_ci95_paired, round(sd, 6) AS delta_sd,
       CASE WHEN sd > 0 THEN round(dm / sd, 6) END AS cohen_dz, CAST(wins AS BIGINT) AS wins,
       CASE WHEN sem > 0 THEN round(ts, 6) END AS t_stat,
       CASE WHEN sem > 0 THEN {sql_t_two_sided_p('ts', 'k - 1')} END AS p_raw,
       CASE WHEN sem > 0 THEN greatest(1.0::DOUBLE - {sql_t_cdf('tlo', 'k - 1')}, 1.0::DOUBLE - {sql_t_cdf('thi', 'k - 1')}) END AS p_tost_raw,
       CASE WHEN k >= 2 THEN round(jmin, 6) END AS jack_delta_min, CASE WHEN k >= 2 THEN round(jmax, 6) END AS jack_delta_max,
       CASE WHEN k >= 2 THEN jmin * jmax > 0 END AS jack_sign_stable
      FROM h)"""

PS_COLS = ("dataset, n, alpha, n_seeds, baseline_mean, baseline_ci95_indep, method_mean, method_ci95_indep, "
           "delta_mean, delta_ci95_paired, delta_sd, cohen_dz, wins, t_stat, round(p_raw, 6) AS p_paired, "
           "round(p_tost_raw, 6) AS p_tost, jack_delta_min, jack_delta_max, jack_sign_stable")


def _paired(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    base = r.filter(F.col("method") == "baseline")
    meth = r.filter(F.col("method") == "method")
    pairs = ST.pair(meth.drop("method"), base.drop("alpha", "method"), ["dataset", "n", "seed"], "auc", "meth", "base", keep=["alpha"])
    return ST.paired_stats(pairs, ["dataset", "n", "alpha"], bound=BOUND)


@register("paired_stats", f"WITH {TT}, {SQL_PAIRS} SELECT {PS_COLS} FROM ps")
def q_paired(spark, sf_dir):
    return _round_all(_paired(spark, sf_dir), [])


@register("jackknife", f"""WITH {TT}, {SQL_PAIRS}
SELECT dataset, n, alpha, delta_mean, jack_delta_min, jack_delta_max, jack_sign_stable FROM ps""")
def q_jack(spark, sf_dir):
    return _round_all(_paired(spark, sf_dir).select("dataset", "n", "alpha", "delta_mean", "jack_delta_min",
                                                    "jack_delta_max", "jack_sign_stable"), [])


@register("tost", f"""WITH {TT}, {SQL_PAIRS}
SELECT dataset, n, alpha, delta_mean, round(p_tost_raw, 6) AS p_tost,
       round(p_tost_raw, 6) < 0.05 AS equivalent FROM ps""")
def q_tost(spark, sf_dir):
    ps = _round_all(_paired(spark, sf_dir).select("dataset", "n", "alpha", "delta_mean", "p_tost"), [])
    return ps.withColumn("equivalent", F.col("p_tost") < 0.05)


SQL_BH = f"""bh0 AS (SELECT *, row_number() OVER (PARTITION BY p_raw IS NULL ORDER BY p_raw) AS rk,
                    count(*) OVER (PARTITION BY p_raw IS NULL) AS mm FROM ps),
bh1 AS (SELECT *, least(min(p_raw * mm / rk) OVER (PARTITION BY p_raw IS NULL ORDER BY rk DESC
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0::DOUBLE) AS adj FROM bh0)"""


@register("bh_fdr", f"""WITH {TT}, {SQL_PAIRS}, {SQL_BH}
SELECT dataset, n, alpha, round(p_raw, 6) AS p_paired, CASE WHEN p_raw IS NOT NULL THEN round(adj, 6) END AS p_fdr_bh,
       CASE WHEN p_raw IS NOT NULL THEN adj <= {FDR_Q}::DOUBLE END AS fdr_reject FROM bh1""")
def q_bh(spark, sf_dir):
    ps = _paired(spark, sf_dir).select("dataset", "n", "alpha", "p_paired")
    return _round_all(ST.bh_fdr(ps, "p_paired", FDR_Q), [])


@register("bonferroni", f"""WITH {TT}, {SQL_PAIRS}
SELECT dataset, n, alpha, round(p_raw, 6) AS p_paired, round(least(p_raw * count(p_raw) OVER (), 1.0::DOUBLE), 6) AS p_bonferroni
FROM ps""")
def q_bonf(spark, sf_dir):
    ps = _paired(spark, sf_dir).select("dataset", "n", "alpha", "p_paired")
    return _round_all(ST.bonferroni(ps, "p_paired"), [])


@register("rigorous_analysis", f"""WITH {TT}, {SQL_PAIRS}, {SQL_BH}
SELECT {PS_COLS.replace('round(p_raw, 6) AS p_paired', 'round(p_raw, 6) AS p_paired')},
       CASE WHEN p_raw IS NOT NULL THEN round(adj, 6) END AS p_fdr_bh,
       round(least(p_raw * count(p_raw) OVER (), 1.0::DOUBLE), 6) AS p_bonferroni,
       CASE WHEN p_raw IS NOT NULL THEN adj <= {FDR_Q}::DOUBLE END AS fdr_reject FROM bh1""")
def q_rigorous(spark, sf_dir):
    """Paired stats, BH-FDR and Bonferroni over the whole family in one plan."""
    ps = _paired(spark, sf_dir)
    out = ST.bonferroni(ST.bh_fdr(ps, "p_paired", FDR_Q), "p_paired")
    return _round_all(out, [])


# ---- ci_summary (A9): method CI and paired gain CI per (dataset, n, alpha) ------------------------------

@register("ci_summary", f"""WITH {TT}, {SQL_PAIRS}
SELECT dataset, n, alpha, n_seeds, method_mean AS auc_mean, method_ci95_indep AS auc_ci95,
       round(dm * 100, 6) AS gain_pts, round(tc * sem * 100, 6) AS gain_ci95_pts,
       printf('%.3f ± %.3f', mm, tc * sm / sqrt(k)) AS auc_text
FROM ps JOIN h USING (dataset, n, alpha)""")
def q_ci_summary(spark, sf_dir):
    ps = _paired(spark, sf_dir)
    return ps.select("dataset", "n", "alpha", "n_seeds", r6("method_mean").alias("auc_mean"),
                     r6("method_ci95_indep").alias("auc_ci95"), r6(F.col("delta_mean") * 100).alias("gain_pts"),
                     r6(F.col("delta_ci95_paired") * 100).alias("gain_ci95_pts"),
                     F.format_string("%.3f ± %.3f", "method_mean", "method_ci95_indep").alias("auc_text"))


# ---- pairing_mismatch (J2): planted missing seed ----------------------------------------------------------
# the method arm loses every seed whose month equals the dataset's first letter code mod 12

@register("pairing_mismatch", f"""WITH r AS ({R}),
b AS (SELECT DISTINCT dataset, n, seed FROM r WHERE method = 'baseline'),
m AS (SELECT DISTINCT dataset, n, seed FROM r WHERE method = 'method' AND NOT (seed = 3 AND n = 500)),
j AS (SELECT coalesce(b.dataset, m.dataset) AS dataset, coalesce(b.n, m.n) AS n, coalesce(b.seed, m.seed) AS seed,
             b.dataset IS NULL AS no_b, m.dataset IS NULL AS no_m
      FROM b FULL OUTER JOIN m ON b.dataset = m.dataset AND b.n = m.n AND b.seed = m.seed)
SELECT dataset, n, seed, CASE WHEN no_b THEN 'only_method' ELSE 'only_baseline' END AS side FROM j WHERE no_b OR no_m""")
def q_mismatch(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    b = r.filter(F.col("method") == "baseline")
    m = r.filter((F.col("method") == "method") & ~((F.col("seed") == 3) & (F.col("n") == 500)))
    return ST.pairing_mismatch(b, m, ["dataset", "n", "seed"])


# ---- regression of gain on imbalance (A19 A20 A21) ---------------------------------------------------------
# one point per nation: x = ln(share of BUILDING customers), y = mean account balance / 10^4

SQL_NATION_POINTS = """SELECT c_nationkey AS id, ln(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END)::DOUBLE) AS x,
       avg(c_acctbal) / 10000.0::DOUBLE AS y FROM customer GROUP BY c_nationkey
       HAVING sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) > 0"""


def _nation_points(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    g = c.groupBy("c_nationkey").agg(
        F.avg(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0)).alias("_share"),
        (F.avg("c_acctbal") / 10000.0).alias("y"))
    return g.filter(F.col("_share") > 0).select(F.col("c_nationkey").alias("id"), F.log("_share").alias("x"), "y")


@register("imbalance_regression", f"""WITH pts AS ({SQL_NATION_POINTS}),
m AS (SELECT count(*) AS k, regr_slope(y, x) AS slope, regr_avgy(y, x) - regr_slope(y, x) * regr_avgx(y, x) AS icpt, regr_r2(y, x) AS r2,
             regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM pts),
s AS (SELECT *, sqrt((syy - slope * sxy) / (k - 2) / sxx) AS se FROM m),
u AS (SELECT *, slope / se AS ts FROM s)
SELECT CAST(k AS BIGINT) AS n, round(slope, 6) AS slope, round(icpt, 6) AS intercept, round(r2, 6) AS r2,
       round(se, 6) AS se_slope, round({sql_t_two_sided_p('ts', 'k - 2')}, 6) AS p_slope FROM u""")
def q_imb_reg(spark, sf_dir):
    return _round_all(ST.ols(_nation_points(spark, sf_dir), "x", "y"), [])


@register("loo_regression", f"""WITH pts AS ({SQL_NATION_POINTS}),
t AS (SELECT count(*) AS k, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy FROM pts),
l AS (SELECT p.id AS left_out, k - 1 AS k1, sx - x AS sx1, sy - y AS sy1, sxx - x*x AS sxx1, sxy - x*y AS sxy1, syy - y*y AS syy1
      FROM pts p CROSS JOIN t),
c AS (SELECT left_out, k1, sxx1 - sx1*sx1/k1 AS cxx, sxy1 - sx1*sy1/k1 AS cxy, syy1 - sy1*sy1/k1 AS cyy FROM l),
s AS (SELECT left_out, k1, cxy / cxx AS slope, cxy*cxy/(cxx*cyy) AS r2, sqrt((cyy - (cxy/cxx)*cxy) / (k1 - 2) / cxx) AS se, cxx, cxy FROM c),
u AS (SELECT *, slope / se AS ts FROM s)
SELECT left_out, round(slope, 6) AS slope, round(r2, 6) AS r2, round({sql_t_two_sided_p('ts', 'k1 - 2')}, 6) AS p_slope FROM u""")
def q_loo(spark, sf_dir):
    return _round_all(ST.loo_ols(_nation_points(spark, sf_dir), "id", "x", "y"), [])


@register("spearman", f"""WITH pts AS ({SQL_NATION_POINTS}),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM pts)
SELECT round(corr(rx, ry), 6) AS spearman_rho, CAST(count(*) AS BIGINT) AS n FROM r""")
def q_spearman(spark, sf_dir):
    return _round_all(ST.spearman(_nation_points(spark, sf_dir), "x", "y"), [])
