"""Registered queries: reporting, joins over results, run bookkeeping
(A10-A13 A22-A33 J3-J6 J11 W6 A30 E10 E12 E13 E15 S13 A31)."""
from __future__ import annotations

from pyspark.sql import functions as F

from synthlab.functions.exprs import r6
from synthlab.operators import audit as AU
from synthlab.operators import report as RP
from synthlab.operators import stats as ST
from synthlab.plans import fixtures as X
from synthlab.plans.q_stats import FDR_Q, SQL_BH, SQL_PAIRS, TT, _paired
from synthlab.plans.registry import register
from synthlab.sources.tables import load

R = X.SQL_RESULTS_LONG
RA = X.SQL_RESULTS_ALL
CELL = ["dataset", "n"]
# fixed parameters of the report queries
FIXED_ALPHA = 0.3
COLLAPSE_AUC = 0.45
RESCUE_ALPHA = 0.2
BUDGET_LO, BUDGET_HI = 72, 240


def _rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" and c != "alpha" and not c.endswith("alpha") else F.col(c)
                       for c, t in df.dtypes])


SQL_AM = f"am AS (SELECT dataset, n, alpha, avg(auc) AS mean FROM ({R}) WHERE condition = 'augmented' GROUP BY ALL)"
SQL_BM = f"bm AS (SELECT dataset, n, avg(auc) AS baseline_mean FROM ({R}) WHERE condition = 'real_only' GROUP BY ALL)"
SQL_BEST = "ba AS (SELECT dataset, n, max(mean) AS best_mean, arg_max(alpha, (mean, -alpha)) AS best_alpha FROM am GROUP BY ALL)"


@register("best_alpha", f"WITH {SQL_AM}, {SQL_BEST} SELECT dataset, n, round(best_mean, 6) AS best_mean, best_alpha FROM ba")
def q_best_alpha(spark, sf_dir):
    return _rounded(RP.best_alpha(X.results_long(spark, sf_dir), CELL))


@register("best_gain", f"""WITH {SQL_AM}, {SQL_BM}, {SQL_BEST}
SELECT dataset, n, round(best_mean, 6) AS best_mean, best_alpha, round(baseline_mean, 6) AS baseline_mean,
       round(best_mean - baseline_mean, 6) AS best_gain FROM ba JOIN bm USING (dataset, n)""")
def q_best_gain(spark, sf_dir):
    return _rounded(RP.best_gain(X.results_long(spark, sf_dir), CELL))


# ---- two generators against one baseline: A11, A13, A22 per generator ------------------------------------------

SQL_GEN = f"""am AS (SELECT dataset, n, method, alpha, avg(auc) AS mean FROM ({X.SQL_RESULTS_GENERATORS}) WHERE condition = 'augmented' GROUP BY ALL),
bm AS (SELECT dataset, n, avg(auc) AS baseline_mean FROM ({X.SQL_RESULTS_GENERATORS}) WHERE condition = 'real_only' GROUP BY ALL),
ba AS (SELECT dataset, n, method, max(mean) AS best_mean, arg_max(alpha, (mean, -alpha)) AS best_alpha FROM am GROUP BY ALL),
g AS (SELECT ba.*, baseline_mean, best_mean - baseline_mean AS best_gain FROM ba JOIN bm USING (dataset, n))"""


@register("best_gain_by_generator", f"""WITH {SQL_GEN}
SELECT dataset, n, method, round(best_mean, 6) AS best_mean, best_alpha, round(baseline_mean, 6) AS baseline_mean,
       round(best_gain, 6) AS best_gain FROM g""")
def q_best_gain_by_generator(spark, sf_dir):
    return _rounded(RP.best_gain(X.results_generators(spark, sf_dir), [*CELL, "method"]))


@register("best_gain_over_generators", f"""WITH {SQL_GEN}
SELECT dataset, n, round(max(best_gain), 6) AS best_gain FROM g GROUP BY dataset, n""")
def q_best_gain_over_generators(spark, sf_dir):
    return _rounded(RP.best_gain(X.results_generators(spark, sf_dir), CELL).select(*CELL, "best_gain"))


@register("max_gain", f"""WITH {SQL_GEN},
p AS (SELECT l_returnflag AS dataset, round(avg(CAST(l_discount >= 0.09 AS INTEGER)), 3) AS pos_rate FROM lineitem GROUP BY 1)
SELECT dataset, pos_rate, n, round(max(best_gain), 6) AS max_gain, arg_max(method, (best_gain, method)) AS method
FROM g JOIN p USING (dataset) GROUP BY dataset, pos_rate, n""")
def q_max_gain(spark, sf_dir):
    rates = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(
        F.round(F.avg((F.col("l_discount") >= 0.09).cast("int")), 3).alias("pos_rate"))
    gains = RP.best_gain(X.results_generators(spark, sf_dir), [*CELL, "method"]).join(rates, "dataset")
    return RP.max_gain(gains, ["dataset", "pos_rate", "n"]).select(
        "dataset", "pos_rate", "n", r6("max_gain").alias("max_gain"), "method")


@register("summary_by_generator", f"""WITH {SQL_GEN}
SELECT dataset, n, method, round(baseline_mean, 6) AS baseline, CAST(NULL AS DOUBLE) AS tstr,
       round(best_mean, 6) AS best_augmented, best_alpha, round(best_gain, 6) AS delta FROM g""")
def q_summary_by_generator(spark, sf_dir):
    return _rounded(RP.summary_table(X.results_generators(spark, sf_dir), [*CELL, "method"]))


@register("tstr_gap", f"""WITH r AS ({RA})
SELECT dataset, round(avg(auc) FILTER (WHERE condition = 'real_only'), 6) AS baseline,
       round(avg(auc) FILTER (WHERE condition = 'synthetic_only'), 6) AS tstr,
       round((avg(auc) FILTER (WHERE condition = 'real_only') - avg(auc) FILTER (WHERE condition = 'synthetic_only'))
             / avg(auc) FILTER (WHERE condition = 'real_only') * 100, 6) AS gap_pct
FROM r GROUP BY dataset""")
def q_tstr(spark, sf_dir):
    r = X.results_all(spark, sf_dir)
    g = RP.tstr_gap(r.filter(F.col("condition") == "real_only"), r.filter(F.col("condition") == "synthetic_only"),
                    ["dataset"])
    return _rounded(g.orderBy(F.desc("gap_pct")))


@register("summary_table", f"""WITH r AS ({RA}), {SQL_AM}, {SQL_BEST},
s AS (SELECT dataset, n, avg(auc) FILTER (WHERE condition = 'real_only') AS baseline,
             avg(auc) FILTER (WHERE condition = 'synthetic_only') AS tstr FROM r GROUP BY ALL)
SELECT s.dataset, s.n, round(baseline, 6) AS baseline, round(tstr, 6) AS tstr, round(best_mean, 6) AS best_augmented,
       best_alpha, round(best_mean - baseline, 6) AS delta FROM s LEFT JOIN ba USING (dataset, n)""")
def q_summary(spark, sf_dir):
    return _rounded(RP.summary_table(X.results_all(spark, sf_dir), CELL))


@register("compare_datasets", f"""WITH r AS ({RA}), {SQL_AM}
SELECT dataset, round(avg(auc) FILTER (WHERE condition = 'real_only'), 6) AS baseline,
       round(avg(auc) FILTER (WHERE condition = 'synthetic_only'), 6) AS mean_tstr,
       round((SELECT max(mean) FROM am WHERE am.dataset = r.dataset), 6) AS best_augmented
FROM r GROUP BY dataset""")
def q_compare(spark, sf_dir):
    r = X.results_all(spark, sf_dir)
    a = RP.alpha_means(r, CELL).groupBy("dataset").agg(F.max("mean").alias("best_augmented"))
    b = r.groupBy("dataset").agg(F.avg(F.when(F.col("condition") == "real_only", F.col("auc"))).alias("baseline"),
                                 F.avg(F.when(F.col("condition") == "synthetic_only", F.col("auc"))).alias("mean_tstr"))
    return _rounded(b.join(a, "dataset", "left"))


@register("recovery", f"""WITH {SQL_AM}, {SQL_BM}, {SQL_BEST},
d AS (SELECT dataset, max(baseline_mean) FILTER (WHERE n = 1000) AS dense, max(baseline_mean) FILTER (WHERE n = 100) AS sparse
      FROM bm GROUP BY dataset),
b AS (SELECT dataset, best_mean AS best FROM ba WHERE n = 100)
SELECT dataset, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(best, 6) AS best,
       round(CASE WHEN dense <> sparse THEN (best - sparse) / (dense - sparse) * 100 END, 6) AS recovery_pct,
       round((sparse - dense) * 100, 6) AS sparsity_cost_pts FROM d JOIN b USING (dataset)""")
def q_recovery(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    bm = RP.baseline_means(r, CELL)
    d = bm.groupBy("dataset").agg(F.max(F.when(F.col("n") == 1000, F.col("baseline_mean"))).alias("dense"),
                                  F.max(F.when(F.col("n") == 100, F.col("baseline_mean"))).alias("sparse"))
    b = RP.best_alpha(r, CELL).filter(F.col("n") == 100).select("dataset", F.col("best_mean").alias("best"))
    j = d.join(b, "dataset")
    return _rounded(j.select("dataset", "dense", "sparse", "best",
                             RP.recovery(F.col("dense"), F.col("sparse"), F.col("best")).alias("recovery_pct"),
                             ((F.col("sparse") - F.col("dense")) * 100).alias("sparsity_cost_pts")))


@register("collapse_count", f"""WITH r AS ({R}),
b AS (SELECT dataset, n, seed, auc AS base FROM r WHERE method = 'baseline'),
m AS (SELECT dataset, n, seed, auc AS meth FROM r WHERE method = 'method' AND alpha = {RESCUE_ALPHA}::DOUBLE)
SELECT dataset, n, CAST(count(*) FILTER (WHERE base < {COLLAPSE_AUC}::DOUBLE) AS BIGINT) AS n_collapsed,
       CAST(count(*) FILTER (WHERE base < {COLLAPSE_AUC}::DOUBLE AND meth >= {COLLAPSE_AUC}::DOUBLE) AS BIGINT) AS n_rescued
FROM b LEFT JOIN m USING (dataset, n, seed) GROUP BY dataset, n""")
def q_collapse(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    b = r.filter(F.col("method") == "baseline").select("dataset", "n", "seed", F.col("auc").alias("base"))
    m = r.filter((F.col("method") == "method") & (F.col("alpha") == RESCUE_ALPHA)).select(
        "dataset", "n", "seed", F.col("auc").alias("meth"))
    j = b.join(m, ["dataset", "n", "seed"], "left")
    return j.groupBy("dataset", "n").agg(
        F.count_if(F.col("base") < COLLAPSE_AUC).cast("long").alias("n_collapsed"),
        F.count_if((F.col("base") < COLLAPSE_AUC) & (F.col("meth") >= COLLAPSE_AUC)).cast("long").alias("n_rescued"))


@register("ci_width_ratio", f"""WITH {TT}, {SQL_PAIRS}
SELECT dataset, n, alpha, round(baseline_ci95_indep, 6) AS baseline_ci95, round(method_ci95_indep, 6) AS method_ci95,
       round((tc * sb / sqrt(k)) / (tc * sm / sqrt(k)), 6) AS width_ratio FROM ps JOIN h USING (dataset, n, alpha)""")
def q_width(spark, sf_dir):
    ps = _paired(spark, sf_dir)
    return _rounded(ps.select("dataset", "n", "alpha", F.col("baseline_ci95_indep").alias("baseline_ci95"),
                              F.col("method_ci95_indep").alias("method_ci95"),
                              F.try_divide(F.col("baseline_ci95_indep"), F.col("method_ci95_indep")).alias("width_ratio")))


@register("outlier_seed", f"""WITH r AS ({R}),
b AS (SELECT dataset, n, seed, auc AS base FROM r WHERE method = 'baseline'),
p AS (SELECT m.dataset, m.n, m.alpha, m.seed, m.auc - b.base AS d FROM r m JOIN b USING (dataset, n, seed) WHERE m.method = 'method')
SELECT dataset, n, alpha, seed, round((sum(d) OVER w - d) / (count(d) OVER w - 1), 6) AS mean_gain_without
FROM p WINDOW w AS (PARTITION BY dataset, n, alpha)""")
def q_outlier(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    b = r.filter(F.col("method") == "baseline").select("dataset", "n", "seed", F.col("auc").alias("base"))
    p = (r.filter(F.col("method") == "method").join(b, ["dataset", "n", "seed"])
         .select("dataset", "n", "alpha", "seed", (F.col("auc") - F.col("base")).alias("d")))
    # group totals joined back (one row per cell) instead of a window over the cell
    tot = p.groupBy("dataset", "n", "alpha").agg(F.sum("d").alias("_s"), F.count("d").alias("_k"))
    j = p.join(tot, ["dataset", "n", "alpha"])
    return j.select("dataset", "n", "alpha", "seed",
                    r6((F.col("_s") - F.col("d")) / (F.col("_k") - 1)).alias("mean_gain_without"))


# classifier = n band stand-in, generator = dataset stand-in
CLASSIFIER_OF_N = [(100, "gbc"), (500, "lr"), (1000, "rf")]
CLASSIFIER_DISPLAY_ORDER = ["gbc", "lr", "rf", "mlp"]


@register("multi_classifier_summary", f"""WITH {SQL_AM}, {SQL_BM},
g AS (SELECT CASE n {' '.join(f"WHEN {k} THEN '{v}'" for k, v in CLASSIFIER_OF_N)} END AS classifier, dataset AS generator,
             mean - baseline_mean AS gain, alpha FROM am JOIN bm USING (dataset, n))
SELECT classifier, generator, round(max(gain), 6) AS best_gain, arg_max(alpha, (gain, -alpha)) AS best_alpha,
       CAST(any_value(o.display_rank) AS BIGINT) AS display_rank
FROM g JOIN (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(CLASSIFIER_DISPLAY_ORDER, 1))}) o(cls, display_rank) ON g.classifier = o.cls
GROUP BY classifier, generator""")
def q_multi(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    g = RP.alpha_means(r, CELL).join(RP.baseline_means(r, CELL), CELL)
    cls = F.lit(None).cast("string")
    for k, v in CLASSIFIER_OF_N:
        cls = F.when(F.col("n") == k, v).otherwise(cls)
    g = g.select(cls.alias("classifier"), F.col("dataset").alias("generator"), "alpha",
                 (F.col("mean") - F.col("baseline_mean")).alias("gain"))
    best = g.groupBy("classifier", "generator").agg(F.max(F.struct("gain", (-F.col("alpha")).alias("na"))).alias("_b"))
    # O3: fixed display order of categories through a join to a small order table
    order = spark.createDataFrame([(c, i) for i, c in enumerate(CLASSIFIER_DISPLAY_ORDER, 1)], "classifier STRING, display_rank BIGINT")
    out = best.join(F.broadcast(order), "classifier")
    return out.select("classifier", "generator", r6("_b.gain").alias("best_gain"), (-F.col("_b.na")).alias("best_alpha"),
                      "display_rank").orderBy("display_rank", "generator")


@register("pivot_wide", f"""WITH r AS ({RA})
SELECT dataset, n, round(avg(auc) FILTER (WHERE condition = 'real_only'), 6) AS real_only,
       round(avg(auc) FILTER (WHERE condition = 'augmented'), 6) AS augmented,
       round(avg(auc) FILTER (WHERE condition = 'synthetic_only'), 6) AS synthetic_only FROM r GROUP BY dataset, n""")
def q_pivot(spark, sf_dir):
    r = X.results_all(spark, sf_dir)
    p = r.groupBy("dataset", "n").pivot("condition", ["real_only", "augmented", "synthetic_only"]).agg(F.avg("auc"))
    return _rounded(p)


@register("fixed_vs_best_alpha", f"""WITH {SQL_AM}, {SQL_BM}, {SQL_BEST}
SELECT dataset, n, round(max(mean) FILTER (WHERE alpha = {FIXED_ALPHA}::DOUBLE) - any_value(baseline_mean), 6) AS fixed_gain,
       round(any_value(best_mean) - any_value(baseline_mean), 6) AS best_gain,
       round(any_value(best_mean) - max(mean) FILTER (WHERE alpha = {FIXED_ALPHA}::DOUBLE), 6) AS optimism
FROM am JOIN bm USING (dataset, n) JOIN ba USING (dataset, n) GROUP BY dataset, n""")
def q_fixed(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    fixed = RP.alpha_means(r, CELL).filter(F.col("alpha") == FIXED_ALPHA).select(*CELL, F.col("mean").alias("fixed"))
    b = RP.best_gain(r, CELL).join(fixed, CELL)
    return _rounded(b.select(*CELL, (F.col("fixed") - F.col("baseline_mean")).alias("fixed_gain"), "best_gain",
                             (F.col("best_mean") - F.col("fixed")).alias("optimism")))


@register("minority_budget_gain", f"""WITH {SQL_AM}, {SQL_BM}, {SQL_BEST},
mb AS (SELECT l_returnflag AS dataset, count(*) FILTER (WHERE l_discount >= 0.09 AND l_quantity >= 40) AS n_pos FROM lineitem GROUP BY 1)
SELECT dataset, CAST(n_pos AS BIGINT) AS n_pos, round(best_mean - baseline_mean, 6) AS best_gain,
       n_pos BETWEEN {BUDGET_LO} AND {BUDGET_HI} AS unobserved_region
FROM mb JOIN ba USING (dataset) JOIN bm USING (dataset, n) WHERE n = 100""")
def q_budget_gain(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    mb = li.groupBy(F.col("l_returnflag").alias("dataset")).agg(
        F.count_if((F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 40)).cast("long").alias("n_pos"))
    g = RP.best_gain(X.results_long(spark, sf_dir), CELL).filter(F.col("n") == 100)
    return mb.join(g, "dataset").select("dataset", "n_pos", r6("best_gain").alias("best_gain"),
                                        F.col("n_pos").between(BUDGET_LO, BUDGET_HI).alias("unobserved_region"))


@register("head_to_head", f"""WITH r AS ({R}),
a AS (SELECT dataset, n, seed, auc AS a FROM r WHERE method = 'method' AND alpha = 0.1::DOUBLE),
b AS (SELECT dataset, n, seed, auc AS b FROM r WHERE method = 'method' AND alpha = 1.0::DOUBLE)
SELECT dataset, n, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(a - b), 6) AS mean_diff,
       CAST(sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS BIGINT) AS wins_a FROM a JOIN b USING (dataset, n, seed) GROUP BY dataset, n""")
def q_h2h(spark, sf_dir):
    r = X.results_long(spark, sf_dir).filter(F.col("method") == "method")
    p = ST.pair(r.filter(F.col("alpha") == 0.1), r.filter(F.col("alpha") == 1.0), ["dataset", "n", "seed"],
                a_name="a", b_name="b")
    return p.groupBy(*CELL).agg(F.count(F.lit(1)).cast("long").alias("n_pairs"),
                                r6(F.avg(F.col("a") - F.col("b"))).alias("mean_diff"),
                                F.count_if(F.col("a") > F.col("b")).cast("long").alias("wins_a"))


@register("metadata_join", f"""WITH {SQL_AM}, {SQL_BM}, {SQL_BEST},
md AS (SELECT l_returnflag AS dataset, 'flag ' || l_returnflag AS label, avg(CAST(l_discount >= 0.09 AS DOUBLE)) AS pos_rate,
              CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY l_returnflag)
SELECT dataset, n, label, round(pos_rate, 6) AS pos_rate, n_rows, round(best_mean - baseline_mean, 6) AS best_gain
FROM ba JOIN bm USING (dataset, n) JOIN md USING (dataset)""")
def q_meta(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    md = li.groupBy(F.col("l_returnflag").alias("dataset")).agg(
        F.avg((F.col("l_discount") >= 0.09).cast("double")).alias("pos_rate"), F.count(F.lit(1)).cast("long").alias("n_rows"))
    md = md.withColumn("label", F.concat(F.lit("flag "), F.col("dataset")))
    g = RP.best_gain(X.results_long(spark, sf_dir), CELL)
    # one metadata row per dataset: broadcast
    return _rounded(g.join(F.broadcast(md), "dataset").select("dataset", "n", "label", "pos_rate", "n_rows", "best_gain"))


@register("lookup_default", f"""WITH r AS ({R}),
b AS (SELECT dataset, n, seed, auc AS base FROM r WHERE method = 'baseline'),
w AS (SELECT m.dataset, m.alpha, count(*) AS wins FROM r m JOIN b USING (dataset, n, seed)
      WHERE m.method = 'method' AND m.auc - b.base > 0.01::DOUBLE AND m.n = 100 GROUP BY ALL),
g AS (SELECT d.dataset, a.alpha FROM (SELECT DISTINCT dataset FROM r) d CROSS JOIN (SELECT DISTINCT alpha FROM r WHERE alpha IS NOT NULL) a)
SELECT g.dataset, g.alpha, CAST(coalesce(w.wins, 0) AS BIGINT) AS wins FROM g LEFT JOIN w USING (dataset, alpha)""")
def q_lookup(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    b = r.filter(F.col("method") == "baseline").select("dataset", "n", "seed", F.col("auc").alias("base"))
    w = (r.filter((F.col("method") == "method") & (F.col("n") == 100)).join(b, ["dataset", "n", "seed"])
         .filter(F.col("auc") - F.col("base") > 0.01).groupBy("dataset", "alpha").agg(F.count(F.lit(1)).alias("wins")))
    # distinct alphas: bounded by the experiment grid
    grid = r.select("dataset").distinct().crossJoin(F.broadcast(r.filter(F.col("alpha").isNotNull()).select("alpha").distinct()))
    return grid.join(w, ["dataset", "alpha"], "left").select(
        "dataset", "alpha", F.coalesce(F.col("wins"), F.lit(0)).cast("long").alias("wins"))


# ---- run bookkeeping (W6 A30 J6 J4/E15) --------------------------------------------------------------------

RL = X.SQL_RETRY_LOG
LCELL = ["dataset", "n", "seed", "method", "alpha"]


@register("dedup_latest_valid", f"""WITH l AS ({RL}),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, n, seed, method, alpha
                                   ORDER BY (auc IS NOT NULL AND error IS NULL) DESC, attempt DESC) AS rn FROM l)
SELECT dataset, n, seed, method, alpha, attempt, round(auc, 6) AS auc, error FROM k WHERE rn = 1""")
def q_dedup(spark, sf_dir):
    d = AU.dedup_latest_valid(X.retry_log(spark, sf_dir), LCELL)
    return d.select(*LCELL, "attempt", r6("auc").alias("auc"), "error")


@register("run_audit", f"""WITH l AS ({RL}),
c AS (SELECT dataset, method, n, seed, alpha, count(*) AS rows_, count(*) FILTER (WHERE auc IS NULL) AS nulls,
             count(*) FILTER (WHERE error IS NOT NULL) AS errs FROM l GROUP BY ALL)
SELECT dataset, method, CAST(sum(rows_) AS BIGINT) AS n_rows, CAST(sum(nulls) AS BIGINT) AS n_null_metric,
       CAST(count(*) FILTER (WHERE rows_ > 1) AS BIGINT) AS n_duplicate_cells, CAST(sum(errs) AS BIGINT) AS n_error_rows
FROM c GROUP BY dataset, method""")
def q_audit(spark, sf_dir):
    return AU.run_audit(X.retry_log(spark, sf_dir), ["dataset", "method"], LCELL)


@register("resume_pending", f"""WITH l AS ({RL}),
plan AS (SELECT DISTINCT dataset, n, seed, method, alpha FROM ({R})),
ok AS (SELECT * FROM l WHERE auc IS NOT NULL AND error IS NULL)
SELECT p.* FROM plan p WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.dataset = p.dataset AND o.n = p.n AND o.seed = p.seed
       AND o.method = p.method AND o.alpha IS NOT DISTINCT FROM p.alpha)""")
def q_resume(spark, sf_dir):
    plan = X.results_long(spark, sf_dir).select(*LCELL).distinct()
    log = X.retry_log(spark, sf_dir)
    return AU.resume_pending(plan, log, LCELL)


@register("run_drift", f"""WITH a AS ({R}),
b AS (SELECT dataset, n, seed, method, alpha, CASE WHEN dataset = 'R' AND method = 'baseline' THEN auc + 0.01::DOUBLE ELSE auc END AS auc FROM a)
SELECT a.dataset, a.method, CAST(count(*) AS BIGINT) AS n_matched, round(max(abs(a.auc - b.auc)), 6) AS max_abs_diff,
       round(max(abs(a.auc - b.auc)), 6) = 0 AS agree
FROM a JOIN b ON a.dataset = b.dataset AND a.n = b.n AND a.seed = b.seed AND a.method = b.method
     AND a.alpha IS NOT DISTINCT FROM b.alpha GROUP BY a.dataset, a.method""")
def q_drift(spark, sf_dir):
    a = X.results_long(spark, sf_dir)
    b = a.withColumn("auc", F.when((F.col("dataset") == "R") & (F.col("method") == "baseline"), F.col("auc") + 0.01)
                     .otherwise(F.col("auc")))
    d = AU.run_drift(a, b, ["dataset", "n", "seed", "method", "alpha"], ["dataset", "method"])
    return d.select("dataset", "method", "n_matched", r6("max_abs_diff").alias("max_abs_diff"),
                    (r6("max_abs_diff") == 0).alias("agree"))


# ---- decisions (E10 E12 E13 S13) --------------------------------------------------------------------------

@register("decision_rule", f"""WITH {TT}, {SQL_PAIRS}, {SQL_BH}
SELECT dataset, n, alpha, round(dm, 6) AS delta_mean,
       CASE WHEN p_raw IS NOT NULL AND adj <= {FDR_Q}::DOUBLE AND dm > 0 THEN 'significant gain'
            WHEN p_raw IS NOT NULL AND adj <= {FDR_Q}::DOUBLE AND dm < 0 THEN 'significant loss'
            ELSE 'no FDR-significant difference' END AS decision FROM bh1 JOIN h USING (dataset, n, alpha)""")
def q_decision(spark, sf_dir):
    t = ST.bh_fdr(_paired(spark, sf_dir), "p_paired", FDR_Q)
    return t.select("dataset", "n", "alpha", r6("delta_mean").alias("delta_mean"),
                    RP.decision_text(F.coalesce(F.col("fdr_reject"), F.lit(False)), F.col("delta_mean")).alias("decision"))


def _sql_recommend(col: str) -> tuple[str, str]:
    adv, rng = [], []
    last_a = last_r = None
    for upper, text, r in RP.RECOMMEND_BANDS:
        rv = "NULL" if r is None else f"'{r}'"
        if upper is None:
            last_a, last_r = f"'{text}'", rv
        else:
            adv.append(f"WHEN {col} < {upper}::DOUBLE THEN '{text}'")
            rng.append(f"WHEN {col} < {upper}::DOUBLE THEN {rv}")
    return (f"CASE {' '.join(adv)} ELSE {last_a} END", f"CASE {' '.join(rng)} ELSE {last_r} END")


_ADV, _RNG = _sql_recommend("pos_rate")


@register("recommend", f"""WITH p AS (SELECT event_type AS profile, avg(CAST(value > 150.0::DOUBLE AS DOUBLE)) AS pos_rate,
                                 CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type)
SELECT profile, round(pos_rate, 6) AS pos_rate, n, {_ADV} AS advice, {_RNG} AS alpha_range,
       CASE WHEN pos_rate < 0.01 THEN 'extreme' WHEN pos_rate < 0.10 THEN 'moderate' ELSE 'mild' END AS regime,
       pos_rate < 0.01 AS unstable FROM p""")
def q_recommend(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    p = ev.groupBy(F.col("event_type").alias("profile")).agg(
        F.avg((F.col("value") > 150.0).cast("double")).alias("pos_rate"), F.count(F.lit(1)).cast("long").alias("n"))
    adv, rng = RP.recommend(F.col("pos_rate"))
    from synthlab.operators.prep import imbalance_regime, interpolation_unstable
    return p.select("profile", r6("pos_rate").alias("pos_rate"), "n", adv.alias("advice"), rng.alias("alpha_range"),
                    imbalance_regime(F.col("pos_rate")).alias("regime"), interpolation_unstable(F.col("pos_rate")).alias("unstable"))


# profiles: part type x goal; the groups of a profile are its quantities, the target is a price limit that differs by goal
SQL_PROFILES = """
WITH p AS (SELECT p_type, l_quantity, l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT p_type, goal, l_quantity, count(*) AS n, count(*) FILTER (WHERE l_extendedprice > lim) AS pos
      FROM p CROSS JOIN (VALUES ('share', 40000), ('uplift', 30000), ('predict', 60000), ('predict low', 90000)) g(goal, lim) GROUP BY ALL),
s AS (SELECT p_type, goal, sum(n) AS n, min(n) AS n_min_group, sum(pos) / sum(n)::DOUBLE AS pos_rate FROM c GROUP BY ALL)
SELECT p_type, goal, CAST(n AS BIGINT) AS n, CAST(n_min_group AS BIGINT) AS n_min_group, round(pos_rate, 6) AS pos_rate,
       CASE WHEN goal = 'share' THEN 'share_copies_and_test_privacy' WHEN pos_rate < 0.1::DOUBLE THEN 'oversample_minority'
            WHEN n_min_group < 200 THEN CASE WHEN p_type LIKE 'S%' THEN 'language_model_small_alpha' ELSE 'fit_statistical_generator' END
            WHEN n_min_group < 5000 THEN 'fit_generator_and_grow_2x_to_5x' WHEN goal = 'uplift' THEN 'known_process_only'
            WHEN n > 50000 AND pos_rate >= 0.4::DOUBLE AND pos_rate <= 0.6::DOUBLE THEN 'real_rows_suffice'
            ELSE 'sweep_alpha_0.1_to_0.5' END AS advice FROM s"""


@register("recommend_profile", SQL_PROFILES)
def q_recommend_profile(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    limits = {"share": 40000, "uplift": 30000, "predict": 60000, "predict low": 90000}
    counts = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "l_quantity").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("l_extendedprice") > v).alias(g) for g, v in limits.items()])
    per_type = counts.groupBy("p_type").agg(F.sum("n").alias("n"), F.min("n").alias("n_min_group"), *[F.sum(F.col(f"`{g}`")).alias(g) for g in limits])
    long = per_type.select("p_type", "n", "n_min_group", F.explode(F.create_map(
        *[x for g in limits for x in (F.lit(g), F.col(f"`{g}`"))])).alias("goal", "pos")).withColumn("pos_rate", F.col("pos") / F.col("n"))
    return long.select("p_type", "goal", "n", "n_min_group", r6("pos_rate").alias("pos_rate"),
                       RP.recommend_profile(F.col("goal"), F.col("pos_rate"), F.col("n"), F.col("n_min_group"),
                                            F.col("p_type").startswith("S")).alias("advice"))


@register("gain_to_cost", f"""WITH {SQL_AM}, {SQL_BM}, {SQL_BEST}
SELECT dataset, n, round((best_mean - baseline_mean) * 100, 6) AS gain_pts,
       coalesce(best_mean - baseline_mean >= {RP.MIN_AUC_GAIN}::DOUBLE, false) AS deploy FROM ba JOIN bm USING (dataset, n)""")
def q_gain_cost(spark, sf_dir):
    g = RP.best_gain(X.results_long(spark, sf_dir), CELL)
    return g.select(*CELL, r6(F.col("best_gain") * 100).alias("gain_pts"),
                    RP.gain_to_cost(F.col("best_gain"), F.lit(None).cast("double")).alias("deploy"))


@register("report_rows", f"""WITH {TT}, {SQL_PAIRS}
SELECT dataset, n, alpha, printf('%.3f ± %.3f', mm, tc * sm / sqrt(k)) AS auc_text,
       printf('%+.2f', dm * 100) AS gain_text, CAST(wins AS VARCHAR) || '/' || CAST(k AS VARCHAR) AS wins_text
FROM h""")
def q_report_rows(spark, sf_dir):
    ps = _paired(spark, sf_dir)
    return ps.select("dataset", "n", "alpha", RP.pm_text(F.col("method_mean"), F.col("method_ci95_indep")).alias("auc_text"),
                     RP.signed_pts(F.col("delta_mean")).alias("gain_text"),
                     RP.wins_text(F.col("wins"), F.col("n_seeds")).alias("wins_text"))
