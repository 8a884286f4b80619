"""Registered queries: model metrics (W3 W4 M8 M9 F9 F10) and MLlib-backed runs (M1-M7, E*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from synthlab.functions.exprs import r6
from synthlab.operators import metrics as M
from synthlab.operators import sampling as S
from synthlab.plans.q_prep import SQL_TELCO
from synthlab.plans.registry import register
from synthlab.sources.tables import load

# scored stand-in: cell = line status, score = discount (11 distinct values: heavy ties),
# label = returned (R)
SQL_SCORED = ("SELECT l_linestatus AS cell, l_discount AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y, "
              "l_extendedprice, l_quantity FROM lineitem")


def _scored(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("cell"), F.col("l_discount").alias("score"),
                     (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice", "l_quantity")


# independent oracle: mid-rank Mann-Whitney over raw rows
@register("roc_auc", f"""WITH s AS ({SQL_SCORED}),
r AS (SELECT cell, y, rank() OVER (PARTITION BY cell ORDER BY score)
             + (count(*) OVER (PARTITION BY cell, score) - 1) / 2.0::DOUBLE AS mr FROM s)
SELECT cell, round((sum(CASE WHEN y = 1 THEN mr ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
                   / (sum(y) * (count(*) - sum(y))), 6) AS auc_roc,
       CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg FROM r GROUP BY cell""")
def q_auc(spark, sf_dir):
    res = M.auc_ap(_scored(spark, sf_dir), "score", "y", ["cell"])
    return res.select("cell", r6("auc_roc").alias("auc_roc"), "n_pos", "n_neg")


# oracle: step sum over thresholds in descending order, ties grouped
@register("avg_precision", f"""WITH s AS ({SQL_SCORED}),
g AS (SELECT cell, score, sum(y) AS pos, count(*) AS cnt FROM s GROUP BY cell, score),
c AS (SELECT cell, score, pos, sum(pos) OVER (PARTITION BY cell ORDER BY score DESC) AS tp,
             sum(cnt) OVER (PARTITION BY cell ORDER BY score DESC) AS k,
             sum(pos) OVER (PARTITION BY cell) AS p_all FROM g)
SELECT cell, round(sum(pos / p_all::DOUBLE * (tp / k::DOUBLE)), 6) AS avg_precision FROM c GROUP BY cell""")
def q_ap(spark, sf_dir):
    res = M.auc_ap(_scored(spark, sf_dir), "score", "y", ["cell"])
    return res.select("cell", r6("avg_precision").alias("avg_precision"))


# prediction = score > 0.5 after rescaling discount to [0, 1] (x10)
@register("f1_minority", f"""WITH s AS ({SQL_SCORED}),
p AS (SELECT cell, y, CAST(score * 10 > 0.5::DOUBLE AS INTEGER) AS pred FROM s),
g AS (SELECT cell, sum(pred * y) AS tp, sum(pred * (1 - y)) AS fp, sum((1 - pred) * y) AS fn FROM p GROUP BY cell)
SELECT cell, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1_minority,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM g""")
def q_f1(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("score", F.col("score") * 10)
    return M.f1_minority(s, "score", "y", ["cell"]).select(
        "cell", r6("f1_minority").alias("f1_minority"), "tp", "fp", "fn")


# regression stand-in: predict extended price from quantity * mean unit price of the cell
@register("mape_r2", f"""WITH s AS ({SQL_SCORED}),
u AS (SELECT cell, sum(l_extendedprice) / sum(l_quantity) AS up FROM s GROUP BY cell),
p AS (SELECT s.cell, s.l_extendedprice AS y, s.l_quantity * u.up AS yhat FROM s JOIN u ON s.cell = u.cell)
SELECT cell, round(avg(abs(y - yhat) / greatest(abs(y), {M.EPS!r}::DOUBLE)), 6) AS mape,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY cell""")
def q_mape(spark, sf_dir):
    s = _scored(spark, sf_dir)
    u = s.groupBy("cell").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("up"))
    p = s.join(u, "cell").select("cell", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("up")).alias("yhat"))
    return M.regression_metrics(p, "y", "yhat", ["cell"]).select("cell", r6("mape").alias("mape"), r6("r2").alias("r2"))


# best-F1 threshold over distinct scores (predict score >= t)
@register("best_f1_threshold", f"""WITH s AS ({SQL_SCORED}),
g AS (SELECT cell, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY cell, score),
c AS (SELECT cell, score, sum(pos) OVER (PARTITION BY cell ORDER BY score DESC) AS tp,
             sum(neg) OVER (PARTITION BY cell ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY cell) AS pa FROM g),
f AS (SELECT cell, score, 2.0::DOUBLE * tp / (tp + pa + fp) AS f1 FROM c)
SELECT cell, round(arg_max(score, (f1, score)), 6) AS threshold, round(max(f1), 6) AS best_f1 FROM f GROUP BY cell""")
def q_best_f1(spark, sf_dir):
    res = M.best_f1_threshold(_scored(spark, sf_dir), "score", "y", ["cell"])
    return res.select("cell", r6("threshold").alias("threshold"), r6("best_f1").alias("best_f1"))


# calibration bins of the rescaled score
@register("calibration_bins", f"""WITH s AS ({SQL_SCORED})
SELECT cell, CAST(least(floor(score * 10 * 10), 9) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n,
       round(avg(score * 10), 6) AS mean_score, round(avg(y::DOUBLE), 6) AS rate FROM s GROUP BY ALL""")
def q_calib(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("score", F.col("score") * 10)
    res = M.calibration_bins(s, "score", "y", 10, ["cell"])
    return res.select("cell", "bin", F.col("n").cast("long"), r6("mean_score").alias("mean_score"), r6("rate").alias("rate"))


# ---- MLlib runs ------------------------------------

def _telco_ds(spark, sf_dir):
    from synthlab.plans.experiment import Dataset
    from synthlab.plans.q_prep import q_telco
    df = q_telco(spark, sf_dir).withColumn("monthly_charges", F.col("monthly_charges").cast("double"))
    feats = ["contract", "region_code", "tenure", "monthly_charges", "total_charges"]
    df = df.select("customer_id", *[F.col(c).cast("double").alias(c) for c in feats], "target")
    return Dataset(df, "customer_id", "target", "classification", "telco_like", feats)


def _events_ds(spark, sf_dir):
    from synthlab.plans import fixtures as X
    from synthlab.plans.experiment import Dataset
    t = X.events_target(spark, sf_dir)
    df = t.select("event_id", *[F.col(c).cast("double").alias(c) for c in X.EVENT_FEATURES], "target")
    return Dataset(df, "event_id", "target", "classification", "hillstrom_like", X.EVENT_FEATURES)


# A model's score is not SQL, but the run around it is: which cells there are, on how many training
# rows, and that each has a valid metric and no error.  A query returns these facts, and its twin
# ``..._metrics``, without SQL, the results: every cell with its metrics and its error.

def _cells(frame, *more):
    valid = F.coalesce(F.col("auc_roc").between(0, 1), F.col("mape") >= 0, F.lit(False)) & F.col("error").isNull()
    return frame.select("dataset", F.col("n").cast("bigint").alias("n"), F.col("seed").cast("bigint").alias("seed"), "method",
                        "condition", "alpha", "classifier", valid.alias("ok"), *more)


def register_run(name: str, sql: str):
    def deco(fn):
        register(name, sql)(lambda spark, sf_dir: _cells(fn(spark, sf_dir)))
        return register(f"{name}_metrics")(fn)
    return deco


def _sql_cells(dataset: str, cells: list[tuple], n: str, head: str = "", where: str = "") -> str:
    """Expected cells; ``cells`` are (n or None, seed, method, condition, alpha, classifier), None taking ``n``."""
    rows = ", ".join(f"({'NULL' if k is None else k}, {s}, '{m}', '{c}', {'NULL' if a is None else a}, '{clf}')"
                     for k, s, m, c, a, clf in cells)
    return (f"{head} SELECT '{dataset}' AS dataset, CAST(coalesce(v.n, {n}) AS BIGINT) AS n, CAST(seed AS BIGINT) AS seed, "
            f"method, condition, CAST(alpha AS DOUBLE) AS alpha, classifier, true AS ok "
            f"FROM (VALUES {rows}) v(n, seed, method, condition, alpha, classifier) {where}")


def _with(name: str, sql: str) -> str:
    return f"WITH {name} AS ({sql}), k AS (SELECT count(*) AS total, count(*) - CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS train FROM {name})"


TELCO = _with("t", SQL_TELCO)
TRAIN, TOTAL = "(SELECT train FROM k)", "(SELECT total FROM k)"


def _arms(n, seed, generators, alphas, clf, tstr=False):
    out = [(n, seed, "baseline", "real_only", None, clf)]
    for g in generators:
        out += [(n, seed, g, "synthetic_only", None, clf)] if tstr and g != "smote" else []
        out += [(n, seed, g, "augmented", a, clf) for a in alphas]
    return out


SWEEP_GENERATORS = ("smote", "bootstrap", "copula")


@register_run("augment_sweep", _sql_cells("telco_like", _arms(None, 42, SWEEP_GENERATORS, S.ALPHAS, "lr", True), TRAIN, TELCO))
def q_augment_sweep(spark, sf_dir):
    """Baseline, TSTR and the whole alpha sweep with three generators (logistic regression)."""
    from synthlab.plans.experiment import results_frame, run_experiment
    ds = _telco_ds(spark, sf_dir)
    return results_frame(spark, run_experiment(ds, generators=SWEEP_GENERATORS, seed=42, classifiers=("lr",), parallel=4))


MULTI = ("gbc", "lr", "rf", "mlp")


@register_run("multi_classifier", _sql_cells("telco_like", [c for clf in MULTI for c in _arms(None, 42, ("bootstrap",), (1.0,), clf)],
                                         TRAIN, TELCO))
def q_multi_classifier(spark, sf_dir):
    """E4 with M1 M3 M4 M5 (M6 registry): four classifiers, one generator at alpha = 1, one seed."""
    from synthlab.plans.experiment import run_multi_classifier
    ds = _telco_ds(spark, sf_dir)
    return run_multi_classifier(spark, ds, seeds=[42], classifiers=list(MULTI), generators=("bootstrap",), alphas=(1.0,),
                                tstr=False, parallel=4)


@register_run("ci_seeds", _sql_cells("telco_like", [c for s in (42, 123, 7) for c in _arms(None, s, ("bootstrap",), (0.3,), "lr")],
                                 TRAIN, TELCO))
def q_ci_seeds(spark, sf_dir):
    """The experiment for several seeds."""
    from synthlab.plans.experiment import results_frame, run_ci
    rows = run_ci(_telco_ds(spark, sf_dir), (42, 123, 7), generators=("bootstrap",), alphas=(0.3,), classifiers=("lr",), tstr=False,
                  parallel=4)
    return results_frame(spark, rows)


# ---- journal_resume (S10 in E3): which run finished each cell -------------------------------------------------------

def _sql_journal() -> str:
    parts = []
    for run, cells in ((1, [(None, 42, "baseline", "real_only", None, "lr"), (None, 42, "bootstrap", "augmented", 0.3, "lr")]),
                       (2, [(None, 42, "bootstrap", "augmented", 1.0, "lr"), *_arms(None, 123, ("bootstrap",), (0.3, 1.0), "lr")])):
        parts.append(f"SELECT *, CAST({run} AS BIGINT) AS run FROM ({_sql_cells('telco_like', cells, TRAIN, TELCO)})")
    return " UNION ALL ".join(parts)


@register("journal_resume", _sql_journal())
def q_journal_resume(spark, sf_dir):
    """E3 stopped after its first cells and started again on a larger grid: no cell is run twice."""
    from synthlab.plans.experiment import results_frame, run_ci
    from synthlab.plans.journal import KEY, Journal
    from synthlab.sources.files import scratch_path
    ds, path = _telco_ds(spark, sf_dir), scratch_path(spark, "journal")
    kw = {"generators": ("bootstrap",), "classifiers": ("lr",), "tstr": False, "parallel": 4}
    first = Journal(spark, path)
    run_ci(ds, (42,), alphas=(0.3,), journal=first, **kw)
    second = Journal(spark, path)
    rows = run_ci(ds, (42, 123), alphas=(0.3, 1.0), journal=second, **kw)
    times = {r[:KEY]: [k + 1 for k, j in enumerate((first, second)) for key in j.ran if key == r[:KEY]] for r in rows}
    runs = [results_frame(spark, [r]).withColumn("run", F.lit(int("".join(map(str, times[r[:KEY]])) or 0)).cast("bigint")) for r in rows]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return _cells(out, "run")


@register("sparse_recovery")
def q_sparse_recovery(spark, sf_dir):
    """Share of the AUC lost to sparse cells that augmentation recovers, per generator (logistic regression)."""
    from synthlab.plans import fixtures as X
    from synthlab.plans.experiment import Dataset, results_frame, run_sparse, sparse_recovery
    ds = Dataset(X.embeddings_wide(spark, sf_dir), "vec_id", "target", "classification", "nomao_like", [f"f{i}" for i in range(64)])
    rows = run_sparse(ds, 0.7, seed=42, generators=("bootstrap",), alphas=(0.3, 1.0), classifiers=("lr",), parallel=4)
    return sparse_recovery(results_frame(spark, rows))


@register("failed_cells", _sql_cells("telco_like", _arms(None, 42, ("no_such_generator",), (0.3,), "lr", True), TRAIN, TELCO)
          .replace("true AS ok", "method = 'baseline' AS ok"))
def q_failed_cells(spark, sf_dir):
    """A generator that fails leaves a row with the error; the run goes on."""
    from synthlab.plans.experiment import results_frame, run_experiment
    rows = run_experiment(_telco_ds(spark, sf_dir), generators=("no_such_generator",), alphas=(0.3,), seed=42, classifiers=("lr",))
    return _cells(results_frame(spark, rows))


LOW = ("smote", "bootstrap", "class_targeted")


@register_run("low_data", _sql_cells("telco_like", [c for n in S.LOW_DATA_SIZES for c in [
    *_arms(n, 42, LOW[:2], (1.0,), "lr"), (n, 42, "class_targeted", "augmented", 2.0, "lr")]], TRAIN, TELCO,
                                 f"WHERE v.n < 0.7 * {TOTAL}"))
def q_low_data_run(spark, sf_dir):
    """N grid below 0.7 * rows, real-only vs n more rows by SMOTE or bootstrap and 2n by the class-targeted generator."""
    from synthlab.plans.experiment import results_frame, run_low_data
    ds = _telco_ds(spark, sf_dir)
    return results_frame(spark, run_low_data(ds, S.LOW_DATA_SIZES, seed=42, generators=LOW, classifier="lr"))


@register_run("small_n_alpha_sweep", _sql_cells("telco_like", [c for n in (50, 100) for s in (42, 123)
                                                           for c in _arms(n, s, ("bootstrap",), S.ALPHAS, "lr")], TRAIN, TELCO))
def q_small_n_sweep(spark, sf_dir):
    """Matched small-n design, alpha sweep on prefixes of one synthetic table per (n, seed)."""
    from synthlab.plans.experiment import results_frame, run_small_n
    ds = _telco_ds(spark, sf_dir)
    return results_frame(spark, run_small_n(ds, [50, 100], [42, 123], holdout_n=300, generators=("bootstrap",),
                                            alpha=list(S.ALPHAS), classifier="lr", parallel=4))


@register_run("balanced_vs_plain", _sql_cells("hillstrom_like", [(None, s, m, "real_only", None, "lr" if s != 42 else "gbc")
                                                             for s in (42, 123) for m in ("baseline", "class_weighted")],
                                          TRAIN, _with("t", "SELECT event_id FROM events")))
def q_balanced(spark, sf_dir):
    """Class-weighted vs plain fits on the rare-target stand-in, GBT and logistic regression."""
    from synthlab.plans.experiment import results_frame, run_balanced
    from synthlab.plans.journal import side_by_side
    ds = _events_ds(spark, sf_dir)
    runs = side_by_side(spark, [lambda: run_balanced(ds, seed=42, parallel=2),
                                lambda: run_balanced(ds, seed=123, classifier="lr", parallel=2)], 2)
    return results_frame(spark, [row for rows in runs for row in rows])


@register_run("sparse_stress", " UNION ALL ".join([
    "(" + _sql_cells("nomao_like", _arms(None, 42, (), (), "gbc"), TRAIN, _with("t", "SELECT vec_id FROM embeddings")) + ")",
    "(" + _sql_cells("nomao_like_sparse", _arms(None, 42, ("bootstrap",), (0.5,), "gbc"), TRAIN,
                     _with("t", "SELECT vec_id FROM embeddings")) + ")"]))
def q_sparse(spark, sf_dir):
    """Dense vs 70 %-sparse vs sparse + bootstrap augmentation on the 64-feature stand-in."""
    from synthlab.plans import fixtures as X
    from synthlab.plans.experiment import Dataset, results_frame, run_sparse
    df = X.embeddings_wide(spark, sf_dir)
    ds = Dataset(df, "vec_id", "target", "classification", "nomao_like", [f"f{i}" for i in range(64)])
    return results_frame(spark, run_sparse(ds, 0.7, seed=42))


def _clv_ds(spark, sf_dir):
    from synthlab.operators import prep
    from synthlab.plans.experiment import Dataset
    li = load(spark, sf_dir, "lineitem").withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
    clv = prep.clv_rollup(li.withColumnRenamed("l_orderkey", "o_orderkey"), load(spark, sf_dir, "orders"),
                          invoice="o_orderkey", customer="o_custkey", date="o_orderdate", quantity="l_quantity",
                          unit_price="unit_price")
    feats = ["frequency", "recency", "avg_order_value", "num_items"]
    df = clv.select("customer_id", *[F.col(c).cast("double").alias(c) for c in feats], "total_spend")
    return Dataset(df, "customer_id", "total_spend", "regression", "retail_clv", feats)


SQL_CLV_KEYS = ("SELECT o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 0 "
                "GROUP BY o_custkey HAVING sum(l_extendedprice) > 0")


@register_run("clv_regression", _sql_cells("retail_clv", _arms(None, 42, ("bootstrap",), (0.5,), "gbr", True), TRAIN,
                                       _with("t", SQL_CLV_KEYS)))
def q_clv_regression(spark, sf_dir):
    """M2 + M9 through E1 on the customer-value table (regression: MAPE, R^2)."""
    from synthlab.plans.experiment import results_frame, run_experiment
    rows = run_experiment(_clv_ds(spark, sf_dir), generators=("bootstrap",), alphas=(0.5,), seed=42)
    return results_frame(spark, rows)


def _detection(spark, sf_dir):
    """can a classifier tell real rows from synthetic ones?  LR on a hash split, exact AUC."""
    from synthlab.operators import generate as G
    from synthlab.plans.models import fit_score
    ds = _telco_ds(spark, sf_dir)
    n = ds.df.count()
    syn = G.bootstrap_jitter(ds.df, ds.key, ds.features, ds.target, n, 42).select(
        (F.col("syn_rank") + F.lit(10 ** 12)).alias(ds.key), *ds.features)
    both = ds.df.select(ds.key, *ds.features).withColumn("origin", F.lit(0)).unionByName(syn.withColumn("origin", F.lit(1)))
    sp = S.stratified_split(both, [ds.key], "origin", 42)
    scored = fit_score(sp.filter("split = 'train'"), sp.filter("split = 'test'"), ds.features, "origin", "lr", 42)
    res = M.auc_ap(scored, "score", "origin")
    return M.auc_ap(scored, "score", "origin")


@register("detection_auc", f"""{TELCO} SELECT CAST(ceil(0.2::DOUBLE * 2 * total) AS BIGINT) AS n_test, true AS in_range FROM k""")
def q_detection(spark, sf_dir):
    """the checkable facts."""
    res = _detection(spark, sf_dir)
    return res.select((F.col("n_pos") + F.col("n_neg")).alias("n_test"), F.col("auc_roc").between(0, 1).alias("in_range"))


@register("detection_auc_metrics")
def q_detection_metrics(spark, sf_dir):
    """the detection AUC."""
    return _detection(spark, sf_dir).select("auc_roc", "n_pos", "n_neg")
