"""Experiment runner end to end on a tiny stand-in (fast classifier), failure rows, resume."""
from pyspark.sql import functions as F

from synthlab.plans.experiment import Dataset, results_frame, run_experiment, run_multi_classifier

from conftest import SF_MID


def _ds(spark):
    from synthlab.plans.q_prep import q_telco
    df = q_telco(spark, SF_MID)
    feats = ["contract", "region_code", "tenure", "monthly_charges", "total_charges"]
    df = df.select("customer_id", *[F.col(c).cast("double").alias(c) for c in feats], "target")
    return Dataset(df, "customer_id", "target", "classification", "tiny", feats)


def test_run_experiment_rows_and_failure_rows(spark):
    ds = _ds(spark)
    rows = run_experiment(ds, generators=("bootstrap", "no_such_generator"), alphas=(0.5,), seed=1, classifiers=("lr",))
    df = results_frame(spark, rows)
    got = {(r["method"], r["condition"]): r for r in df.collect()}
    assert got[("baseline", "real_only")]["error"] is None
    assert got[("bootstrap", "augmented")]["auc_roc"] is not None
    assert got[("no_such_generator", "augmented")]["error"] is not None   # E14: failure is a row


def test_multi_classifier_resume_skips_finished(spark):
    ds = _ds(spark)
    done = results_frame(spark, [("tiny", 100, 1, "bootstrap", "augmented", 1.0, "lr", 0.7, 0.1, 0.2, None, None, None)])
    out = run_multi_classifier(spark, ds, [1], ["lr"], done=done, generators=("bootstrap",), alphas=(1.0,), tstr=False)
    assert out.count() == 0


def _planted(spark):
    """Telco rows of sf0.01 whose target follows one feature: a flipped label gets an AUC near 0, a constant score 0.5."""
    ds = _ds(spark)
    mid = ds.df.approxQuantile("tenure", [0.6], 0.0)[0]
    return Dataset(ds.df.withColumn("target", (F.col("tenure") > mid).cast("int")), ds.key, "target", ds.task, "planted", ds.features)


def test_runs_find_a_planted_target(spark):
    from synthlab.plans.experiment import run_balanced, run_low_data, run_small_n
    ds = _planted(spark)
    rows = run_small_n(ds, [100], [42], 300, alpha=[0.5], classifier="lr") + run_low_data(ds, [250], generators=("bootstrap",),
                                                                                     classifier="lr") + run_balanced(ds, classifier="lr")
    got = results_frame(spark, rows).collect()
    assert len(got) == 6
    for r in got:
        assert r["error"] is None and r["auc_roc"] > 0.9 and r["f1_minority"] > 0.7 and r["avg_precision"] > 0.85


def test_model_queries_return_their_metrics(spark):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    names = ("detection_auc", "augment_sweep", "multi_classifier", "ci_seeds", "low_data", "small_n_alpha_sweep", "balanced_vs_plain",
             "sparse_stress", "clv_regression")
    assert all(f"{n}_metrics" in qs and f"{n}_metrics" not in sql and n in sql for n in names)
    assert all(r["r2"] > 0.7 and r["mape"] < 0.05 for r in qs["clv_regression_metrics"](spark, SF_MID).collect())
