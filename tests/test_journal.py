"""Runs that stop and go on, cells side by side, recovery table, result files with line breaks."""
import threading
import time

import pytest
from pyspark.sql import functions as F

from synthlab.plans import experiment as E
from synthlab.plans.experiment import Dataset, results_frame, run_ci, run_multi_classifier, run_small_n, sparse_recovery
from synthlab.plans.journal import KEY, Journal, side_by_side
from synthlab.session import scratch_path
from synthlab.sources.files import read_result_files


def _ds(spark):
    df = spark.range(120).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("target"))
    return Dataset(df, "id", "target", "classification", "tiny", ["x"])


class Counted:
    """Stands in for a model fit: counts the cells, is interrupted after ``stop`` of them."""

    def __init__(self, stop=None, fail=None):
        self.calls, self.stop, self.fail, self.lock = 0, stop, fail, threading.Lock()

    def __call__(self, train, test, ds, classifier, seed, weight_col=None):
        with self.lock:
            self.calls += 1
            if self.stop is not None and self.calls > self.stop:
                raise KeyboardInterrupt
        if classifier == self.fail:
            raise ValueError("no fit")
        return {"auc_roc": 0.5 + train.count() / 10_000, "f1_minority": 0.1, "avg_precision": 0.2}


KW = {"generators": ("bootstrap",), "alphas": (0.3, 1.0), "tstr": True}


def test_a_run_killed_halfway_repeats_no_cell(spark, monkeypatch):
    ds, path = _ds(spark), scratch_path(spark, "journal")
    whole = Counted()
    monkeypatch.setattr(E, "_evaluate", whole)
    want = run_ci(ds, (1, 2), classifiers=("lr",), **KW)
    monkeypatch.setattr(E, "_evaluate", Counted(stop=5))
    with pytest.raises(KeyboardInterrupt):
        run_ci(ds, (1, 2), classifiers=("lr",), journal=Journal(spark, path), **KW)
    rest = Counted()
    monkeypatch.setattr(E, "_evaluate", rest)
    journal = Journal(spark, path)
    got = run_ci(ds, (1, 2), classifiers=("lr",), journal=journal, parallel=3, **KW)
    assert got == want and len(want) == 8 and rest.calls == 3
    assert sorted(map(str, journal.frame().collect())) == sorted(map(str, results_frame(spark, want).collect()))


def test_failed_cells_are_written_and_tried_again(spark, monkeypatch):
    ds, path = _ds(spark), scratch_path(spark, "journal")
    monkeypatch.setattr(E, "_evaluate", Counted(fail="lr"))
    run_multi_classifier(spark, ds, [1], ["lr", "rf"], journal=Journal(spark, path), **KW).collect()
    assert Journal(spark, path).frame().filter("error is not null").count() == 4
    again = Counted()
    monkeypatch.setattr(E, "_evaluate", again)
    run_multi_classifier(spark, ds, [1], ["lr", "rf"], journal=Journal(spark, path), **KW).collect()
    done = Journal(spark, path).frame()
    assert again.calls == 4 and done.count() == 8 and done.filter("error is not null").count() == 0


def test_small_draws_resume(spark, monkeypatch):
    ds, path = _ds(spark), scratch_path(spark, "journal")
    first, second = Counted(), Counted()
    monkeypatch.setattr(E, "_evaluate", first)
    a = run_small_n(ds, [20], [1], 30, journal=Journal(spark, path))
    monkeypatch.setattr(E, "_evaluate", second)
    b = run_small_n(ds, [20, 30], [1], 30, journal=Journal(spark, path), parallel=2)
    assert first.calls == 2 and second.calls == 2 and b[:2] == a and [r[1] for r in b] == [20, 20, 30, 30]


def test_units_run_side_by_side_and_keep_their_order(spark):
    def unit(k):
        time.sleep(0.5)
        return k, spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    units = [lambda k=k: unit(k) for k in range(8)]
    t0 = time.time()
    got = side_by_side(spark, units, 4)
    assert time.time() - t0 < 2.0 and [k for k, _ in got] == list(range(8)) and {p for _, p in got} == {f"cells-{i}" for i in range(4)}


def test_recovery_table(spark):
    def row(name, method, auc, alpha=None):
        return (name, 10, 1, method, "augmented" if alpha else "real_only", alpha, "lr", auc, None, None, None, None, None)
    rows = [row("d", "baseline", 0.9), row("d_sparse", "baseline", 0.7), row("d_sparse", "g", 0.75, 0.3), row("d_sparse", "g", 0.8, 1.0),
            row("d_sparse", "h", None, 0.3)]
    out = {r["method"]: r for r in sparse_recovery(results_frame(spark, rows)).collect()}
    assert out["g"]["recovery_pct"] == pytest.approx(50) and out["g"]["dense_auc"] == 0.9
    assert out["h"]["best_auc"] is None and out["h"]["recovery_pct"] is None and len(rows[0][:KEY]) == 7


def test_result_files_with_line_breaks_and_headers_of_their_own(spark, tmp_path):
    (tmp_path / "metrics_one set.csv").write_text('seed,n,auc,error\n1,10,0.5,"two\nlines, ""quoted"""\n2,10,0.6,\n')
    (tmp_path / "metrics_b.csv").write_text("n,seed,auc_roc\n5,3,0.7\n")
    (tmp_path / "metrics_c.csv").write_text("n,seed,auc_roc\n")
    (tmp_path / "metrics_d.csv").write_text("")
    out = read_result_files(spark, f"{tmp_path}/metrics_*.csv", r"metrics_([^/]+)\.csv", escape='"').collect()
    got = {(r["dataset"].replace("%20", " "), r["seed"], r["auc_roc"], r["error"]) for r in out}
    assert got == {("one set", 1, 0.5, 'two\nlines, "quoted"'), ("one set", 2, 0.6, None), ("b", 3, 0.7, None)}
