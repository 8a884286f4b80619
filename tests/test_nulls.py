"""Planted NULL keys, several generators, several runs, empty requests, many buckets."""
import pytest
from pyspark.sql import functions as F

from synthlab.operators import audit as AU
from synthlab.operators import generate as G
from synthlab.operators import metrics as M
from synthlab.operators import ordered as O
from synthlab.operators import prep
from synthlab.operators import report as RP
from synthlab.operators import sampling as S
from synthlab.operators import stats as ST


def test_null_cells_keep_their_metrics(spark):
    df = spark.createDataFrame([(a, s / 10, s % 2) for a in (None, 0.5) for s in range(10)], "alpha double, s double, y int")
    rows = {r["alpha"]: r for r in M.auc_ap(df, "s", "y", ["alpha"]).collect()}
    assert set(rows) == {None, 0.5} and rows[None]["auc_roc"] == rows[0.5]["auc_roc"] == pytest.approx(0.6)
    assert {r["alpha"] for r in M.best_f1_threshold(df, "s", "y", ["alpha"]).collect()} == {None, 0.5}
    ranks = ST.mid_rank(df, "s", ["alpha"]).collect()
    assert len(ranks) == 20 and sorted(r["s_rank"] for r in ranks if r["alpha"] is None) == list(range(1, 11))
    assert M.balanced_weights(df, "alpha").count() == 20


def test_null_groups_are_sampled_like_others(spark):
    df = spark.createDataFrame([(i, None if i < 50 else i % 2) for i in range(250)], "id int, target int")
    split = S.stratified_split(df, ["id"], "target", 1)
    got = {(r["target"], r["split"]): r["count"] for r in split.groupBy("target", "split").count().collect()}
    assert got == {(None, "test"): 10, (None, "train"): 40, (0, "test"): 20, (0, "train"): 80, (1, "test"): 20, (1, "train"): 80}
    quotas = spark.createDataFrame([(0, 3)], "target int, _quota long")
    assert S.select_smallest(df, ["id"], 1, quotas, by=["target"]).groupBy("target").count().collect()[0]["count"] == 3
    assert S.hash_rank(df, ["id"], 1, by=["target"]).count() == 250
    assert S.select_smallest(df.limit(0), ["id"], 1, 5).count() == 0


def test_null_alpha_in_bookkeeping(spark):
    plan = spark.createDataFrame([("d", None), ("d", 0.1)], "dataset string, alpha double")
    done = spark.createDataFrame([("d", None, 0.5, None)], "dataset string, alpha double, auc double, error string")
    assert [r["alpha"] for r in AU.resume_pending(plan, done, ["dataset", "alpha"]).collect()] == [0.1]
    drift = AU.run_drift(done, done, ["dataset", "alpha"], ["dataset"]).first()
    assert drift["n_matched"] == 1 and drift["agree"]


def test_null_cells_do_not_hide_zeros(spark):
    df = spark.createDataFrame([(None, 0, 0), (1, 0, 2)], "a int, b int, c int")
    r = prep.cell_fractions(df, ["a", "b", "c"]).first()
    assert r["zero_frac"] == pytest.approx(0.5) and r["missing_frac"] == pytest.approx(1 / 6)


RESULTS = [("d", None, "baseline", "real_only", 0.50), ("d", 0.1, "A", "augmented", 0.60), ("d", 0.1, "B", "augmented", 0.40),
           ("d", None, "B", "synthetic_only", 0.3)]


def test_generators_are_not_averaged(spark):
    res = spark.createDataFrame(RESULTS, "dataset string, alpha double, method string, condition string, auc double")
    assert RP.best_gain(res, ["dataset"]).first()["best_gain"] == pytest.approx(0.1)
    by = {r["method"]: r for r in RP.best_gain(res, ["dataset", "method"]).collect()}
    assert by["A"]["best_gain"] == pytest.approx(0.1) and by["B"]["best_gain"] == pytest.approx(-0.1)
    best = RP.max_gain(RP.best_gain(res, ["dataset", "method"]), ["dataset"]).first()
    assert best["method"] == "A" and best["max_gain"] == pytest.approx(0.1)
    table = {r["method"]: r for r in RP.summary_table(res, ["dataset", "method"]).collect()}
    assert set(table) == {"A", "B"} and table["B"]["tstr"] == pytest.approx(0.3)
    assert table["A"]["delta"] == pytest.approx(0.1) and table["B"]["baseline"] == pytest.approx(0.5)


def test_arms_of_different_runs_never_pair(spark):
    a = spark.createDataFrame([("d", 1, "r1", 0.5), ("d", 1, "r2", 0.7)], "dataset string, seed int, run_id string, auc double")
    b = spark.createDataFrame([("d", 1, "r1", 0.6)], "dataset string, seed int, run_id string, auc double")
    rows = ST.pair(a, b, ["dataset", "seed"]).collect()
    assert [(r["base"], r["meth"]) for r in rows] == [(0.5, 0.6)]


def test_smote_of_no_rows_and_skip_reason(spark):
    df = spark.createDataFrame([(i, float(i), 1) for i in range(8)], "id int, x double, target int")
    none = spark.createDataFrame([(0,)], "n_syn long")
    assert G.smote(df, "id", ["x"], "target", none, 1).count() == 0 and G.smote(df, "id", ["x"], "target", 3, 1).count() == 3
    assert G.smote_skip(5) and G.smote_skip(6) is None


@pytest.mark.parametrize("every", [500, 5000])
def test_copula_keeps_rare_classes_and_values(spark, every):
    df = spark.range(10_000).select(F.col("id").alias("k"), (F.rand(3) * 10).alias("x"), (F.col("id") % 3).cast("double").alias("c"),
                                    (F.col("id") % every == 0).cast("int").alias("target"))
    out = G.gaussian_copula(df, "k", ["x", "c"], "target", 10_000, 7)
    assert out.where("target = 1").count() == 10_000 // every
    assert {r["c"] for r in out.select("c").distinct().collect()} == {0.0, 1.0, 2.0}
    assert out.columns == ["syn_rank", "x", "c", "target"]


@pytest.mark.parametrize("buckets", [2_000, 10_000])
def test_many_buckets_and_one_frequent_value(spark, buckets):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id")).alias("v"))
    got = O.global_rank(df.withColumn("o", F.struct("v", "id")), "o", name="r", buckets=buckets)
    want = sorted((0 if i % 10 < 7 else i, i) for i in range(20_000))
    assert [(r["v"], r["id"]) for r in got.orderBy("r").select("v", "id").collect()] == want


def test_frequent_value_spreads_over_buckets(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id")).alias("v"))
    b = O.bucketed(df.withColumn("o", F.struct("v", "id")), "o", buckets=50)
    assert b.where("v = 0").select("_bk").distinct().count() > 20
    r = O.running_before(df.groupBy("v").count(), [], "v", ["count"], buckets=50)
    assert r.agg(F.max(F.col("count_before") + F.col("count"))).first()[0] == 20_000
