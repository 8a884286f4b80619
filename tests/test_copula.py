"""Mixed columns, NULLs, quotas and the text form of rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthlab.operators import copula as C
from synthlab.operators import generate as G

NORMAL = __import__("statistics").NormalDist()


def test_normal_functions():
    u = np.array([1e-9, 1e-4, 0.02, 0.024, 0.3, 0.5, 0.77, 0.976, 0.999, 1 - 1e-9])
    want = np.array([NORMAL.inv_cdf(x) for x in u])
    assert np.allclose(C.normal_quantile(u), want, rtol=2e-9, atol=1e-9)
    assert np.allclose(C.normal_cdf(want), u, atol=1e-7)


def test_nearest_correlation():
    a = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    x = C.nearest_correlation(a)
    assert np.linalg.eigvalsh(x)[0] > 0 and np.allclose(np.diag(x), 1) and np.allclose(x, x.T)
    # by symmetry the nearest matrix shrinks all three to the same size, one half in the limit
    assert np.allclose(np.abs(x[np.triu_indices(3, 1)]), 0.5, atol=1e-3)
    good = np.array([[1, 0.3], [0.3, 1.0]])
    assert np.array_equal(C.nearest_correlation(good), good)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        x = rng.gauss(0, 1)
        rows.append((i, None if rng.random() < 0.2 else "low" if x < 0 else "mid, or so" if x < 1 else "top", int(10 + 3 * x), i % 3 == 0,
                     None, x if rng.random() < 0.5 else None, "n" if i % 40 == 39 else "y" if x > 1 else "x"))
    return spark.createDataFrame(rows, "k long, s string, w int, f boolean, z double, x double, target string")


@pytest.mark.parametrize("make", [G.gaussian_copula, G.class_targeted])
@pytest.mark.parametrize("n", [0, 1, 100, 1001])
def test_rows_of_mixed_tables(mixed, make, n):
    out = make(mixed, "k", ["s", "w", "f", "z", "x"], "target", n, 5)
    assert [t for _, t in out.dtypes] == ["bigint", "string", "double", "boolean", "double", "double", "string"]
    rows = out.collect()
    assert sorted(r["syn_rank"] for r in rows) == list(range(1, n + 1))
    assert all(r["z"] is None and r["w"] == int(r["w"]) and r["target"] in "nxy" for r in rows)


def test_shares_nulls_and_dependence(mixed):
    out = G.gaussian_copula(mixed, "k", ["s", "w", "f", "z", "x"], "target", 8000, 5).cache()

    def share(df, condition):
        return df.where(condition).count() / df.count()
    for condition in ("s is null", "s = 'mid, or so'", "s = 'top'", "f", "x is null", "w = 10"):
        assert share(out, condition) == pytest.approx(share(mixed, condition), abs=0.025)
    assert out.corr("w", "x") is not None
    both = out.where("x is not null")
    assert both.corr("w", "x") > 0.9
    counts = {r[0]: r[1] for r in out.groupBy("target").count().collect()}
    real = {r[0]: r[1] for r in mixed.groupBy("target").count().collect()}
    assert all(abs(counts[c] - 2 * real[c]) <= 1 for c in real)


def test_prefixes_hold_all_classes(mixed):
    out = G.class_targeted(mixed, "k", ["w"], "target", 900, 5)
    whole = {r[0]: r[1] for r in out.groupBy("target").count().collect()}
    part = {r[0]: r[1] for r in out.where("syn_rank <= 90").groupBy("target").count().collect()}
    assert all(abs(part[c] - whole[c] / 10) <= 3 for c in whole)


@pytest.mark.parametrize("generator", ["copula", "bootstrap"])
def test_quotas_add_up_and_null_class(spark, generator):
    df = spark.createDataFrame([(i, float(i), None if i % 10 == 0 else i % 3) for i in range(300)], "k long, x double, target int")
    for n in (100, 1000, 1001):
        assert G.class_targeted(df, "k", ["x"], "target", n, 1, generator=generator).where("target is not null").count() == n
    assert G.class_targeted(df, "k", ["x"], "target", 200, 1, pos_share=0.3, generator=generator).where("target = 1").count() == 60


@pytest.mark.parametrize("values", [60, 65, 80, 1500])
def test_whole_numbers_stay_whole(spark, values):
    """One rule for columns of few and of many values."""
    df = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") % values).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("target"))
    out = G.gaussian_copula(df, "k", ["x"], "target", 2000, 7)
    assert out.where("x <> floor(x) or x < 0").count() == 0


def test_jobs_do_not_grow_with_classes(spark):
    def jobs(classes):
        df = spark.range(2000).select(F.col("id").alias("k"), F.rand(1).alias("x"), (F.col("id") % classes).cast("int").alias("target"))
        group = f"fit-{classes}"
        spark.sparkContext.setJobGroup(group, "")
        C.fit_copula(df, ["x"], "target", by_class=True)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n
    assert jobs(2) == jobs(50)


HARD = ["x, y", 'say "a"', "back\\slash", "", " lead", "trail ", "None", "a is b", "b is 2, c is 3", "\n", "ü", "\\", '"', 'x", y is "z']


def test_row_text_round_trip(spark):
    rows = [(i, v, i * 1.5 if i % 2 else None, HARD[-1 - i]) for i, v in enumerate(HARD)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "k int, a string, b double, c string")
    kinds = {"a": "string", "b": "double", "c": "string"}
    for seed in (None, 4):
        back = G.row_parse(G.row_text(df, "k", ["a", "b", "c"], seed), "k", kinds).collect()
        assert sorted((r["k"], r["a"], r["b"], r["c"]) for r in back) == sorted(rows, key=lambda r: r[0])
        assert all(r["error"] is None for r in back)


def test_bad_rows_are_error_rows(spark):
    texts = [("a is 1, a is 2, b is 3", "repeated field"), ("b is 3", "missing field"), ("a is one, b is x", "value of another type"),
             ("a = 1, b is x", "not a list of fields"), (None, "missing field"), ("", "missing field"), ('a is "1, b is x', "not a list of fields"),
             ("a is , b is x", "missing field"), ("a is 1, b is x, extra is 7", None), ("a is 1, b is x", None), ("a is None, b is x", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "k int, text string")
    got = {r["k"]: r["error"] for r in G.row_parse(df, "k", {"a": "int", "b": "string"}).collect()}
    assert got == {i: e for i, (_, e) in enumerate(texts)}
