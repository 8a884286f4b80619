"""Tie ranks on hot values, blocked Gram matrices, one-pass encoding, crossed variance components."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthlab.operators import fidelity as FD
from synthlab.operators import gram
from synthlab.operators import prep
from synthlab.operators.ordered import tie_ranks


def test_tie_ranks_with_a_hot_value_and_nulls(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(2000) < 0.4, 7.0, rng.integers(0, 30, 2000)).astype(object)
    v[rng.random(2000) < 0.1] = None
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 2000), "v": pd.Series(v, dtype="Float64"), "id": range(2000)})
    df = spark.createDataFrame([(r.g, None if pd.isna(r.v) else float(r.v), int(r.id)) for r in pdf.itertuples()], "g string, v double, id long")
    got = tie_ranks(df, ["g"], "v", buckets=8).toPandas().set_index("id").sort_index()
    key = pdf["v"].astype(float).fillna(-1)             # NULL comes first
    for g in ("a", "b"):
        k = key[pdf["g"] == g]
        r = got[got["g"] == g]
        assert (r["_before"].values == (k.rank(method="min") - 1).values).all()
        assert (r["_dense"].values == (k.rank(method="dense") - 1).values).all()
        assert (r["_equal"].values == k.map(k.value_counts()).values).all()


def test_tie_ranks_of_no_rows(spark):
    assert tie_ranks(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def _frame(spark, x):
    cols = [f"c{i}" for i in range(x.shape[1])]
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols


def test_spearman_matrix_with_ties_missing_values_and_a_constant(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (120, 5)).astype(float)
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 4] = 2.0
    df, cols = _frame(spark, x)
    got = {r["pair"]: r["rho"] for r in FD.spearman_matrix(df, cols).collect()}
    ranks = pd.DataFrame(x, columns=cols).rank()        # of the column's values, then Pearson where both are present
    want = ranks.corr()
    assert len(got) == 10
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if b == "c4":
                assert got[f"{a}|{b}"] is None
            else:
                assert got[f"{a}|{b}"] == pytest.approx(want.loc[a, b], abs=1e-9)


@pytest.mark.parametrize("strip", [160, 3])
def test_pair_sums_of_many_columns_in_one_strip_or_several(spark, monkeypatch, strip):
    monkeypatch.setattr(gram, "STRIP", strip)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 300))
    x[:, 1] = np.nan                                    # a column without values
    rows = [([int(j) for j in np.flatnonzero(~np.isnan(r))], [float(v) for v in r[~np.isnan(r)]]) for r in x]
    df = spark.createDataFrame(rows, "at array<int>, v array<double>").repartition(5)
    out = gram.pair_sums(df, 300).select("i", "j", "n", gram.pearson().alias("rho")).toPandas().set_index(["i", "j"])
    want = np.corrcoef(np.delete(x, 1, axis=1), rowvar=False)
    assert len(out) == 300 * 299 // 2
    for i, j in ((0, 2), (2, 299), (63, 64), (128, 200), (298, 299)):
        a, b = (k - (k > 1) for k in (i, j))
        assert out.loc[(i, j), "rho"] == pytest.approx(want[a, b], abs=1e-9) and out.loc[(i, j), "n"] == 90
    assert out.loc[(0, 1), "n"] == 0 and np.isnan(out.loc[(0, 1), "rho"])


def _texts(spark, n=400):
    cols = [f"t{i}" for i in range(6)]
    df = spark.range(n).select("id", *[F.when(F.col("id") % 7 == i, F.lit(None)).otherwise(
        F.concat(F.lit("v"), (F.col("id") * (i + 3) % (5 + 40 * (i == 2))).cast("string"))).alias(c) for i, c in enumerate(cols)])
    return df, cols


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_label_encode_broadcast_and_by_rows_agree_with_pandas(spark, monkeypatch, limit):
    monkeypatch.setattr(prep, "DICT_ROWS", limit)
    df, cols = _texts(spark)
    got = prep.label_encode(df, cols, "_code").toPandas().set_index("id").sort_index()
    for c in cols:
        v = got[c].fillna("nan")
        codes = {x: k for k, x in enumerate(sorted(set(v)))}
        assert got[c + "_code"].tolist() == [codes[x] for x in v]


def _jobs(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_label_encode_jobs_do_not_grow_with_the_columns(spark):
    df, cols = _texts(spark)
    one, six = (_jobs(spark, f"enc{k}", lambda k=k: prep.label_encode(df, cols[:k], "_code").collect()) for k in (2, 6))
    assert six == one
    out = prep.label_encode(df, cols, "_code")
    out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 5


def test_label_encode_of_no_rows_and_no_columns(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert prep.label_encode(df, ["a", "b"]).dtypes == [("a", "bigint"), ("b", "bigint")]
    assert prep.label_encode(df, []).columns == ["a", "b"]


def _components(rows):
    """Expected sums of squares by brute force: traces of projections over the design."""
    d = pd.DataFrame(rows, columns=["a", "b", "y"])
    za, zb, zc = (pd.get_dummies(k).to_numpy(float) for k in (d["a"], d["b"], d["a"] + "/" + d["b"]))
    n = len(d)
    one = np.ones((n, 1))
    proj = [z @ np.linalg.inv(z.T @ z) @ z.T for z in (one, za, zb, zc)] + [np.eye(n)]
    v = [za @ za.T, zb @ zb.T, zc @ zc.T, np.eye(n)]
    y = d["y"].to_numpy(float) - d["y"].mean()
    t = [y @ p @ y for p in proj]
    q = [[np.trace(p @ k) for k in v] for p in proj]
    diff = [lambda s: s[1] - s[0], lambda s: s[2] - s[0], lambda s: s[3] - s[1] - s[2] + s[0], lambda s: s[4] - s[3]]
    lhs = np.array([[f([r[k] for r in q]) for k in range(4)] for f in diff])
    return np.linalg.solve(lhs, np.array([f(t) for f in diff]))


def test_variance_components_of_unbalanced_cells(spark):
    rng = np.random.default_rng(11)
    ea, eb = rng.normal(0, 2, 6), rng.normal(0, 1, 4)
    rows = [(f"s{i}", f"f{j}", float(10 + ea[i] + eb[j] + rng.normal(0, 0.5)))
            for i in range(6) for j in range(4) for _ in range(int(rng.integers(1, 4))) if (i, j) != (2, 3)]
    df = spark.createDataFrame(rows, "split string, fit string, y double")
    extra = spark.createDataFrame([(None, "f1", 1.0), ("s1", "f1", None)], "split string, fit string, y double")
    r = FD.variance_decomposition(df.unionByName(extra), "y", "split", "fit").first()
    want = _components(rows)
    got = [r["comp_split"], r["comp_fit"], r["comp_interaction"], r["comp_residual"]]
    assert got == pytest.approx(list(want), abs=1e-9)
    assert r["n"] == len(rows) and r["n_cells"] == 23
    assert sum(r[f"share_{p}"] for p in ("split", "fit", "interaction", "residual")) == pytest.approx(1)


def test_variance_components_hand_made_and_degenerate(spark):
    # one value a cell, y = a + b with a in {0, 2}, b in {0, 4}: var(a) = 2, var(b) = 8, nothing left over
    rows = [("g", a, b, float(2 * a + 4 * b)) for a in (0, 1) for b in (0, 1)] + [("one", 0, b, float(b)) for b in (0, 1, 2)]
    df = spark.createDataFrame(rows, "g string, a int, b int, y double")
    out = {r["g"]: r for r in FD.variance_decomposition(df, "y", "a", "b", ["g"]).collect()}
    g = out["g"]
    assert (g["comp_a"], g["comp_b"], g["comp_residual"]) == (pytest.approx(2), pytest.approx(8), pytest.approx(0))
    assert g["comp_interaction"] is None and g["share_b"] == pytest.approx(0.8)
    assert out["one"]["comp_a"] is None and out["one"]["share_a"] is None and out["one"]["n"] == 3
