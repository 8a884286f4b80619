"""Statistics layer: closed-form t, golden per-cell row, BH, jackknife, planted failures."""
import math

import pytest
from pyspark.sql import functions as F

from synthlab.functions.tdist import _abs_prob_py, t_quantile_py
from synthlab.operators import stats as ST

# fixed values: five paired seeds (baseline, method AUC) of one published cell and its published
# per-cell statistics (rounded to 4 places in the publication)
GOLDEN_PAIRS = [
    (42, 0.46651866801210895, 0.41832268191501293),
    (123, 0.5047690324027357, 0.43848637739656915),
    (7, 0.5616829240946294, 0.47228108532346674),
    (2024, 0.5852539522367979, 0.507943715663191),
    (999, 0.554143401726651, 0.49207814777441417),
]
GOLDEN = dict(baseline_mean=0.5345, baseline_ci95_indep=0.0596, method_mean=0.4658, method_ci95_indep=0.0461,
              delta_mean=-0.0687, delta_ci95_paired=0.0194, delta_sd=0.0156, cohen_dz=-4.4018, wins=0,
              t_stat=-9.8427, p_paired=0.0006, p_tost=0.9996, jack_delta_min=-0.0738, jack_delta_max=-0.0635)


def test_t_quantiles_and_cdf():
    assert t_quantile_py(0.975, 4) == pytest.approx(2.7764451, abs=1e-6)
    assert t_quantile_py(0.975, 9) == pytest.approx(2.2621572, abs=1e-6)
    assert t_quantile_py(0.975, 1) == pytest.approx(12.7062047, abs=1e-6)
    assert 1 - _abs_prob_py(2.0, 4) == pytest.approx(0.1161165, abs=1e-6)
    # Cauchy (nu = 1): P(|T| < 1) = 1/2
    assert _abs_prob_py(1.0, 1) == pytest.approx(0.5, abs=1e-12)


def test_spark_t_matches_python(spark):
    from synthlab.functions.tdist import t_crit, t_two_sided_p
    rows = [(t, nu) for t in (0.3, 1.7, 4.2) for nu in (1, 2, 3, 8, 11, 40)]
    df = spark.createDataFrame(rows, "t DOUBLE, nu INT")
    got = df.select("t", "nu", t_two_sided_p(F.col("t"), F.col("nu")).alias("p"), t_crit(F.col("nu")).alias("c")).collect()
    for r in got:
        assert r["p"] == pytest.approx(1 - _abs_prob_py(r["t"], r["nu"]), abs=1e-12)
        assert r["c"] == pytest.approx(t_quantile_py(0.975, r["nu"]), abs=1e-12)


def test_golden_paired_row(spark):
    df = spark.createDataFrame([("cell",) + p for p in GOLDEN_PAIRS], "cell STRING, seed INT, base DOUBLE, meth DOUBLE")
    row = ST.paired_stats(df, ["cell"]).first().asDict()
    for k, v in GOLDEN.items():
        assert round(row[k], 4) == pytest.approx(v, abs=1e-4), k
    assert row["jack_sign_stable"] is True


def test_constant_difference_gives_null_tests(spark):
    df = spark.createDataFrame([("c", s, 0.5, 0.6) for s in range(5)], "cell STRING, seed INT, base DOUBLE, meth DOUBLE")
    row = ST.paired_stats(df, ["cell"]).first()
    assert row["t_stat"] is None and row["p_paired"] is None and row["cohen_dz"] is None
    assert row["delta_mean"] == pytest.approx(0.1)


def test_bh_monotone_and_bounded(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id INT, p_paired DOUBLE")
    out = {r["id"]: r for r in ST.bh_fdr(df, q=0.05).collect()}
    adj = [out[i]["p_fdr_bh"] for i in range(len(ps) - 1)]
    assert all(a <= b + 1e-15 for a, b in zip(adj, adj[1:]))
    assert all(0 <= a <= 1 for a in adj)
    assert out[len(ps) - 1]["p_fdr_bh"] is None
    # textbook example: m = 10, p * m / rank, reverse running minimum
    assert adj[0] == pytest.approx(0.01)
    assert adj[1] == pytest.approx(0.04)


def test_jackknife_mean_of_leave_one_out_is_mean(spark):
    d = [0.1, -0.2, 0.05, 0.3, 0.0]
    df = spark.createDataFrame([("c", i, 0.0, x) for i, x in enumerate(d)], "cell STRING, seed INT, base DOUBLE, meth DOUBLE")
    row = ST.paired_stats(df, ["cell"]).first()
    loo = [(sum(d) - x) / (len(d) - 1) for x in d]
    assert row["jack_delta_min"] == pytest.approx(min(loo))
    assert row["jack_delta_max"] == pytest.approx(max(loo))
    assert sum(loo) / len(loo) == pytest.approx(sum(d) / len(d))


def test_ci95_null_below_two(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("b", 0.6), ("b", None)], "g STRING, v DOUBLE")
    out = {r["g"]: r for r in ST.ci95(df, "v", ["g"]).collect()}
    assert out["a"]["ci95"] is None
    assert out["b"]["n_valid"] == 2
    assert out["b"]["ci95"] == pytest.approx(t_quantile_py(0.975, 1) * math.sqrt(0.02) / math.sqrt(2))
