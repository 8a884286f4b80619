"""Exact neighbours of wide vectors: brute force, ties, rows without a vector, and how much is ruled out."""
import numpy as np
import pytest

from synthlab.operators.metric_index import search
from synthlab.plans.q_wide import mixed_search
from conftest import SF_MID

SCHEMA = "id long, v array<double>, note string"


def _brute(q, r, k, exclude_self):
    out = set()
    for qk, qv in q:
        d = sorted((float(((np.array(qv) - np.array(rv)) ** 2).sum()), rk) for rk, rv in r if not (exclude_self and rk == qk))
        out |= {(qk, rk, i + 1, round(d2 ** 0.5, 9)) for i, (d2, rk) in enumerate(d[:k])}
    return out


def _got(s):
    return [(a["id"], a["nn_key"], a["nn_rank"], round(a["dist"], 9)) for a in s.neighbours.collect()]


def _points(n, dims, latent, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, latent)) @ rng.normal(size=(latent, dims)), 3)
    x[:copies] = x[0]                                   # equal vectors: ties by key
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("latent,copies", [(2, 0), (20, 0), (2, 150)])
def test_equal_to_brute_force(spark, latent, copies):
    pts = _points(450, 20, latent, 3 + latent, copies)
    df = spark.createDataFrame([(i, v, "x") for i, v in pts], SCHEMA)
    s = search(df.filter("id % 5 = 0"), df, "id", "v", 4, 20, pivots=8, tile_rows=32, block_rows=16, exclude_self=True)
    assert sorted(_got(s)) == sorted(_brute([p for p in pts if p[0] % 5 == 0], pts, 4, True))
    c = s.compared.first()
    assert (c["queries"], c["reference"], c["all_pairs"]) == (90, 450, 90 * 450)
    if latent == 2 and not copies:
        assert c["pairs"] < 0.4 * c["all_pairs"]


def test_queries_of_another_table_and_rows_without_a_vector(spark):
    pts = _points(80, 6, 3, 9)
    bad = [(900, None, "n"), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], "n"), (902, [float("nan")] * 6, "n"), (903, [1.0], "n"),
           (904, [float("inf")] + [0.0] * 5, "n"), (None, [0.0] * 6, "n")]
    ref = spark.createDataFrame([(i, v, "x") for i, v in pts] + bad, SCHEMA)
    far = [(1000, [50.0] * 6), (1001, pts[3][1])]
    q = spark.createDataFrame([(i, v, "x") for i, v in far] + bad, SCHEMA)
    s = search(q, ref, "id", "v", 3, 6, pivots=4, tile_rows=16, block_rows=4)
    assert sorted(_got(s)) == sorted(_brute(far, pts, 3, False))


def test_fewer_rows_than_k_repeated_queries_and_empty_tables(spark):
    pts = _points(3, 4, 2, 1)
    df = spark.createDataFrame([(i, v, "x") for i, v in pts], SCHEMA)
    twice = df.unionByName(df)
    got = _got(search(twice, df, "id", "v", 10, 4, exclude_self=True))
    assert sorted(got) == sorted(list(_brute(pts, pts, 10, True)) * 2)
    none = df.limit(0)
    for q, r in ((none, df), (df, none), (none, none)):
        s = search(q, r, "id", "v", 2, 4)
        assert s.neighbours.count() == 0 and s.compared.first()["pairs"] == 0


def test_correlated_columns_are_pruned(spark):
    c = mixed_search(spark, SF_MID, tile_rows=256).compared.first()
    assert 0 < c["pairs"] < 0.25 * c["all_pairs"]
