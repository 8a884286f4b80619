"""Bootstrap replicates of the AUC by arrays, against the definition."""
from hashlib import md5

import pytest

from synthlab.operators import fidelity as FD


def plain(rows, replicates, seed):
    limits = FD.poisson_thresholds()
    out = {}
    for b, (f1, f2, f3) in enumerate(FD.replicate_factors(replicates, seed), 1):
        for cell in {r[1] for r in rows}:
            weighted = []
            for k, c, s, y in rows:
                if c == cell:
                    h = md5(f"{k}:{seed}".encode()).hexdigest()
                    u = (int(h[:8], 16) % FD.PRIME * f1 + int(h[8:16], 16) % FD.PRIME * f2 + f3) % FD.PRIME / FD.PRIME
                    weighted.append((float("-inf") if s is None else s, y, sum(u >= t for t in limits)))
            pos = sum(w for _, y, w in weighted if y)
            neg = sum(w for _, y, w in weighted if not y)
            won = sum(w * v * (1 if s > t else 0.5 if s == t else 0) for s, y, w in weighted if y for t, z, v in weighted if not z)
            out[cell, b] = won / (pos * neg) if pos and neg else None
    return out


@pytest.mark.parametrize("step", [4, 1024])
def test_replicates_equal_the_definition(spark, monkeypatch, step):
    monkeypatch.setattr(FD, "STEP", step)
    rows = [(i, "a" if i % 3 else None, (None if i % 17 == 0 else [0.5, 0.25, i / 90][i % 5 % 3]), int(i * i % 7 < 3)) for i in range(90)]
    rows += [(200 + i, "one class", i / 5, 1) for i in range(5)] + [(300 + i, "ties", 0.5, i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, cell string, score double, y int")
    want = plain(rows, 7, 42)
    got = FD.bootstrap_auc(df, "score", "y", ["k"], 7, 42, by=["cell"])
    kept = {(r["cell"], r["b"]): r["auc"] for r in got.collect()}
    want = {k: v for k, v in want.items() if k[0] is not None} | {(None, b): want[None, b] for b in range(1, 8)}
    assert kept.keys() == want.keys()
    assert all(kept[k] == pytest.approx(v) for k, v in want.items())
    assert FD.bootstrap_auc(df.limit(0), "score", "y", ["k"], 7, 42, by=["cell"]).collect() == []


def test_no_row_per_replicate(spark):
    df = spark.range(100).selectExpr("id as k", "id / 100 as score", "cast(id % 2 as int) as y")
    plan = FD.bootstrap_auc(df, "score", "y", ["k"], 1000, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
