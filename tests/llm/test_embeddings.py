import numpy as np
import pytest
from pyspark.sql import functions as F

from synthlab.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, component_id string, digest string"


def brute(rows):
    """All pairs, in double precision."""
    good = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1])
            and any(r[1]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (_, v, label, *_) in enumerate(rows):
        for j in range(i):
            if good[i] and good[j] and rows[j][2] == label and len(rows[j][1]) == len(v):
                a, b = np.array(v), np.array(rows[j][1])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98 or (a == b).all():
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i))) for i, r in enumerate(rows)), key=str)


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(450):
        n, label = int(rng.choice([64, 5])), int(rng.choice([1, 1, 1, 2]))
        v = rng.normal(size=n)
        if rows and rng.random() < 0.6:                 # a copy, or a neighbour near the threshold
            _, v, label, *_ = rows[rng.integers(len(rows))]
            v = np.array(v) + rng.normal(size=len(v)) * np.linalg.norm(v) / np.sqrt(len(v)) * rng.choice([0, 0.05, 0.14])
        rows.append((i, [float(x) for x in v], label))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [float("nan")] * 64, 1), (904, [1.0, None], 1),
             (905, [1.0] * 64, None), (906, [1.0] * 64, None), (None, [1.0] * 64, 3), (907, [2.0] * 64, 3),
             (None, None, None), (907, [2.0] * 64, 3), (908, [float("inf")] + [1.0] * 63, 3), (909, [1e-200] * 64, 3)]
    rows += [(1000 + i, [0.5, 0.25, 0.25, 0.0, 1.0], 4) for i in range(150)]
    return [(*r, "x", "x", "x") for r in rows]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA)


@pytest.mark.parametrize("cell, tile", [(512, 4096), (8, 4096), (8, 3)])
def test_equal_to_all_pairs(spark, table, monkeypatch, cell, tile):
    monkeypatch.setattr(E, "CELL", cell)                # small cells: balls cross borders
    monkeypatch.setattr(E, "TILE", tile)
    rows = [r for r in vectors() if r[0] != 909]
    got = E.near_vectors(table.where("vec_id is null or vec_id <> 909")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_tiny_and_scaled_vectors(spark):
    df = spark.createDataFrame([(1, [1e-200] * 3, 1), (2, [1e200] * 3, 1), (3, [1.0] * 3, 1), (4, [-1.0] * 3, 1)],
                               "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_empty(spark, table):
    out = E.near_vectors(table.limit(0))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.collect() == []
    assert E.near_vectors(table.where("label is null")).agg(F.sum("n_links")).first()[0] == 0


def test_blocks_share_the_budget():
    rng = np.random.default_rng(1)
    axes, _ = np.linalg.qr(rng.normal(size=(21, 21)))
    plan = E.Blocks(axes, np.linspace(1, 0.1, 21), 100_000, 0.98)
    assert sorted(i for p in plan.parts for i in p) == list(range(21))
    assert abs(sum(b - E.SLACK for b in plan.budgets) - 0.04) < 1e-12 and any(plan.cut_axes)
