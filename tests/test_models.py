"""Model fits: weights, equal bins and forests."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from synthlab.functions.keys import hash_uniform
from synthlab.operators import forest as T
from synthlab.operators.metrics import auc_ap, balanced_weights
from synthlab.plans import models
from synthlab.plans.experiment import Dataset, run_balanced


@pytest.fixture(scope="module")
def rare(spark):
    """About a tenth of 2,000 rows are positive, more of them where x is large."""
    u, x = hash_uniform(["id"], "y"), hash_uniform(["id"], "x")
    return spark.range(2000).select("id", x.alias("x"), hash_uniform(["id"], "z").alias("z"),
                                    (u < 0.2 * x).cast("int").alias("y"))


@pytest.mark.parametrize("name", ["lr", "gbc"])
def test_weights_reach_every_fit(rare, name, monkeypatch):
    """under balanced weights the classes count the same, so the weighted mean score is near a half."""
    monkeypatch.setattr(models, "GBT_TREES", 5)
    w = balanced_weights(rare, "y")
    plain = models.fit_score(rare, rare, ["x", "z"], "y", name, 1).agg(F.avg("score")).first()[0]
    even = models.fit_score(w, w, ["x", "z"], "y", name, 1, weight_col="weight").agg(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).first()[0]
    assert plain < 0.2 and abs(even - 0.5) < 0.05


def test_balanced_cells_differ(rare):
    """the class-weighted cell is not the plain one again."""
    plain, weighted = run_balanced(Dataset(rare, "id", "y", "classification", "d", ["x", "z"]), 123, "lr")
    assert plain[3:4] == ("baseline",) and weighted[3:4] == ("class_weighted",)
    assert plain[-1] is None and weighted[-1] is None and plain[7:10] != weighted[7:10]


def test_mlp_refuses_weights(spark):
    """a fit that can't use weights says so."""
    with pytest.raises(ValueError):
        models.classifier("mlp", ["x"], "y", weight_col="weight")


def test_boosting_trains_on_distinct_bins(spark, rare, monkeypatch):
    """What boosting reads grows with the different rows, and not with the rows; equal rows count by their number."""
    seen, plain = [], models.dealt
    monkeypatch.setattr(models, "dealt", lambda df, n: seen.append(n) or plain(df, n))
    monkeypatch.setattr(models, "GBT_TREES", 5)
    few = rare.select("id", F.floor(F.col("x") * 6).alias("x"), F.floor(F.col("z") * 5).alias("z"), "y")
    many = few.withColumn("id", F.explode(F.array(*[F.col("id") + 2000 * i for i in range(4)])))
    a, b = (models.fit_score(t, few, ["x", "z"], "y", "gbc", 1).orderBy("id").toPandas()["score"] for t in (few, many))
    assert max(seen) <= 6 * 5 * 2 and len(seen) == 2
    assert (a - b).abs().max() < 1e-9 and a.nunique() > 4


@pytest.mark.parametrize("weight", [None, "weight"])
def test_boosting_is_mllib_on_the_rows(rare, monkeypatch, weight):
    """Bins and counts change nothing of the fit."""
    monkeypatch.setattr(models, "GBT_TREES", 5)
    t = balanced_weights(rare, "y")
    got = models.fit_score(t, t, ["x", "z"], "y", "gbc", 1, weight_col=weight).orderBy("id").toPandas()["score"]
    want = models._scored(models._fit(t, ["x", "z"], "y", "gbc", 1, weight), t, "y").orderBy("id").toPandas()["score"]
    assert (got - want).abs().max() < 1e-6


def test_cut_points_of_many_values(spark, monkeypatch):
    """A feature of many values is cut at equal shares by intervals, from all rows."""
    t = spark.range(20_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).alias("z"), F.lit(None).cast("double").alias("n"))
    exact = T.cut_points(t, ["x", "z", "n"])
    monkeypatch.setattr(T, "VALUES", 1000)
    rough = T.cut_points(t, ["x", "z", "n"])
    assert len(exact[0]) == len(rough[0]) == T.MAX_BINS - 1 and exact[1] == rough[1] == [0.5, 1.5] and exact[2] == rough[2] == []
    assert max(abs(a - b) for a, b in zip(exact[0], rough[0])) <= 2 * 20_000 / T.EDGES + 5


def _auc(scored):
    return auc_ap(scored, "score", "y").first()["auc_roc"]


def test_forest_does_not_depend_on_layout(rare, monkeypatch):
    """F1 F2: the bootstrap is drawn from the rows and not from the tasks they lie in; nothing is fitted by MLlib."""
    monkeypatch.setattr(models, "RF_TREES", 6)
    monkeypatch.setattr(models, "_fit", None)
    monkeypatch.setattr(models, "LEAST_ROWS", 100)
    a, b = (models.fit_score(t, rare, ["x", "z"], "y", "rf", 1).orderBy("id").toPandas() for t in (rare.repartition(1), rare.repartition(9)))
    assert len(a) == 2000 and (a["score"] - b["score"]).abs().max() < 1e-12
    assert models.fit_score(rare, rare, ["x", "z"], "y", "rf", 2).orderBy("id").toPandas()["score"].ne(a["score"]).any()


def test_forest_is_as_good_as_mllib(spark, monkeypatch):
    """F1 F2: a forest of as many trees of as many bins and depth; it falls back on MLlib where rows are too many for a task."""
    monkeypatch.setattr(models, "RF_TREES", 25)
    u = [hash_uniform(["id"], c) for c in "abcdy"]
    t = spark.range(3000).select("id", *[v.alias(c) for v, c in zip(u, "abcd")], (u[4] < F.pow(u[0] * u[1], 2) + 0.3 * u[2]).cast("int").alias("y"))
    train, test = t.where("id < 2000"), t.where("id >= 2000")
    own = models.fit_score(train, test, list("abcd"), "y", "rf", 1)
    assert own.count() == 1000 and own.agg(F.min("score") >= 0, F.max("score") <= 1).first()[:] == (True, True)
    monkeypatch.setattr(T, "FOREST_BYTES", 0)
    other = models.fit_score(train, test, list("abcd"), "y", "rf", 1)
    assert other.count() == 1000 and abs(_auc(own) - _auc(other)) < 0.02
    assert abs(own.agg(F.avg("score")).first()[0] - other.agg(F.avg("score")).first()[0]) < 0.02


def test_one_tree_by_hand():
    """F1 F2: a full tree without draws gives each row its label; counts weigh; a depth of 0 is the mean."""
    x = np.array([[0, 3], [1, 3], [2, 1], [2, 2]], np.uint8)
    y, w, rng = np.array([0., 1., 0., 1.]), np.array([1., 2., 3., 2.]), np.random.default_rng(1)
    assert T.tree_votes(x, y, w, x, 30, 2, rng).tolist() == [0, 1, 0, 1]
    assert T.tree_votes(x, y, w, x, 0, 2, rng).tolist() == [0.5] * 4
    assert T.tree_votes(np.zeros_like(x), y, w, x, 30, 2, rng).tolist() == [0.5] * 4
    assert T.tree_votes(x, y, 0 * w, x, 30, 2, rng).tolist() == [0] * 4


@pytest.mark.parametrize("name", ["gbc", "rf"])
@pytest.mark.parametrize("bad", [{"x": None}, {"x": float("nan")}, {"x": float("inf")}, {"y": None}])
def test_rows_that_mllib_refuses(rare, monkeypatch, name, bad):
    """A row without a finite feature or a label goes to MLlib, which refuses it as before."""
    monkeypatch.setattr(models, "_fit", lambda train, *a: (_ for _ in ()).throw(ValueError(f"{train.count()} rows")))
    t = rare
    for c, v in bad.items():
        t = t.withColumn(c, F.when(F.col("id") == 5, F.lit(v)).otherwise(F.col(c)).cast(dict(rare.dtypes)[c]))
    with pytest.raises(ValueError, match="2000 rows"):
        models.fit_score(t, t, ["x", "z"], "y", name, 1)
