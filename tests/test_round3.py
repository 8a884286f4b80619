"""What is shuffled, and how rows are dealt to tasks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from synthlab.operators import generate as G
from synthlab.operators import knn as N
from synthlab.operators import sampling as S
from synthlab.plans import models


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    """One large file is cut, many small ones are put together."""
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    one = spark.range(1000, numPartitions=1)
    parts = models.dealt(one, 1000).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(parts) == 10 and max(parts) <= 110
    assert models.dealt(spark.range(90, numPartitions=40), 90).rdd.getNumPartitions() == 1


def test_fit_reads_the_dealt_rows(spark, monkeypatch):
    """A fit trains on what ``dealt`` gives, with all rows and the weight."""
    seen = []
    plain = models.dealt
    monkeypatch.setattr(models, "dealt", lambda df, n: seen.append((df.columns, n, df.count())) or plain(df, n))
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"),
                                 F.lit(1.5).alias("weight"), F.lit("a").alias("other"))
    models.fit_score(df, df, ["x"], "y", "lr", 1, weight_col="weight").count()
    assert seen == [(["x", "y", "weight"], 200, 200)]


def _brute(q, r, k, self_join):
    out = {}
    for a, x in q:
        d = sorted((sum((u - v) ** 2 for u, v in zip(x, y)) ** 0.5, b) for b, y in r if not (self_join and a == b))
        out[a] = [(b, round(e, 9)) for e, b in d[:k]]
    return out


@pytest.mark.parametrize("self_join", [True, False])
def test_tiles_give_the_exact_neighbours(spark, self_join, monkeypatch):
    """Many tiles, queries outside all boxes, a point on a third of the rows, ties."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    pts = [(i, [float(v) for v in (rng.integers(0, 40, 3) if i % 3 else (7, 7, 7))]) for i in range(900)]
    far = [(2000 + i, [float(v) for v in rng.normal(0, 60, 3)]) for i in range(60)]
    ref = spark.createDataFrame(pts, "k long, x array<double>")
    q = ref if self_join else spark.createDataFrame(far + pts[:30], "k long, x array<double>")
    rows = N.knn_join(q, ref, "k", "x", 4, slab_size=4, exclude_self=self_join).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["nn_rank"])):
        got.setdefault(r["k"], []).append((r["nn_key"], round(r["dist"], 9)))
    assert got == _brute(pts if self_join else far + pts[:30], pts, 4, self_join)


def test_nulls_have_no_distance_and_come_last(spark):
    ref = spark.createDataFrame([(1, [0.0]), (2, [None]), (3, [5.0])], "k long, x array<double>")
    q = spark.createDataFrame([(10, [1.0]), (11, [None])], "k long, x array<double>")
    got = sorted((r["k"], r["nn_rank"], r["nn_key"], r["dist"]) for r in N.knn_join(q, ref, "k", "x", 3, dims=1).collect())
    assert got == [(10, 1, 1, 1.0), (10, 2, 3, 4.0), (10, 3, 2, None), (11, 1, 1, None), (11, 2, 2, None), (11, 3, 3, None)]


def test_candidate_pairs_are_never_rows(spark):
    """The plan joins no queries with reference rows."""
    df = spark.range(300).select("id", F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0).alias("x"))
    plan = N.knn_join(df, df, "id", "x", 3, slab_size=4, exclude_self=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "collect_list" not in plan


def test_rows_at_ranks_is_the_row_of_that_rank(spark):
    """nulls in rows, repeated picks, picks outside, against the ranks themselves."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") * 2).alias("v"))
    picks = spark.range(0, 9000).select("id", (F.col("id") * 7 % 3500 - 200).alias("at")).withColumnRenamed("id", "p")
    got = S.rows_at_ranks(df, ["id"], 9, picks, "at", 3000, 9000, digits=2)
    rank = S.hash_rank(df, ["id"], 9).select((F.col("rank") - 1).alias("at"), "id", "v")
    want = picks.join(rank, "at").select("p", "at", "id", "v")
    assert got.select("p", "at", "id", "v").exceptAll(want).isEmpty() and got.count() == want.count()


def test_smote_shuffles_no_synthetic_rows(spark, monkeypatch):
    """synthetic rows come from base rows, in blocks when these are few; shared neighbours change nothing."""
    df = spark.range(400).select("id", (F.col("id") * 1.7 % 31).alias("a"), (F.col("id") % 11 * 1.0).alias("b"),
                                 (F.col("id") % 20 == 0).cast("int").alias("y"))
    plain = G.smote(df, "id", ["a", "b"], "y", 1000, 3)
    assert sorted(r[0] for r in plain.select("syn_rank").collect()) == list(range(1, 1001))
    shared = G.smote(df, "id", ["a", "b"], "y", 1000, 3, neighbours=G.minority_neighbours(df, "id", ["a", "b"], "y"))
    assert plain.exceptAll(shared).isEmpty() and shared.count() == 1000
    monkeypatch.setattr(G, "ID_BLOCK", 8)
    blocks = G.smote(df, "id", ["a", "b"], "y", 1000, 3)
    assert plain.exceptAll(blocks).isEmpty() and blocks.count() == 1000


def test_wide_search_over_many_tasks(spark):
    """blocks and pages meet in every task, not only where all groups fit into one."""
    from synthlab.operators.metric_index import search
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        df = spark.range(400).select("id", F.array(*[(F.col("id") * w % 101).cast("double") for w in (3, 5, 7, 11)]).alias("v"))
        got = search(df, df, "id", "v", 3, 4, pivots=4, tile_rows=32, block_rows=16, exclude_self=True).neighbours.groupBy("id").count().collect()
        assert len(got) == 400 and {r["count"] for r in got} == {3}
    finally:
        spark.conf.set(conf, old)
