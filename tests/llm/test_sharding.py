from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures_llm import awkward, nothing  # noqa: F401
from synthlab.llm import sharding as S


def test_slots_are_gapless_and_growth_moves_rows_into_the_new_shard_only(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("size"))
    rows = S.assign_shards(df, "doc_id", 16, ties=["size"]).collect()
    assert len(rows) == 3000 and {r["shard"] for r in rows} == set(range(16))
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 16 for r in moved) and 100 < len(moved) < 260


def test_weights(spark):
    got = Counter(r[0] for r in spark.range(8000).select(S.rendezvous(F.col("id"), 3, [1, 2, 0])).collect())
    assert set(got) == {0, 1} and 1.8 < got[1] / got[0] < 2.2
    with pytest.raises(ValueError):
        S.rendezvous(F.col("id"), 2, [1.0])


def test_awkward_and_hot_rows(spark, awkward, nothing):
    rows = S.assign_shards(awkward, "doc_id", 4, ties=["text"]).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in awkward.collect())
    assert len({r["shard"] for r in rows if r["doc_id"] == 4}) == 1
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"))
    rows = S.assign_shards(hot, "doc_id", 4).collect()
    assert sum(r["doc_id"] == 7 for r in rows) == 1000 + 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert S.assign_shards(nothing, "doc_id", 4).count() == 0


def test_written_shards_hold_whole_rows(spark, awkward):
    df = awkward.select("doc_id", "text")
    path = S.write_shards(df, "doc_id", 4, files_per_shard=2)
    back = spark.read.parquet(path)
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(map(tuple, df.collect()))
    wrong = back.where(F.col("shard") != S.rendezvous(F.col("doc_id"), 4)).count()
    assert wrong == 0
