import zlib

import numpy as np
from fixtures_llm import awkward, nothing  # noqa: F401

from synthlab.llm import toxicity as T


def test_machine_learns_a_pair_that_no_sum_of_weights_explains():
    rng = np.random.default_rng(1)
    rows, toxic = [], []
    for _ in range(1200):
        insult, group, other = rng.random(3) < 0.5
        rows.append(np.array([i for i, on in enumerate((insult, group, other)) if on], dtype=np.int64))
        toxic.append(insult == group)                      # not linear in the two
    m = T.fit_machine(rows, np.array(toxic), np.arange(3), decay=0.0, steps=400)
    score = {(a, b): m.score(np.array([i for i, on in enumerate((a, b)) if on], dtype=np.int64)) for a in (0, 1) for b in (0, 1)}
    assert score[1, 1] > 0.5 > max(score[1, 0], score[0, 1]) and score[0, 0] > 0.5
    again = T.fit_machine(rows, np.array(toxic), np.arange(3), decay=0.0, steps=400)
    assert again.score(rows[0]) == m.score(rows[0])


def test_constant_without_rows_or_with_one_class():
    none = T.fit_machine([], np.zeros(0, bool), np.zeros(0, np.int64))
    one = T.fit_machine([np.array([0])], np.ones(1, bool), np.arange(1))
    assert none.score(np.zeros(0, np.int64)) < 0.01 and one.score(np.array([0])) > 0.5


def test_held_out_accuracy_and_no_leak(spark):
    from pyspark.sql import functions as F
    docs, labels = spark.read.parquet(f"/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"/root/testdata/sf0.01/labels.parquet")
    machine = T.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = T.fit(docs, flipped)
    assert np.array_equal(machine.weights, other.weights) and np.array_equal(machine.factors, other.factors)
    got = T.score_documents(docs, machine).join(labels, "doc_id").select("doc_id", "held_out", "predicted", "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, 1), (6, 0), (8, 1)], "doc_id long, toxic int")
    machine = T.fit(awkward, labels)
    out = T.score_documents(awkward, machine).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not r["text"]}) == 1            # null and empty alike
    clean = T.keep_clean(awkward, labels)
    assert clean.columns == awkward.columns and clean.count() == sum(r["predicted"] == 0 for r in out)
    assert T.score_documents(nothing, T.fit(nothing, labels)).count() == 0
