"""Each stage against a plain version of its rule, on the stage's own input."""
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from fixtures_llm import awkward, nothing  # noqa: F401
from test_decontaminate import brute as brute_contamination
from test_quality import brute as brute_counts
from test_simhash import brute_print, brute_roots

from synthlab.llm import quality, toxicity
from synthlab.llm.queries import QUERIES
from synthlab.session import materialise

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF_SMALL), "stage")
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_order(steps):
    assert [n for n, _ in P.STAGES][2] == "SimHash near-dedup" and len(P.STAGES) == 5
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    sizes = [s.count() for s in steps]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[3] > 0 and sizes[-1] == sizes[-2]


def test_learned_stages(spark, steps):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rules = quality.fit_rules(steps[0], labels)
    want = []
    for r in steps[0].collect():
        n, chars, symbols, dup, repeat = brute_counts(r["text"])
        row = {k: np.array([float(v)]) for k, v in {
            "words": n, "word_length": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1),
            "dup_lines_per_100_words": 100 * dup / max(n, 1), "repeat_share": repeat / max(n, 1)}.items()}
        bad = n < 10 or 100 * repeat > 20 * n or any(quality.covers(rule, row)[0] for rule in rules)
        want += [] if bad else [r["doc_id"]]
    assert ids(steps[1]) == sorted(want)
    machine = toxicity.fit(steps[1], labels)
    place = {int(b): i for i, b in enumerate(machine.buckets)}
    want = []
    for r in steps[1].collect():
        active = {place[b] for w in toxicity.text_words(r["text"]) for b in toxicity.term_buckets(w) if b in place}
        z, on = machine.bias, sorted(active)
        z += sum(machine.weights[i] for i in on)
        z += sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(on) for b in on[i + 1:])
        want += [r["doc_id"]] if z < 0 else []
    assert ids(steps[2]) == sorted(want)


def test_near_duplicate_stage(steps):
    rows = steps[2].select("doc_id", "text").collect()
    own = {r["doc_id"]: int(np.array(brute_print(r["text"]), dtype=np.uint64).view(np.int64)) for r in rows}
    roots = brute_roots(sorted(set(own.values())), 2)
    least = {}
    for k, p in own.items():
        least[roots[p]] = min(least.get(roots[p], k), k)
    assert ids(steps[3]) == sorted(least.values())


def test_benchmark_stage(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in steps[3].collect()]
    assert ids(steps[4]) == sorted(r[0] for r in brute_contamination(rows, items) if not r[-1])


def test_run_equals_the_stages(spark, steps):
    got = P.run(spark, SF_SMALL)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, steps[-1].collect()))


def test_awkward_rows_pass_through(spark, awkward, tmp_path):
    base = awkward.selectExpr("doc_id", "text", "score as lang", "ids as source", "cast(length(text) as long) as n_chars")
    for rows, folder in ((base, "rows"), (base.limit(0), "none")):
        sf = str(tmp_path / folder)
        rows.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "same words here again and"), (2, None)], "item_id long, text string").write.parquet(
            f"{sf}/benchmark.parquet")
        out = P.run(spark, sf)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (out.count() > 0) == (folder == "rows")


def test_registry():
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in QUERIES} and "pipeline" in QUERIES
