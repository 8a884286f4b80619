import random
from collections import Counter

import numpy as np
import pytest

from fixtures_llm import awkward, nothing  # noqa: F401
from synthlab.llm import quality as Q


def brute(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit))


def texts():
    rng = random.Random(1)
    return [None, "", "\n\n", "a\na\n \n \na", "a b c d e a b c d e", "a a a a a a", "x\x0by\x1cz q\n\n#$|"] + [
        "".join(rng.choice("ab \n#\t") for _ in range(rng.randint(0, 80))) for _ in range(300)]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in Q.COUNTS) for r in Q.text_statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts())}


def test_rules_find_a_planted_conjunction_and_agree_with_their_expression(spark):
    rng = np.random.default_rng(0)
    n = 1500
    table = {"words": rng.integers(10, 400, n).astype(float), "word_length": rng.uniform(2, 9, n),
             "symbols_per_word": rng.uniform(0, 1, n), "dup_lines_per_100_words": rng.uniform(0, 9, n),
             "repeat_share": rng.uniform(0, 0.2, n)}
    bad = ((table["symbols_per_word"] > 0.5) & (table["words"] < 200)) | (table["word_length"] > 8)
    rules = Q.learn_rules(table, bad)
    said = np.any([Q.covers(r, table) for r in rules], axis=0)
    assert (said & bad).sum() > 0.9 * bad.sum() and (said & ~bad).sum() < 0.05 * said.sum()
    assert any(len(r) > 1 for r in rules)
    rows = [(int(w), int(w * le), int(w * s), int(w * d / 100), int(w * p)) for w, le, s, d, p in zip(*table.values())]
    df = spark.createDataFrame(rows, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = np.array([r[0] for r in df.select(Q.rules_column(rules)).collect()])
    n_w = np.array([r[0] for r in rows], float)
    again = {"words": n_w, "word_length": np.array([r[1] for r in rows]) / n_w,
             "symbols_per_word": np.array([r[2] for r in rows]) / n_w,
             "dup_lines_per_100_words": 100 * np.array([r[3] for r in rows]) / n_w,
             "repeat_share": np.array([r[4] for r in rows]) / n_w}
    first = np.zeros(n, int)
    for i, r in reversed(list(enumerate(rules, 1))):
        first[Q.covers(r, again)] = i
    assert got.tolist() == first.tolist()


def test_no_labels_and_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(None, 0), (4, 0), (4, 1)], "doc_id long, quality int")
    rules = Q.fit_rules(awkward, labels)
    assert rules == []
    out = Q.judge_quality(awkward, rules)
    assert out.count() == awkward.count()
    for r in out.collect():
        assert r["kept"] == (not r["base_failed"]) and (r["text"] or r["base_failed"])
    kept = Q.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == out.where("kept").count()
    assert Q.judge_quality(nothing, Q.fit_rules(nothing, labels)).count() == 0


@pytest.mark.parametrize("share", [0, 1])
def test_one_class_gives_no_wrong_rule(share):
    table = {name: np.arange(60.0) for name in Q.FEATURES}
    assert Q.learn_rules(table, np.full(60, bool(share))) == []


def test_learned_on_labels_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = Q.judge_quality(docs, Q.fit_rules(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    assert right >= 0.97 * len(judged)
    assert sum(r["kept"] for r in judged if r["quality"] == 1) >= 0.99 * sum(r["quality"] == 1 for r in judged)


def test_a_hot_key_takes_no_room_from_other_keys(spark):
    n = 400
    good = "plain words that stand here {} and go on for a while without any sign at all in it"
    bad = "# $ # word{} * # | & # < word # $ word % # & | # < # and word # $ # |"
    rows = [(i, (bad if i % 2 else good).format(i)) for i in range(n)]
    docs = spark.createDataFrame(rows + [(k, good.format(k)) for k in (0, 2, 4, 6, 8, 10) for _ in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    rules = Q.fit_rules(docs, labels, sample_rows=n)
    assert rules and rules == Q.fit_rules(once, labels, sample_rows=n)
    from synthlab.llm import toxicity as T
    a, b = T.fit(docs, labels, sample_rows=n), T.fit(once, labels, sample_rows=n)
    assert list(a.buckets) == list(b.buckets) and np.array_equal(a.weights, b.weights)
