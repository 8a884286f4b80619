import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fixtures_llm import awkward, nothing, pairs  # noqa: F401
from synthlab.llm import runs as R
from synthlab.llm.queries import op13_periodic_runs, with_planted_runs


def brute_runs(words):
    """Every period's longest stretches, the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def words_with_runs(rng):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(0, 60))]
    n = len(words)
    if rng.random() < 0.6 and n > 6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)] + [words[-1]] * rng.randint(0, 9)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(4)
    texts = [words_with_runs(rng) for _ in range(2500)]
    for at in range(0, len(texts), 50):
        part = texts[at:at + 50]
        assert R.runs_of(part) == [brute_runs(t) for t in part]


def test_hash_collisions_change_nothing(monkeypatch):
    monkeypatch.setattr(R, "_FACTORS", R._FACTORS * 0)      # all places share one hash
    rng = random.Random(5)
    texts = [words_with_runs(rng) for _ in range(60)]
    assert R.runs_of(texts) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("words, runs", [
    ([b"a"] * 100_000, [(0, 100_000, 1)]),
    ([b"%d" % (i % 10_000) for i in range(90_000)], [(0, 90_000, 10_000)]),
    (sum([[b"x%d" % i, b"a", b"b", b"c", b"d", b"e"] for i in range(15_000)], []), []),
])
def test_very_long_texts(words, runs):
    assert R.runs_of([words]) == [runs]


def test_rows(spark, awkward, nothing):
    got = R.find_runs(awkward).collect()
    assert len(got) == awkward.count() and got[0].asDict().keys() == {"doc_id", "n_words", "runs", "collapsed"}
    texts = {(r["doc_id"], r["text"]): R.split_words(r["text"] or "") for r in awkward.select("doc_id", "text").collect()}
    long = next(r for r in got if r["doc_id"] == 5)
    assert [tuple(x) for x in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "word"
    want = sorted((k, len(w), tuple(brute_runs(w)), brute_collapsed(w, brute_runs(w)).decode()) for (k, _), w in texts.items()
                  if k is not None and len(w) < 1000 and k != 4)
    assert sorted((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got
                  if r["doc_id"] not in (None, 4, 5)) == want
    assert R.find_runs(nothing).collect() == []


def plain_query(doc_id, text):
    words = R.split_words(text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = (None,) * 4
    if runs:
        s, length, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, sha256(listed.encode()).hexdigest(), sha256(brute_collapsed(words, runs)).hexdigest())


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(w.decode() for w in words_with_runs(rng)), "en") for i in range(400)]
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "a a a a a a a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_query(k, t) for k, t, _ in rows), key=str)
    assert with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == len(rows)
