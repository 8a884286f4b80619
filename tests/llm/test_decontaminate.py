import hashlib
import random
import re

import pytest

from fixtures_llm import awkward, nothing  # noqa: F401
from synthlab.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            if item is None or not b:
                continue
            span = min(13, len(b))
            windows = {tuple(b[i:i + span]) for i in range(len(b) - span + 1)}
            for i in range(len(w) - span + 1):
                if tuple(w[i:i + span]) in windows:
                    hit.update(range(i, i + span))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    vocabulary = ["a", "B", "c1", "É", "é", "the", "d"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n)))
             for i, n in enumerate([1, 2, 3, 5, 7, 8, 9, 11, 12, 13, 14, 20, 40])]
    items += [(50, None), (51, "!!"), (None, "the a"), (52, "the " * 30), (9, "a second text of item nine")]
    rows = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            body = (rng.choice(items)[1] or "").split(" ")
            at = rng.randint(0, len(text))
            text[at:at] = body[rng.randint(0, 3):]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    return rows + [(1, rows[1][1]), (2, "other text of the same id"), (None, items[-3][1]), (None, None), (77, ""),
                   (78, "the " * 4000)], items


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_equals_brute_force(spark, broadcast_rows):
    rows, items = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, w string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs, bench, broadcast_rows=broadcast_rows)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                  for r in got.collect()), key=str)
    assert got == brute(rows, items)
    kept = [r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted((r[0] for r in brute(rows, items) if not r[-1]), key=str)


def test_empty_tables(spark, awkward, nothing):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(nothing, no_items).count() == 0
    rows = D.contamination(awkward, no_items).collect()
    assert len(rows) == awkward.count() and not any(r["contaminated"] or r["n_hit"] for r in rows)
    assert D.drop_contaminated(awkward, no_items).columns == awkward.columns


def test_plan_is_native(spark, awkward):
    items = spark.createDataFrame([(1, "the a the a")], "item_id long, text string")
    plan = D.contamination(awkward, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


@pytest.mark.parametrize("span", range(1, 14))
def test_every_shared_span_keeps_a_fingerprint(spark, span):
    from pyspark.sql import functions as F
    rng = random.Random(span)
    common = [rng.choice("abc") for _ in range(span)]
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 20))] + common + [rng.choice("abcd") for _ in range(9)],)
            for _ in range(30)]
    got = spark.createDataFrame(rows, "w array<string>").select(
        "w", D.fingerprints(F.col("w"), span).alias("v")).collect()
    k, _ = D.scheme(span)
    kept = [{tuple(r["w"][p:p + k]) for p in (v & ((1 << 30) - 1) for v in r["v"])} for r in got]
    grams = {tuple(common[i:i + k]) for i in range(span - k + 1)}
    assert set.intersection(*kept) & grams or all(s & grams for s in kept)
    # the same k-gram of the common span is kept in every text
    assert any(all(g in s for s in kept) for g in grams)


def test_time_in_proportion_to_hits(spark):
    """One text of nothing but hits: four times the text must not take much more than four times as long."""
    import time
    words = " ".join(f"word{i:02d}x" for i in range(13)) + " "
    items = spark.createDataFrame([("a", words)], "item_id string, text string")

    def seconds(n):
        docs = spark.createDataFrame([(1, words * n)], "doc_id long, text string")
        t0 = time.time()
        row = D.contamination(docs, items).first()
        assert row["n_hit"] == row["n_words"] == 13 * n
        return time.time() - t0
    seconds(1000)
    assert seconds(16_000) < 4 * seconds(4000) + 10
