import random
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fixtures_llm import awkward, nothing  # noqa: F401
from synthlab.llm import simhash as S
from synthlab.llm.graph import components


def brute_print(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, bits):
    root = {p: p for p in prints}
    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for a in prints:
        for b in prints:
            if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def clusters(seed):
    rng = random.Random(seed)
    out = {0}
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 30, 120])):
            out.add(p)
            p ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                p ^= 1 << rng.randrange(24)
    return [int(np.array(p, dtype=np.uint64).view(np.int64)) for p in out]


def test_fingerprints(spark, awkward):
    rows = awkward.select("doc_id", "text", S.fingerprint_column(F.col("text")).alias("fp")).collect()
    assert all(r["fp"] % 2 ** 64 == brute_print(r["text"]) for r in rows)


@pytest.mark.parametrize("bits, bucket", [(1, 3), (1, 64), (2, 3), (2, 64)])
def test_components_equal_brute_force(spark, monkeypatch, bits, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)                # 3: nearly all goes through crowded buckets
    prints = clusters(bits)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {p: p for p in prints} | {r["node"]: r["root"] for r in components(S.near_links(df, bits)).collect()}
    assert got == brute_roots(prints, bits)


def test_every_plan_finds_all_links():
    """Whatever thresholds the program picks, two values within the bits meet in some partition."""
    rng = random.Random(2)
    for sizes in S.SCHEMES:
        for _ in range(20):
            pairs = [rng.randint(1, 10 ** 6) for _ in sizes]
            _, t = S.allocate(list(sizes), pairs, 1000, 2)
            assert sum(t) == 2 - len(sizes) + 1 and min(t) >= -1
            for spread in product(range(3), repeat=len(sizes)):
                if sum(spread) <= 2:
                    assert any(d <= limit for d, limit in zip(spread, t))
    assert S.allocate([21, 21, 22], [10, 10, 10 ** 9], 10 ** 5, 2)[1][2] == -1     # the crowded one is left out


def test_correlated_bits_meet_in_one_partition():
    related = np.eye(64)
    for a, b in ((3, 40), (40, 63), (3, 63)):
        related[a, b] = related[b, a] = 0.9
    assert any({3, 40, 63} <= set(p) for p in S.group_bits(related, (22, 21, 21)))
    assert sorted(sum(S.group_bits(related, (22, 21, 21)), [])) == list(range(64))


def test_near_duplicates_and_survivors(spark, awkward, nothing):
    extra = awkward.union(awkward.where("doc_id > 100").withColumn("doc_id", F.col("doc_id") + 1000))
    rows = S.near_duplicates(extra).collect()
    assert len(rows) == extra.count()
    texts = extra.select("doc_id", "text").collect()
    prints = {brute_print(r["text"]) for r in texts}
    roots = brute_roots([int(np.array(p, dtype=np.uint64).view(np.int64)) for p in prints], 2)
    least = {}
    for r in texts:
        g = roots[int(np.array(brute_print(r["text"]), dtype=np.uint64).view(np.int64))]
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], least.get(roots[int(np.array(brute_print(r["text"]), dtype=np.uint64).view(np.int64))]))
                   for r in texts), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == want
    kept = S.keep_one(extra)
    assert kept.columns == extra.columns
    want = sorted((least.get(g) for g in set(roots.values())), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want
    assert S.near_duplicates(nothing).count() == 0 and S.keep_one(nothing).count() == 0


def test_long_chain_and_hub(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(500).select(F.lit(1000).cast("long").alias("a"), (F.col("id") + 1001).alias("b"))
    got = {r["node"]: r["root"] for r in components(chain.union(hub)).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1501))
    assert components(chain.limit(0)).count() == 0
