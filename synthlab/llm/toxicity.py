"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and the proper prefixes of those words, hashed to
``BUCKETS`` buckets.  The machine scores ``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` over the buckets
present, so a pair of terms, such as an insult and the mention of a group, can weigh more than the
sum of its parts.  Presence is not divided by the length of the text: one insult in a long document
counts as in a short one.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows, drawn by a hash of the key.  Spark extracts their
terms and counts them by class; the ``TOP_TERMS`` buckets that tell the classes apart best and the
``COMMON_TERMS`` most frequent ones (partners for pairs) enter the machine, which is then fitted on
that bounded matrix.  Scoring covers every row and whole texts.
"""
from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlab.llm.common import fresh_name, one_text, text_udf

SAMPLE_ROWS = 8_000
BUCKETS = 1 << 20
TOP_TERMS, COMMON_TERMS = 1024, 128
FACTORS, STEPS = 4, 150
#: words kept in a task's memo before it starts anew
MEMO = 400_000

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 8)


def term_buckets(word: str) -> list[int]:
    """Buckets of a word and of its proper prefixes of 4 to 7 letters."""
    terms = [word, *("^" + word[:k] for k in PREFIXES if k < len(word))]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for t in terms]


def text_words(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def _text_buckets(texts: list[str]) -> pa.Array:
    out = [sorted({b for w in text_words(t) for b in term_buckets(w)}) for t in texts]
    return pa.array(out, pa.list_(pa.int32()))


@dataclass(frozen=True)
class Machine:
    buckets: np.ndarray          # sorted buckets in use
    bias: float
    weights: np.ndarray          # one of each bucket
    factors: np.ndarray          # (buckets, FACTORS)

    def score(self, active: np.ndarray) -> float:
        """Probability for the (distinct) positions in ``buckets`` that are present."""
        v = self.factors[active]
        pairs = 0.5 * ((v.sum(0) ** 2).sum() - (v ** 2).sum())
        z = self.bias + self.weights[active].sum() + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_machine(rows: list[np.ndarray], toxic: np.ndarray, buckets: np.ndarray, factors: int = FACTORS,
                steps: int = STEPS, decay: float = 2e-3, rate: float = 0.05) -> Machine:
    """Full-batch Adam on the logistic loss with weight decay; the start is a fixed pattern, so the
    same rows give the same machine.  ``rows`` hold positions in ``buckets``.

    No rows, or one class only, give a constant score: the share of toxic rows, 0 for no rows.
    """
    n, d = len(rows), len(buckets)
    share = float(toxic.mean()) if n else 0.0
    bias0 = float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5))) if n else -40.0
    angle = np.outer(np.arange(1, d + 1), np.arange(1, factors + 1)) * 0.7548776662466927
    theta = np.concatenate([[bias0], np.zeros(d), 0.02 * np.cos(2 * np.pi * angle).ravel()])
    if 0 < share < 1 and d:
        flat = np.concatenate(rows).astype(np.int64)
        owner = np.repeat(np.arange(n), [len(r) for r in rows])
        y = toxic.astype(float)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            w, v = theta[1:d + 1], theta[d + 1:].reshape(d, factors)
            mine = v[flat]
            sums = np.stack([np.bincount(owner, mine[:, f], n) for f in range(factors)], 1)
            z = theta[0] + np.bincount(owner, w[flat] - 0.5 * (mine ** 2).sum(1), n) + 0.5 * (sums ** 2).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
            each = err[owner]
            gv = np.stack([np.bincount(flat, each * (sums[owner, f] - mine[:, f]), d) for f in range(factors)], 1)
            grad = np.concatenate([[err.sum()], np.bincount(flat, each, d) + decay * w / 100,
                                   (gv + decay * v / 10).ravel()])
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad ** 2
            theta = theta - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    return Machine(buckets, float(theta[0]), theta[1:d + 1].copy(), theta[d + 1:].reshape(d, factors).copy())


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text is divisible by 5; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most ``sample_rows`` labelled keys that are not held out, one text of each.

    Null keys and labels, and keys with two different labels, are left out.
    """
    one = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
           .groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
           .where("_y = _z").select("_k", "_y"))
    drawn = one.orderBy(F.xxhash64("_k"), "_k").limit(sample_rows)
    texts = one_text(docs, drawn, key, text)
    bagged = texts.select("_k", "_y", text_udf("array<int>", _text_buckets)(F.col("_t")).alias("_b")).cache()
    try:
        total = bagged.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y").cast("long")).alias("p")).first()
        n, p = int(total["n"]), int(total["p"] or 0)
        # signed root of the chi-square statistic of a bucket against the class
        expect = F.col("df") * F.lit(p / max(n, 1))
        stats = (bagged.select("_y", F.explode("_b").alias("b")).groupBy("b")
                 .agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("_y").cast("long")).alias("tox"))
                 .where("df >= 3").withColumn("chi", (F.col("tox") - expect) / F.sqrt(expect + 0.01)))
        best = stats.orderBy(F.abs("chi").desc(), "b").limit(TOP_TERMS).select("b")
        common = stats.orderBy(F.col("df").desc(), "b").limit(COMMON_TERMS).select("b")
        used = np.array(sorted(r["b"] for r in best.union(common).distinct().collect()), dtype=np.int64)
        wanted = F.array(*[F.lit(int(b)) for b in used]) if len(used) else F.array().cast("array<int>")
        rows = bagged.select("_y", F.array_intersect("_b", wanted).alias("_b"), "_k").orderBy("_k").collect()
    finally:
        bagged.unpersist()
    positions = [np.searchsorted(used, np.array(sorted(r["_b"]), dtype=np.int64)) for r in rows]
    return fit_machine(positions, np.array([r["_y"] == 1 for r in rows], dtype=bool), used)


def score_column(text: Column, machine: Machine) -> Column:
    """Score (0 to 1) of a text; null and empty texts have no terms and get the bias alone."""
    place = {int(b): i for i, b in enumerate(machine.buckets)}
    memo: dict[str, tuple[int, ...]] = {}

    def scores(texts: list[str]) -> pa.Array:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            active: set[int] = set()
            for w in text_words(t):
                known = memo.get(w)
                if known is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    known = memo[w] = tuple(place[b] for b in term_buckets(w) if b in place)
                if known:
                    active.update(known)
            out[i] = machine.score(np.fromiter(sorted(active), np.int64, len(active)))
        return pa.array(out)
    return text_udf("double", scores)(text)


def score_documents(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``held_out`` (boolean), ``score`` (double), ``predicted`` (int; 1
    from 0.5); input columns of these names are replaced.  Equal texts get equal scores."""
    out = docs.drop("held_out", "score", "predicted")
    return (out.withColumn("score", score_column(F.col(text), machine))
            .withColumn("held_out", held_out(F.col(key)))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that are not predicted toxic, with the columns of ``docs`` only."""
    score = fresh_name(docs, "score")
    return (docs.withColumn(score, score_column(F.col("text"), fit(docs, labels)))
            .where(F.col(score) < 0.5).drop(score))
