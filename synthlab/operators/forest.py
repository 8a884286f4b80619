"""Bins of features for tree fits, and a random forest grown a tree a task (M1 M4).

A tree fit sees a feature only through its bins.  ``cut_points`` finds them from all rows by MLlib's
rule: every middle between two values where there are few, else cuts at equal shares of the weight.
``packed`` makes the bins of a row a key of one byte a feature; rows with equal bins and label then
add up to one row with a count, and a fit works on those.

``forest_scores`` grows a forest of such rows.  A sum of Poisson draws is a Poisson draw of the summed
count, so the bootstrap of counted rows is that of the rows.  Every task gets the counted rows, of
bounded size, grows its trees level by level from histograms and adds up their votes for the rows
to score, so no tree is kept or sent.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlab.session import materialise

MAX_BINS = 32
VALUES = 1 << 16                # distinct values of a feature that the driver looks at; of more, EDGES intervals
EDGES = 1 << 12
FOREST_BYTES = 1 << 26          # of counted rows that are sent to every task
TREES_PER_TASK = 5
NODES = 1 << 14                 # nodes whose histograms are held at once


def value_counts(train: DataFrame, features: Sequence[str], weight: str | None) -> DataFrame:
    """(i, lo, hi, n, w): the values of feature i with their rows and weight, or, of features with more than ``VALUES``
    values, those of ``EDGES`` intervals at about equal numbers of rows.  No value is left out."""
    vals = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = train.select(F.posexplode(F.array(*vals)).alias("i", "v"), w.alias("w"))
    counts = materialise(pairs.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")), "values")
    many = [r["i"] for r in counts.groupBy("i").count().filter(F.col("count") > VALUES).collect()]     # a row for each feature
    few = counts.filter(~F.col("i").isin(many)).select("i", F.col("v").alias("lo"), F.col("v").alias("hi"), "n", "w")
    if not many:
        return few
    shares = [j / EDGES for j in range(1, EDGES)]
    edges = train.agg(*[F.percentile_approx(vals[i], shares, 4 * EDGES).alias(str(i)) for i in many]).first()
    edges = {i: np.asarray(edges[str(i)]) for i in many}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.zeros(len(b), np.int64)
            for i, e in edges.items():
                own = (b["i"] == i).to_numpy()
                at[own] = np.searchsorted(e, b["v"].to_numpy()[own])
            yield b.assign(at=at)
    placed = counts.filter(F.col("i").isin(many)).mapInPandas(place, "i int, v double, n long, w double, at long")
    return few.unionByName(placed.groupBy("i", "at").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"),
                                                         F.sum("w").alias("w")).drop("at"))


def walk(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, splits: int) -> list[float]:
    """MLlib's thresholds of one feature from its values in order: a value goes left where it is at most the threshold."""
    middle = (hi[:-1] + lo[1:]) / 2.0
    if len(middle) > splits:
        stride, done, out = w.sum() / (splits + 1), w[0], []
        target = stride
        for j in range(1, len(w)):
            before, done = done, done + w[j]
            if abs(before - target) < abs(done - target):
                out.append(middle[j - 1])
                target += stride
        middle = np.asarray(out)
    return [float(t) for t in middle if not math.isnan(t)]


def cut_points(train: DataFrame, features: Sequence[str], weight: str | None = None) -> list[list[float]]:
    """At most ``MAX_BINS - 1`` thresholds of every feature, from all rows of ``train``."""
    got = value_counts(train, features, weight).toPandas().sort_values(["i", "lo"], na_position="last", kind="stable")
    out = []
    for i in range(len(features)):
        own = got[got["i"] == i]
        splits = min(MAX_BINS, int(own["n"].sum())) - 1
        out.append(walk(own["lo"].to_numpy(), own["hi"].to_numpy(), own["w"].to_numpy(), splits) if len(own) else [])
    return out


def bin_of(value: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """The number of ``cuts`` below ``value``; NULL and NaN are above all."""
    if not cuts:
        return F.lit(first)
    at = len(cuts) // 2
    return F.when(value <= F.lit(cuts[at]), bin_of(value, cuts[:at], first)).otherwise(bin_of(value, cuts[at + 1:], first + at + 1))


def bins(features: Sequence[str], cuts: Sequence[Sequence[float]]) -> list[Column]:
    return [bin_of(F.col(c).cast("double"), t) for c, t in zip(features, cuts)]


def packed(features: Sequence[str], cuts: Sequence[Sequence[float]]) -> Column:
    """The bins as bytes, a byte for each feature."""
    return F.unhex(F.concat(*[F.lpad(F.hex(b), 2, "0") for b in bins(features, cuts)]))


# ---- the forest ---------------------------------------------------------------------------------------------------------

def _best(x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, k: int, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: leaf) and bin of the best Gini split of nodes 0..k-1 over the features each tries."""
    gain, feature, cut = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
    for j in range(tried.shape[1]):
        f = tried[:, j]
        code = node * MAX_BINS + x[np.arange(len(x)), f[node]]
        both = np.bincount(code, w, k * MAX_BINS).reshape(k, MAX_BINS).cumsum(axis=1)
        pos = np.bincount(code, w * y, k * MAX_BINS).reshape(k, MAX_BINS).cumsum(axis=1)
        n, p = both[:, -1:], pos[:, -1:]
        l, lp = both[:, :-1], pos[:, :-1]
        r, rp = n - l, p - lp
        with np.errstate(divide="ignore", invalid="ignore"):
            g = (lp ** 2 + (l - lp) ** 2) / l + (rp ** 2 + (r - rp) ** 2) / r - (p ** 2 + (n - p) ** 2) / n
        tiny = 1e-12 * n
        g[~((l > tiny) & (r > tiny) & (g > tiny))] = 0.0
        at = g.argmax(axis=1)
        top = g[np.arange(k), at]
        better = top > gain
        gain[better], feature[better], cut[better] = top[better], f[better], at[better]
    return feature, cut


def tree_votes(x: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, depth: int, n_tried: int,
               rng: np.random.Generator) -> np.ndarray:
    """Grows one tree of the rows ``x`` (bins), ``y`` (0 or 1) with weights ``w`` and returns the share of class 1 in the
    leaf of each of the rows ``asked``."""
    votes = np.zeros(len(asked))
    keep = np.flatnonzero(w > 0)
    x, y, w = x[keep], y[keep], w[keep]
    node, here, at = np.zeros(len(x), np.int64), np.arange(len(asked)), np.zeros(len(asked), np.int64)
    k = 1 if len(x) else 0
    for level in range(depth + 1):
        if not k:
            break
        share = np.bincount(node, w * y, k) / np.bincount(node, w, k)
        feature, cut = np.full(k, -1), np.zeros(k, np.int64)
        if level < depth:
            tried = rng.random((k, x.shape[1])).argsort(axis=1)[:, :n_tried]
            for a in range(0, k, NODES):                # rows are in the order of their nodes
                s = slice(*np.searchsorted(node, [a, a + NODES]))
                own = tried[a:a + NODES]
                feature[a:a + NODES], cut[a:a + NODES] = _best(x[s], y[s], w[s], node[s] - a, len(own), own)
        leaf = feature < 0
        child = 2 * (np.cumsum(~leaf) - 1)
        ended = leaf[at]
        votes[here[ended]] = share[at[ended]]
        here, at = here[~ended], at[~ended]
        at = child[at] + (asked[here, feature[at]] > cut[at])
        stays = ~leaf[node]
        x, y, w, node = x[stays], y[stays], w[stays], node[stays]
        node = child[node] + (x[np.arange(len(x)), feature[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        x, y, w, node = x[order], y[order], w[order], node[order]
        k = 2 * int((~leaf).sum())
    return votes


def forest_scores(train: DataFrame, asked: DataFrame, width: int, label: str, seed: int, trees: int, depth: int) -> DataFrame | None:
    """(_x, score) of every distinct ``_x`` of ``asked``: the mean share of class 1 over the trees.  ``train`` has ``_x``,
    ``label`` (0 or 1) and a weight ``_w`` (NULL: 1).  None where the counted rows are more than every task can get."""
    rows = materialise(train.groupBy("_x", label, "_w").agg(F.count(F.lit(1)).alias("_n")), "counted")
    want = materialise(asked.select("_x").distinct(), "asked")
    if rows.count() * (width + 20) > FOREST_BYTES or want.count() * (width + 8) > FOREST_BYTES:
        return None
    got = rows.orderBy("_x", label, "_w").toPandas()
    spark = train.sparkSession

    def matrix(keys) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(v) for v in keys), np.uint8).reshape(-1, width)
    y, n, w = got[label].to_numpy(np.float64), got["_n"].to_numpy(np.int64), got["_w"].fillna(1.0).to_numpy(np.float64)
    sent = spark.sparkContext.broadcast((matrix(got["_x"]), y, n, w, matrix(want.toPandas()["_x"])))
    tried = math.ceil(math.sqrt(width))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, n, w, asked = sent.value
        votes = np.zeros(len(asked))
        for b in batches:
            for t in b["id"]:
                rng = np.random.default_rng([seed % (1 << 63), int(t)])
                votes += tree_votes(x, y, rng.poisson(n) * w, asked, depth, tried, rng)
        for a in range(0, len(asked), 1 << 16):
            yield pd.DataFrame({"_x": [v.tobytes() for v in asked[a:a + (1 << 16)]], "_votes": votes[a:a + (1 << 16)]})
    grown = spark.range(0, trees, 1, -(-trees // TREES_PER_TASK)).mapInPandas(grow, "_x binary, _votes double")
    return materialise(grown.groupBy("_x").agg((F.sum("_votes") / F.lit(float(trees))).alias("score")), "votes")
