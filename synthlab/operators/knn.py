"""Exact k-nearest neighbours without all-pairs.

Reference points are cut into tiles of some thousand points by a k-d tree of medians, which is found
on a bounded sample; a tile keeps its box.  The answer does not depend on the cuts.

1. phase 1: a query is searched in the tile it falls into -> r = its k-th distance there;
2. phase 2: the tiles whose box lies within r of it are searched too.

Tiles meet their queries in blocks as arrays, and a block gives its k best for each query: the pairs
compared are never rows, so what is shuffled is points, queries and k rows for each searched tile.
The boxes shrink in every direction as points get denser, so the tiles that a radius reaches stay few.

The answer is exact (ties by key), with no candidate cap.  A pair with a NULL in either vector has no
distance and comes after all others, by key.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlab.session import materialise

MAX_TILES = 1 << 14             # leaves of the tree; boxes are sent to every task
SAMPLE_ROWS = 1 << 17           # the tree is found on about so many points
BLOCK_ROWS = 2048               # queries that meet a tile in one task
ROUNDING = 1e-9                 # relative, of bounds


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.empty((0, dims))


def _tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of every inner node, in heap order; a point goes right where it is above the cut."""
    axis, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    parts = {0: x}
    for node in range(len(axis)):
        own = parts.pop(node, None)
        if own is None or len(own) < 2:
            continue
        j = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        at, top = np.median(own[:, j]), own[:, j].max()
        if at >= top:                                    # many equal values: all below the largest go left
            below = own[:, j][own[:, j] < top]
            if not len(below):
                continue
            at = below.max()
        axis[node], cut[node] = j, at
        parts[2 * node + 1], parts[2 * node + 2] = own[own[:, j] <= at], own[own[:, j] > at]
    return axis, cut


def _leaf(x: np.ndarray, axis: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > cut[node])
    return node - len(axis)


def _nearest(q: np.ndarray, qk: np.ndarray, r: np.ndarray, rk: np.ndarray, k: int, exclude_self: bool,
             limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, reference place, squared distance) of the k nearest; ``r`` in key order."""
    codes = pd.factorize(np.concatenate([qk, rk]))[0] if exclude_self else None
    out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    step = max(1, (1 << 20) // max(1, len(r)))
    for a in range(0, len(q) if len(r) else 0, step):
        some = q[a:a + step]
        d = np.zeros((len(some), len(r)))
        for j in range(q.shape[1]):                      # left to right, like the sum in SQL
            t = some[:, j, None] - r[None, :, j]
            d += t * t
        if exclude_self:
            d[codes[a:a + len(some), None] == codes[None, len(q):]] = np.inf
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(r) else np.full(len(some), np.finfo(float).max)
        if limit is not None:
            most = np.minimum(most, limit[a:a + step])
        qi, ri = np.nonzero((d <= most[:, None]) & (d < np.inf))
        d2 = d[qi, ri]
        order = np.lexsort((ri, d2, qi))
        qi, ri, d2 = qi[order], ri[order], d2[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        out.append((qi[keep] + a, ri[keep], d2[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _blocks(asked: DataFrame, members: DataFrame, tile: str) -> tuple[DataFrame, DataFrame]:
    """Queries with ``_b``, a block of about ``BLOCK_ROWS`` queries of their tile, and the members once for each block."""
    sizes = asked.groupBy(tile).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_parts")).withColumnRenamed(tile, "_pt")
    sizes = F.broadcast(materialise(sizes, "blocks"))     # a row for each tile
    q = asked.join(sizes, F.col(tile) == F.col("_pt")).withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_parts"))).drop("_pt", "_parts")
    r = members.join(sizes, F.col("_tile") == F.col("_pt")).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_pt", "_parts")
    return q, r


def knn_join(queries: DataFrame, reference: DataFrame, key: str, vec: str, k: int, slab_size: int = 128,
             dims: int | None = None, exclude_self: bool = False) -> DataFrame:
    """Rows (key, nn_key, nn_rank 1..k, dist): the k nearest reference points of every query point.
    With ``exclude_self`` a point never matches the reference row with the same key.  Tiles have about
    8 * ``slab_size`` points, more where that would make over ``MAX_TILES``."""
    if dims is None:
        dims = len(reference.select(vec).first()[0])
    key_type = reference.schema[key].dataType
    whole = F.forall("_v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        v = df.select(F.col(key).cast(key_type).alias("_k"), F.array(*[F.col(vec)[i].cast("double") for i in range(dims)]).alias("_v"))
        return v.filter(whole), v.filter(~whole)
    ref, ref_null = sides(reference)
    asked, asked_null = sides(queries)
    n = ref.count()
    rows = max(8 * slab_size, -(-n // MAX_TILES))
    depth = max(0, (-(-n // rows) - 1).bit_length())
    sample = ref.select("_v").sample(min(1.0, SAMPLE_ROWS / max(n, 1)), 17) if depth else ref.select("_v").limit(0)
    axis, cut = _tree(_matrix(sample.toPandas()["_v"], dims), depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_tile=_leaf(_matrix(b["_v"], dims), axis, cut, depth))
    base = T.StructType([T.StructField("_k", key_type), T.StructField("_v", T.ArrayType(T.DoubleType()))])
    placed = T.StructType([*base.fields, T.StructField("_tile", T.LongType())])
    # a leaf that the sample left too large is cut by a hash of the key into tiles with boxes of their own
    members = materialise(ref.mapInPandas(place, placed), "members")
    leaves = members.groupBy("_tile").agg(F.ceil(F.count(F.lit(1)) / (4 * rows)).alias("_parts")).filter("_parts > 1").withColumnRenamed("_tile", "_l")
    leaves = F.broadcast(materialise(leaves, "leaves"))

    def cut_up(df: DataFrame) -> DataFrame:
        part = F.coalesce(F.pmod(F.xxhash64("_k"), F.col("_parts")), F.lit(0))
        return df.join(leaves, F.col("_tile") == F.col("_l"), "left").withColumn(
            "_tile", F.col("_tile") + part * F.lit(1 << depth).cast("long")).drop("_l", "_parts")
    members = cut_up(members).select("_tile", F.col("_k").alias("nn_key"), F.col("_v").alias("_nv"))
    boxes = members.groupBy("_tile").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("_nv")[i]) for i in range(dims)]).alias("lo"),
                                         F.array(*[F.max(F.col("_nv")[i]) for i in range(dims)]).alias("hi")).toPandas()   # a row for each tile
    numbers = boxes["_tile"].to_numpy(np.int64)
    lo, hi, filled = _matrix(boxes["lo"], dims), _matrix(boxes["hi"], dims), boxes["n"].to_numpy() > k

    def reached(q: np.ndarray, rad2: np.ndarray, own: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Tiles other than ``own`` within the radius of each query; radii without k neighbours are bounded by the boxes first."""
        rad2 = rad2.copy()
        for i in np.flatnonzero(np.isinf(rad2)):
            if filled.any():
                far = np.maximum(np.abs(q[i] - lo[filled]), np.abs(hi[filled] - q[i]))
                rad2[i] = (far ** 2).sum(axis=1).min() * (1 + ROUNDING)
        wide = rad2 * (1 + ROUNDING)
        gap = np.maximum(np.maximum(lo - q.max(axis=0), q.min(axis=0) - hi), 0.0)
        near = np.flatnonzero(((gap ** 2).sum(axis=1) <= wide.max()) & (numbers != own))
        found = []
        for a in range(0, len(q), 256):
            d = np.zeros((len(q[a:a + 256]), len(near)))
            for j in range(dims):
                g = np.maximum(np.maximum(lo[None, near, j] - q[a:a + 256, j, None], q[a:a + 256, j, None] - hi[None, near, j]), 0.0)
                d += g * g
            found += [numbers[near[row]] for row in d <= wide[a:a + 256, None]]
        return found, rad2

    def first(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in first_schema.names})
        r = r.sort_values("nn_key", kind="stable")
        x, names = _matrix(q["_v"], dims), r["nn_key"].to_numpy()
        qi, ri, d2 = _nearest(x, q["_k"].to_numpy(), _matrix(r["_nv"], dims), names, k, exclude_self)
        ends = np.searchsorted(qi, np.arange(len(q) + 1))
        rad2 = np.array([d2[b - 1] if b - a == k else np.inf for a, b in zip(ends, ends[1:])])
        tiles, rad2 = reached(x, rad2, int(q["_tile"].iloc[0]))
        cuts = list(zip(ends, ends[1:]))
        return pd.DataFrame({"_id": q["_id"].to_numpy(), "_k": q["_k"].to_numpy(), "_v": list(x), "_rad2": rad2,
                             "_nn": [names[ri[a:b]] for a, b in cuts], "_d": [d2[a:b] for a, b in cuts], "_tiles": tiles})
    long, double = T.LongType(), T.DoubleType()
    first_schema = T.StructType([T.StructField("_id", long), *base.fields, T.StructField("_rad2", double), T.StructField("_nn", T.ArrayType(key_type)),
                                 T.StructField("_d", T.ArrayType(double)), T.StructField("_tiles", T.ArrayType(long))])
    q = materialise(cut_up(asked.filter("_k is not null").mapInPandas(place, placed)).withColumn("_id", F.monotonically_increasing_id()), "asked")
    qb, rb = _blocks(q, members, "_tile")
    empty = q.join(F.broadcast(members.select(F.col("_tile").alias("_mt")).distinct()), F.col("_tile") == F.col("_mt"), "left_anti")
    # a tile without members has no block: its queries meet none there
    qb = qb.unionByName(empty.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(1 << 10)) + F.lit(1 << 40))) if len(boxes) else qb
    done = materialise(qb.groupBy("_tile", "_b").cogroup(rb.groupBy("_tile", "_b")).applyInPandas(first, first_schema), "first")
    hits = done.select("_k", F.explode(F.arrays_zip(F.col("_nn").alias("n"), F.col("_d").alias("d"))).alias("_z")).select(
        "_k", F.col("_z.n").alias("nn_key"), F.col("_z.d").alias("_d2"))

    def further(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("nn_key", kind="stable")
        qk, rk = q["_k"].to_numpy(), r["nn_key"].to_numpy()
        qi, ri, d2 = _nearest(_matrix(q["_v"], dims), qk, _matrix(r["_nv"], dims), rk, k, exclude_self, q["_rad2"].to_numpy())
        return pd.DataFrame({"_k": qk[qi], "nn_key": rk[ri], "_d2": d2})
    more = done.select("_id", "_k", "_v", "_rad2", F.explode("_tiles").alias("_t"))
    qb, rb = _blocks(more, members, "_t")
    hit_schema = T.StructType([base["_k"], T.StructField("nn_key", key_type), T.StructField("_d2", double)])
    hits = hits.unionByName(qb.groupBy("_t", "_b").cogroup(rb.groupBy("_tile", "_b")).applyInPandas(further, hit_schema))

    # pairs without a distance come last, by key: at most k + 1 keys are needed
    def smallest(df: DataFrame) -> DataFrame:
        return F.broadcast(df.select(F.col("_k").alias("nn_key")).orderBy("nn_key").limit(k + 1))
    none = F.lit(None).cast("double").alias("_d2")
    hits = hits.unionByName(asked_null.filter("_k is not null").crossJoin(smallest(ref.unionByName(ref_null))).select("_k", "nn_key", none))
    if n <= k:
        hits = hits.unionByName(asked.filter("_k is not null").crossJoin(smallest(ref_null)).select("_k", "nn_key", none))
    if exclude_self:
        hits = hits.filter(F.col("nn_key") != F.col("_k"))
    w = Window.partitionBy("_k").orderBy(F.col("_d2").asc_nulls_last(), "nn_key")      # at most k rows for each searched tile
    t = hits.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k)
    return t.select(F.col("_k").alias(key), "nn_key", F.col("nn_rank").cast("long"), F.sqrt("_d2").alias("dist"))


def knn(points: DataFrame, key: str, vec: str, k: int, slab_size: int = 128, dims: int | None = None) -> DataFrame:
    """Self-join version: the k nearest *other* points of every point."""
    return knn_join(points, points, key, vec, k, slab_size, dims, exclude_self=True)
