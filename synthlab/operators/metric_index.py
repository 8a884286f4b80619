"""Exact k nearest neighbours of wide vectors by a pivot index (J10 on many columns).

One projection says little about a vector of 64 columns.  Here every vector is described by its
distances to a bounded set of pivots, and the triangle inequality rules out whole tiles of vectors:

1. pivots: a farthest-first pass in every task, repeated over the union of what the tasks chose;
2. reference vectors are ordered by (nearest pivot, distance to it) and cut into tiles of at most
   ``tile_rows``; a tile keeps the smallest and largest distance of its vectors to every pivot;
3. radius: the k-th distance of a query among the vectors beside it in that order;
4. a tile is searched for a query only if no pivot shows it to be farther away than the radius;
5. the searched tiles meet the queries that need them in blocks of about ``block_rows`` x ``tile_rows``
   and give their k best; distances of these are summed again from the differences, without cancellation.

The answer does not depend on the pivots, which only decide how much is ruled out: vectors that lie
near a surface of few dimensions are pruned well, vectors spread evenly over a sphere of many
dimensions hardly at all, as no bound separates them.  ``compared`` tells the share for the data at
hand.  No step holds more than a tile, a block or a page of tile bounds in one task.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlab.operators.ordered import global_rank
from synthlab.session import materialise

PAGE_TILES = 1024               # tile bounds that meet a block of queries in one task
SLACK = 1e-9                    # relative; covers the rounding of bounds and of blocked products
PRODUCT = 1e-6                  # relative; covers the cancellation in distances to pivots up to some thousand columns
NO_CELL_ROWS = 1 << 40          # tile number = cell * this + place


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.empty((0, dims))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots by one matrix product, to within ``PRODUCT`` * (norm + norm of the pivot)."""
    d2 = (x ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _farthest_first(x: np.ndarray, m: int) -> np.ndarray:
    """At most ``m`` different vectors of ``x``, each the farthest from those before it."""
    if not len(x):
        return x
    xx = (x ** 2).sum(axis=1)

    def gap_to(c: int) -> np.ndarray:
        d2 = xx + xx[c] - 2.0 * (x @ x[c])
        return np.where(d2 > 1e-12 * (xx + xx[c]), d2, 0.0)          # less is rounding: equal vectors
    chosen = [int(np.argmax(xx))]
    gap = gap_to(chosen[0])
    while len(chosen) < m and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, gap_to(chosen[-1]))
    return x[chosen]


def _finite(b: pd.DataFrame, dims: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows whose vector has no NULL and no component that is not finite, and their vectors."""
    x = _matrix(b["_v"], dims)
    good = np.isfinite(x).all(axis=1)
    return (b, x) if good.all() else (b[good], x[good])


def choose_pivots(points: DataFrame, vec: str, dims: int, m: int) -> np.ndarray:
    """``m`` spread-out vectors; the driver receives only the last ``m``."""
    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core = np.empty((0, dims))
        for b in batches:
            core = _farthest_first(np.vstack([core, _finite(b, dims)[1]]), m)
        yield pd.DataFrame({"_v": pd.Series(list(core), dtype=object)})
    schema = "_v array<double>"
    cores = points.select(F.col(vec).alias("_v")).mapInPandas(thin, schema)
    for tasks in (16, 1):                                # what P tasks chose, then what 16 tasks chose
        cores = cores.repartition(tasks).mapInPandas(thin, schema)
    return _matrix(cores.toPandas()["_v"], dims)


def _best(q: np.ndarray, qk: np.ndarray, r: np.ndarray, rk: np.ndarray, k: int, exclude_self: bool,
          radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, reference place, squared distance) of the k nearest, ties by reference place."""
    none = np.empty(0, np.int64)
    if not len(q) or not len(r):
        return none, none, np.empty(0)
    qq, rr = (q ** 2).sum(axis=1), (r ** 2).sum(axis=1)
    d = qq[:, None] + rr[None, :] - 2.0 * (q @ r.T)
    if exclude_self:
        d[qk[:, None] == rk[None, :]] = np.inf
    slack = SLACK * (qq + rr.max())
    limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(r) else np.full(len(q), np.inf)
    limit = limit + slack
    if radius is not None:
        limit = np.minimum(limit, radius ** 2 + slack)
    qi, ri = np.nonzero((d <= limit[:, None]) & (d < np.inf))
    d2 = np.empty(len(qi))
    for a in range(0, len(qi), 65536):                   # ties may be many: differences in pieces
        d2[a:a + 65536] = ((q[qi[a:a + 65536]] - r[ri[a:a + 65536]]) ** 2).sum(axis=1)
    order = np.lexsort((ri, d2, qi))
    qi, ri, d2 = qi[order], ri[order], d2[order]
    first = np.searchsorted(qi, qi)                      # place of the query's first candidate
    keep = np.arange(len(qi)) - first < k
    return qi[keep], ri[keep], d2[keep]


@dataclass
class Search:
    """``neighbours``: (key, nn_key, nn_rank from 1, dist); ``compared``: one row (queries, reference,
    pairs, all_pairs), the pairs whose distance was taken against all there are."""
    neighbours: DataFrame
    compared: DataFrame


def search(queries: DataFrame, reference: DataFrame, key: str, vec: str, k: int, dims: int, pivots: int = 64,
           tile_rows: int = 4096, block_rows: int = 1024, exclude_self: bool = False) -> Search:
    """The ``k`` nearest reference rows of every query row, exact, ties by ``key``.

    Rows with a NULL key, or a vector that is NULL, of another length than ``dims`` or with a component
    that is NULL or not finite neither search nor are found.  Repeated reference keys are rows of their
    own; a repeated query row answers once each time.  Fewer than ``k`` reference rows: all of them; no
    rows: no rows.  ``exclude_self``: a row never finds a reference row of its own key."""
    if k < 1:
        raise ValueError("k must be positive")
    key_type = reference.schema[key].dataType

    def valid(df: DataFrame, side: int) -> DataFrame:
        v = df.select(F.col(key).cast(key_type).alias("_k"), F.col(vec).cast("array<double>").alias("_v"))
        return v.filter(F.col("_k").isNotNull() & (F.size("_v") == dims)).withColumn("_q", F.lit(side))

    ref = valid(reference, 0)
    pv = choose_pivots(ref, "_v", dims, pivots)
    if not len(pv):
        pv = np.zeros((1, dims))

    # ---- order by (nearest pivot, distance); queries take their place in the same order
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b, x = _finite(b, dims)
            d = _distances(x, pv)
            cell = d.argmin(axis=1) if len(d) else np.empty(0, np.int64)
            yield b.assign(_cell=cell.astype(np.int64), _dp=d[np.arange(len(d)), cell])
    base = T.StructType([T.StructField("_k", key_type), T.StructField("_v", T.ArrayType(T.DoubleType())), T.StructField("_q", T.IntegerType())])
    both = ref.unionByName(valid(queries, 1)).mapInPandas(
        place, T.StructType([*base.fields, T.StructField("_cell", T.LongType()), T.StructField("_dp", T.DoubleType())]))
    both = both.withColumn("_o", F.struct("_cell", "_dp", "_k", "_q", F.monotonically_increasing_id().alias("_id")))
    ranked = global_rank(both, "_o", name="_r").drop("_o", "_dp")
    rows = materialise(ranked.withColumn("_near", F.floor(F.col("_r") / tile_rows))
                       .withColumn("_tile", F.col("_cell") * NO_CELL_ROWS + F.col("_near")), "placed")
    members = rows.filter("_q = 0").select("_tile", "_near", F.col("_k").alias("nn_key"), F.col("_v").alias("_nv"))
    asked = rows.filter("_q = 1").select("_r", "_k", "_v", "_near")

    # ---- radius: the k-th distance among the rows beside the query
    def nearest(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        qi, _ri, d2 = _best(_matrix(q["_v"], dims), q["_k"].to_numpy(), _matrix(r["_nv"], dims), r["nn_key"].to_numpy(), k, exclude_self)
        radius = np.full(len(q), np.inf)
        n = np.bincount(qi, minlength=len(q))
        last = np.cumsum(n) - 1
        radius[n == k] = np.sqrt(d2[last[n == k]])
        return q[["_r", "_k", "_v"]].assign(_rad=radius)
    asked_schema = T.StructType([T.StructField("_r", T.LongType()), base["_k"], base["_v"], T.StructField("_rad", T.DoubleType())])
    with_radius = asked.groupBy("_near").cogroup(members.groupBy("_near")).applyInPandas(nearest, asked_schema)
    blocks = materialise(global_rank(with_radius, "_r", name="_i").withColumn("_block", F.floor(F.col("_i") / block_rows)).drop("_i"), "blocks")

    # ---- bounds of every tile, met with the blocks page by page
    def bounds(t: pd.DataFrame) -> pd.DataFrame:
        d = _distances(_matrix(t["_nv"], dims), pv)
        return pd.DataFrame({"_tile": [t["_tile"].iloc[0]], "_n": [len(t)], "_lo": [d.min(axis=0)], "_hi": [d.max(axis=0)]})
    tiles = materialise(members.select("_tile", "_nv").groupBy("_tile").applyInPandas(
        bounds, "_tile long, _n long, _lo array<double>, _hi array<double>"), "tiles")
    pages = max(1, -(-tiles.count() // PAGE_TILES))
    n_blocks = blocks.agg(F.coalesce(F.max("_block"), F.lit(-1)) + 1).first()[0]
    paged = tiles.withColumn("_page", F.pmod(F.xxhash64("_tile"), F.lit(pages)).cast("long"))
    paged = paged.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))) if n_blocks else paged.withColumn("_block", F.lit(0)).limit(0)
    # both sides long: equal numbers of other types are sent to other tasks, where groups do not meet
    turned = blocks.withColumn("_page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))

    def within(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in need_schema.names})
        d = _distances(_matrix(q["_v"], dims), pv)
        lo, hi = np.stack(t["_lo"].to_numpy()), np.stack(t["_hi"].to_numpy())
        gap = np.zeros((len(q), len(t)))
        for p in range(len(pv)):                        # the widest gap that any pivot shows
            np.maximum(gap, lo[None, :, p] - d[:, p, None], out=gap)
            np.maximum(gap, d[:, p, None] - hi[None, :, p], out=gap)
        norms = 4 * np.sqrt((pv ** 2).sum(axis=1).max()) + d.max(axis=1) + hi.max()    # at least both norms and twice a pivot's
        reach = q["_rad"].to_numpy() + SLACK + PRODUCT * norms
        qi, ti = np.nonzero(gap <= reach[:, None])
        out = q.iloc[qi][["_r", "_k", "_v", "_rad", "_block"]].reset_index(drop=True)
        return out.assign(_tile=t["_tile"].to_numpy()[ti], _n=t["_n"].to_numpy()[ti])
    need_schema = T.StructType([*asked_schema.fields, T.StructField("_block", T.LongType()),
                                T.StructField("_tile", T.LongType()), T.StructField("_n", T.LongType())])
    need = materialise(turned.groupBy("_block", "_page").cogroup(
        paged.withColumn("_block", F.col("_block").cast("long")).groupBy("_block", "_page")).applyInPandas(within, need_schema), "need")

    # ---- search
    # a tile is sent once for every block_rows queries that need it: what is sent grows with the members and ``need``,
    # where a tile for each block of neighbouring queries would be sent for a few queries at a time
    parts = F.broadcast(materialise(need.groupBy(F.col("_tile").alias("_wt")).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).alias("_parts")), "parts"))          # a row for each tile
    asking = need.join(parts, F.col("_tile") == F.col("_wt")).withColumn("_wb", F.pmod(F.xxhash64("_r"), F.col("_parts"))).drop("_wt", "_parts")
    sent = members.select("_tile", "nn_key", "_nv").join(parts, F.col("_tile") == F.col("_wt")).withColumn(
        "_wb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_tile", "_parts")

    def found(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("nn_key", kind="stable")      # ties by key
        qi, ri, d2 = _best(_matrix(q["_v"], dims), q["_k"].to_numpy(), _matrix(r["_nv"], dims), r["nn_key"].to_numpy(), k,
                           exclude_self, q["_rad"].to_numpy() if len(q) else None)
        return pd.DataFrame({"_r": q["_r"].to_numpy()[qi], "_k": q["_k"].to_numpy()[qi], "nn_key": r["nn_key"].to_numpy()[ri], "_d2": d2})
    hit_schema = T.StructType([asked_schema["_r"], base["_k"], T.StructField("nn_key", key_type), T.StructField("_d2", T.DoubleType())])
    hits = asking.groupBy("_wb", "_tile").cogroup(sent.groupBy("_wb", "_wt")).applyInPandas(found, hit_schema)
    w = Window.partitionBy("_r").orderBy("_d2", "nn_key")        # at most k rows for each searched tile
    top = hits.withColumn("nn_rank", F.row_number().over(w).cast("long")).filter(F.col("nn_rank") <= k)
    neighbours = top.select(F.col("_k").alias(key), "nn_key", "nn_rank", F.sqrt("_d2").alias("dist"))
    sizes = blocks.agg(F.count(F.lit(1)).alias("queries")).crossJoin(members.agg(F.count(F.lit(1)).alias("reference")))   # one row each
    compared = need.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("pairs")).crossJoin(sizes).select(
        "queries", "reference", "pairs", (F.col("queries") * F.col("reference")).alias("all_pairs"))
    return Search(neighbours, compared)
