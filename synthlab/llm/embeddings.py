"""Embedding near-duplicates by a subspace pigeonhole join.

Two vectors of cosine c have unit vectors at squared distance ``2 - 2 c``.  The unit vectors are
rotated and split into blocks of a few dimensions; a rotation keeps distances, and the squared
distance is the sum over the blocks.  So a pair within the whole budget is within some block's share
of it, the share being proportional to the block's dimensions.

1. Rotation: principal axes of a bounded sample, dealt to the blocks in turn so that the blocks
   separate alike.  It decides the speed only.
2. Range join of each block: space is cut into cells along the block's widest axes, as many as give
   cells of about ``CELL`` vectors.  Every vector lies in its own cell and is also sent to the later
   cells that its ball reaches, so a pair meets in one cell of a block.  Crowded cells are cut into
   tiles of bounded size that meet two by two.
3. Pairs that some block lets through are verified once on the whole vectors in double precision.

Equal vectors of one label are one point with a count, whatever their number.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlab.llm.graph import components
from synthlab.session import materialise

COSINE = 0.98
BLOCK_DIMS = 8
#: vectors that an own cell should hold (a border costs more than comparing some thousand vectors in
#: few dimensions), and members of a tile
CELL, TILE = 4096, 8192
#: vectors that the axes are taken from, those of the smallest digests
SAMPLE_ROWS = 4096
#: covers the rounding of block coordinates (float32) and of unit vectors
SLACK = 1e-5
#: rows of one matrix product
STEP = 512


# ---- vectors --------------------------------------------------------------------------------

def _doubles(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Each list as doubles; None for a null list or one with a null."""
    values = column.flatten()
    nulls = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    flat = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)
    at = 0
    for n in column.value_lengths().to_pylist():
        if n is None:
            yield None
            continue
        part = slice(at, at + n)
        at += n
        yield None if nulls is not None and nulls[part].any() else flat[part]


def digest_column(vec: Column) -> Column:
    """MD5 of a vector's doubles; null for vectors that link with nothing: null, empty, zero, or with
    a null or non-finite component."""
    def run(column: pa.Array) -> pa.Array:
        out = []
        for v in _doubles(column):
            good = v is not None and bool(np.isfinite(v).all()) and bool(v.any())
            out.append(md5((v + 0.0).tobytes()).digest() if good else None)       # -0.0 counts as 0.0
        return pa.array(out, pa.binary())
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary").asNondeterministic()(vec)


def unit_rows(column: pa.ListArray) -> np.ndarray:
    """Unit vectors of a batch of one length.  Scaled by the largest component first, so that squares
    neither overflow nor vanish."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


# ---- blocks and cells -----------------------------------------------------------------------

class Blocks:
    """Rotation, blocks, budgets and cells for vectors of one length."""

    def __init__(self, axes: np.ndarray, spread: np.ndarray, most: int, cosine: float):
        """``axes``: columns by falling ``spread`` (standard deviations); ``most``: vectors that are
        compared with each other at most."""
        dims = len(spread)
        count = -(-dims // BLOCK_DIMS)
        turns = [[*range(count), *reversed(range(count))][i % (2 * count)] for i in range(dims)]
        self.parts = [[i for i, t in enumerate(turns) if t == b] for b in range(count)]
        self.axes = axes
        whole = 2 - 2 * cosine
        self.budgets = [whole * len(p) / dims + SLACK for p in self.parts]
        # a cell is two radii wide, so a ball reaches at most one more cell along each axis
        self.widths = [2 * np.sqrt(b) for b in self.budgets]
        self.cut_axes = []
        for part, width in zip(self.parts, self.widths):
            cells, cut = 1.0, []
            for i in part:
                if most / cells <= CELL:
                    break
                cells *= max(1.0, 2 * spread[i] / width)
                cut.append(i)
            self.cut_axes.append(cut)

    def rows(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, rows, home, cells, coordinates): the cells (one row of indices each) that the
        vectors ``rows`` are sent to; ``home`` marks their own."""
        turned = units @ self.axes
        for b, (part, cut, width, budget) in enumerate(zip(self.parts, self.cut_axes, self.widths, self.budgets)):
            own = np.ascontiguousarray(turned[:, part].astype(np.float32))
            along = turned[:, cut] / width
            cell = np.floor(along).astype(np.int64)
            everyone = np.arange(len(units))
            yield b, everyone, np.ones(len(units), bool), cell, own
            # nearest border along each cut axis, and the squared distance to it
            up = along - cell >= 0.5
            reach = (np.where(up, cell + 1 - along, along - cell) * width) ** 2
            step = np.where(up, 1, -1)
            for n in range(1, len(cut) + 1):
                for axes in combinations(range(len(cut)), n):
                    # later cells only: the pair is found where its later home is
                    go = (reach[:, axes].sum(axis=1) <= budget + SLACK) & (step[:, axes[0]] > 0)
                    if go.any():
                        there = cell[go].copy()
                        there[:, axes] += step[go][:, axes]
                        yield b, everyone[go], np.zeros(int(go.sum()), bool), there, own[go]


def cell_names(cells: np.ndarray) -> np.ndarray:
    """A number for each row of cell indices; cells that share one are compared, which costs time only."""
    name = np.zeros(len(cells), np.int64)
    for column in cells.T:
        name = (name ^ column) * 0x5851F42D4C957F2D + 0x14057B7EF767814F
        name ^= name >> 29
    return name


def close_pairs(x: np.ndarray, y: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the rows of x and y within ``budget`` of squared distance, a step of x at a time."""
    size = (y * y).sum(axis=1)
    for i in range(0, len(x), STEP):
        part = x[i:i + STEP]
        far = (part * part).sum(axis=1)[:, None] + size[None, :] - 2 * (part @ y.T)
        a, b = np.nonzero(far <= budget)
        yield a + i, b


# ---- the join -------------------------------------------------------------------------------

def principal_axes(points: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes, spread) of the unit vectors of a bounded sample, about their mean."""
    sample = points.where(F.col("width") == width).orderBy("digest").limit(SAMPLE_ROWS).select("vec").toArrow()
    units = unit_rows(sample.column("vec").combine_chunks())
    centred = units - units.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(units))
    return axes[:, ::-1], np.sqrt(np.maximum(values[::-1], 0))


def candidates(points: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a long, b long), a < b, distinct: at least all pairs of one label and width whose cosine is
    ``cosine`` or more, of ``points`` (uid, label, width, digest, vec)."""
    sizes = points.groupBy("width", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("width").agg(F.max("n").alias("n"))
    plans = {r["width"]: Blocks(*principal_axes(points, r["width"]), r["n"], cosine) for r in sizes.collect()}
    kind = points.schema["label"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                piece = batch.slice(at, STEP)
                widths = piece.column("width").to_numpy()
                for width in np.unique(widths):
                    some = piece.filter(pa.array(widths == width))
                    uid, label = some.column("uid").to_numpy(), some.column("label")
                    for b, rows, home, cells, own in plans[int(width)].rows(unit_rows(some.column("vec"))):
                        coordinates = pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(4 * own.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(own))])
                        yield pa.RecordBatch.from_arrays(
                            [label.take(pa.array(rows)), pa.array(np.full(len(rows), width, np.int32)),
                             pa.array(np.full(len(rows), b, np.int32)), pa.array(cell_names(cells)), pa.array(home),
                             pa.array(uid[rows]), coordinates.cast(pa.binary())],
                            ["label", "width", "block", "cell", "home", "uid", "own"])
    cell = ["label", "width", "block", "cell"]
    sent = materialise(points.select("uid", "label", "width", "vec").mapInArrow(
        spread, f"label {kind}, width int, block int, cell bigint, home boolean, uid bigint, own binary"), "cells")
    # cells without a home vector, or with one vector, hold no pair; crowded ones are cut into tiles
    counts = sent.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("home").cast("int")).alias("h"))
    counts = counts.where("n > 1 and h = 1").select(*cell, F.ceil(F.col("n") / TILE).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("uid"), F.col("k")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    tiled = (sent.join(counts, cell).withColumn("t", mine).withColumn("o", other)
             .withColumn("i", F.least("t", "o")).withColumn("j", F.greatest("t", "o")))
    budgets = {w: p.budgets for w, p in plans.items()}

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        width, block, i, j = (key[k].as_py() for k in (1, 2, 4, 5))
        uid, home = table.column("uid").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        side = table.column("t").to_numpy()
        chunks = [np.frombuffer(c.buffers()[2], np.uint8)[slice(*np.frombuffer(c.buffers()[1], np.int32)[[c.offset, c.offset + len(c)]])]
                  for c in table.column("own").chunks if len(c)]
        own = np.concatenate(chunks).view(np.float32).reshape(len(uid), -1)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        found = []
        for a, b in close_pairs(own[left], own[right], budgets[width][block]):
            a, b = left[a], right[b]
            keep = (home[a] | home[b]) & ((uid[a] < uid[b]) if i == j else True)
            found.append(np.stack([uid[a[keep]], uid[b[keep]]]))
        pairs = np.sort(np.concatenate(found, axis=1), axis=0) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})
    met = tiled.select(*cell, "i", "j", "t", "home", "uid", "own").groupBy(*cell, "i", "j").applyInArrow(
        meet, "a bigint, b bigint")
    return met.distinct()


def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosines of vectors of equal lengths, in double precision."""
    widths, out = a.value_lengths().to_numpy(zero_copy_only=False), np.zeros(len(a))
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        x, y = (unit_rows(side.take(pa.array(at))) for side in (a, b))
        out[at] = np.einsum("ij,ij->i", x, y)
    return pa.array(out)


_cosines.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}


def near_vectors(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label",
                 cosine: float = COSINE) -> DataFrame:
    """(key, n_links long, component_id, kept boolean), one row per row of ``vectors``.

    Rows link where their labels are equal and not null, their vectors have the same length and
    their cosine is at least ``cosine`` (above 0, below 1).  Vectors that are null, empty, zero or
    hold a null or non-finite component link with nothing.  ``n_links`` counts the other rows linked
    directly, equal vectors and repeated rows included.  ``component_id`` is the smallest key that
    links reach, the row's own included (null keys are passed over); rows of that key are kept.
    Other columns are dropped; an empty table gives an empty table.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine is above 0 and below 1")
    digest = F.when(F.col(label).isNotNull(), digest_column(F.col(vec)))
    rows = materialise(vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vec).alias("vec"),
                                      F.size(vec).alias("width"), digest.alias("digest")), "vectors")
    same = rows.where("digest is not null").groupBy("label", "digest")
    points = materialise(same.agg(F.first("width").alias("width"), F.first("vec").alias("vec"), F.min("k").alias("least"),
                                  F.count(F.lit(1)).alias("n")).withColumn("uid", F.monotonically_increasing_id()), "points")
    pairs = candidates(points, cosine)
    side = points.select("uid", "vec", "n")
    both = (pairs.join(side.toDF("a", "va", "na"), "a").join(side.toDF("b", "vb", "nb"), "b")
            .where(F.arrow_udf(_cosines, "double").asNondeterministic()(F.col("va"), F.col("vb")) >= cosine))
    links = materialise(both.select("a", "b", "na", "nb"), "links")
    reached = (links.select(F.col("a").alias("uid"), F.col("nb").alias("n"))
               .union(links.select(F.col("b").alias("uid"), F.col("na").alias("n"))).groupBy("uid").agg(F.sum("n").alias("linked")))
    roots = components(links.select("a", "b")).withColumnRenamed("node", "uid")
    named = points.select("uid", "label", "digest", "least", "n").join(roots, "uid", "left").join(reached, "uid", "left")
    named = materialise(named.withColumn("root", F.coalesce("root", "uid"))
                        .withColumn("links", F.col("n") - 1 + F.coalesce("linked", F.lit(0))), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(named.join(least, "root").select("label", "digest", "n", "links", "component"), "classes")
    alone = rows.where("digest is null").select(F.col("k"), F.lit(0).cast("long").alias("links"), F.col("k").alias("component"))
    linked = rows.where("digest is not null").join(named, ["label", "digest"]).select("k", "links", "component")
    return linked.union(alone).select(
        F.col("k").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("k") == F.col("component"), F.col("component").isNull()).alias("kept"))
