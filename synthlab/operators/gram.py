"""Sums over column pairs by blocks: the Gram matrices of sparse numeric rows.

A row is (``at``: column numbers, ``v``: their values); absent columns are missing.  Tasks turn Arrow batches into
dense blocks of columns and add up matrix products, so a plan holds no expression per pair, whatever the
number of columns.  A task holds the sums of ``STRIP`` block pairs; wider tables send each row once per strip.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64             # columns of a block: one block pair holds 6 x 64 x 64 doubles, 200 KB
STRIP = 160            # block pairs summed by a task at once: 32 MB; 1,088 columns are one strip
CELLS = 1 << 21        # cells made dense at once: 16 MB, and as much for their mask

SUMS = ("n", "si", "sj", "sii", "sjj", "sij")


def pair_sums(rows: DataFrame, width: int) -> DataFrame:
    """(i, j, n, si, sj, sii, sjj, sij) for columns i < j < ``width`` over rows that hold both; pairs that
    no row holds have n = 0.  Empty input returns no pair."""
    edges, step = range(0, width, BLOCK), max(1, CELLS // max(width, 1))
    tiles = [(p, q) for p in edges for q in edges if p <= q]
    strips = [tiles[k:k + STRIP] for k in range(0, len(tiles), STRIP)]
    src = rows.select("at", "v", F.explode(F.array(*[F.lit(k) for k in range(len(strips))])).alias("strip")) \
        if len(strips) > 1 else rows.select("at", "v", F.lit(0).alias("strip"))
    if len(strips) > 1:                  # one strip a task, and many tasks a strip
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        src = src.withColumn("_s", F.pmod(F.xxhash64("at", "v"), F.lit(parts))).repartition(parts * len(strips), "strip", "_s").drop("_s")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int, int], np.ndarray] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                add(acc, whole.slice(lo, step))
            if len(acc) > STRIP:         # rows of several strips met in one task
                yield from flush(acc)
                acc.clear()
        yield from flush(acc)

    def add(acc: dict, batch: pa.RecordBatch) -> None:
        strip = batch.column("strip").to_numpy()
        for k in np.unique(strip):
            part = batch.filter(pa.array(strip == k))
            at, v = part.column("at"), part.column("v")
            row = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
            x, seen = np.zeros((part.num_rows, width)), np.zeros((part.num_rows, width))
            x[row, at.flatten().to_numpy()] = v.flatten().to_numpy()
            seen[row, at.flatten().to_numpy()] = 1.0
            for p, q in strips[k]:
                xi, xj, mi, mj = x[:, p:p + BLOCK], x[:, q:q + BLOCK], seen[:, p:p + BLOCK], seen[:, q:q + BLOCK]
                new = np.stack([mi.T @ mj, xi.T @ mj, mi.T @ xj, (xi * xi).T @ mj, mi.T @ (xj * xj), xi.T @ xj])
                old = acc.get((k, p, q))
                acc[(k, p, q)] = new if old is None else old + new

    def flush(acc: dict) -> Iterator[pa.RecordBatch]:
        for (_k, p, q), s in acc.items():
            i, j = np.meshgrid(np.arange(p, p + s.shape[1]), np.arange(q, q + s.shape[2]), indexing="ij")
            up = i < j
            yield pa.RecordBatch.from_arrays([pa.array(i[up], pa.int32()), pa.array(j[up], pa.int32()),
                                              *[pa.array(t[up]) for t in s]], ["i", "j", *SUMS])
    out = src.mapInArrow(sums, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    return out.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def pearson() -> Column:
    """Correlation of the columns i and j from their sums; NULL without variation."""
    n, si, sj, sii, sjj, sij = (F.col(c) for c in SUMS)
    var = (n * sii - si * si) * (n * sjj - sj * sj)
    return F.when((n * sii - si * si > 1e-9 * n * sii) & (n * sjj - sj * sj > 1e-9 * n * sjj), (n * sij - si * sj) / F.sqrt(var))
