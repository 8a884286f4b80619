"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair gets a uniform number from MD5 of the two, and the row goes to the shard
with the largest ``-weight / ln(u)``.  The choice uses nothing but key, shard numbers and weights:
adding a shard moves only the rows that the new shard wins, about ``w_new / sum(w)`` of them, and
every moved row moves into it.

Slots number the rows of a shard without gaps.  A window over one shard would be one task per
shard, so a shard is cut into ranges of the key's digest.  Rows equal in key and tie columns are
counted first, which also takes the heat out of a key that holds a third of all rows; ranges are
numbered inside, and the small table of (shard, range) counts is summed up for the offsets.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlab.llm.common import fresh_name
from synthlab.session import materialise, scratch_path

#: hex digits of the digest that cut a shard into ranges: 4096 ranges of each shard
RANGE_DIGITS = 3


def _uniform(key: Column, shard: int) -> Column:
    """52 bits of MD5 as a number in (0, 1)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def rendezvous(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """Shard number (int) of ``key`` among ``shards`` shards, or weighted ones.

    A null key hashes like the empty string.  Scores tie only if two digests agree in 52 bits; the
    larger shard number then wins.  A shard of weight 0 gets no rows.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    if len(weights) != shards or shards < 1 or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("one weight of 0 or more for each shard, not all 0")
    scores = [F.struct((-F.lit(float(w)) / F.log(_uniform(key, s))).alias("score"), F.lit(s).alias("shard"))
              for s, w in enumerate(weights) if w > 0]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return best.getField("shard").cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, ties: Sequence[str] = (),
                  weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """(key, ties..., shard int, slot long, grown_shard int), one row per row of ``df``.

    ``ties`` order rows of one key; rows equal in key and ties are interchangeable and get
    consecutive slots.  Slots follow the key's digest, then key and ties, from 0 without gaps in
    every shard.  ``grown_shard`` is the shard with one shard more, of ``grown_weight``.  A null
    key is a key like any other.  Other columns are dropped, so their names cannot clash.  An empty
    table gives an empty table.
    """
    cols = [key, *ties]
    n, base = fresh_name(df, "n"), fresh_name(df, "digest")
    grown = [*(weights or [1.0] * shards), grown_weight]
    rows = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
            .withColumn(base, F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
            .withColumn("shard", rendezvous(F.col(key), shards, weights))
            .withColumn("grown_shard", rendezvous(F.col(key), shards + 1, grown))
            .withColumn("_range", F.substring(base, 1, RANGE_DIGITS)))
    rows = materialise(rows, "shards")        # narrow; read for the offsets and for the numbering
    sums = rows.groupBy("shard", "_range").agg(F.sum(n).alias("_in"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_offset"))
    inside = (Window.partitionBy("shard", "_range").orderBy(base, *cols)
              .rowsBetween(Window.unboundedPreceding, -1))
    # at most shards * 16 ** RANGE_DIGITS offsets
    first = (rows.withColumn("_first", F.coalesce(F.sum(n).over(inside), F.lit(0)))
             .join(F.broadcast(offsets), ["shard", "_range"])
             .withColumn("_first", F.col("_first") + F.col("_offset")))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    return (first.withColumn("_copy", copy)
            .select(*cols, "shard", (F.col("_first") + F.col("_copy")).alias("slot"), "grown_shard"))


def write_shards(df: DataFrame, key: str, shards: int, path: str | None = None,
                 weights: Sequence[float] | None = None, files_per_shard: int = 1) -> str:
    """Write whole rows as Parquet folders ``shard=0 .. shards-1`` and return the path.

    Each shard is spread over ``files_per_shard`` files by a second hash of the whole row, so that
    a hot shard, or a hot key, is not one task.
    """
    path = path or scratch_path(df.sparkSession, "sharded")
    part = fresh_name(df, "part")
    if "shard" in {c.lower() for c in df.columns}:
        raise ValueError("the table has a column named shard, which names the folders")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(files_per_shard))
    out = df.withColumn("shard", rendezvous(F.col(key), shards, weights)).withColumn(part, spread)
    (out.repartition(shards * files_per_shard, "shard", part).drop(part)
     .write.partitionBy("shard").parquet(path))
    return path
