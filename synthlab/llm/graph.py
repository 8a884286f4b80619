"""Connected components of an edge table by alternating large and small stars.

Every round rewrites edges towards smaller neighbours with joins and partial aggregates; no group
is collected, nothing but two numbers a round reaches the driver, and each round is written to the
shared folder, so a lost executor costs one round at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthlab.session import materialise


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node long, root long): root is the smallest node that can be
    reached.  Nodes without an edge to another node, and rows with a null, are left out."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _state(e)
        if new == state:
            break
        state = new
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
