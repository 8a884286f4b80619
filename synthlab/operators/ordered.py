"""Distributed order statistics without a global single-task window.

Rows are range-partitioned on the whole order key (a struct compares field by field, so one frequent
first field still spreads over tasks), the partition number is kept as the bucket, and the result is
written once as Parquet to the shared folder: later reads see fixed buckets, prune columns, and do
not recompute anything upstream.  Spark's range partitioner samples the split points of any
orderable type; no expression grows with the number of buckets.  Per-bucket totals (P rows per
group) become offsets; windows run inside (group, bucket) partitions of about n/P rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthlab.functions.exprs import join_on
from synthlab.session import materialise

BUCKET = "_bk"


def bucketed(df: DataFrame, order: str, ties: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bk``, written and reread: rows with a smaller (order, *ties) never have a larger
    bucket.  NULL order values come first."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order, *ties) if n > 1 else df.coalesce(1)
    return materialise(ranged.withColumn(BUCKET, F.spark_partition_id()), "ordered")


def global_rank(values: DataFrame, col: str, name: str = "code", buckets: int | None = None) -> DataFrame:
    """0-based rank of each row in ascending ``col`` order (``col`` unique; may be a struct)."""
    b = bucketed(values, col, buckets=buckets)
    counts = b.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)   # <= P rows
    offsets = counts.select(BUCKET, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    wr = Window.partitionBy(BUCKET).orderBy(col)
    return (b.join(F.broadcast(offsets), BUCKET)
            .withColumn(name, (F.col("_off") + F.row_number().over(wr) - 1).cast("long"))
            .drop(BUCKET, "_off"))


def running_before(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
                   buckets: int | None = None, agg: str = "sum", maxes: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_before`` = sum (``agg="max"``: max) of ``c`` over rows of the same ``by`` group
    with a smaller ``order`` value (``order`` unique within a group; may be a struct); columns in
    ``maxes`` always get a running max.  NULL is a group like any other."""
    by = list(by)
    kinds = {c: agg for c in sums}
    kinds.update({c: "max" for c in maxes})
    fns = {"sum": F.sum, "max": F.max}
    b = bucketed(df, order, by, buckets)
    tot = b.groupBy(*by, BUCKET).agg(*[fns[kd](c).alias(f"_t_{c}") for c, kd in kinds.items()])
    wo = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(*by, BUCKET, *[fns[kd](f"_t_{c}").over(wo).alias(f"_o_{c}") for c, kd in kinds.items()])
    wl = Window.partitionBy(*by, BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = join_on(b, offsets, [*by, BUCKET])
    vals = []
    for c, kd in kinds.items():
        if kd == "sum":
            vals.append((F.coalesce(F.col(f"_o_{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(wl), F.lit(0))).alias(f"{c}_before"))
        else:
            vals.append(F.greatest(F.col(f"_o_{c}"), F.max(c).over(wl)).alias(f"{c}_before"))
    return out.select(*df.columns, *vals)


def tie_ranks(df: DataFrame, by: Sequence[str], order: str, buckets: int | None = None) -> DataFrame:
    """``df`` with, for each row, ``_before`` = rows of its ``by`` group with a smaller ``order`` value,
    ``_equal`` = rows of the group with the same value (itself included) and ``_dense`` = number of
    smaller distinct values.  NULL is a group and a value like any other; NULL values come first.

    Rows are spread on (by, order, row), so a value on a third of all rows fills many buckets.  The
    counts of a value are kept at its first bucket and come back to the rows by (bucket, by, order):
    the join key holds the bucket, so no task gets all rows of a frequent value."""
    by = list(by)
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(n, *by, order, "_tie") if n > 1 else spread.coalesce(1)
    b = materialise(ranged.drop("_tie").withColumn(BUCKET, F.spark_partition_id()), "tied")
    part = materialise(b.groupBy(BUCKET, *by, order).agg(F.count(F.lit(1)).alias("_c")), "tiecounts")
    g = part.groupBy(*by, order).agg(F.sum("_c").alias("_equal"), F.min(BUCKET).alias("_first"))
    tot = g.groupBy(*by, "_first").agg(F.sum("_equal").alias("_tn"), F.count(F.lit(1)).alias("_td"))
    wo = Window.partitionBy(*by).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)   # <= P rows a group
    tot = tot.select(*by, "_first", F.coalesce(F.sum("_tn").over(wo), F.lit(0)).alias("_on"),
                     F.coalesce(F.sum("_td").over(wo), F.lit(0)).alias("_od"))
    wl = Window.partitionBy(*by, "_first").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    g = join_on(g, tot, [*by, "_first"]).select(
        *by, order, "_equal", (F.col("_on") + F.coalesce(F.sum("_equal").over(wl), F.lit(0))).alias("_before"),
        (F.col("_od") + F.count(F.lit(1)).over(wl)).alias("_dense"))
    ranks = join_on(part.select(BUCKET, *by, order), g, [*by, order])
    return join_on(b, ranks, [BUCKET, *by, order]).select(*df.columns, "_before", "_equal", "_dense")
