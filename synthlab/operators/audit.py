"""Run bookkeeping: retries, resume, drift between runs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthlab.functions.exprs import join_on


def dedup_latest_valid(log: DataFrame, cell: Sequence[str], attempt: str = "attempt",
                       metric: str = "auc") -> DataFrame:
    """One row per cell: the latest attempt with a valid metric, else the latest attempt.

    Uses ``max(struct(valid, attempt, ...))`` per cell, a partial aggregate (no per-cell window)."""
    valid = F.col(metric).isNotNull() & F.col("error").isNull()
    other = [c for c in log.columns if c not in cell]
    best = log.groupBy(*cell).agg(F.max(F.struct(valid.alias("_valid"), F.col(attempt).alias("_att"),
                                                 *[F.col(c) for c in other])).alias("_b"))
    return best.select(*cell, *[F.col("_b." + c).alias(c) for c in other])


def run_audit(log: DataFrame, by: Sequence[str], cell: Sequence[str], metric: str = "auc") -> DataFrame:
    """Rows, NULL metrics, cells with more than one row, error rows per group."""
    per_cell = log.groupBy(*by, *[c for c in cell if c not in by]).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(metric).isNull()).alias("_nulls"),
        F.count_if(F.col("error").isNotNull()).alias("_errs"))
    return per_cell.groupBy(*by).agg(
        F.sum("_rows").cast("long").alias("n_rows"), F.sum("_nulls").cast("long").alias("n_null_metric"),
        F.count_if(F.col("_rows") > 1).cast("long").alias("n_duplicate_cells"),
        F.sum("_errs").cast("long").alias("n_error_rows"))


def resume_pending(plan: DataFrame, done: DataFrame, cell: Sequence[str], metric: str = "auc") -> DataFrame:
    """J6 (T8): cells of the plan without a valid row in ``done`` (a baseline row alone does not count).
    Cell keys may be NULL, as alpha is for baselines."""
    ok = done.filter(F.col(metric).isNotNull() & F.col("error").isNull()).select(*cell)
    return join_on(plan, ok, cell, "left_anti")


def run_drift(a: DataFrame, b: DataFrame, cell: Sequence[str], by: Sequence[str], metric: str = "auc") -> DataFrame:
    """Same cells in two runs: matched cells, max |diff|, exact agreement flag."""
    j = join_on(a.select(*cell, F.col(metric).alias("_a")), b.select(*cell, F.col(metric).alias("_b")), cell)
    return j.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n_matched"),
                              F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff")).withColumn(
        "agree", F.col("max_abs_diff") == 0)
