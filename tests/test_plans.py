"""Plan-shape checks: pushdown, pruning, and no whole-class windows in the samplers."""
from pyspark.sql import functions as F

from synthlab.operators import metrics as M
from synthlab.operators import sampling as S
from synthlab.plans import fixtures as X

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    plan = _plan(X.tstr_results(spark, SF_SMALL))
    assert "EqualTo(l_linestatus,F)" in plan                # pushed into the parquet scan
    assert "l_extendedprice" not in plan and "l_quantity" not in plan   # unused columns pruned


def test_stratified_split_reads_once_and_has_no_window(spark):
    t = X.events_target(spark, SF_SMALL).select("event_id", "target")
    plan = S.stratified_split(t, ["event_id"], "target", 42)._jdf.queryExecution().optimizedPlan().toString()
    # the cutoffs are found before; the plan compares each row with its class's cutoff
    assert "Window [" not in plan
    assert plan.count("Relation [event_id") == 1


def test_auc_has_no_unpartitioned_window(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    s = li.select(F.col("l_linestatus").alias("cell"), F.col("l_discount").alias("score"),
                  (F.col("l_returnflag") == "R").cast("int").alias("y"))
    plan = M.auc_ap(s, "score", "y", ["cell"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            # every window over score rows is partitioned (by cell and value bucket)
            assert "windowspecdefinition(cell" in line or "windowspecdefinition(_pid" in line or "_bk" in line, line
