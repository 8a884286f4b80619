"""Cell journal and side-by-side cells of experiment runs (S10 in E3 E4 E6 E8).

A journal is a folder of one small Parquet table per finished cell, named by a digest of the cell's key.
Writing a cell twice leaves one row; a run that stops at any moment has lost only the cells it was at.
Failed cells are written too, and are tried again by the next run.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from synthlab.sources.files import path_exists

RESULT_SCHEMA = ("dataset STRING, n BIGINT, seed INT, method STRING, condition STRING, alpha DOUBLE, "
                 "classifier STRING, auc_roc DOUBLE, f1_minority DOUBLE, avg_precision DOUBLE, mape DOUBLE, "
                 "r2 DOUBLE, error STRING")
NAMES = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
KEY = 7                  # the first fields name the cell


class Journal:
    """Finished cells of a run under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ran: list[tuple] = []                       # keys of the cells this run evaluated
        # the grid bounds the rows; a later run with the same path starts from what is there
        self._done = {tuple(r)[:KEY]: tuple(r) for r in self.frame().collect()
                      if r["error"] is None and (r["auc_roc"] is not None or r["mape"] is not None)}

    def frame(self) -> DataFrame:
        """All rows written so far, one per cell; failed cells have their error."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], RESULT_SCHEMA)
        return self.spark.read.schema(RESULT_SCHEMA).parquet(self.path).select(*NAMES)

    def find(self, key: Sequence) -> tuple | None:
        """The row of a cell that an earlier run finished with a metric and no error."""
        return self._done.get(tuple(key))

    def add(self, row: tuple) -> None:
        name = hashlib.md5(json.dumps(row[:KEY]).encode()).hexdigest()
        self.ran.append(row[:KEY])
        self.spark.createDataFrame([row], RESULT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cell={name}")


def side_by_side(spark: SparkSession, units: Sequence[Callable[[], object]], parallel: int = 1) -> list:
    """Results of ``units`` in their order, at most ``parallel`` at a time.  Each runs in a driver thread with
    its own scheduler pool, so under ``spark.scheduler.mode=FAIR`` small fits share the cluster instead
    of waiting for one another."""
    if parallel <= 1 or len(units) <= 1:
        return [unit() for unit in units]

    def pooled(k: int, unit: Callable[[], object]) -> Callable[[], object]:
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"cells-{k % parallel}")
            return unit()
        return inheritable_thread_target(spark)(run)
    with ThreadPoolExecutor(max_workers=parallel) as threads:
        return [f.result() for f in [threads.submit(pooled(k, u)) for k, u in enumerate(units)]]
