"""File-source stream -> idempotent attempt log (S10 with W6 as the read view)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from synthlab.operators.audit import dedup_latest_valid
from synthlab.sources.files import path_exists


def ingest_result_files(spark: SparkSession, source_dir: str, schema: str, log_path: str, checkpoint: str,
                        key: Sequence[str]) -> DataFrame:
    """Append every new (cell, attempt) row found in ``source_dir`` to the parquet log at ``log_path``.

    ``foreachBatch`` anti-joins each micro-batch against the log, so a batch replayed after a failure
    (same batch id, same files) writes nothing twice; ``availableNow`` processes what is there and
    stops.  Returns the log."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def write_batch(batch: DataFrame, _batch_id: int) -> None:
        new = batch.dropDuplicates(list(key))
        if path_exists(spark, log_path):
            seen = spark.read.parquet(log_path).select(*key)
            new = new.join(seen, [new[c].eqNullSafe(seen[c]) for c in key], "left_anti")
        new.write.mode("append").parquet(log_path)

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(log_path)


def current_results(log: DataFrame, cell: Sequence[str]) -> DataFrame:
    """The result table = latest valid attempt per cell."""
    return dedup_latest_valid(log, cell)
