"""Loader registry (U5): a name -> a callable (spark, sf_dir) that returns a checked ``Dataset``.

The prepared tables are those of the loader queries (L1-L8); here they become what an experiment
runner takes: key, target, task, name and numeric features, with the contract P13 checked."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlab.operators.prep import check_contract
from synthlab.plans import q_loaders as L
from synthlab.plans import q_prep as Q
from synthlab.plans.experiment import Dataset
from synthlab.plans.registry import REGISTRY, register

# name -> (prepared table, its query, key columns, target, task)
TABLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str, list[str], str, str]] = {
    "telco": (Q.q_telco, "telco_prepare", ["customer_id"], "target", "classification"),
    "bank": (L.q_bank, "bank_prepare", ["o_orderkey"], "target", "classification"),
    "german": (L.q_german, "german_prepare", ["f0"], "target", "classification"),
    "retail": (Q.clv, "clv_rollup", ["customer_id"], "total_spend", "regression"),
    "nomao": (L.q_nomao, "nomao_prepare", ["s_suppkey"], "target", "classification"),
    "hillstrom": (L.q_hillstrom, "hillstrom_prepare", ["event_id"], "target", "classification"),
    "criteo": (L.q_criteo, "criteo_prepare", L.LKEY, "target", "classification"),
    "kdd": (L.q_kdd, "kdd_prepare", ["c_custkey"], "target", "classification"),
}
KEY = "row_key"


def dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    """The named dataset; a key of several columns becomes one text, an unknown name is a KeyError."""
    table, _query, keys, target, task = TABLES[name]
    df = table(spark, sf_dir)
    features = [c for c in df.columns if c not in (*keys, target)]
    check_contract(df, target, features)                                   # P13
    key = F.col(keys[0]) if len(keys) == 1 else F.concat_ws(":", *keys)
    df = df.select(key.alias(KEY), *[F.col(c).cast("double").alias(c) for c in features],        # P22
                   F.col(target).cast("double" if task == "regression" else "int").alias(target))
    return Dataset(df, KEY, target, task, name, features)


LOADERS: dict[str, Callable[[SparkSession, str], Dataset]] = {
    name: (lambda spark, sf_dir, _n=name: dataset(spark, sf_dir, _n)) for name in TABLES}


def _sql() -> str:
    out = []
    for name, (_t, query, keys, target, task) in TABLES.items():
        out.append(f"SELECT '{name}' AS name, '{task}' AS task, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT ({', '.join(keys)})) AS BIGINT) AS n_keys, "
                   f"round(sum(CAST({target} AS DOUBLE)), 3) AS target_sum FROM ({REGISTRY[query][1]})")
    return " UNION ALL ".join(out)


@register("loader_registry", _sql())
def q_loader_registry(spark, sf_dir):
    """Every loader through the registry: its name, task, rows, different keys and the sum of its target."""
    out = None
    for name in LOADERS:
        ds = LOADERS[name](spark, sf_dir)
        row = ds.df.agg(F.lit(ds.name).alias("name"), F.lit(ds.task).alias("task"), F.count(F.lit(1)).alias("n_rows"),
                        F.count_distinct(ds.key).alias("n_keys"), F.round(F.sum(F.col(ds.target).cast("double")), 3).alias("target_sum"))
        out = row if out is None else out.unionByName(row)
    return out
