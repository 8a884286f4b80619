"""Registered queries: exact neighbours of wide vectors (J10 with many columns).

Queries are the rows whose id is divisible by 50, searched against all rows."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from synthlab.functions.exprs import r6
from synthlab.operators.metric_index import search
from synthlab.plans.registry import register
from synthlab.sources.tables import load

K = 10
DIMS = 64


# ---- embeddings: 64 columns spread evenly over the sphere ------------------------------------------------------

@register("knn_wide", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS nn_key, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nn_key) AS nn_rank FROM d)
SELECT vec_id, nn_key, CAST(nn_rank AS BIGINT) AS nn_rank, round(dist, 6) AS dist FROM r WHERE nn_rank <= {K}""")
def q_knn_wide(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    res = search(e.filter(F.col("vec_id") % 50 == 0), e, "vec_id", "embedding", K, DIMS, exclude_self=True)
    return res.neighbours.select("vec_id", "nn_key", "nn_rank", r6("dist").alias("dist"))


# ---- orders: 64 correlated columns (whole-number mixes of price, customer and status) ---------------------------

def _mix(j: int) -> tuple[int, int, int]:
    return (j * 7) % 5 - 2, (j * 11) % 7 - 3, (j * 13) % 3 - 1


def _sql_d2() -> str:
    """Sum over the 64 columns of (a dx + b dy + c dz)^2, multiplied out."""
    m = [_mix(j) for j in range(DIMS)]
    s = {(p, q): sum(t[p] * t[q] for t in m) for p in range(3) for q in range(p, 3)}
    f = ["(a.x - b.x)", "(a.y - b.y)", "(a.z - b.z)"]
    return " + ".join(f"{v if p == q else 2 * v} * {f[p]} * {f[q]}" for (p, q), v in s.items())


SQL_MIXED = ("SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS x, CAST(o_custkey % 1000 AS BIGINT) AS y, "
             "CAST(100 * ascii(o_orderstatus) AS BIGINT) AS z FROM orders")


@register("knn_wide_mixed", f"""
WITH o AS ({SQL_MIXED}),
d AS (SELECT a.o_orderkey, b.o_orderkey AS nn_key, {_sql_d2()} AS d2 FROM o a JOIN o b ON a.o_orderkey <> b.o_orderkey WHERE a.o_orderkey % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY d2, nn_key) AS nn_rank FROM d)
SELECT o_orderkey, nn_key, CAST(nn_rank AS BIGINT) AS nn_rank, round(sqrt(CAST(d2 AS DOUBLE)), 6) AS dist FROM r WHERE nn_rank <= {K}""")
def q_knn_mixed(spark, sf_dir):
    return mixed_search(spark, sf_dir).neighbours.select("o_orderkey", "nn_key", "nn_rank", r6("dist").alias("dist"))


def mixed_search(spark, sf_dir, **sizes):
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.floor(F.col("o_totalprice") / 100).alias("x"), (F.col("o_custkey") % 1000).alias("y"),
        (100 * F.ascii("o_orderstatus")).alias("z"))
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))       # few columns: the vectors are made in even parts
    mix = np.array([_mix(j) for j in range(DIMS)], float).T

    def vectors(batches):                           # 64 sums as one product: too many expressions for one compiled method
        for b in batches:
            xyz = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1)
            ends = pa.array(np.arange(len(xyz) + 1, dtype=np.int32) * DIMS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array((xyz @ mix).ravel()))], ["o_orderkey", "v"])

    def wide(rows):
        return rows.mapInArrow(vectors, f"o_orderkey {rows.schema['o_orderkey'].dataType.simpleString()}, v array<double>")
    return search(wide(o.filter(F.col("o_orderkey") % 50 == 0)), wide(o), "o_orderkey", "v", K, DIMS, exclude_self=True, **sizes)
