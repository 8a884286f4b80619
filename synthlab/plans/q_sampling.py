"""Registered queries: seeded sampling and splitting."""
from __future__ import annotations

from pyspark.sql import functions as F

from synthlab.functions.exprs import r6
from synthlab.functions.keys import sql_hash_hex
from synthlab.operators import sampling as S
from synthlab.plans import fixtures as X
from synthlab.plans.registry import register
from synthlab.sources.tables import load

EV = X.sql_events_target()
H_EV = sql_hash_hex(["event_id"], 42)
KEY = ["event_id"]

# fixed parameters of the registered sampling queries
CAP_N = 1000
HOLDOUT_N = 2000
SMALL_N = 500
SEEDS = [42, 123, 7, 2024, 999]


def _sql_quotas(src: str, total: str) -> str:
    """Largest-remainder class quotas, SQL twin of ``largest_remainder_quotas``."""
    return f"""
c AS (SELECT target, count(*) AS n_class FROM {src} GROUP BY target),
q1 AS (SELECT target, n_class, CAST({total} AS DOUBLE) * n_class / sum(n_class) OVER () AS ex,
              CAST({total} AS BIGINT) AS total FROM c),
q2 AS (SELECT target, ex, CAST(floor(ex) AS BIGINT) AS fl, total - sum(CAST(floor(ex) AS BIGINT)) OVER () AS lft FROM q1),
q AS (SELECT target, fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, target) <= lft THEN 1 ELSE 0 END AS quota
      FROM q2)"""


# ---- cap_sample (D1) --------------------------------------------------------------------------

@register("cap_sample", f"""
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {H_EV}, event_id) AS rn FROM events)
WHERE rn <= {CAP_N}""")
def q_cap(spark, sf_dir):
    return S.cap(load(spark, sf_dir, "events").select("event_id"), KEY, CAP_N, 42)


# ---- shuffle_rank (D8) ------------------------------------------------------------------------

@register("shuffle_rank", f"""
SELECT event_id, CAST(row_number() OVER (ORDER BY {H_EV}, event_id) AS BIGINT) AS rank FROM events""")
def q_shuffle(spark, sf_dir):
    return S.shuffle(load(spark, sf_dir, "events").select("event_id"), KEY, 42)


# ---- stratified_split (D2) ----------------------------------------------------------------------

SQL_STRAT = f"""
WITH t AS ({EV}),
{_sql_quotas('t', "(SELECT ceil(0.2::DOUBLE * count(*)) FROM t)")},
r AS (SELECT event_id, target, row_number() OVER (PARTITION BY target ORDER BY {H_EV}, event_id) AS rn FROM t)
SELECT r.event_id, r.target, CASE WHEN r.rn <= q.quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN q ON r.target = q.target
"""


@register("stratified_split", SQL_STRAT)
def q_strat(spark, sf_dir):
    t = X.events_target(spark, sf_dir).select("event_id", "target")
    return S.stratified_split(t, KEY, "target", 42)


# ---- minority_budget (D13) ------------------------------------------------------------------------

@register("minority_budget", f"""
WITH s AS ({SQL_STRAT})
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(target) AS BIGINT) AS n_pos FROM s GROUP BY split""")
def q_budget(spark, sf_dir):
    return S.minority_budget(q_strat(spark, sf_dir), "target")


# ---- random_split (D3) on the regression stand-in (orders) ---------------------------------------------

H_O = sql_hash_hex(["o_orderkey"], 42)


@register("random_split", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {H_O}, o_orderkey) <= ceil(0.2::DOUBLE * count(*) OVER ())
       THEN 'test' ELSE 'train' END AS split FROM orders""")
def q_random_split(spark, sf_dir):
    return S.random_split(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 42)


# ---- fixed_holdout_pool (D4 D5 J7) ---------------------------------------------------------------------

SQL_HOLDOUT = f"""
t AS ({EV}),
{_sql_quotas('t', str(HOLDOUT_N))},
r AS (SELECT event_id, target, row_number() OVER (PARTITION BY target ORDER BY {H_EV}, event_id) AS rn FROM t),
h AS (SELECT r.event_id, r.target FROM r JOIN q ON r.target = q.target WHERE r.rn <= q.quota),
pool AS (SELECT * FROM t WHERE event_id NOT IN (SELECT event_id FROM h))"""


@register("fixed_holdout_pool", f"""
WITH {SQL_HOLDOUT}
SELECT event_id, target, 'holdout' AS role FROM h UNION ALL SELECT event_id, target, 'pool' AS role FROM pool""")
def q_holdout(spark, sf_dir):
    t = X.events_target(spark, sf_dir).select("event_id", "target")
    h = S.fixed_holdout(t, KEY, "target", HOLDOUT_N, 42)
    pool = S.pool_without(t, h, KEY)
    return h.withColumn("role", F.lit("holdout")).unionByName(pool.withColumn("role", F.lit("pool")))


def _pool(spark, sf_dir):
    t = X.events_target(spark, sf_dir).select("event_id", "target")
    h = S.fixed_holdout(t, KEY, "target", HOLDOUT_N, 42)
    return t, h, S.pool_without(t, h, KEY)


# ---- small_n_quota (D7) and small_n (D6) -----------------------------------------------------------------

H_EV7 = sql_hash_hex(["event_id"], 7)


@register("small_n_quota", f"""
WITH {SQL_HOLDOUT},
np AS (SELECT greatest(1, CAST(round_even({SMALL_N}::DOUBLE * avg(CAST(target AS DOUBLE)), 0) AS BIGINT)) AS npos FROM pool),
qq AS (SELECT 1 AS target, npos AS quota FROM np UNION ALL SELECT 0 AS target, {SMALL_N} - npos FROM np),
rr AS (SELECT event_id, target, row_number() OVER (PARTITION BY target ORDER BY {H_EV7}, event_id) AS rn FROM pool)
SELECT rr.event_id, rr.target FROM rr JOIN qq ON rr.target = qq.target WHERE rr.rn <= qq.quota""")
def q_small_n_quota(spark, sf_dir):
    _t, _h, pool = _pool(spark, sf_dir)
    return S.small_n_stratified(pool, KEY, "target", SMALL_N, 7)


@register("small_n_simple", f"""
WITH {SQL_HOLDOUT}
SELECT event_id, target FROM (SELECT event_id, target, row_number() OVER (ORDER BY {H_EV7}, event_id) AS rn FROM pool)
WHERE rn <= {SMALL_N}""")
def q_small_n(spark, sf_dir):
    _t, _h, pool = _pool(spark, sf_dir)
    return S.small_n(pool, KEY, SMALL_N, 7)


# ---- leak_check (D15, trap T1) ----------------------------------------------------------------------------
# leak-free draw from the pool vs the leaky draw from all rows

@register("leak_check", f"""
WITH {SQL_HOLDOUT},
a AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {H_EV7}, event_id) AS rn FROM pool) WHERE rn <= {SMALL_N}),
b AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {H_EV7}, event_id) AS rn FROM t) WHERE rn <= {SMALL_N})
SELECT CAST((SELECT count(*) FROM a WHERE event_id IN (SELECT event_id FROM h)) AS BIGINT) AS overlap_pool_draw,
       CAST((SELECT count(*) FROM b WHERE event_id IN (SELECT event_id FROM h)) AS BIGINT) AS overlap_all_rows_draw""")
def q_leak(spark, sf_dir):
    t, h, pool = _pool(spark, sf_dir)
    a = S.leak_check(S.small_n(pool, KEY, SMALL_N, 7), h, KEY).agg(F.count(F.lit(1)).alias("overlap_pool_draw"))
    b = S.leak_check(S.small_n(t, KEY, SMALL_N, 7), h, KEY).agg(F.count(F.lit(1)).alias("overlap_all_rows_draw"))
    return a.crossJoin(F.broadcast(b)).select(F.col("overlap_pool_draw").cast("long"), F.col("overlap_all_rows_draw").cast("long"))


# ---- single_class_guard (D14): n=50 draws for five seeds on the rarest target ---------------------------------

@register("single_class_guard", f"""
WITH t AS ({X.sql_events_target(X.RARER_VALUE)}),
g AS (SELECT * FROM t CROSS JOIN (VALUES {', '.join(f'({s})' for s in SEEDS)}) s(seed)),
r AS (SELECT seed, target, row_number() OVER (PARTITION BY seed ORDER BY {sql_hash_hex(['event_id'], 'seed', True)}, event_id) AS rn FROM g)
SELECT CAST(seed AS BIGINT) AS seed, CAST(count(DISTINCT target) AS BIGINT) AS n_classes,
       CASE WHEN count(DISTINCT target) < 2 THEN 'single class in training sample' END AS error
FROM r WHERE rn <= 50 GROUP BY seed""")
def q_single_class(spark, sf_dir):
    t = X.events_target(spark, sf_dir, X.RARER_VALUE).select("event_id", "target")
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "seed BIGINT")
    grid = t.crossJoin(F.broadcast(seeds))
    draws = S.select_smallest(grid, KEY, F.col("seed"), 50, by=["seed"])
    return S.single_class_guard(draws, "target", ["seed"])


# ---- sparsify (D10) + effective sparsity (A7) ------------------------------------------------------------------

def _sql_sparse(rate: float, seed) -> str:
    from synthlab.functions.keys import sql_hash_uniform
    cols = ", ".join(
        f"round(CASE WHEN {sql_hash_uniform(['vec_id'], f'{seed}:f{i}')} < {rate!r}::DOUBLE THEN 0.0::DOUBLE "
        f"ELSE CAST(embedding[{i + 1}] AS DOUBLE) END, 6) AS f{i}" for i in range(64))
    return f"SELECT vec_id, {cols}, CAST(label = 0 AS INTEGER) AS target FROM embeddings"


@register("sparsify", _sql_sparse(0.7, 42))
def q_sparsify(spark, sf_dir):
    em = X.embeddings_wide(spark, sf_dir)
    feats = [f"f{i}" for i in range(64)]
    sp = S.sparsify(em, ["vec_id"], feats, 0.7, 42)
    return sp.select("vec_id", *[r6(c).alias(c) for c in feats], "target")


# ---- nested_prefix (D11) --------------------------------------------------------------------------------------

ALPHAS = S.ALPHAS


@register("nested_prefix", f"""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {H_EV}, event_id) AS syn_rank FROM events),
a AS (SELECT alpha, CAST(floor(alpha * (SELECT count(*) FROM events)) AS BIGINT) AS n_alpha
      FROM (VALUES {', '.join(f'({a!r}::DOUBLE)' for a in ALPHAS)}) v(alpha))
SELECT a.alpha, r.event_id, CAST(r.syn_rank AS BIGINT) AS syn_rank FROM r JOIN a ON r.syn_rank <= a.n_alpha""")
def q_nested(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id")
    syn = S.shuffle(ev, KEY, 42, name="syn_rank")
    alphas = spark.createDataFrame([(a,) for a in ALPHAS], "alpha DOUBLE")
    n_real = ev.agg(F.count(F.lit(1)).alias("n_real"))
    return S.nested_prefix(syn, alphas, n_real).select("alpha", "event_id", "syn_rank")


# ---- balanced_weights (M7) ------------------------------------------------------------------------------------

@register("balanced_weights", f"""
WITH t AS ({EV})
SELECT event_id, target, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY target)), 6) AS weight FROM t""")
def q_weights(spark, sf_dir):
    from synthlab.operators.metrics import balanced_weights
    t = X.events_target(spark, sf_dir).select("event_id", "target")
    return balanced_weights(t, "target").select("event_id", "target", r6("weight").alias("weight"))


# ---- low_data_sizes (D9) ------------------------------------------------------------------------------------------

@register("low_data_sizes", """
WITH d AS (SELECT 'events' AS dataset, count(*) AS n_rows FROM events
           UNION ALL SELECT 'customer', count(*) FROM customer
           UNION ALL SELECT 'embeddings', count(*) FROM embeddings
           UNION ALL SELECT 'labels', count(*) FROM labels)
SELECT dataset, CAST(n_rows AS BIGINT) AS n_rows, CAST(s.n AS BIGINT) AS n
FROM d CROSS JOIN (VALUES (250), (500), (1000), (2000)) s(n) WHERE s.n < 0.7::DOUBLE * n_rows""")
def q_low_data(spark, sf_dir):
    parts = [load(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("dataset", F.lit(t))
             for t in ["events", "customer", "embeddings", "labels"]]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return (d.select("dataset", F.col("n_rows").cast("long"),
                     F.explode(S.low_data_sizes(F.col("n_rows"))).alias("n"))).withColumn("n", F.col("n").cast("long"))


# ---- head_rows (D12): the first rows of an explicit rank --------------------------------------------------------------

@register("head_rows", f"""
SELECT event_id, CAST(syn_rank AS BIGINT) AS syn_rank FROM (
  SELECT event_id, row_number() OVER (ORDER BY {H_EV}, event_id) AS syn_rank FROM events) WHERE syn_rank <= 100""")
def q_head(spark, sf_dir):
    ranked = S.shuffle(load(spark, sf_dir, "events").select("event_id"), KEY, 42, name="syn_rank")
    return S.head(ranked, 100)


# ---- experiment_grid (J8): datasets of the results table x seeds x classifiers x alphas ---------------------------------

@register("experiment_grid", f"""
WITH d AS (SELECT DISTINCT l_returnflag AS dataset FROM lineitem)
SELECT dataset, CAST(seed AS BIGINT) AS seed, classifier, 'smote' AS method, alpha FROM d,
  (VALUES {', '.join(f'({s})' for s in SEEDS)}) s(seed), (VALUES ('gbc'), ('lr')) c(classifier),
  (VALUES {', '.join(f'({a!r}::DOUBLE)' for a in S.ALPHAS)}) a(alpha)""")
def q_grid(spark, sf_dir):
    from synthlab.plans.experiment import experiment_grid
    names = [r[0] for r in load(spark, sf_dir, "lineitem").select("l_returnflag").distinct().collect()]
    grid = experiment_grid(spark, names, SEEDS, ["gbc", "lr"], ["smote"], S.ALPHAS)
    return grid.withColumn("seed", F.col("seed").cast("long"))
