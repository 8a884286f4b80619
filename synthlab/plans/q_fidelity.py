"""Registered queries: fidelity and privacy checks.

Real/synthetic stand-in: lineitem lines with status O ("real") vs status F ("synthetic")."""
from __future__ import annotations

from pyspark.sql import functions as F

from synthlab.functions.exprs import r6
from synthlab.functions.keys import sql_hash_hex, sql_hash_uniform
from synthlab.operators import fidelity as FD
from synthlab.plans import fixtures as X
from synthlab.plans.registry import register
from synthlab.sources.tables import load

FID = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BINS = 20


def _pair(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_linestatus") == "O"), li.filter(F.col("l_linestatus") == "F")


SQL_LV = f"""lv AS (
  SELECT 'real' AS side, col, x FROM (UNPIVOT (SELECT {', '.join(FID)} FROM lineitem WHERE l_linestatus = 'O') ON {', '.join(FID)} INTO NAME col VALUE x)
  UNION ALL
  SELECT 'syn' AS side, col, x FROM (UNPIVOT (SELECT {', '.join(FID)} FROM lineitem WHERE l_linestatus = 'F') ON {', '.join(FID)} INTO NAME col VALUE x))"""


@register("tvd", f"""WITH {SQL_LV},
rng AS (SELECT col, min(x) AS lo, max(x) AS hi FROM lv GROUP BY col),
h AS (SELECT lv.col, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * {BINS}), {BINS - 1}) ELSE 0 END AS INTEGER) AS bin,
             count(*) FILTER (WHERE side = 'real') AS nr, count(*) FILTER (WHERE side = 'syn') AS ns
      FROM lv JOIN rng ON lv.col = rng.col GROUP BY ALL),
t AS (SELECT col, sum(nr) AS tr, sum(ns) AS ts FROM h GROUP BY col),
pq AS (SELECT h.col, nr / tr::DOUBLE AS p, ns / ts::DOUBLE AS q FROM h JOIN t ON h.col = t.col)
SELECT col, round(sum(abs(p - q)) / 2, 6) AS tvd,
       round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 / ln(2), 6) AS js
FROM pq GROUP BY col""")
def q_tvd(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return FD.tvd_js(a, b, FID, BINS).select("col", r6("tvd").alias("tvd"), r6("js").alias("js"))


SQL_ECDF = f"""WITH {SQL_LV},
g AS (SELECT col, x, count(*) FILTER (WHERE side = 'real') AS cr, count(*) FILTER (WHERE side = 'syn') AS cs FROM lv GROUP BY col, x),
c AS (SELECT col, x, cr, cs, coalesce(sum(cr) OVER w1, 0) AS crb, coalesce(sum(cs) OVER w1, 0) AS csb, lag(x) OVER w0 AS xp,
             sum(cr) OVER wa AS tr, sum(cs) OVER wa AS ts FROM g
      WINDOW w0 AS (PARTITION BY col ORDER BY x), w1 AS (PARTITION BY col ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             wa AS (PARTITION BY col))"""


@register("wasserstein", f"""{SQL_ECDF}
SELECT col, round(sum(CASE WHEN xp IS NOT NULL THEN abs(crb / tr::DOUBLE - csb / ts::DOUBLE) * (x - xp) ELSE 0 END), 6) AS wasserstein
FROM c GROUP BY col""")
def q_w1(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return FD.ecdf_distances(a, b, FID).select("col", r6("wasserstein").alias("wasserstein"))


@register("ks", f"""{SQL_ECDF}
SELECT col, round(max(abs((crb + cr) / tr::DOUBLE - (csb + cs) / ts::DOUBLE)), 6) AS ks FROM c GROUP BY col""")
def q_ks(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return FD.ecdf_distances(a, b, FID).select("col", r6("ks").alias("ks"))


def _sql_spearman(status: str, name: str) -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}" for c in FID)
    pairs = " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, corr(r_{a}, r_{b}) AS rho FROM {name}_r"
                               for i, a in enumerate(FID) for b in FID[i + 1:])
    return (f"{name}_r AS (SELECT {ranks} FROM lineitem WHERE l_linestatus = '{status}'), "
            f"{name} AS ({pairs})")


@register("corr_frobenius", f"""WITH {_sql_spearman('O', 'ra')}, {_sql_spearman('F', 'sy')}
SELECT round(sqrt(2 * sum((ra.rho - sy.rho) * (ra.rho - sy.rho))), 6) AS frobenius, CAST(count(*) AS BIGINT) AS n_pairs
FROM ra JOIN sy ON ra.pair = sy.pair""")
def q_frob(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return FD.corr_frobenius(a, b, FID).select(r6("frobenius").alias("frobenius"), "n_pairs")


# ---- dcr (F6): purchases ("synthetic") against views and clicks ("real") --------------------------------------

DCR_FEATS = ["k", "hour", "user_id"]


def _dcr_sides(spark, sf_dir):
    t = X.events_target(spark, sf_dir)
    t = t.select("event_id", F.array(*[F.col(c).cast("double") for c in DCR_FEATS]).alias("x"),
                 F.col("etype"))
    return t.filter(F.col("etype") == 3).drop("etype"), t.filter(F.col("etype").isin(0, 1)).drop("etype")


@register("dcr", f"""WITH t AS ({X.sql_events_target()}),
s AS (SELECT event_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DCR_FEATS)} FROM t WHERE etype = 3),
r AS (SELECT event_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DCR_FEATS)} FROM t WHERE etype IN (0, 1)),
d AS (SELECT s.event_id, min(0.0::DOUBLE + {' + '.join(f'(s.{c} - r.{c}) * (s.{c} - r.{c})' for c in DCR_FEATS)}, 2) AS l
      FROM s CROSS JOIN r GROUP BY s.event_id)
SELECT event_id, round(sqrt(l[1]), 6) AS dcr, round(CASE WHEN l[2] > 0 THEN sqrt(l[1]) / sqrt(l[2]) END, 6) AS nndr FROM d""")
def q_dcr(spark, sf_dir):
    syn, real = _dcr_sides(spark, sf_dir)
    return FD.dcr(syn, real, "event_id", "x").select("event_id", r6("dcr").alias("dcr"), r6("nndr").alias("nndr"))


# ---- bootstrap_auc_ci (F7) ----------------------------------------------------------------------------------

B = 1000
LKEY = X.LINEITEM_KEY
#: the replicates' factors as rows
SQL_FACTORS = ", ".join(f"({b}, {x}, {y}, {z})" for b, (x, y, z) in enumerate(FD.replicate_factors(B, 42), 1))


def _sql_u_slot() -> str:
    """A replicate's uniform: the row's two 31-bit slices times the replicate's factors."""
    return f"(((s.x * b.f1 + s.y * b.f2 + b.f3) % {FD.PRIME}) / {FD.PRIME}.0::DOUBLE)"


def _sql_poisson(u: str) -> str:
    th = FD.poisson_thresholds()
    return "CASE " + " ".join(f"WHEN {u} < {t!r}::DOUBLE THEN {j}" for j, t in enumerate(th)) + f" ELSE {len(th)} END"


@register("bootstrap_auc_ci", f"""WITH s AS (SELECT {', '.join(LKEY)}, l_linestatus AS cell, l_discount AS score,
                                        CAST(l_returnflag = 'R' AS INTEGER) AS label,
                                        {sql_hash_hex(LKEY, 42)} AS h FROM lineitem),
d AS (SELECT cell, score, label, ('0x' || substr(h, 1, 8))::BIGINT % {FD.PRIME} AS x, ('0x' || substr(h, 9, 8))::BIGINT % {FD.PRIME} AS y FROM s),
b AS (SELECT * FROM (VALUES {SQL_FACTORS}) v(b, f1, f2, f3)),
e AS (SELECT s.cell, s.score, s.label, b.b, {_sql_poisson(_sql_u_slot())} AS w FROM d AS s CROSS JOIN b),
g AS (SELECT cell, b, score, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM e WHERE w > 0 GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cell, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g),
a AS (SELECT cell, b, sum(pos * (nb + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY cell, b)
SELECT cell, round(avg(auc), 6) AS auc_mean, round(quantile_cont(auc, 0.025), 6) AS auc_lo, round(quantile_cont(auc, 0.975), 6) AS auc_hi,
       CAST(count(*) AS BIGINT) AS replicates FROM a GROUP BY cell""")
def q_boot_ci(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    s = li.select(*LKEY, F.col("l_linestatus").alias("cell"), F.col("l_discount").alias("score"),
                  (F.col("l_returnflag") == "R").cast("int").alias("y"))
    reps = FD.bootstrap_auc(s, "score", "y", LKEY, B, 42, by=["cell"])
    return reps.groupBy("cell").agg(r6(F.avg("auc")).alias("auc_mean"), r6(F.percentile("auc", 0.025)).alias("auc_lo"),
                                    r6(F.percentile("auc", 0.975)).alias("auc_hi"), F.count(F.lit(1)).cast("long").alias("replicates"))


# ---- adasyn_quotas (F8) --------------------------------------------------------------------------------------------

@register("adasyn_quotas", f"""WITH t AS ({X.sql_events_target()}),
a AS (SELECT event_id, target, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in X.EVENT_FEATURES)} FROM t),
mn AS (SELECT * FROM a WHERE target = 1),
d AS (SELECT m.event_id, o.event_id AS nk, o.target AS y,
             0.0::DOUBLE + {' + '.join(f'(m.{c} - o.{c}) * (m.{c} - o.{c})' for c in X.EVENT_FEATURES)} AS d2
      FROM mn m JOIN a o ON m.event_id <> o.event_id),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d2, nk) AS rk FROM d),
r AS (SELECT event_id, sum(1 - y) / 5.0::DOUBLE AS r FROM k WHERE rk <= 5 GROUP BY event_id),
cn AS (SELECT count(*) FILTER (WHERE target = 0) AS nmaj, count(*) FILTER (WHERE target = 1) AS nmin FROM a),
g AS (SELECT greatest(floor(nmaj / 6.6::DOUBLE) - nmin, 0) AS g FROM cn)
SELECT event_id, round(r, 6) AS r, CAST(CASE WHEN (SELECT sum(r) FROM r) > 0 THEN round_even(r / (SELECT sum(r) FROM r) * (SELECT g FROM g), 0) ELSE 0 END AS BIGINT) AS quota
FROM r""")
def q_adasyn(spark, sf_dir):
    t = X.events_target(spark, sf_dir)
    a = t.select("event_id", "target", F.array(*[F.col(c).cast("double") for c in X.EVENT_FEATURES]).alias("x"))
    mn = a.filter(F.col("target") == 1)
    return FD.adasyn_quotas(mn, a, "event_id", "x", "target").select("event_id", r6("r").alias("r"), "quota")


# ---- precision_at_k (F10) ----------------------------------------------------------------------------------------

DEPTH = 0.1


@register("precision_at_k", f"""WITH s AS (SELECT {', '.join(LKEY)}, l_linestatus AS cell, l_discount AS score,
                                      CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, {sql_hash_hex(LKEY, 42)}, {', '.join(LKEY)}) AS rn,
             ceil(count(*) OVER (PARTITION BY cell) * {DEPTH}::DOUBLE) AS kk FROM s)
SELECT cell, round(avg(CASE WHEN rn <= kk THEN y::DOUBLE END), 6) AS precision, round(avg(y::DOUBLE), 6) AS base_rate,
       CAST(count(*) FILTER (WHERE rn <= kk) AS BIGINT) AS k,
       round(avg(CASE WHEN rn <= kk THEN y::DOUBLE END) / avg(y::DOUBLE), 6) AS lift FROM r GROUP BY cell""")
def q_prec(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    s = li.select(*LKEY, F.col("l_linestatus").alias("cell"), F.col("l_discount").alias("score"),
                  (F.col("l_returnflag") == "R").cast("int").alias("y"))
    p = FD.precision_at(s, "score", "y", LKEY, DEPTH, 42, by=["cell"])
    return p.select("cell", r6("precision").alias("precision"), r6("base_rate").alias("base_rate"), "k", r6("lift").alias("lift"))


# ---- variance_components (F11): split seed x fit seed (alpha band) --------------------------------------------------

@register("variance_components", f"""WITH r AS ({X.SQL_RESULTS_LONG}), m AS (SELECT * FROM r WHERE method = 'method'),
a AS (SELECT dataset, var_samp(ma) AS var_seed FROM (SELECT dataset, seed, avg(auc) AS ma FROM m GROUP BY ALL) GROUP BY dataset),
b AS (SELECT dataset, var_samp(mb) AS var_alpha FROM (SELECT dataset, alpha, avg(auc) AS mb FROM m GROUP BY ALL) GROUP BY dataset),
t AS (SELECT dataset, var_samp(auc) AS var_total, CAST(count(auc) AS BIGINT) AS n FROM m GROUP BY dataset)
SELECT dataset, round(var_total, 6) AS var_total, n, round(var_seed, 6) AS var_seed, round(var_alpha, 6) AS var_alpha
FROM t JOIN a USING (dataset) JOIN b USING (dataset)""")
def q_var(spark, sf_dir):
    m = X.results_long(spark, sf_dir).filter(F.col("method") == "method")
    v = FD.variance_components(m, "auc", "seed", "alpha", ["dataset"])
    return v.select("dataset", r6("var_total").alias("var_total"), "n", r6("var_seed").alias("var_seed"),
                    r6("var_alpha").alias("var_alpha"))


# ---- variance_decomposition (F11): split seed x alpha band, crossed random effects, unbalanced cells ----------------

@register("variance_decomposition", f"""WITH m AS (SELECT dataset, seed AS a, alpha AS b, auc FROM ({X.SQL_RESULTS_LONG})
  WHERE method = 'method' AND auc IS NOT NULL AND (seed + n) % 5 <> 0),
y AS (SELECT dataset, a, b, auc - avg(auc) OVER (PARTITION BY dataset) AS y FROM m),
c AS (SELECT dataset, a, b, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s, sum(y * y) AS q FROM y GROUP BY ALL),
ra AS (SELECT dataset, a, sum(n) AS n, sum(s) AS s, sum(n * n) AS nn FROM c GROUP BY ALL),
rb AS (SELECT dataset, b, sum(n) AS n, sum(s) AS s, sum(n * n) AS nn FROM c GROUP BY ALL),
t AS (SELECT dataset, sum(n) AS n, count(*) AS c, sum(q) AS t0, sum(s * s / n) AS tab, sum(s) * sum(s) / sum(n) AS tm,
             sum(n * n) / sum(n) AS k12 FROM c GROUP BY dataset),
sa AS (SELECT dataset, sum(s * s / n) AS ta, count(*) AS la, sum(n * n) / sum(n) AS k1, sum(nn / n) AS ka FROM ra GROUP BY dataset),
sb AS (SELECT dataset, sum(s * s / n) AS tb, count(*) AS lb, sum(n * n) / sum(n) AS k2, sum(nn / n) AS kb FROM rb GROUP BY dataset),
e AS (SELECT *, CASE WHEN n > c THEN (t0 - tab) / (n - c) ELSE 0 END AS e FROM t JOIN sa USING (dataset) JOIN sb USING (dataset)),
r AS (SELECT *, ta - tm - e * (la - 1) AS r1, tb - tm - e * (lb - 1) AS r2, tab - ta - tb + tm - e * (c - la - lb + 1) AS r3 FROM e),
-- the last equation is the negative sum of what the first two leave: eliminate the interaction, then the second factor
p AS (SELECT *, n - k1 AS a1, ka - k2 AS b1, ka - k12 AS c1, kb - k1 AS a2, n - k2 AS b2, kb - k12 AS c2,
             k1 - kb AS a3, k2 - ka AS b3, n - ka - kb + k12 AS c3 FROM r),
q AS (SELECT *, a1 - a3 * c1 / c3 AS u1, b1 - b3 * c1 / c3 AS v1, r1 - r3 * c1 / c3 AS w1,
             a2 - a3 * c2 / c3 AS u2, b2 - b3 * c2 / c3 AS v2, r2 - r3 * c2 / c3 AS w2 FROM p),
x AS (SELECT *, (w1 * v2 - w2 * v1) / (u1 * v2 - u2 * v1) AS ca, (u1 * w2 - u2 * w1) / (u1 * v2 - u2 * v1) AS cb FROM q),
z AS (SELECT *, (r3 - a3 * ca - b3 * cb) / c3 AS cab FROM x)
SELECT dataset, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS n_cells, round(ca, 6) AS comp_seed, round(cb, 6) AS comp_alpha,
       CASE WHEN n > c THEN round(cab, 6) END AS comp_interaction, round(CASE WHEN n > c THEN e ELSE cab END, 6) AS comp_residual
FROM z""")
def q_var_decomposition(spark, sf_dir):
    m = X.results_long(spark, sf_dir).filter((F.col("method") == "method") & ((F.col("seed") + F.col("n")) % 5 != 0))
    v = FD.variance_decomposition(m, "auc", "seed", "alpha", ["dataset"])
    return v.select("dataset", "n", "n_cells", *[r6(f"comp_{c}").alias(f"comp_{c}") for c in ("seed", "alpha", "interaction", "residual")])


# ---- spearman_wide (F4): all 2,016 pairs of 64 columns ------------------------------------------------------------------

@register("spearman_wide", """WITH l AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding[1:64]) AS x FROM embeddings),
r AS (SELECT vec_id, j, rank() OVER (PARTITION BY j ORDER BY x) + (count(*) OVER (PARTITION BY j, x) - 1) / 2.0::DOUBLE AS r
      FROM l WHERE x IS NOT NULL)
SELECT 'f' || p.j || '|f' || q.j AS pair, round(corr(p.r, q.r), 6) AS rho FROM r p JOIN r q ON p.vec_id = q.vec_id AND p.j < q.j GROUP BY p.j, q.j""")
def q_spearman_wide(spark, sf_dir):
    cols = [f"f{i}" for i in range(64)]
    return FD.spearman_matrix(X.embeddings_wide(spark, sf_dir).select(*cols), cols).select("pair", r6("rho").alias("rho"))
