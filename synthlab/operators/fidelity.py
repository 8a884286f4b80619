"""Fidelity and privacy checks of synthetic rows against real rows.

Column-wise distances work on a long (column, side, value) projection built with ``unpivot``, so
one job handles every column; ordered statistics use the distributed running sums of
``metrics.running_before``; nearest-record distances use the exact slab kNN.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlab.operators.gram import pair_sums, pearson
from synthlab.operators.knn import knn_join
from synthlab.operators.metrics import running_before
from synthlab.operators.ordered import tie_ranks
from synthlab.functions.exprs import join_on
from synthlab.operators.sampling import BROADCAST_GROUPS, H, cutoffs, with_hash
from synthlab.session import materialise


def long_values(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(side, col, x) rows for both tables."""
    def one(df, side):
        return (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
                .unpivot([], list(cols), "col", "x").withColumn("side", F.lit(side)))
    return one(real, "real").unionByName(one(syn, "syn"))


def tvd_js(real: DataFrame, syn: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """total variation distance and Jensen-Shannon divergence (base 2) on shared equal-width bins."""
    lv = long_values(real, syn, cols).filter(F.col("x").isNotNull())
    rng = lv.groupBy("col").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
                                                   F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    h = lv.join(F.broadcast(rng), "col").groupBy("col", b.alias("bin")).agg(
        F.count_if(F.col("side") == "real").alias("_nr"), F.count_if(F.col("side") == "syn").alias("_ns"))
    tot = h.groupBy("col").agg(F.sum("_nr").alias("_tr"), F.sum("_ns").alias("_ts"))
    h = h.join(tot, "col").withColumn("p", F.try_divide(F.col("_nr"), F.col("_tr"))).withColumn("q", F.try_divide(F.col("_ns"), F.col("_ts")))
    m = (F.col("p") + F.col("q")) / 2
    kl = (F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / m)).otherwise(0.0) +
          F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / m)).otherwise(0.0))
    return h.groupBy("col").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tvd"),
                                (F.sum(kl) / 2 / math.log(2)).alias("js"))


def ecdf_distances(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F2 + F3: Wasserstein-1 (area between the two empirical CDFs) and KS (max CDF gap) per column."""
    lv = long_values(real, syn, cols).filter(F.col("x").isNotNull())
    g = lv.groupBy("col", "x").agg(F.count_if(F.col("side") == "real").alias("cr"),
                                   F.count_if(F.col("side") == "syn").alias("cs"))
    tot = g.groupBy("col").agg(F.sum("cr").alias("_tr"), F.sum("cs").alias("_ts"))
    rb = running_before(g.withColumn("xp", F.col("x")), ["col"], "x", ["cr", "cs"], maxes=["xp"])
    rb = rb.join(F.broadcast(tot), "col")          # one row per column
    # CDFs just below x (valid on [prev x, x)) and at x (inclusive)
    f_lo = F.try_divide(F.col("cr_before"), F.col("_tr"))
    g_lo = F.try_divide(F.col("cs_before"), F.col("_ts"))
    f_at = F.try_divide(F.col("cr_before") + F.col("cr"), F.col("_tr"))
    g_at = F.try_divide(F.col("cs_before") + F.col("cs"), F.col("_ts"))
    seg = F.when(F.col("xp_before").isNotNull(), F.abs(f_lo - g_lo) * (F.col("x") - F.col("xp_before"))).otherwise(0.0)
    return rb.groupBy("col").agg(F.sum(seg).alias("wasserstein"), F.max(F.abs(f_at - g_at)).alias("ks"))


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F4 part: Spearman correlation (pair, rho) of every column pair: mid-ranks of each column's values,
    Pearson over the rows where both are present, from one blocked Gram pass (``gram.pair_sums``)."""
    pos = {c: i for i, c in enumerate(cols)}
    base = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in cols])
                       .withColumn("_rid", F.monotonically_increasing_id()), "ranked")        # ids fixed by the write
    long = base.unpivot(["_rid"], list(cols), "_col", "_x").filter(F.col("_x").isNotNull())
    at = F.create_map(*[F.lit(v) for c, i in pos.items() for v in (c, i)])[F.col("_col")]
    ranks = tie_ranks(long.select("_rid", at.alias("_j"), "_x"), ["_j"], "_x")
    present = base.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], list(cols), "_col", "_m").select(
        at.alias("_j"), "_m")                                               # d rows
    # the mean of m mid-ranks is (m + 1) / 2: ranks are centred before any product
    centred = ranks.join(F.broadcast(present), "_j").select(
        "_rid", "_j", (F.col("_before") + (F.col("_equal") + 1) / 2.0 - (F.col("_m") + 1) / 2.0).alias("_v"))
    rows = centred.groupBy("_rid").agg(F.collect_list(F.struct("_j", "_v")).alias("_e"))     # at most d entries
    s = pair_sums(rows.select(F.col("_e._j").alias("at"), F.col("_e._v").alias("v")), len(cols))
    names = F.array(*[F.lit(c) for c in cols])
    return s.select(F.concat(names[F.col("i")], F.lit("|"), names[F.col("j")]).alias("pair"), pearson().alias("rho"))


def corr_frobenius(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frobenius norm of the difference of the two Spearman matrices (both triangles)."""
    a = spearman_matrix(real, cols).withColumnRenamed("rho", "_a")
    b = spearman_matrix(syn, cols).withColumnRenamed("rho", "_b")
    j = a.join(b, "pair")
    return j.agg(F.sqrt(2 * F.sum((F.col("_a") - F.col("_b")) ** 2)).alias("frobenius"),
                 F.count(F.lit(1)).cast("long").alias("n_pairs"))


def dcr(syn: DataFrame, real: DataFrame, key: str, vec: str, slab_size: int = 256) -> DataFrame:
    """distance of each synthetic row to its closest real row and the nearest/second ratio."""
    nn = knn_join(syn, real, key, vec, 2, slab_size=slab_size)
    return nn.groupBy(key).agg(F.min(F.when(F.col("nn_rank") == 1, F.col("dist"))).alias("dcr"),
                               F.min(F.when(F.col("nn_rank") == 2, F.col("dist"))).alias("_d2")) \
        .select(key, "dcr", F.when(F.col("_d2") > 0, F.col("dcr") / F.col("_d2")).alias("nndr"))


def poisson_thresholds() -> list[float]:
    """Cumulative Poisson(1) probabilities e^-1 * sum_{i<=j} 1/i!, j = 0..11."""
    out, cum, term = [], 0.0, math.exp(-1)
    for j in range(12):
        cum += term
        out.append(cum)
        term /= (j + 1)
    return out


#: modulus of the replicate hash, and rows weighted at a time
PRIME, STEP = (1 << 31) - 1, 1024


def replicate_factors(replicates: int, seed) -> list[tuple[int, int, int]]:
    """Three factors below ``PRIME`` for each replicate, from md5(seed:replicate)."""
    from hashlib import md5
    hexes = [md5(f"{seed}:{b}".encode()).hexdigest() for b in range(replicates)]
    return [tuple(int(h[i:i + 8], 16) % (PRIME - 1) + 1 for i in (0, 8, 16)) for h in hexes]


def bootstrap_auc(scored: DataFrame, score: str, label: str, keys: Sequence[str], replicates: int, seed,
                  by: Sequence[str] = ()) -> DataFrame:
    """Poisson-weighted bootstrap replicates (b = 1..replicates) of the exact AUC, in one pass.

    A row's weight in replicate b is a Poisson(1) draw from ``(x f1 + y f2 + f3) mod PRIME``, where x
    and y are two 31-bit slices of its key's digest and f the replicate's factors.  Rows are
    range-partitioned by (cell, score, digest), so equal scores spread over tasks, and are sorted in
    each; a task turns its rows into weight arrays some at a time, and adds up, for each cell, the
    weights of either class and the pairs won, as arrays with one element per replicate.  What
    leaves a task is three rows a cell: its first score, its last score (either may go on in another
    task) and what lies between.  No row is repeated per replicate.  NULL scores come first.
    """
    by = list(by)
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    cell = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    half = [(F.conv(F.substring(digest, i, 8), 16, 10).cast("long") % PRIME).alias(n) for i, n in ((1, "_x"), (9, "_y"))]
    rows = scored.select(cell.alias("_c"), F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("_s"),
                         F.col(label).cast("int").alias("_l"), *half)
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "_c", "_s", "_x", "_y").sortWithinPartitions("_c", "_s").select(
        "*", F.spark_partition_id().alias("_p"))
    factors = np.array(replicate_factors(replicates, seed), dtype=np.int64).reshape(-1, 3).T
    limits = np.array(poisson_thresholds())

    def weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        u = (x[:, None] * factors[0] + y[:, None] * factors[1] + factors[2]) % PRIME / PRIME
        return np.searchsorted(limits, u.ravel(), "right").reshape(u.shape)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(replicates, np.int64)
        cell_name = open_score = None
        first = middle = None                 # of the open cell: (score, pos, neg); (pos, neg, won twice)
        pos, neg = zero, zero                 # of the open score

        def row(at: int, seq: int, s, p, n, won) -> pa.RecordBatch:
            arrays = [pa.array([a.tolist()], pa.list_(pa.int64())) for a in (p, n, won)]
            return pa.RecordBatch.from_arrays(
                [pa.array([cell_name]), pa.array([at], pa.int32()), pa.array([seq], pa.int32()), pa.array([s], pa.float64()), *arrays],
                ["_c", "_p", "_q", "_s", "pos", "neg", "won"])

        def close_score() -> None:
            nonlocal first, middle
            if first is None:
                first = (open_score, pos, neg)
            else:
                mp, mn, won = middle or (zero, zero, zero)
                middle = (mp + pos, mn + neg, won + pos * (2 * mn + neg))

        def close_cell(at: int) -> Iterator[pa.RecordBatch]:
            if cell_name is None:
                return
            if first is None:
                yield row(at, 0, open_score, pos, neg, pos * neg)
                return
            yield row(at, 0, first[0], first[1], first[2], first[1] * first[2])
            if middle is not None:
                yield row(at, 1, None, *middle)
            yield row(at, 2, open_score, pos, neg, pos * neg)
        at = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                part = batch.slice(begin, STEP)
                names, s = part.column(0).to_pylist(), part.column(1).to_numpy()
                at = part.column(5)[0].as_py()
                w, y = weights(part.column(3).to_numpy(), part.column(4).to_numpy()), part.column(2).to_numpy()[:, None]
                opens = [i for i in range(len(s)) if i == 0 or names[i] != names[i - 1] or s[i] != s[i - 1]]
                up, down = np.add.reduceat(w * y, opens, axis=0), np.add.reduceat(w * (1 - y), opens, axis=0)
                for i, p, n in zip(opens, up, down):
                    if names[i] != cell_name:
                        yield from close_cell(at)
                        cell_name, open_score, first, middle, pos, neg = names[i], s[i], None, None, p, n
                    elif s[i] != open_score:
                        close_score()
                        open_score, pos, neg = s[i], p, n
                    else:
                        pos, neg = pos + p, neg + n
        yield from close_cell(at)
    partial = ordered.mapInArrow(sums, "_c string, _p int, _q int, _s double, pos array<bigint>, neg array<bigint>, won array<bigint>")

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        won, before, ups = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        tie = None                            # the open score: (score, pos, neg)

        def end_tie() -> None:
            nonlocal won, before
            if tie is not None:
                won, before = won + tie[1] * (before + tie[2] / 2), before + tie[2]
        for r in table.sort_by([("_p", "ascending"), ("_q", "ascending")]).to_batches(max_chunksize=64):
            for s, p, n, w in zip(*(r.column(c).to_pylist() for c in ("_s", "pos", "neg", "won"))):
                p, n, w = (np.array(a, dtype=float) for a in (p, n, w))
                ups = ups + p
                if s is not None and tie is not None and s == tie[0]:
                    tie = (s, tie[1] + p, tie[2] + n)
                    continue
                end_tie()
                tie = (s, p, n) if s is not None else None
                if s is None:
                    won, before = won + p * before + w / 2, before + n
        end_tie()
        with np.errstate(divide="ignore", invalid="ignore"):
            auc = won / (ups * before)
        return pa.table({"_c": pa.array([key[0].as_py()] * replicates), "b": pa.array(np.arange(1, replicates + 1)),
                         "auc": pa.array(auc, mask=~((ups > 0) & (before > 0)))})
    out = partial.groupBy("_c").applyInArrow(finish, "_c string, b bigint, auc double")
    if not by:
        return out.select("b", "auc")
    cells = scored.select(*by, cell.alias("_c")).distinct()
    return out.join(cells, "_c").select(*by, "b", "auc")


def adasyn_quotas(minority: DataFrame, everyone: DataFrame, key: str, vec: str, target: str, k: int = 5,
                  ratio: float = 6.6) -> DataFrame:
    """F8: per minority row, share of majority rows among its k nearest rows, normalised, times the
    number of rows needed to reach majority:minority = ratio (half-even rounding)."""
    nn = knn_join(minority, everyone, key, vec, k, exclude_self=True)
    lab = everyone.select(F.col(key).alias("nn_key"), F.col(target).alias("_y"))
    r = nn.join(lab, "nn_key").groupBy(key).agg((F.sum(1 - F.col("_y")) / k).alias("r"))
    counts = everyone.agg(F.count_if(F.col(target) == 0).alias("_nmaj"), F.count_if(F.col(target) == 1).alias("_nmin"))
    tot = r.agg(F.sum("r").alias("_rs"))
    j = r.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(tot))
    g = F.greatest(F.floor(F.col("_nmaj") / F.lit(ratio)) - F.col("_nmin"), F.lit(0))
    return j.select(key, "r", F.when(F.col("_rs") > 0, F.bround(F.col("r") / F.col("_rs") * g, 0)).otherwise(0).cast("long").alias("quota"))


def top_fraction(scored: DataFrame, score: str, keys: Sequence[str], frac: float, seed, by: Sequence[str] = ()) -> DataFrame:
    """F10 helper: flag ``_top`` for the ceil(frac * n) highest scores per cell; ties at the boundary
    score are broken in hash order.  One row per cell (boundary score, rows wanted from it, cutoff
    in hash order) meets the raw rows; none of them is joined on its score."""
    by = list(by)
    if not by:
        return top_fraction(scored.withColumn("_all", F.lit(1)), score, keys, frac, seed, ["_all"]).drop("_all")
    cnt = scored.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c")).withColumn("_neg", -F.col(score))
    rb = running_before(cnt, by, "_neg", ["_c"])  # rows with a higher score
    n = scored.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) * F.lit(float(frac))).cast("long").alias("_k"))
    holds = (F.col("_c_before") < F.col("_k")) & (F.col("_k") <= F.col("_c_before") + F.col("_c"))
    edges = materialise(join_on(rb, n, by).filter(holds).select(
        *by, F.col(score).alias("_edge"), (F.col("_k") - F.col("_c_before")).alias("_quota")), "edges")
    small = edges.count() <= BROADCAST_GROUPS
    hashed = with_hash(scored, keys, seed)
    at_edge = join_on(hashed, edges, by, broadcast=small).filter(F.col(score) == F.col("_edge"))
    cuts = cutoffs(at_edge, keys, by, edges.select(*by, "_quota"))
    cells = materialise(join_on(edges, cuts, by, "left"), "cells")
    j = join_on(hashed, cells, by, "left", broadcast=small)
    top = (F.col(score) > F.col("_edge")) | ((F.col(score) == F.col("_edge")) & (
        (F.col("_q") >= F.col("_n")) | F.coalesce(F.struct(H, *keys) <= F.col("_cut"), F.lit(False))))
    return j.withColumn("_top", F.coalesce(top, F.lit(False))).select(*scored.columns, "_top")


def precision_at(scored: DataFrame, score: str, label: str, keys: Sequence[str], frac: float, seed,
                 by: Sequence[str] = ()) -> DataFrame:
    """precision in the top ``frac`` of scores and lift over the cell's base rate."""
    t = top_fraction(scored, score, keys, frac, seed, by)
    return t.groupBy(*by).agg(F.avg(F.when(F.col("_top"), F.col(label).cast("double"))).alias("precision"),
                              F.avg(F.col(label).cast("double")).alias("base_rate"),
                              F.count_if(F.col("_top")).cast("long").alias("k")) \
        .withColumn("lift", F.try_divide(F.col("precision"), F.col("base_rate")))


def variance_components(res: DataFrame, value: str, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """total variance and variance of factor means for two crossed factors (split seed, fit seed)."""
    ma = res.groupBy(*by, a).agg(F.avg(value).alias("_ma")).groupBy(*by).agg(F.var_samp("_ma").alias(f"var_{a}"))
    mb = res.groupBy(*by, b).agg(F.avg(value).alias("_mb")).groupBy(*by).agg(F.var_samp("_mb").alias(f"var_{b}"))
    tot = res.groupBy(*by).agg(F.var_samp(value).alias("var_total"), F.count(value).cast("long").alias("n"))
    return tot.join(ma, list(by)).join(mb, list(by))


def variance_decomposition(res: DataFrame, value: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """two-way crossed random effects, value = mean + a + b + a:b + residual, cells of any size.

    The variance components equate the uncorrected sums of squares with their expectations for unbalanced
    cells; every sum is a grouped aggregate and the 3 x 3 system is solved by a column expression.  One
    row per ``by`` group: n, n_cells, comp_<a>, comp_<b>, comp_interaction, comp_residual (estimates may be
    negative) and share_* (of the estimates cut at 0).  Without replicates (n = n_cells) interaction and
    residual are one: comp_interaction is NULL.  A component that the cells do not identify (one level of
    a factor) makes the system singular: all but comp_residual are NULL.  Rows without a value or a factor are left
    out.  Values are centred at the group's mean first, which the estimates do not depend on."""
    by = list(by)
    ok = res.filter(F.col(value).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *by, F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(value).cast("double").alias("_y"))
    if not by:
        return variance_decomposition(res.withColumn("_all", F.lit(1)), value, a, b, ["_all"]).drop("_all")
    mean = ok.groupBy(*by).agg(F.avg("_y").alias("_mu"))
    y = F.col("_y") - F.col("_mu")
    cells = materialise(join_on(ok, mean, by).groupBy(*by, "_a", "_b").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(y).alias("_s"), F.sum(y * y).alias("_q")), "cells")

    def side(f: str) -> DataFrame:
        t = cells.groupBy(*by, f).agg(F.sum("_n").alias("_m"), F.sum("_s").alias("_t"), F.sum(F.col("_n") ** 2).alias("_nn"))
        return t.groupBy(*by).agg(F.sum(F.col("_t") ** 2 / F.col("_m")).alias(f"T{f}"), F.count(F.lit(1)).alias(f"L{f}"),
                                  F.sum(F.col("_m") ** 2).alias(f"M{f}"), F.sum(F.col("_nn") / F.col("_m")).alias(f"K{f}"))
    g = cells.groupBy(*by).agg(F.sum("_n").alias("N"), F.count(F.lit(1)).alias("C"), F.sum("_s").alias("S"), F.sum("_q").alias("T0"),
                               F.sum(F.col("_s") ** 2 / F.col("_n")).alias("Tab"), F.sum(F.col("_n") ** 2).alias("_nn"))
    g = join_on(join_on(g, side("_a"), by), side("_b"), by)
    N, C, Tm = F.col("N"), F.col("C"), F.col("S") ** 2 / F.col("N")
    k1, k2, k12 = F.col("M_a") / N, F.col("M_b") / N, F.col("_nn") / N
    ka, kb, A, B = F.col("K_a"), F.col("K_b"), F.col("L_a"), F.col("L_b")
    replicated = N > C
    e = F.when(replicated, (F.col("T0") - F.col("Tab")) / (N - C)).otherwise(0.0)
    m = [[N - k1, ka - k2, ka - k12], [kb - k1, N - k2, kb - k12], [k1 - kb, k2 - ka, N - ka - kb + k12]]
    r = [F.col("T_a") - Tm - e * (A - 1), F.col("T_b") - Tm - e * (B - 1),
         F.col("Tab") - F.col("T_a") - F.col("T_b") + Tm - e * (C - A - B + 1)]
    wide = g.select(*by, N.cast("long").alias("n"), C.cast("long").alias("n_cells"), replicated.alias("_rep"), e.alias("_e"),
                    ((A > 1) & (B > 1)).alias("_two"), *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)],
                    *[r[i].alias(f"r{i}") for i in range(3)])

    def det(x: list[list[Column]]) -> Column:
        return (x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1]) - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0])
                + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0]))
    mm = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    d = det(mm)
    sound = F.col("_two") & (F.abs(d) > F.col("n") ** 3 * 1e-12)
    sol = [F.when(sound, det([[F.col(f"r{i}") if j == k else mm[i][j] for j in range(3)] for i in range(3)]) / d) for k in range(3)]
    out = wide.select(*by, "n", "n_cells", sol[0].alias(f"comp_{a}"), sol[1].alias(f"comp_{b}"),
                      F.when(F.col("_rep"), sol[2]).alias("comp_interaction"),
                      F.when(F.col("_rep"), F.col("_e")).otherwise(sol[2]).alias("comp_residual"))
    parts = [a, b, "interaction", "residual"]
    cut = {p: F.greatest(F.col(f"comp_{p}"), F.lit(0.0)) for p in parts}
    total = sum((F.coalesce(cut[p], F.lit(0.0)) for p in parts), F.lit(0.0))
    return out.select("*", *[F.when(F.col(f"comp_{a}").isNotNull(), F.try_divide(cut[p], total)).alias(f"share_{p}") for p in parts])
