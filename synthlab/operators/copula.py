"""Gaussian copula over mixed columns (G2) and class-targeted sampling (G3): one fit for all classes.

A fit takes three aggregates over the table, whatever the number of classes and columns:

1. text, boolean and date columns become codes in the order of their values (``ordinal_codes``);
2. every (class, column) has a mergeable quantile sketch: ``GRID`` observed values at the middles of
   equal shares, one rule for columns of few and of many values, so no value is invented and whole
   numbers stay whole;
3. normal scores of rows (the middle of a value's place in its sketch) are summed to counts, sums
   and products of every (class, column, column), over the rows that have both values.

The correlations of the pairwise-complete sums need not form a possible matrix; the nearest one is
found by alternating projections on the driver (columns x columns of each class).  Drawing a row
takes hash normals of its id and the tables of its class, with no shuffle at all.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from synthlab.functions.exprs import join_on
from synthlab.functions.keys import hash_normal, hash_uniform
from synthlab.operators.ordered import global_rank
from synthlab.session import materialise

#: observed values in a sketch; a value of a smaller share than 1 / GRID may be missed
GRID = 2000
#: rows of a table of codes that is broadcast; a larger one is joined by shuffle
BROADCAST_CODES = 100_000


# ---- normal distribution --------------------------------------------------------------------

# fixed values: coefficients of Acklam's rational approximation (relative error below 1.2e-9)
_CENTRE = ([-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00],
           [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01, 1.0])
_TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00],
         [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0])
_TAIL_BELOW = 0.02425
# fixed values: coefficients of Abramowitz and Stegun 26.2.17 (error below 7.5e-8)
_CDF_STEP, _CDF = 0.2316419, [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0]


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution, 0 < u < 1."""
    lower = np.minimum(u, 1 - u)
    q = np.sqrt(-2 * np.log(np.minimum(lower, _TAIL_BELOW)))
    tail = np.polyval(_TAIL[0], q) / np.polyval(_TAIL[1], q)
    d = np.clip(u, _TAIL_BELOW, 1 - _TAIL_BELOW) - 0.5
    centre = np.polyval(_CENTRE[0], d * d) * d / np.polyval(_CENTRE[1], d * d)
    return np.where(lower >= _TAIL_BELOW, centre, np.where(u < 0.5, tail, -tail))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    a = np.abs(z)
    upper = np.exp(-a * a / 2) / math.sqrt(2 * math.pi) * np.polyval(_CDF, 1 / (1 + _CDF_STEP * a))
    return np.where(z >= 0, 1 - upper, upper)


def nearest_correlation(a: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Nearest positive definite matrix with ones on the diagonal, by alternating projections onto
    the positive definite matrices (with Dykstra's correction) and onto a unit diagonal."""
    y, correction = (a + a.T) / 2, np.zeros_like(a)
    for _ in range(rounds):
        r = y - correction
        values, axes = np.linalg.eigh(r)
        if values[0] >= 1e-8 and not correction.any():
            return y
        x = (axes * np.maximum(values, 1e-8)) @ axes.T
        correction = x - r
        y = x.copy()
        np.fill_diagonal(y, 1.0)
        if np.abs(y - x).max() < 1e-9:
            break
    scale = 1 / np.sqrt(np.diag(x))
    return x * np.outer(scale, scale)


# ---- fit ------------------------------------------------------------------------------------

@dataclass
class Tables:
    """What one class is drawn from: sketches, shares of nulls and a factor of the correlations."""
    values: np.ndarray                       # columns x GRID
    nulls: np.ndarray                        # share of nulls of each column
    factor: np.ndarray                       # lower triangular


@dataclass
class Fit:
    """A fitted copula; ``classes`` in ascending order with their numbers of rows."""
    features: list[str]
    types: dict[str, str]
    classes: list
    counts: list[int]
    tables: list[Tables]
    by_class: bool
    codes: DataFrame | None = None
    texts: list[str] = field(default_factory=list)


def text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not isinstance(df.schema[c].dataType, NumericType)]


def ordinal_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, value string, code double): codes of the distinct values of all ``columns`` in the order
    of (column, value), by one long-form aggregate and one distributed rank."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "col", "value")
    distinct = long.where("value is not null").distinct().withColumn("_o", F.struct("col", "value"))
    return materialise(global_rank(distinct, "_o").select("col", "value", F.col("code").cast("double").alias("code")), "codes")


def _coded(df: DataFrame, keep: Sequence[str], columns: Sequence[str], texts: Sequence[str], codes: DataFrame | None) -> DataFrame:
    """``keep`` and ``columns``, all of these doubles; NULL and NaN become NULL."""
    out = df.select(*keep, *columns)
    if texts:
        small = codes.count() <= BROADCAST_CODES
        for c in texts:
            own = codes.where(F.col("col") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
            own = F.broadcast(own) if small else own
            out = out.join(own, out[c].cast("string") == F.col("_v"), "left").withColumn(c, F.col("_code")).drop("_v", "_code")
    return out.select(*keep, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])


def _scores(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Normal scores: the middle of each value's place among the sketch's values; NaN stays."""
    place = (np.searchsorted(values, x, "left") + np.searchsorted(values, x, "right")) / 2
    z = normal_quantile(np.clip(place / len(values), 0.5 / len(values), 1 - 0.5 / len(values)))
    return np.where(np.isnan(x), np.nan, z)


def fit_copula(train: DataFrame, features: Sequence[str], target: str, by_class: bool = False) -> Fit:
    """Fit one copula of the features and the class (``by_class``: one of the features within each
    class, all in the same jobs).

    Features may be numbers (fitted as doubles), text, booleans or dates, with NULLs (NaN counts as
    NULL).  Rows without a class are left out.  A column without values is drawn as NULL.
    """
    features = list(features)
    train = train.where(F.col(target).isNotNull())
    texts = text_columns(train, features)
    codes = ordinal_codes(train, texts) if texts else None
    coded = _coded(train, [target], features, texts, codes)
    if texts:
        coded = materialise(coded, "coded")
    sizes = {r[0]: r[1] for r in train.groupBy(target).agg(F.count(F.lit(1))).collect()}
    classes = sorted(sizes)
    fit = Fit(features, {c: train.schema[c].dataType.simpleString() for c in [*features, target]}, classes,
              [sizes[c] for c in classes], [], by_class, codes, texts)
    if not classes:
        return fit
    # 2: sketches, one aggregate for all classes and columns
    shares = [(i + 0.5) / GRID for i in range(GRID)]
    group = [target] if by_class else []
    sketches = coded.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{i}") for i, c in enumerate(features)],
        *[F.percentile_approx(c, shares, 10 * GRID).alias(f"_q_{i}") for i, c in enumerate(features)]).collect()
    by_key = {r[target] if by_class else None: r for r in sketches}
    order = classes if by_class else [None]
    found = {k: np.array([by_key[k][f"_q_{i}"] or [np.nan] * GRID for i in range(len(features))]).reshape(len(features), GRID)
             for k in order}
    nulls = {k: np.array([1 - by_key[k][f"_n_{i}"] / by_key[k]["_rows"] for i in range(len(features))]) for k in order}
    # middle of each class's place among the rows, for the class as a column of the copula
    ends = np.cumsum(fit.counts)
    middles = {c: z for c, z in zip(classes, normal_quantile((ends - np.array(fit.counts) / 2) / ends[-1]).tolist())}
    width = len(features) + (0 if by_class else 1)

    # 3: grouped second moments, one aggregate
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            raw = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1) \
                if features else np.zeros((batch.num_rows, 0))
            keys = np.array([order.index(c) for c in labels]) if by_class else np.zeros(len(labels), int)
            for k in np.unique(keys):
                rows = np.flatnonzero(keys == k)
                z = np.stack([_scores(raw[rows, i], found[order[k]][i]) for i in range(len(features))], 1) \
                    if features else np.zeros((len(rows), 0))
                if not by_class:
                    z = np.concatenate([np.array([[middles[labels[r]]] for r in rows]), z], 1)
                there = ~np.isnan(z)
                z, m = np.where(there, z, 0.0), there.astype(float)
                part = np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(part.size, k, np.int64)), pa.array(np.arange(part.size)), pa.array(part.ravel())], ["k", "i", "s"])
    added = coded.mapInArrow(moments, "k bigint, i bigint, s double").groupBy("k", "i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((len(order), 4 * width * width))
    for r in added:                                    # classes x columns x columns
        total[r["k"], r["i"]] = r["s"]
    for k, key in enumerate(order):
        n, s, ss, p = total[k].reshape(4, width, width)
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = p / n - (s / n) * (s / n).T
            var = ss / n - (s / n) ** 2
            corr = np.nan_to_num(cov / np.sqrt(var * var.T), posinf=0.0, neginf=0.0)
        corr = np.clip(corr, -1, 1)
        np.fill_diagonal(corr, 1.0)
        fit.tables.append(Tables(found[key], nulls[key], np.linalg.cholesky(nearest_correlation(corr) + 1e-9 * np.eye(width))))
    return fit


# ---- draw -----------------------------------------------------------------------------------

def largest_remainders(weights: Sequence[float], n: int) -> list[int]:
    """Whole quotas in proportion to ``weights`` that add up to n; ties go to the first."""
    total = sum(weights)
    exact = [w * n / total for w in weights]
    quotas = [math.floor(x) for x in exact]
    order = sorted(range(len(exact)), key=lambda i: (quotas[i] - exact[i], i))
    for i in order[:n - sum(quotas)]:
        quotas[i] += 1
    return quotas


def spread_step(n: int) -> int:
    """A step prime to n: multiples of it, modulo n, visit every place and are spread evenly, so
    that every prefix of the ids has all classes in proportion."""
    step = max(1, round(min(n, 1 << 30) * 0.6180339887498949))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def draw_copula(spark: SparkSession, fit: Fit, target: str, quotas: Sequence[int], seed) -> DataFrame:
    """(syn_rank 1..n, features, target): ``quotas`` rows of each class, mixed over the ranks."""
    n, features = int(sum(quotas)), fit.features
    kinds = [f"{_quoted(c)} double" for c in features]
    if not n or not fit.classes:
        kinds = [f"{_quoted(c)} {fit.types[c] if c in [*fit.texts, target] else 'double'}" for c in [*features, target]]
        return spark.createDataFrame([], ", ".join(["syn_rank bigint", *kinds]))
    stops, step, tables, by_class = np.cumsum(quotas), spread_step(n), fit.tables, fit.by_class
    ends = np.cumsum(fit.counts) / sum(fit.counts)
    some_null = [i for i in range(len(features)) if any(t.nulls[i] > 0 for t in fit.tables)]
    width = len(features) + (0 if fit.by_class else 1)
    ids = spark.range(0, n).select(
        "id", F.array(*[hash_normal(["id"], f"{seed}:e{j}") for j in range(width)]).alias("e"),
        F.array(*[hash_uniform(["id"], f"{seed}:null:{i}") for i in some_null], hash_uniform(["id"], f"{seed}:class")).alias("u"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            place = (at % n) * step % n
            label = np.searchsorted(stops, place, "right")
            e = batch.column(1).flatten().to_numpy().reshape(len(at), width).copy()
            u = batch.column(2).flatten().to_numpy().reshape(len(at), -1)
            if not by_class:                       # the class's own score: a place within its share
                low = np.append(0, ends[:-1])[label]
                e[:, 0] = normal_quantile(np.clip(low + (ends[label] - low) * u[:, -1], 1e-12, 1 - 1e-12))
            out = np.full((len(at), len(features)), np.nan)
            for k in np.unique(label):
                t = tables[k if by_class else 0]
                rows = np.flatnonzero(label == k)
                z = (e[rows] @ t.factor.T)[:, width - len(features):]
                index = np.clip((normal_cdf(z) * GRID).astype(np.int64), 0, GRID - 1)
                for i in range(len(features)):
                    out[rows, i] = t.values[i][index[:, i]]
                for j, i in enumerate(some_null):
                    out[rows[u[rows, j] < t.nulls[i]], i] = np.nan
            yield pa.RecordBatch.from_arrays(
                [pa.array(at + 1), pa.array(label.astype(np.int32)), *(pa.array(out[:, i], mask=np.isnan(out[:, i])) for i in range(len(features)))],
                ["syn_rank", "_label", *features])
    rows = ids.mapInArrow(draw, ", ".join(["syn_rank bigint", "_label int", *kinds]))
    names = reduce(lambda acc, kv: acc.when(F.col("_label") == kv[0], F.lit(kv[1])), enumerate(fit.classes[1:], 1),
                   F.when(F.col("_label") == 0, F.lit(fit.classes[0])))
    rows = rows.withColumn("_label", names.cast(fit.types[target]))
    if fit.texts:
        small = fit.codes.count() <= BROADCAST_CODES
        for c in fit.texts:
            own = fit.codes.where(F.col("col") == c).select(F.col("code").alias("_code"), F.col("value").alias("_v"))
            rows = rows.join(F.broadcast(own) if small else own, rows[c] == F.col("_code"), "left")
            rows = rows.withColumn(c, F.col("_v").cast(fit.types[c])).drop("_code", "_v")
    return rows.select("syn_rank", *features, F.col("_label").alias(target))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def gaussian_copula(train: DataFrame, key: str, features: Sequence[str], target: str, n: int, seed,
                    fit: Fit | None = None) -> DataFrame:
    """N rows with the class as a column of the copula.  A row's class is its place among the class
    shares, drawn evenly, so each class has its share of ``n`` to within one row, in every prefix of the
    ranks nearly so.  A ``fit`` may be shared by several seeds."""
    fit = fit or fit_copula(train, features, target)
    total = sum(fit.counts)
    stops = [(2 * int(c) * int(n) + total) // (2 * total) for c in np.cumsum(fit.counts)]
    stops[-1:] = [int(n)] if stops else []
    return draw_copula(train.sparkSession, fit, target, np.diff([0, *stops]).tolist(), seed)


def class_quotas(fit: Fit, n: int, pos_share: float | None = None) -> list[int]:
    """Rows of each class, log(1 + count) each in proportion (the sampling of conditional
    generators); with ``pos_share`` class 1 has that share and the others divide the rest so."""
    weights = [math.log1p(c) for c in fit.counts]
    if pos_share is not None:
        rest = sum(w for c, w in zip(fit.classes, weights) if c != 1)
        weights = [pos_share if c == 1 else (1 - pos_share) * w / rest for c, w in zip(fit.classes, weights)]
    return largest_remainders(weights, int(n)) if weights else []


def bootstrap_by_class(train: DataFrame, key: str, features: Sequence[str], target: str, quotas: dict, seed,
                       sigma: float = 0.1) -> DataFrame:
    """Rows drawn with replacement within each class, with N(0, (sigma * sd of the class)^2) noise on
    each feature; one job for all classes."""
    from synthlab.operators.sampling import hash_rank
    spark, n = train.sparkSession, int(sum(quotas.values()))
    classes = sorted(quotas)
    stops, step = [0, *np.cumsum([quotas[c] for c in classes]).tolist()], spread_step(max(n, 1))
    own = train.where(F.col(target).isin(classes))
    ranked = hash_rank(own, [key], seed, by=[target], name="_idx").withColumn("_idx", F.col("_idx") - 1)
    stats = own.groupBy(target).agg(F.count(F.lit(1)).alias("_m"), *[F.stddev_samp(c).alias(f"_sd_{i}") for i, c in enumerate(features)])
    place = F.col("id") * F.lit(step) % F.lit(max(n, 1))
    label = reduce(lambda acc, kv: F.when(place >= F.lit(kv[0]), F.lit(kv[1])).otherwise(acc), zip(stops[1:], classes[1:]), F.lit(classes[0]))
    kind = train.schema[target].dataType
    ids = spark.range(0, n).select(F.col("id").alias("_i"), label.cast(kind).alias(target))
    u = hash_uniform(["_i"], f"{seed}:pick")
    picks = join_on(ids, stats, [target], broadcast=True).withColumn(         # one row per class
        "_idx", F.least(F.floor(u * F.col("_m")).cast("long"), F.col("_m") - 1))
    drawn = join_on(picks, ranked.select(target, "_idx", *features), [target, "_idx"])
    noisy = [(F.col(c) + F.lit(sigma) * F.coalesce(F.col(f"_sd_{i}"), F.lit(0.0)) * hash_normal(["_i"], f"{seed}:{c}")).alias(c)
             for i, c in enumerate(features)]
    return drawn.select((F.col("_i") + 1).alias("syn_rank"), *noisy, target)


def class_targeted(train: DataFrame, key: str, features: Sequence[str], target: str, n: int, seed,
                   pos_share: float | None = None, generator: str = "copula", fit: Fit | None = None) -> DataFrame:
    """Class mix shifted toward the minority (``class_quotas``; the quotas add up to n), then rows
    drawn within each class by ``copula`` or ``bootstrap``, all classes in the same jobs.  Rows
    without a class are left out.  A ``fit`` (by class) may be shared by several seeds."""
    if generator == "copula":
        fit = fit or fit_copula(train, features, target, by_class=True)
        return draw_copula(train.sparkSession, fit, target, class_quotas(fit, n, pos_share), seed)
    if generator != "bootstrap":
        raise ValueError("generator is copula or bootstrap")
    counts = {r[0]: r[1] for r in train.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1))).collect()}
    plain = Fit(list(features), {}, sorted(counts), [counts[c] for c in sorted(counts)], [], True)
    return bootstrap_by_class(train, key, features, target, dict(zip(plain.classes, class_quotas(plain, n, pos_share))), seed)
