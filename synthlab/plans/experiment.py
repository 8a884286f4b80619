"""Experiment runners (E1-E8 E14): compositions of the operators.

A cell = (dataset, n, seed, generator, condition, alpha, classifier).  Each cell is a lazy plan
(split -> generate -> union -> fit -> score -> metric aggregate); the driver loops over the small
parameter grid and every heavy step runs on the cluster.  A generator is fitted once per
(seed, generator) at the largest size and every alpha reads a prefix (G6).  A failing cell becomes
a row with NULL metrics and the error text (E14); resumed runs skip valid cells (J6, T8).  With a
``journal`` each finished cell is on disk at once and is not run again by a later run; ``parallel``
cells run side by side.
"""
from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlab.functions.exprs import join_on
from synthlab.operators import generate as G
from synthlab.operators import sampling as S
from synthlab.operators.metrics import balanced_weights, regression_metrics
from synthlab.operators.prep import align_columns
from synthlab.operators.report import recovery
from synthlab.plans.journal import KEY, RESULT_SCHEMA, Journal, side_by_side
from synthlab.plans.models import classification_metrics, fit_score, fit_score_regression
from synthlab.session import materialise

ALPHAS = S.ALPHAS


@dataclass
class Dataset:
    """Loader contract (df, key, target, task, name)."""
    df: DataFrame
    key: str
    target: str
    task: str
    name: str
    features: Sequence[str]


Generator = Callable[[DataFrame, Dataset, int, int], DataFrame]


def gen_smote(train: DataFrame, ds: Dataset, n: int, seed: int) -> DataFrame:
    return G.smote(train, ds.key, ds.features, ds.target, n, seed)


def gen_bootstrap(train: DataFrame, ds: Dataset, n: int, seed: int) -> DataFrame:
    return G.bootstrap_jitter(train, ds.key, ds.features, ds.target, n, seed)


def gen_copula(train: DataFrame, ds: Dataset, n: int, seed: int) -> DataFrame:
    return G.gaussian_copula(train, ds.key, ds.features, ds.target, n, seed)


def gen_class_targeted(train: DataFrame, ds: Dataset, n: int, seed: int) -> DataFrame:
    return G.class_targeted(train, ds.key, ds.features, ds.target, n, seed)


GENERATORS: dict[str, Generator] = {"smote": gen_smote, "bootstrap": gen_bootstrap, "copula": gen_copula,
                                    "class_targeted": gen_class_targeted}


def _row(ds: Dataset, n: int, seed: int, method: str, condition: str, alpha, classifier: str,
         metrics: dict | None = None, error: str | None = None) -> tuple:
    m = metrics or {}
    return (ds.name, int(n), int(seed), method, condition, alpha, classifier, m.get("auc_roc"), m.get("f1_minority"),
            m.get("avg_precision"), m.get("mape"), m.get("r2"), error[:200] if error else None)


def _evaluate(train: DataFrame, test: DataFrame, ds: Dataset, classifier: str, seed: int,
              weight_col: str | None = None) -> dict:
    if ds.task == "classification":
        scored = fit_score(train, test, ds.features, ds.target, classifier, seed, weight_col)
        return classification_metrics(scored, ds.target).first().asDict()
    pred = fit_score_regression(train.withColumn(ds.target, F.col(ds.target).cast("double")),
                                test.withColumn(ds.target, F.col(ds.target).cast("double")), ds.features, ds.target, seed)
    return regression_metrics(pred, ds.target, "yhat").first().asDict()


def _cell(fn: Callable[[], dict], *row_args, journal: Journal | None = None) -> tuple:
    """Run one cell; an exception becomes a row with NULL metrics and the error text.  A cell that
    the journal holds is not run."""
    if journal is not None and (old := journal.find(_row(*row_args)[:KEY])) is not None:
        return old
    try:
        row = _row(*row_args, metrics=fn())
    except Exception as e:  # noqa: BLE001 - a failed cell is data, the run continues
        row = _row(*row_args, error=f"{type(e).__name__}: {e}".strip() or traceback.format_exc(limit=1))
    if journal is not None:
        journal.add(row)
    return row


def _generate(g: str, train: DataFrame, ds: Dataset, n: int, seed: int) -> DataFrame | Exception:
    """The written synthetic table, or why there is none: its cells turn that into error rows."""
    try:
        return materialise(GENERATORS[g](train, ds, n, seed))
    except Exception as e:  # noqa: BLE001
        return e


def split(ds: Dataset, seed: int, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    cols = [ds.key, *ds.features, ds.target]
    base = ds.df.select(*cols)
    s = (S.stratified_split(base, [ds.key], ds.target, seed, test_size) if ds.task == "classification"
         else S.random_split(base, [ds.key], seed, test_size))
    s = materialise(s)
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


def run_experiment(ds: Dataset, generators: Sequence[str] = ("smote", "bootstrap"), alphas: Sequence[float] = ALPHAS,
                   seed: int = 42, classifiers: Sequence[str] = ("gbc",), tstr: bool = True,
                   rounding: str = "floor", journal: Journal | None = None, parallel: int = 1) -> list[tuple]:
    """E1 (+E3/E4 when called per seed): baseline, TSTR and the alpha sweep."""
    spark = ds.df.sparkSession
    train, test = split(ds, seed)
    n_train = train.count()
    classes = ds.task == "classification"
    if not classes:
        classifiers = ("gbr",)
    used = [g for g in generators if classes or g != "smote"]
    cells = [("baseline", "real_only", None, clf) for clf in classifiers]
    for g in used:
        for clf in classifiers:
            if tstr and g != "smote":  # SMOTE is minority-only: no TSTR (P1)
                cells.append((g, "synthetic_only", None, clf))
            cells += [(g, "augmented", a, clf) for a in alphas]

    def at(method, condition, alpha, clf) -> tuple:
        return ds, n_train, seed, method, condition, alpha, clf
    pending = [g for g in used if journal is None or any(journal.find(_row(*at(*c))[:KEY]) is None for c in cells if c[0] == g)]
    tables = dict(zip(pending, side_by_side(spark, [
        lambda g=g: _generate(g, train, ds, max(S_round(max(alphas) * n_train, rounding), n_train if tstr and g != "smote" else 0), seed)
        for g in pending], parallel)))
    cols = [ds.key, *ds.features, ds.target]

    def evaluate(method, condition, alpha, clf) -> dict:
        if method == "baseline":
            return _evaluate(train, test, ds, clf, seed)
        if isinstance(tables[method], Exception):
            raise tables[method]
        n_syn = n_train if condition == "synthetic_only" else S_round(alpha * n_train, rounding)
        if n_syn == 0:  # T11: nothing to add, the cell equals the baseline
            raise ValueError("alpha * n rounds to 0 rows")
        # Synthetic rows reindexed to the training columns (the key, absent, becomes 0)
        syn = align_columns(tables[method], train.select(*cols), extra=["syn_rank"])
        syn = syn.filter(F.col("syn_rank") <= n_syn).select(*cols)
        mix = syn if condition == "synthetic_only" else train.select(*cols).unionByName(syn)
        return _evaluate(mix, test, ds, clf, seed)
    return side_by_side(spark, [lambda c=c: _cell(lambda: evaluate(*c), *at(*c), journal=journal) for c in cells], parallel)


def S_round(x: float, rounding: str) -> int:
    """T4: floor or half-even rounding of alpha * n."""
    import math
    return int(math.floor(x)) if rounding == "floor" else int(round(x))


def results_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def run_ci(ds: Dataset, seeds: Sequence[int], **kw) -> list[tuple]:
    """The experiment for every seed."""
    out = []
    for s in seeds:
        out.extend(run_experiment(ds, seed=s, **kw))
    return out


def experiment_grid(spark: SparkSession, datasets: Sequence[str], seeds: Sequence[int], classifiers: Sequence[str],
                    methods: Sequence[str] = ("baseline",), alphas: Sequence[float | None] = (None,)) -> DataFrame:
    """The experiment grid (cross product of small parameter lists) as chained explodes of
    literal arrays in one single-partition relation -- no join, so no partition cross product."""
    g = spark.range(1).select()
    for name, vals, typ in [("dataset", datasets, "string"), ("seed", seeds, "int"), ("classifier", classifiers, "string"),
                            ("method", methods, "string"), ("alpha", alphas, "double")]:
        arr = F.array(*[F.lit(v).cast(typ) for v in vals])
        g = g.withColumn(name, F.explode(arr))
    return g


def run_multi_classifier(spark: SparkSession, ds: Dataset, seeds: Sequence[int], classifiers: Sequence[str],
                         done: DataFrame | None = None, **kw) -> DataFrame:
    """Seeds x classifiers with resume.  Pending (seed, classifier) cells = grid anti-join the
    cells of ``done`` that have a valid method row at the largest alpha (J6, T8: a baseline row alone
    does not finish a cell)."""
    todo = [(s, c) for s in seeds for c in classifiers]
    if done is not None:
        alphas = kw.get("alphas", ALPHAS)
        grid = experiment_grid(spark, [ds.name], seeds, classifiers)
        ok = (done.filter((F.col("alpha") == max(alphas)) & F.col("auc_roc").isNotNull() & F.col("error").isNull())
              .select("dataset", "seed", "classifier"))
        pending = grid.join(ok, ["dataset", "seed", "classifier"], "left_anti").select("seed", "classifier")
        todo = sorted((r["seed"], r["classifier"]) for r in pending.collect())  # bounded by the grid
    rows = []
    for s in sorted({s for s, _ in todo}):      # one split and one fit of each generator for all classifiers of a seed
        rows.extend(run_experiment(ds, seed=s, classifiers=tuple(c for t, c in todo if t == s), **kw))
    return results_frame(spark, rows)


def run_small_n(ds: Dataset, ns: Sequence[int], seeds: Sequence[int], holdout_n: int, generators=("bootstrap",),
                alpha: float | Sequence[float] | dict[str, float] = 1.0, classifier: str = "gbc",
                stratified: bool = True, journal: Journal | None = None, parallel: int = 1) -> list[tuple]:
    """Fixed stratified holdout, small-n draws from the pool (no leakage, T1), augmentation with
    one alpha, several, or one for each generator named (1 for the others).  Draws run side by side."""
    cols = [ds.key, *ds.features, ds.target]
    base = ds.df.select(*cols)
    classes = ds.task == "classification"      # a continuous target has no classes to stratify by
    hold = materialise(S.fixed_holdout(base, [ds.key], ds.target, holdout_n, 42) if classes
                       else S.cap(base, [ds.key], holdout_n, 42))
    pool = S.pool_without(base, hold, [ds.key])
    def alphas_of(g: str) -> list[float]:
        own = alpha.get(g, 1.0) if isinstance(alpha, dict) else alpha
        return list(own) if isinstance(own, (list, tuple)) else [own]
    used = [g for g in generators if classes or g != "smote"]

    def draw(n: int, s: int) -> list[tuple]:
        def at(g: str, a: float | None) -> tuple:
            return ds, n, s, g, "real_only" if a is None else "augmented", a, classifier
        cells = [("baseline", None), *((g, a) for g in used for a in alphas_of(g))]
        old = [journal.find(_row(*at(*c))[:KEY]) if journal is not None else None for c in cells]
        if all(r is not None for r in old):
            return old
        tr = materialise(S.small_n_stratified(pool, [ds.key], ds.target, n, s) if stratified and classes
                         else S.small_n(pool, [ds.key], n, s))
        if classes and tr.select(ds.target).distinct().count() < 2:  # D14
            return [_row(*at("baseline", None), error="single class in training sample")]
        tables = {}

        def evaluate(g: str, a: float | None) -> dict:
            if a is None:
                return _evaluate(tr, hold, ds, classifier, s)
            if g not in tables:
                tables[g] = _generate(g, tr, ds, max(S_round(max(alphas_of(g)) * n, "half_even"), 1), s)
            if isinstance(tables[g], Exception):
                raise tables[g]
            syn = tables[g].withColumn(ds.key, F.lit(None).cast(dict(tr.dtypes)[ds.key]))
            mix = tr.unionByName(syn.filter(F.col("syn_rank") <= S_round(a * n, "half_even")).select(*cols))
            return _evaluate(mix, hold, ds, classifier, s)
        return [_cell(lambda: evaluate(*c), *at(*c), journal=journal) for c in cells]
    drawn = side_by_side(ds.df.sparkSession, [lambda n=n, s=s: draw(n, s) for n in ns for s in seeds], parallel)
    return [row for rows in drawn for row in rows]


def run_balanced(ds: Dataset, seed: int = 42, classifier: str = "gbc", parallel: int = 1) -> list[tuple]:
    """Baseline vs class-weighted (n / (k * n_class)) fit on the same split."""
    train, test = split(ds, seed)
    n = train.count()
    w = balanced_weights(train, ds.target)
    return side_by_side(ds.df.sparkSession, [
        lambda: _cell(lambda: _evaluate(train, test, ds, classifier, seed), ds, n, seed, "baseline", "real_only", None, classifier),
        lambda: _cell(lambda: _evaluate(w, test, ds, classifier, seed, weight_col="weight"), ds, n, seed, "class_weighted",
                      "real_only", None, classifier),
    ], parallel)


def run_low_data(ds: Dataset, sizes: Sequence[int], seed: int = 42, generators=("smote", "bootstrap"),
                 holdout_frac: float = 0.2, classifier: str = "gbc", **kw) -> list[tuple]:
    """For each n (< 0.7 rows), real-only vs n more rows by each generator, 2n more by the
    class-targeted one, on a fixed holdout."""
    total = ds.df.count()
    return run_small_n(ds, [n for n in sizes if n < 0.7 * total], [seed], int(holdout_frac * total), generators,
                       alpha={"class_targeted": 2.0}, classifier=classifier, **kw)


def run_sparse(ds: Dataset, rate: float, seed: int = 42, generators=("bootstrap",), alphas=(0.5,),
               classifiers: Sequence[str] = ("gbc",), journal: Journal | None = None, parallel: int = 1) -> list[tuple]:
    """Dense baseline, sparse baseline (cells zeroed at ``rate``) and sparse + augmentation."""
    kw = {"seed": seed, "tstr": False, "classifiers": classifiers, "journal": journal, "parallel": parallel}
    dense = run_experiment(ds, generators=(), **kw)
    sp = Dataset(S.sparsify(ds.df, [ds.key], ds.features, rate, seed), ds.key, ds.target, ds.task, ds.name + "_sparse",
                 ds.features)
    return dense + run_experiment(sp, generators=generators, alphas=alphas, **kw)


def sparse_recovery(results: DataFrame) -> DataFrame:
    """A row per (dataset, seed, classifier, method) of ``run_sparse`` results: dense and sparse baseline AUC,
    the best augmented AUC and the percentage of the loss it recovers.  Cells without a metric are NULL."""
    base = results.withColumn("_sparse", F.col("dataset").endswith("_sparse")) \
        .withColumn("dataset", F.regexp_replace("dataset", "_sparse$", ""))
    at = ["dataset", "seed", "classifier"]
    real = base.filter("method = 'baseline'").groupBy(*at).agg(
        F.max(F.when(~F.col("_sparse"), F.col("auc_roc"))).alias("dense_auc"),
        F.max(F.when(F.col("_sparse"), F.col("auc_roc"))).alias("sparse_auc"))
    best = base.filter("method <> 'baseline' AND _sparse").groupBy(*at, "method").agg(F.max("auc_roc").alias("best_auc"))
    return join_on(best, real, at).withColumn(
        "recovery_pct", recovery(F.col("dense_auc"), F.col("sparse_auc"), F.col("best_auc")))
