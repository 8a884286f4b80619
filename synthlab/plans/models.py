"""Model registry on Spark MLlib (M1-M7) and scoring into the metric operators (M8 M9)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthlab.operators import forest as T
from synthlab.operators import metrics as M
from synthlab.session import materialise

# fixed values: model settings of the reference runs
GBT_TREES, GBT_DEPTH, GBT_STEP = 100, 4, 0.1
LR_ITER = 500
RF_TREES, RF_DEPTH = 200, 30          # MLlib's depth limit is 30 ("unlimited" in the reference)
MLP_HIDDEN, MLP_ITER = (64, 32), 200

CLASSIFIERS = ("gbc", "lr", "rf", "mlp")

#: training rows of one task; MLlib keeps a task's rows in memory and every task sends statistics of every tree node
ROWS_PER_TASK = 1 << 16
#: fewer rows than this are not worth a task of their own, even where a core is idle
LEAST_ROWS = 1 << 13


def dealt(train: DataFrame, rows: int) -> DataFrame:
    """``train`` (``rows`` rows) in equal parts of at most ``ROWS_PER_TASK`` rows, however its files are
    cut: no task of a fit grows with the input, and a small table is not spread over more tasks than cores."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.repartition(max(1, -(-rows // ROWS_PER_TASK), min(cores, -(-rows // LEAST_ROWS))))


def classifier(name: str, features: Sequence[str], label: str, seed: int = 42, n_train: float | None = None,
               weight_col: str | None = None) -> Pipeline:
    """M6: pipeline by name; unknown names raise.  ``n_train`` is the number of training rows, or their total weight."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")
    if name == "gbc":
        est = GBTClassifier(featuresCol="_raw", labelCol=label, maxIter=GBT_TREES, maxDepth=GBT_DEPTH,
                            stepSize=GBT_STEP, seed=seed)
        if weight_col:
            est.setWeightCol(weight_col)
        return Pipeline(stages=[assemble, est])
    if name == "lr":
        # L2 with C = 1 in a per-sample-mean loss is regParam = 1 / n; the mean is one by weight
        reg = 1.0 / max(n_train or 1, 1)
        scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)
        est = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=LR_ITER, regParam=reg, elasticNetParam=0.0)
        if weight_col:      # the penalty is on the columns as scaled above, not scaled again by weight
            est.setWeightCol(weight_col).setStandardization(False)
        return Pipeline(stages=[assemble, scale, est])
    if name == "rf":
        est = RandomForestClassifier(featuresCol="_raw", labelCol=label, numTrees=RF_TREES, maxDepth=RF_DEPTH, seed=seed)
        if weight_col:
            est.setWeightCol(weight_col)
        return Pipeline(stages=[assemble, est])
    if name == "mlp":
        if weight_col:
            raise ValueError("mlp takes no weights")
        scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)
        est = MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label,
                                             layers=[len(features), *MLP_HIDDEN, 2], maxIter=MLP_ITER, seed=seed)
        return Pipeline(stages=[assemble, scale, est])
    raise ValueError(f"unknown classifier {name!r}; known: {CLASSIFIERS}")


def regressor(features: Sequence[str], label: str, seed: int = 42) -> Pipeline:
    """M2."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")
    return Pipeline(stages=[assemble, GBTRegressor(featuresCol="_raw", labelCol=label, maxIter=GBT_TREES,
                                                   maxDepth=GBT_DEPTH, stepSize=GBT_STEP, seed=seed)])


def _fit(train: DataFrame, features: Sequence[str], label: str, name: str, seed: int, weight_col: str | None, **set_params):
    """The fitted pipeline on all rows of ``train``, dealt to tasks."""
    n, total = train.agg(F.count(F.lit(1)), F.sum(weight_col) if weight_col else F.count(F.lit(1))).first()
    used = [*features, label] + ([weight_col] if weight_col else [])
    tr = dealt(train.select(*used).withColumn(label, F.col(label).cast("double")), n)
    pipeline = classifier(name, features, label, seed, n_train=total, weight_col=weight_col)
    if set_params:
        pipeline.getStages()[-1].setParams(**set_params)
    return pipeline.fit(tr)


#: MLlib looks for split points on max(10,000, this squared) rows; features have at most ``T.MAX_BINS`` values by then
SPLIT_ROWS_ROOT = 1 << 10


def _fit_score_bins(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, name: str, seed: int,
                    weight_col: str | None) -> DataFrame | None:
    """Tree fits on rows added up by bins and label: what a tree sees of them, however many rows there are.  None where a
    forest has too many different rows for a task, and for rows that are not of two classes with finite features: MLlib
    refuses those, or has more classes."""
    train = materialise(train.select(*features, label, *([weight_col] if weight_col else [])), "train")
    usual = F.col(label).isin(0, 1)
    for c in features:
        usual = usual & (F.abs(F.col(c).cast("double")) < float("inf"))         # NaN is above all
    if not train.filter(~F.coalesce(usual, F.lit(False))).isEmpty():
        return None
    cuts = T.cut_points(train, features, weight_col)
    if name == "rf":
        kept = train.select(T.packed(features, cuts).alias("_x"), F.col(label).cast("double").alias(label),
                            (F.col(weight_col).cast("double") if weight_col else F.lit(None).cast("double")).alias("_w"))
        placed = test.withColumn("_x", T.packed(features, cuts))
        scores = T.forest_scores(kept, placed, len(features), label, seed, RF_TREES, RF_DEPTH)
        if scores is None:
            return None
        return placed.join(scores, "_x").drop("_x").withColumn(label, F.col(label).cast("int"))
    named = [f"_b{i}" for i in range(len(features))]
    placed = [b.alias(c) for c, b in zip(named, T.bins(features, cuts))]
    weight = F.sum(F.col(weight_col).cast("double")) if weight_col else F.count(F.lit(1)).cast("double")
    added = materialise(train.select(*placed, label, *([weight_col] if weight_col else [])).groupBy(*named, label)
                        .agg(weight.alias("_w")), "added")
    model = _fit(added, named, label, name, seed, "_w", maxBins=SPLIT_ROWS_ROOT)
    return _scored(model, test.select("*", *placed), label).drop(*named)


def _scored(model, test: DataFrame, label: str) -> DataFrame:
    pred = model.transform(test.withColumn(label, F.col(label).cast("double")))
    return pred.withColumn("score", vector_to_array("probability")[1]).withColumn(label, F.col(label).cast("int"))


def fit_score(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, name: str = "gbc",
              seed: int = 42, weight_col: str | None = None) -> DataFrame:
    """Fit on ``train`` and return ``test`` with ``score`` = P(class 1)."""
    if name in ("gbc", "rf"):
        scored = _fit_score_bins(train, test, features, label, name, seed, weight_col)
        if scored is not None:
            return scored
    return _scored(_fit(train, features, label, name, seed, weight_col), test, label)


def classification_metrics(scored: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M8: AUC, AP and minority F1 (prediction = P(1) > 0.5) per cell."""
    a = M.auc_ap(scored, "score", label, by)
    f = M.f1_minority(scored, "score", label, by)
    return (a.join(f, list(by)) if by else a.crossJoin(F.broadcast(f))).select(*by, "auc_roc", "avg_precision", "f1_minority")


def fit_score_regression(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    model = regressor(features, label, seed).fit(dealt(train.select(*features, label), train.count()))
    return model.transform(test).withColumnRenamed("prediction", "yhat")
