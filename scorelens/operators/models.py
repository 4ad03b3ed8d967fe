"""M1-M4, M6, M7, A10: model builders, parameter grids and fold-safe stages.

All estimators are Spark ML.  Anything fitted from data -- class weights,
the descriptor scaler, the LogReg penalty that depends on the summed
weights -- is a pipeline stage, so ``CrossValidator`` re-fits it on each
inner training split and test rows never leak into it.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark import SparkContext, keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassifier)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCA, Interaction, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators import treeshap as TS
from scorelens.operators.scaling import FamilyScaler
from scorelens.session import scratch_path

SEED = 42
MAX_DEPTH_CEILING = 30  # unlimited depth maps to Spark's ceiling
WEIGHT_COL = "class_weight"
TURNED_FROM = 64  # columns from which a linear fit is worth turning its measured ones
SHORT_AXIS = 1e-6  # variance over penalty
TURNED_AXES = 1024  # most of them; their covariance is on the driver
NEWTON_COLUMNS = 63  # of many columns a Gramian costs more than the passes it saves
NEWTON_STEPS = 50
NEWTON_GAIN = 1e-10  # a step that promises less of the loss is the last
TREE_ROWS = 3_500_000  # training rows x trees grown at once: their nodes are on the driver
SEED_STEP = 1_000_003  # Spark adds the partition's number to the seed: groups stay apart
TINY = 1e-300  # added to a weight that may be 0: a sum needs one above


# ------------------------------------------------------------------ A10 class weights stage

class BalancedWeights(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """'balanced' weights n / (n_classes * n_c), counted on the rows it is fitted on."""

    outputCol = Param(Params._dummy(), "outputCol", "weight column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol="label", outputCol=WEIGHT_COL):
        super().__init__()
        self._setDefault(labelCol="label", outputCol=WEIGHT_COL)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        lab = self.getLabelCol()
        rows = dataset.groupBy(lab).count().collect()  # one row per class
        n = sum(r["count"] for r in rows)
        weights = {float(r[lab]): n / (len(rows) * r["count"]) for r in rows}
        return BalancedWeightsModel(labelCol=lab, outputCol=self.getOrDefault(self.outputCol),
                                    w0=weights.get(0.0, 1.0), w1=weights.get(1.0, 1.0))


class BalancedWeightsModel(Model, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    outputCol = Param(Params._dummy(), "outputCol", "weight column", TypeConverters.toString)
    w0 = Param(Params._dummy(), "w0", "weight of class 0", TypeConverters.toFloat)
    w1 = Param(Params._dummy(), "w1", "weight of class 1", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, labelCol="label", outputCol=WEIGHT_COL, w0=1.0, w1=1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # rows being scored may lack a label; they get weight 1 (weights only matter in fit)
        lab = F.col(self.getLabelCol()) if self.getLabelCol() in dataset.columns else F.lit(None)
        w = F.when(lab == 1, F.lit(self.getOrDefault(self.w1))) \
            .when(lab == 0, F.lit(self.getOrDefault(self.w0))).otherwise(F.lit(1.0))
        return dataset.withColumn(self.getOrDefault(self.outputCol), w)


# ------------------------------------------------------------------ M3 LogReg parameterised by C

class LogRegByC(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """L2 logistic regression with the objective 1/2 |w|^2 + C * sum_i w_i loss_i.

    Spark's objective is sum_i w_i loss_i / sum_i w_i + regParam/2 |w|^2, so
    regParam = 1 / (C * sum_i w_i): it depends on the training split's
    summed weights and is therefore fixed at fit time, per split.
    """

    C = Param(Params._dummy(), "C", "inverse regularisation strength", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weights", TypeConverters.toString)
    turned = Param(Params._dummy(), "turned", "whether it is fitted by Newton steps, or with measured columns turned",
                   TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, C=1.0, maxIter=1000, featuresCol="features", labelCol="label",
                 weightCol=WEIGHT_COL, turned=False):
        super().__init__()
        self._setDefault(C=1.0, maxIter=1000, featuresCol="features", labelCol="label",
                         weightCol=WEIGHT_COL, turned=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        wcol, lab = self.getOrDefault(self.weightCol), self.getLabelCol()
        known = dataset.agg(F.sum(wcol).alias("total"), F.count_if(F.col(lab) == 0).alias("n0"),
                            F.count_if(F.col(lab) == 1).alias("n1"), F.count(F.lit(1)).alias("n")).first()
        total = known["total"] or 1.0
        lr = LogisticRegression(
            featuresCol=self.getOrDefault(self.featuresCol), labelCol=lab,
            weightCol=wcol, regParam=1.0 / (self.getOrDefault(self.C) * total),
            elasticNetParam=0.0, standardization=False, maxIter=self.getOrDefault(self.maxIter))
        both = self.getOrDefault(self.turned) and known["n0"] and known["n1"] and known["n0"] + known["n1"] == known["n"]
        return both and (newton_fit(dataset, lr) or turned_fit(dataset, lr)) or lr.fit(dataset)


def linear_model(lr: LogisticRegression, coef: np.ndarray, intercept: float) -> LogisticRegressionModel:
    """The model of ``lr`` with given coefficients."""
    sc = SparkContext._active_spark_context
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        lr.uid, _py2java(sc, Vectors.dense(coef)), float(intercept))
    return lr._copyValues(LogisticRegressionModel(java))


def newton_fit(dataset: DataFrame, lr: LogisticRegression) -> LogisticRegressionModel | None:
    """``lr`` fitted by Newton steps, for at most ``NEWTON_COLUMNS`` columns.

    Columns that nearly follow from one another take L-BFGS over a hundred passes, each a job, however few the rows.  A
    Newton step takes two, an aggregate of the loss and its gradient and a Gramian of the weighted rows, and a handful of
    steps ends at the same optimum.  A step that does not lower the loss is halved.  None with more
    columns, or where the sums are not finite or no step is the last.
    """
    x = lr.getFeaturesCol()
    first = dataset.select(x).first()
    if first is None or first[x].size > NEWTON_COLUMNS:
        return None
    lean = dataset.select(F.col(x).alias("x"), F.col(lr.getLabelCol()).cast("double").alias("y"),
                          F.col(lr.getWeightCol()).alias("w"), F.lit(1.0).alias("one"))
    rows = VectorAssembler(inputCols=["x", "one"], outputCol="row").transform(lean).persist()
    try:
        found = _newton_steps(rows, lr, first[x].size)
    finally:
        rows.unpersist()
    return None if found is None else linear_model(lr, found[:-1], found[-1])


def _newton_steps(rows: DataFrame, lr: LogisticRegression, n: int) -> np.ndarray | None:
    """Coefficients and, last, intercept at the optimum of ``newton_fit``; ``row`` is ``x`` with a last column of 1."""
    y, w = F.col("y"), F.col("w")
    fixed = rows.agg(Summarizer.sum(F.col("row"), w * y).alias("g"), Summarizer.sum(F.col("row"), w).alias("all"),
                     F.sum(w).alias("total")).first()
    if not np.isfinite(fixed["all"].toArray()).all():
        return None
    total, target = fixed["total"], fixed["g"].toArray() / fixed["total"]
    ridge = lr.getRegParam() * np.append(np.ones(n), 0.0)

    def scored(beta: np.ndarray) -> DataFrame:
        told = linear_model(lr, beta[:n], beta[n]).copy({lr.featuresCol: "x"}).transform(rows)
        return told.withColumn("m", vector_to_array("rawPrediction")[1]).withColumn("p", vector_to_array("probability")[1])

    def loss_and_slope(beta: np.ndarray) -> tuple[float, np.ndarray]:
        m = F.col("m")
        got = scored(beta).agg(F.sum(w * (F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - y * m)).alias("loss"),
                               Summarizer.sum(F.col("row"), w * F.col("p") + TINY).alias("g")).first()
        return got["loss"] / total + 0.5 * float(ridge @ beta ** 2), got["g"].toArray() / total - target + ridge * beta

    def bends(beta: np.ndarray) -> np.ndarray:
        bent = scored(beta).withColumn("h", F.sqrt(w * F.col("p") * (1 - F.col("p"))))
        bent = Interaction(inputCols=["h", "row"], outputCol="bent").transform(bent).select("bent")
        gram = RowMatrix(MLUtils.convertVectorColumnsFromML(bent, "bent"), 0, n + 1).computeGramianMatrix()
        return gram.toArray() / total + np.diag(ridge)

    beta = np.append(np.zeros(n), np.log(target[n] / (1 - target[n])))
    loss, slope = loss_and_slope(beta)
    for _ in range(NEWTON_STEPS):
        hess = bends(beta)
        size = np.sqrt(np.maximum(np.diag(hess), TINY))  # columns of equal curvature, so that the solution keeps its digits
        if not (np.isfinite(loss) and np.isfinite(hess).all()):
            return None
        spans, axes = np.linalg.eigh(hess / np.outer(size, size))
        kept = spans > spans[-1] * n * np.finfo(float).eps
        step = -(axes[:, kept] @ (axes[:, kept].T @ (slope / size) / spans[kept])) / size
        if -slope @ step <= NEWTON_GAIN * loss:
            return beta
        for _ in range(NEWTON_STEPS):
            tried = loss_and_slope(beta + step)
            if tried[0] < loss:
                break
            step = step / 2
        else:
            return None
        beta, (loss, slope) = beta + step, tried
    return None


def turned_fit(dataset: DataFrame, lr: LogisticRegression) -> LogisticRegressionModel | None:
    """``lr`` fitted with the measured columns turned onto their principal axes, its coefficients turned back.

    Measured columns (not just 0 and 1) that nearly follow from one another take L-BFGS up to a thousand passes over
    the rows.  Turning them keeps every score and the length of the coefficients, so objective and optimum stay the
    same, and ``lr`` divides each axis by its own deviation.  An axis along which the rows differ by rounding only (or so
    little that the penalty leaves it less than ``lr``'s tolerance of the loss) is no column of the fit.  None where
    there is nothing to turn, or few columns in all.
    """
    col = lr.getFeaturesCol()
    stats = dataset.agg(Summarizer.metrics("max", "min", "sum", "numNonZeros").summary(F.col(col)).alias("s")).select("s.*").first()
    most, least, total, filled = (np.asarray(stats[k].toArray()) for k in ("max", "min", "sum", "numNonZeros"))
    slots = (most <= 1) & (least >= 0) & (total == filled)  # NaN is no slot
    axes = np.flatnonzero(~slots)
    if len(slots) < TURNED_FROM or not 2 <= len(axes) <= TURNED_AXES or not np.isfinite(total).all():
        return None
    rest = np.flatnonzero(slots)
    cut = VectorSlicer(inputCol=col, outputCol="_measured", indices=axes.tolist()).transform(dataset)
    if len(rest):
        cut = VectorSlicer(inputCol=col, outputCol="_slots", indices=rest.tolist()).transform(cut)
    turn = PCA(k=len(axes), inputCol="_measured", outputCol="_axes").fit(cut)
    cut = turn.transform(cut)
    spans = cut.agg(Summarizer.variance(F.col("_axes")).alias("v")).first()["v"].toArray()
    long = np.flatnonzero(spans > SHORT_AXIS * lr.getRegParam())
    if len(long) < 2:
        return None
    cut = VectorSlicer(inputCol="_axes", outputCol="_long", indices=long.tolist()).transform(cut)
    parts = [*(["_slots"] if len(rest) else []), "_long"]
    found = lr.copy({lr.featuresCol: "_turned"}).fit(VectorAssembler(inputCols=parts, outputCol="_turned").transform(cut))
    got, coef = found.coefficients.toArray(), np.zeros(len(slots))
    coef[rest], coef[axes] = got[:len(rest)], turn.pc.toArray()[:, long] @ got[len(rest):]
    return linear_model(lr, coef, found.intercept)


# ------------------------------------------------------------------ M1 forests whose trees outgrow the driver

class GroupedForest(RandomForestClassifier):
    """A random forest grown in groups of trees, so that the driver holds one group at a time.

    Spark's driver keeps every node of all trees it grows.  Deep trees get nodes in
    proportion to the rows, so a group has as many trees as keep rows x trees below ``TREE_ROWS``; a forest
    below that is Spark's own, in one fit.  Groups differ in their seed only: trees of a forest do not depend on one another.
    """

    def _fit(self, dataset: DataFrame):
        rows, trees = max(1, dataset.count()), self.getNumTrees()
        size = max(1, TREE_ROWS // rows)
        if trees <= size:
            return super()._fit(dataset)
        paths = []
        for start in range(0, trees, size):
            part = self.copy({self.numTrees: min(size, trees - start), self.seed: self.getSeed() + SEED_STEP * len(paths)})
            grown = RandomForestClassifier._fit(part, dataset)
            paths.append(scratch_path(dataset.sparkSession, "trees"))
            grown.write().save(paths[-1])
            width = grown.numFeatures
            del grown  # frees the group's nodes
        return GroupedForestModel(featuresCol=self.getFeaturesCol(), paths=paths, numTrees=trees, numFeatures=width)


class GroupedForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """The groups of a ``GroupedForest``, stored; scores are the mean over all trees, as in Spark's own model."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    paths = Param(Params._dummy(), "paths", "stored models, one per group of trees", TypeConverters.toListString)
    numTrees = Param(Params._dummy(), "numTrees", "trees in all", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", paths=None, numTrees=0, numFeatures=0):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(featuresCol=featuresCol, paths=kwargs.get("paths"), numTrees=numTrees, width=numFeatures)

    @property
    def numFeatures(self) -> int:
        return self.getOrDefault(self.width)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows are stored once; each group adds a table of (row, votes for class 1), the driver reads one group at a time."""
        spark, n = dataset.sparkSession, self.getOrDefault(self.numTrees)
        kept, votes = scratch_path(spark, "rows"), scratch_path(spark, "votes")
        dataset.withColumn("_row", F.monotonically_increasing_id()).write.parquet(kept)
        rows = spark.read.parquet(kept)
        lean = rows.select("_row", vector_to_array(self.getOrDefault(self.featuresCol)).alias("x"))
        for path in self.getOrDefault(self.paths):
            TS.forest_votes(lean, TS.tree_arrays(spark, path, "rf")).write.mode("append").parquet(votes)
        share = spark.read.parquet(votes).groupBy("_row").agg((F.sum("votes") / n).alias("_p"))
        p = F.col("_p")
        return rows.join(share, "_row").withColumns({
            "rawPrediction": array_to_vector(F.array((1 - p) * n, p * n)), "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (p > 0.5).cast("double")}).drop("_row", "_p")


# ------------------------------------------------------------------ builders and grids (M1, M2, M4)

def build_rf(**kw) -> RandomForestClassifier:
    """M1: defaults 500 trees, leaf >= 5, sqrt features, balanced weights.

    Rows keep the node they are in, so a deep level does not walk every tree from its root again.
    """
    depth = kw.get("max_depth")
    return GroupedForest(
        numTrees=kw.get("n_estimators", 500),
        maxDepth=MAX_DEPTH_CEILING if depth is None else depth,
        minInstancesPerNode=kw.get("min_samples_leaf", 5),
        featureSubsetStrategy=kw.get("max_features", "sqrt"),
        cacheNodeIds=True, weightCol=WEIGHT_COL, seed=SEED, labelCol="label", featuresCol="features")


def build_gbt(**kw) -> GBTClassifier:
    """M2: defaults 400 rounds x depth 6, rate 0.05, subsample 0.8, column share 0.8, child weight 5; no class weights."""
    return GBTClassifier(
        maxIter=kw.get("n_estimators", 400), maxDepth=kw.get("max_depth", 6),
        stepSize=kw.get("learning_rate", 0.05), subsamplingRate=kw.get("subsample", 0.8),
        featureSubsetStrategy=str(kw.get("colsample_bytree", 0.8)),
        minInstancesPerNode=kw.get("min_child_weight", 5), seed=SEED,
        labelCol="label", featuresCol="features")


def build_logreg(**kw) -> LogRegByC:
    """M3: L2, balanced weights, C = 1, 1000 iterations (one value for search and final fit)."""
    return LogRegByC(C=kw.get("C", 1.0), maxIter=1000, turned=kw.get("turned", False))


# The search grids (full and quick) of the three model families.
GRIDS = {
    "rf": {
        "full": {"n_estimators": [200, 500], "max_depth": [None, 10, 30],
                 "min_samples_split": [2, 5], "min_samples_leaf": [1, 3],
                 "max_features": ["sqrt", "log2"]},
        "quick": {"n_estimators": [200], "max_depth": [None], "min_samples_split": [2],
                  "min_samples_leaf": [1], "max_features": ["sqrt"]},
    },
    "logreg": {
        "full": {"C": [0.01, 0.1, 1, 10]},
        "quick": {"C": [1]},
    },
    "gbt": {
        "full": {"n_estimators": [200, 400], "max_depth": [3, 6, 10],
                 "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.7, 0.8],
                 "colsample_bytree": [0.7, 0.8], "min_child_weight": [1, 5]},
        "quick": {"n_estimators": [200], "max_depth": [6], "learning_rate": [0.05],
                  "subsample": [0.8], "colsample_bytree": [0.8], "min_child_weight": [1]},
    },
}
MODEL_ALIASES = {"rf": "rf", "logreg": "logreg", "logistic": "logreg", "xgb": "gbt", "gbt": "gbt"}


def grid_points(model: str, quick: bool) -> list[dict]:
    """M4: every combination of the grid, in grid order; unknown model -> error."""
    key = MODEL_ALIASES.get(model.lower())
    if key is None:
        raise ValueError(f"no model of the name {model!r}; known: {sorted(MODEL_ALIASES)}")
    g = GRIDS[key]["quick" if quick else "full"]
    names = list(g)
    return [dict(zip(names, combo)) for combo in itertools.product(*[g[n] for n in names])]


def build(model: str, **params):
    key = MODEL_ALIASES.get(model.lower())
    if key is None:
        raise ValueError(f"no model of the name {model!r}; known: {sorted(MODEL_ALIASES)}")
    return {"rf": build_rf, "logreg": build_logreg, "gbt": build_gbt}[key](**params)


def spark_param_grid(model: str, estimator, quick: bool):
    """The same grid as Spark ParamMaps on ``estimator`` (for CrossValidator).

    ``min_samples_split`` has no Spark twin and is dropped (it only
    duplicates grid points), so the Spark grid can be smaller.
    """
    key = MODEL_ALIASES[model.lower()]
    g = GRIDS[key]["quick" if quick else "full"]
    b = ParamGridBuilder()
    if key == "rf":
        b.addGrid(estimator.numTrees, g["n_estimators"])
        b.addGrid(estimator.maxDepth, [MAX_DEPTH_CEILING if d is None else d for d in g["max_depth"]])
        b.addGrid(estimator.minInstancesPerNode, g["min_samples_leaf"])
        b.addGrid(estimator.featureSubsetStrategy, g["max_features"])
    elif key == "logreg":
        b.addGrid(estimator.C, [float(c) for c in g["C"]])
    else:
        b.addGrid(estimator.maxIter, g["n_estimators"])
        b.addGrid(estimator.maxDepth, g["max_depth"])
        b.addGrid(estimator.stepSize, g["learning_rate"])
        b.addGrid(estimator.subsamplingRate, g["subsample"])
        b.addGrid(estimator.featureSubsetStrategy, [str(x) for x in g["colsample_bytree"]])
        b.addGrid(estimator.minInstancesPerNode, g["min_child_weight"])
    return b.build()


def model_pipeline(model: str, feature_stages: list, scale_cols: list[str] | None, **params) -> Pipeline:
    """M7: [scaler?] + feature assembly + [class weights] + classifier, re-fitted per split."""
    stages = []
    if scale_cols:
        stages.append(FamilyScaler(inputCols=scale_cols, outputCols=scale_cols))
    stages += feature_stages
    if MODEL_ALIASES[model.lower()] in ("rf", "logreg"):
        stages.append(BalancedWeights(labelCol="label", outputCol=WEIGHT_COL))
    stages.append(build(model, **params))
    return Pipeline(stages=stages)
