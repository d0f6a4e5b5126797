"""Regressors and classifiers over ``pyspark.ml``, and the stacked ensemble."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.operators.features import assembler, fit_pca
from hearthlens.operators.numbering import contiguous_folds, hashed_folds
from hearthlens.session import shared_folder

#: Rows up to which the fits of a stack run side by side.
SIDE_BY_SIDE = 1_000_000


def training_frame(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Vector column ``features`` and double column ``label`` next to the kept columns; rows without
    a label or with a missing feature are left out."""
    rows = df.where(F.col(label).isNotNull()).dropna(subset=list(features))
    doubles = rows.select(*[c for c in keep if c not in features],
                          F.col(label).cast("double").alias("label"),
                          *[F.col(c).cast("double").alias(c) for c in features])
    return assembler(features).transform(doubles)


def training_partitions(rows: int, cores: int) -> int:
    """Partitions for a frame that is read by hundreds of short jobs: few rows stay together, many
    rows get about three tasks per core, and no partition grows past two million rows."""
    return max(1, min(math.ceil(rows / 20_000), max(3 * cores, math.ceil(rows / 2_000_000))))


def repeatable(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Fixed partitions and row order by a unique key. Tree ensembles draw their samples per
    partition, so the same layout gives the same model for the same seed."""
    partitions = partitions or training_partitions(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(partitions, key).sortWithinPartitions(key)


def random_forest(trees: int = 200, depth: int = 12, subset: str = "all", seed: int = 0, **params) -> RandomForestRegressor:
    """Forest over all features per split by default. Spark trees have a depth limit of 30; unlimited
    depth is approached by raising ``depth``."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, seed=seed, **params)


def forest_classifier(trees: int = 500, depth: int = 12, seed: int = 0, **params) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **params)


def least_squares(**params) -> LinearRegression:
    return LinearRegression(regParam=0.0, standardization=False, **params)


def boosted_trees(rounds: int = 100, depth: int = 3, step: float = 0.1, seed: int = 42, **params) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, **params)


# Names that other boosted-tree libraries give to the same settings.
BOOSTING_NAMES = {
    "n_estimators": "maxIter", "iterations": "maxIter", "num_boost_round": "maxIter",
    "max_depth": "maxDepth", "depth": "maxDepth",
    "learning_rate": "stepSize", "eta": "stepSize",
    "subsample": "subsamplingRate", "bagging_fraction": "subsamplingRate",
    "min_child_samples": "minInstancesPerNode", "min_data_in_leaf": "minInstancesPerNode",
    "max_bin": "maxBins", "border_count": "maxBins",
    "random_state": "seed", "random_seed": "seed",
}


def boosted_trees_named(**settings) -> GBTRegressor:
    """Boosted trees from the setting names of the other libraries; an unknown name is an error."""
    unknown = [name for name in settings if name not in BOOSTING_NAMES]
    if unknown:
        raise ValueError(f"no counterpart for {unknown}")
    return GBTRegressor(**{BOOSTING_NAMES[name]: value for name, value in settings.items()})


def fit_cached(estimator: Estimator, df: DataFrame) -> Model:
    """Fits on rows kept at hand for the many passes of an iterative fit."""
    shared_folder(df.sparkSession)
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(rows)
    finally:
        rows.unpersist()


def scaled_pca_forest(df: DataFrame, features: Sequence[str], label: str, forest: RandomForestRegressor,
                      k: int | None = None):
    """Standardise, reduce to principal components, fit a forest on the components; returns a
    function that scores rows and the fitted forest, whose importances belong to components."""
    scaling, reduction = fit_pca(df, features, k)

    def reduced(rows: DataFrame) -> DataFrame:
        return reduction.transform(scaling.apply(rows)).withColumn("label", F.col(label).cast("double"))

    # the fit keeps these two columns of a row and not all that they were made of
    model = fit_cached(forest.copy({forest.featuresCol: "components"}), reduced(df).select("components", "label"))
    return lambda rows: model.transform(reduced(rows)), model


def boosting_curve(model, df: DataFrame) -> list[float]:
    """RMSE on the given rows after each boosting round."""
    return [mse ** 0.5 for mse in model.evaluateEachIteration(df, "squared")]


def boosted_until_best(df: DataFrame, validation: Column, rounds: int = 1000, tolerance: float = 0.01, **params) -> tuple[GBTRegressionModel, DataFrame]:
    """Boosted trees that stop when the error on the rows marked by ``validation`` gets no better, and the curve up to there:
    (iter, train, validation, best) with the RMSE of both kinds of rows and the round that the model ends with.

    ``tolerance`` is the share of the error by which a round has to improve on the best one. Marked rows are not
    trained on. One of the rounds after the best is fitted to know that it is the best; it is not kept.
    """
    marked = df.withColumn("held", F.coalesce(validation, F.lit(False)))
    model = fit_cached(boosted_trees(rounds, validationIndicatorCol="held", validationTol=tolerance, **params), marked)
    curves = [boosting_curve(model, marked.where(where)) for where in ("not held", "held")]
    best = model.getNumTrees - 1
    log = [(i, float(a), float(b), i == best) for i, (a, b) in enumerate(zip(*curves))]
    return model, df.sparkSession.createDataFrame(log, "iter bigint, train double, validation double, best boolean")


class _StackWriter(MLWriter):
    """Settings as metadata, each part in a folder of its own, and the rows of a fitted stack beside them."""

    def __init__(self, stack):
        super().__init__()
        self.stack = stack

    def saveImpl(self, path: str) -> None:
        parts, settings, rows = self.stack._parts()
        session = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.stack, path, session, extraMetadata={"settings": settings, "parts": len(parts)})
        for i, part in enumerate(parts):
            part.write().save(f"{path}/parts/{i}")
        if rows is not None:
            rows.write.parquet(f"{path}/out_of_fold")


class _StackReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = [DefaultParamsReader.loadParamsInstance(f"{path}/parts/{i}", self.sparkSession) for i in range(metadata["parts"])]
        stack = self.kind._from_parts(parts, metadata["settings"], lambda: self.sparkSession.read.parquet(f"{path}/out_of_fold"))
        stack._resetUid(metadata["uid"])
        return stack


class _Stack(MLReadable, MLWritable):
    def write(self) -> MLWriter:
        return _StackWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StackReader(cls)

    def copy(self, extra: dict | None = None):
        parts, settings, rows = self._parts()
        copied = type(self)._from_parts([part.copy(extra) for part in parts], settings, lambda: rows)
        return copied._resetUid(self.uid)


class StackedRegressor(_Stack, Estimator):
    """Stacking with out-of-fold predictions.

    Every base model is fitted once per fold and predicts the rows it has not seen; a least-squares
    model on those predictions, with the original features beside them if wanted, combines them.
    The bases are then fitted again on all rows for scoring. ``folds`` follow the order of the key
    ("contiguous") or its hash ("hashed"). Base and fold fits are independent jobs; ``parallelism``
    of them are submitted at a time while there are few rows. A fit on many rows has tasks for all cores and
    needs the memory for the points it keeps: those fits run one after the other, on folds kept on disk.
    """

    def __init__(self, bases: Sequence[Estimator], key: str, folds: int = 5, use_features: bool = True,
                 fold_order: str = "contiguous", parallelism: int = 2, meta: Estimator | None = None):
        super().__init__()
        self.bases = list(bases)
        self.key = key
        self.folds = folds
        self.use_features = use_features
        self.fold_order = fold_order
        self.parallelism = parallelism
        self.meta = meta or least_squares()

    def _parts(self):
        settings = {name: getattr(self, name) for name in ("key", "folds", "use_features", "fold_order", "parallelism")}
        return [*self.bases, self.meta], settings, None

    @classmethod
    def _from_parts(cls, parts, settings, rows) -> StackedRegressor:
        return cls(parts[:-1], meta=parts[-1], **settings)

    def _inputs(self) -> list[str]:
        return (["features"] if self.use_features else []) + [f"base_{i}" for i in range(len(self.bases))]

    def _fit(self, dataset: DataFrame) -> StackedModel:
        shared_folder(dataset.sparkSession)
        rows = dataset.select(self.key, "features", "label")
        folded = contiguous_folds(rows, self.key, self.folds) if self.fold_order == "contiguous" else hashed_folds(
            rows, self.key, self.folds)
        # in memory the folds and the points of a fit would drive each other out again and again
        folded = folded.persist(StorageLevel.DISK_ONLY)
        try:
            work = [(i, k) for i in range(len(self.bases)) for k in range(self.folds)]
            with ThreadPoolExecutor(self.parallelism if folded.count() <= SIDE_BY_SIDE else 1) as pool:
                fitted = dict(zip(work, pool.map(
                    lambda w: self.bases[w[0]].fit(folded.where(F.col("fold") != w[1])), work)))
                final = list(pool.map(lambda base: base.fit(folded), self.bases))

            unseen = []
            for k in range(self.folds):
                part = folded.where(F.col("fold") == k)
                for i in range(len(self.bases)):
                    part = _scored(fitted[(i, k)], part, f"base_{i}")
                unseen.append(part)
            out_of_fold = reduce(DataFrame.unionByName, unseen)
            joined = VectorAssembler(inputCols=self._inputs(), outputCol="meta_features")
            meta = self.meta.copy({self.meta.featuresCol: "meta_features"})
            combiner = fit_cached(Pipeline(stages=[joined, meta]), out_of_fold)
            return StackedModel(final, combiner, out_of_fold)
        finally:
            folded.unpersist()


def _scored(model: Model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out).select(*df.columns, out)


class StackedModel(_Stack, Model):
    """Fitted bases and combiner; ``out_of_fold`` holds the training rows with their unseen predictions."""

    def __init__(self, bases: Sequence[Model], combiner: PipelineModel, out_of_fold: DataFrame):
        super().__init__()
        self.bases = list(bases)
        self.combiner = combiner
        self.out_of_fold = out_of_fold

    def _parts(self):
        return [*self.bases, self.combiner], {}, self.out_of_fold

    @classmethod
    def _from_parts(cls, parts, settings, rows) -> StackedModel:
        return cls(parts[:-1], parts[-1], rows())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset
        for i, base in enumerate(self.bases):
            rows = _scored(base, rows, f"base_{i}")
        return self.combiner.transform(rows).drop("meta_features")
