"""Support vector machines: linear, and with a Gaussian kernel through random Fourier features.

Both are solved by ``hinge`` to a proven gap. Rahimi and Recht (2007) map x to sqrt(2/D) cos(Wx + b)
with the rows of W drawn from a normal distribution of variance 2 gamma, so that the product of two
mapped rows approaches exp(-gamma |x - y|^2); the error falls with the square root of the number of
features D. A linear machine on the mapped rows then stands for the kernel machine. Models are pipeline
stages that can be copied, saved and read again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasInputCols, HasLabelCol, HasMaxIter, HasPredictionCol, HasRawPredictionCol,
                                     HasSeed, HasTol, HasWeightCol)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.operators.hinge import FourierMap, accuracies, fit_machines
from hearthlens.operators.joins import parameter_grid

# The candidate settings of the search.
C_VALUES = [0.01, 0.03, 0.1, 0.3, 1, 3, 10, 30, 100]
GAMMA_VALUES = [0.01, 0.03, 0.1, 0.3, 1, 3, 10, 30, 100]


def _param(name: str, doc: str, converter) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=converter)


class _Solved(Params):
    """What a fit proves: its loss and a lower bound of the best loss."""

    loss = _param("loss", "penalty and mean hinge loss of the training rows", TypeConverters.toFloat)
    bound = _param("bound", "no machine has a smaller loss than this", TypeConverters.toFloat)
    rounds = _param("rounds", "rounds of two passes", TypeConverters.toInt)
    coefficientValues = _param("coefficientValues", "one number per feature", TypeConverters.toListFloat)
    interceptValue = _param("interceptValue", "the score of a row of zeros", TypeConverters.toFloat)

    def _take(self, machine) -> None:
        self._set(loss=float(machine.loss), bound=float(machine.bound), rounds=machine.rounds, interceptValue=float(machine.intercept),
                  coefficientValues=[float(v) for v in machine.coefficients])

    @property
    def gap(self) -> float:
        """How far the loss can be from the best one at most."""
        return self.getOrDefault(self.loss) - self.getOrDefault(self.bound)

    @property
    def coefficients(self) -> list[float]:
        return self.getOrDefault(self.coefficientValues)

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.interceptValue)


class _LinearParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasWeightCol, HasMaxIter, HasTol):
    c = _param("c", "weight of the loss against the norm; infinite for no penalty", TypeConverters.toFloat)
    penaltyRows = _param("penaltyRows", "rows that the penalty 1 / (c rows) counts; 0 for the sum of the weights", TypeConverters.toFloat)


class LinearMachine(Estimator, _LinearParams, DefaultParamsReadable, DefaultParamsWritable):
    """Hinge-loss machine on a vector column, within ``tol`` of the best loss as a share of it or a hundredth of ``tol`` in all. Features that are not finite are an error; rows without a label, a
    vector or a positive weight take no part."""

    @keyword_only
    def __init__(self, *, c=1.0, penaltyRows=0.0, maxIter=200, tol=1e-4, featuresCol="features", labelCol="label",
                 predictionCol="prediction", rawPredictionCol="rawPrediction", weightCol=None):
        super().__init__()
        self._setDefault(c=1.0, penaltyRows=0.0, maxIter=200, tol=1e-4)
        self._set(**{name: value for name, value in self._input_kwargs.items() if value is not None})

    def _fit(self, dataset: DataFrame) -> LinearMachineModel:
        get = self.getOrDefault
        weight = get(self.weightCol) if self.isDefined(self.weightCol) else None
        machine, = fit_machines(dataset, vector_to_array(F.col(self.getFeaturesCol())), [get(self.c)], label=self.getLabelCol(), weight=weight,
                                tolerance=self.getTol(), max_rounds=self.getMaxIter(), rows=get(self.penaltyRows) or None, near=self.getTol() / 100)
        model = self._copyValues(LinearMachineModel())
        model._take(machine)
        return model


class LinearMachineModel(Model, _LinearParams, _Solved, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the scores of both sides and the prediction; a row without a vector gets nulls."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = vector_to_array(F.col(self.getFeaturesCol()))
        weights = F.array(*[F.lit(v) for v in self.coefficients])
        score = F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(self.intercept), lambda a, b: a + b)
        raw = self.getRawPredictionCol()
        scored = dataset.withColumn(raw, F.when(F.col(self.getFeaturesCol()).isNotNull(), array_to_vector(F.array(-score, score))))
        return scored.withColumn(self.getPredictionCol(), F.when(F.get(vector_to_array(F.col(raw)), F.lit(1)) > 0, 1.0).when(F.col(raw).isNotNull(), 0.0))


def linear_svm(c: float, rows: float | None = None, max_iter: int = 200, weight: str | None = None,
               features: str = "features", tol: float = 1e-4, **params) -> LinearMachine:
    """Hinge-loss machine with penalty 1 / (c rows), by default for the sum of the weights of the training
    rows; an infinite ``c`` is no regularisation. A row of weight w counts as w rows."""
    return LinearMachine(c=float(c), penaltyRows=float(rows or 0.0), maxIter=max_iter, featuresCol=features, tol=tol, weightCol=weight, **params)


def fourier_features(x: Column, width: int, gamma: float, size: int = 200, seed: int = 0) -> Column:
    """The mapped row of an array column of ``width`` numbers, as an array of ``size`` numbers."""
    directions, offsets, scale = FourierMap(width, gamma, size, seed).arrays()

    @F.pandas_udf("array<double>")
    def mapped(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(scale * np.cos(np.stack(batch.to_numpy()) @ directions + offsets)))

    return mapped(x)


class _KernelParams(HasInputCols, HasLabelCol, HasPredictionCol, HasMaxIter, HasTol, HasSeed):
    c = _param("c", "weight of the loss against the norm", TypeConverters.toFloat)
    gamma = _param("gamma", "the kernel is exp(-gamma distance^2)", TypeConverters.toFloat)
    size = _param("size", "random features", TypeConverters.toInt)
    probability = _param("probability", "fit a logistic curve from the score to a probability", TypeConverters.toBoolean)

    def _mapping(self) -> FourierMap:
        get = self.getOrDefault
        return FourierMap(len(self.getInputCols()), get(self.gamma), get(self.size), self.getSeed())

    def _array(self) -> Column:
        """The inputs as an array, null where one of them is missing."""
        columns = [F.col(name).cast("double") for name in self.getInputCols()]
        known = columns[0].isNotNull()
        for column in columns[1:]:
            known = known & column.isNotNull()
        return F.when(known, F.array(*columns))


class KernelMachine(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian kernel machine on numeric columns, within ``tol`` of the best loss as a share of it or a tenth of ``tol`` in all;
    rows with a missing input or label take no part."""

    @keyword_only
    def __init__(self, *, inputCols=None, c=1.0, gamma=1.0, size=200, seed=0, maxIter=200, tol=1e-3, probability=False,
                 labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(c=1.0, gamma=1.0, size=200, seed=0, maxIter=200, tol=1e-3, probability=False)
        self._set(**{name: value for name, value in self._input_kwargs.items() if value is not None})

    def _fit(self, dataset: DataFrame) -> KernelSvm:
        machine, = fit_machines(dataset, self._array(), [self.getOrDefault(self.c)], [self._mapping()], label=self.getLabelCol(),
                                tolerance=self.getTol(), max_rounds=self.getMaxIter(), near=self.getTol() / 10)
        model = self._copyValues(KernelSvm())
        model._take(machine)
        if self.getOrDefault(self.probability):
            scores = model._scored(dataset.where(F.col(self.getLabelCol()).isNotNull())).where("score is not null").select(
                array_to_vector(F.array("score")).alias("features"), F.col(self.getLabelCol()).cast("double").alias("label"))
            curve = LogisticRegression().fit(scores)
            model._set(curveSlope=float(curve.coefficients[0]), curveIntercept=float(curve.intercept))
        return model


class KernelSvm(Model, _KernelParams, _Solved, DefaultParamsReadable, DefaultParamsWritable):
    """Adds score and prediction, and the probability of the class 0 when calibrated; a row with a missing input gets
    nulls."""

    curveSlope = _param("curveSlope", "slope of the logistic curve", TypeConverters.toFloat)
    curveIntercept = _param("curveIntercept", "its value at a score of zero", TypeConverters.toFloat)

    def _scored(self, dataset: DataFrame) -> DataFrame:
        directions, offsets, scale = self._mapping().arrays()
        weights, intercept = scale * np.array(self.coefficients), self.intercept

        @F.pandas_udf("double")
        def score(batch: pd.Series) -> pd.Series:
            known = batch.notna()
            out = pd.Series(np.full(len(batch), np.nan), index=batch.index)
            if known.any():
                out[known] = np.cos(np.stack(batch[known].to_numpy()) @ directions + offsets) @ weights + intercept
            return out.astype(object).where(known, None)

        return dataset.withColumn("score", score(self._array()))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self._scored(dataset)
        scored = scored.withColumn(self.getPredictionCol(), F.when(F.col("score") > 0, 1.0).when(F.col("score").isNotNull(), 0.0))
        if self.isDefined(self.curveSlope):
            line = F.lit(self.getOrDefault(self.curveSlope)) * F.col("score") + F.lit(self.getOrDefault(self.curveIntercept))
            scored = scored.withColumn("probability_0", 1.0 / (1.0 + F.exp(line)))
        return scored


def fit_kernel_svm(df: DataFrame, inputs: Sequence[str], c: float, gamma: float, size: int = 200, seed: int = 0,
                   max_iter: int = 200, probability: bool = False) -> KernelSvm:
    """Fits on rows with numeric ``inputs`` and a 0/1 ``label``."""
    return KernelMachine(inputCols=list(inputs), c=float(c), gamma=float(gamma), size=size, seed=seed, maxIter=max_iter,
                         probability=probability).fit(df)


def search_kernel_svm(train: DataFrame, validation: DataFrame, inputs: Sequence[str],
                      c_values: Sequence[float] = C_VALUES, gamma_values: Sequence[float] = GAMMA_VALUES,
                      size: int = 200, seed: int = 0, max_iter: int = 200, tol: float = 1e-3) -> DataFrame:
    """(position, c, gamma, score, gap) of every setting: accuracy on the separate validation rows, and how far
    the fit can be from the best loss at most.

    All settings are fitted in the same passes over the training rows, which are packed once, and measured in
    one pass over the validation rows.
    """
    points = parameter_grid(c=list(c_values), gamma=list(gamma_values))
    shape = KernelMachine(inputCols=list(inputs))
    mappings = [FourierMap(len(inputs), float(gamma), size, seed) for gamma in gamma_values]
    machines = fit_machines(train, shape._array(), c_values, mappings, tolerance=tol, max_rounds=max_iter, near=tol / 10)
    scores = accuracies(validation, shape._array(), machines)
    settings = [(c, gamma) for gamma in gamma_values for c in c_values]
    results = [(points.index({"c": c, "gamma": gamma}), float(c), float(gamma), score, float(machine.gap))
               for (c, gamma), score, machine in zip(settings, scores, machines)]
    return train.sparkSession.createDataFrame(sorted(results), "position int, c double, gamma double, score double, gap double")
