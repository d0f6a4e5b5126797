"""Scaling, splitting, selection and reduction of features.

Scalers are fitted once, to one row of figures, and applied as plain column arithmetic, so the
figures of the training rows can be applied to any other rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.operators.numbering import key_hash
from hearthlens.operators.orderstats import order_statistics


@dataclass(frozen=True)
class Scaling:
    """x -> (x - offset) / factor per column; a factor of 0 gives 0."""

    offset: dict[str, float]
    factor: dict[str, float]

    def columns(self) -> dict[str, Column]:
        scaled = {}
        for name, offset in self.offset.items():
            gap = F.col(name).cast("double") - F.lit(float(offset))
            factor = self.factor[name]
            scaled[name] = gap / F.lit(float(factor)) if factor else gap * F.lit(0.0)
        return scaled

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


def fit_min_max(df: DataFrame, names: Sequence[str]) -> Scaling:
    """To [0, 1] by the extremes; a constant column becomes 0."""
    row = df.agg(*[F.min(n).cast("double").alias(f"a{i}") for i, n in enumerate(names)],
                 *[F.max(n).cast("double").alias(f"z{i}") for i, n in enumerate(names)]).first()
    lo = {n: row[f"a{i}"] for i, n in enumerate(names)}
    return Scaling(lo, {n: row[f"z{i}"] - lo[n] for i, n in enumerate(names)})


def fit_standard(df: DataFrame, names: Sequence[str]) -> Scaling:
    """To mean 0 and population deviation 1; a constant column becomes 0."""
    row = df.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)],
                 *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)]).first()
    return Scaling({n: row[f"m{i}"] for i, n in enumerate(names)}, {n: row[f"s{i}"] for i, n in enumerate(names)})


def hash_split(df: DataFrame, key: str, test_share: float, seed: int = 0, out: str = "split") -> DataFrame:
    """Adds 'train' or 'test' by a hash of the key: the same rows on every run, layout and cluster,
    and about the wanted share."""
    bucket = key_hash(F.col(key), seed) % 1_000_000
    return df.withColumn(out, F.when(bucket < int(round(test_share * 1_000_000)), "test").otherwise("train"))


#: Different keys that may share one hash of 52 bits.
MOST_TIED = 1000


def exact_split(df: DataFrame, key: str, test_share: float, seed: int = 0, out: str = "split") -> DataFrame:
    """Like :func:`hash_split` with exactly ceil(test_share * n) test rows.

    The test rows are those with the smallest hashes; the cut is found by counting, not by sorting.
    ``key`` is unique; the few rows that share the cut's hash are told apart by it, and a key that is found more
    than once there is an error.
    """
    hashed = df.select(F.col(key), key_hash(F.col(key), seed).alias("__h"))
    total = hashed.count()
    # the share is a decimal number: 0.3 * 10 must not become 4 rows through rounding
    size = math.ceil(round(test_share * total, 9))
    if size == 0:
        return df.withColumn(out, F.lit("train"))
    cut = order_statistics(hashed, {"__h": [size - 1]}, {"__h": total})[("__h", size - 1)]
    below = hashed.where(F.col("__h") < F.lit(cut)).count()
    tied = hashed.where(F.col("__h") == F.lit(cut)).groupBy(key).count().orderBy(key).limit(MOST_TIED).collect()
    if len(tied) == MOST_TIED or any(row["count"] > 1 for row in tied):
        raise ValueError(f"the key {key} is not unique")
    tied = tied[:size - below]
    in_test = (key_hash(F.col(key), seed) < F.lit(cut)) | F.col(key).isin([row[0] for row in tied])
    return df.withColumn(out, F.when(in_test, "test").otherwise("train"))


def chi2_scores(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(feature, score): per class, the sum of a non-negative feature against the sum expected from
    the size of the class, squared gap over expectation. ``label`` is a class, not a measurement."""
    df = df.where(F.col(label).isNotNull())
    totals = df.agg(F.count("*").alias("n"), *[F.sum(c).cast("double").alias(f"t{i}") for i, c in enumerate(features)],
                    *[F.min(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
    negative = [c for i, c in enumerate(features) if (totals[f"m{i}"] or 0) < 0]
    if negative:
        raise ValueError(f"chi-squared scores need non-negative features: {negative}")
    observed = df.groupBy(label).agg(
        F.count("*").alias("n"), *[F.sum(c).cast("double").alias(f"o{i}") for i, c in enumerate(features)])
    scores = []
    for i in range(len(features)):
        expected = F.col("n") / F.lit(float(max(totals["n"], 1))) * F.lit(totals[f"t{i}"])
        scores.append(F.sum(F.try_divide(F.pow(F.col(f"o{i}") - expected, F.lit(2.0)), expected)).alias(f"c{i}"))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("score")) for i, c in enumerate(features)]
    return observed.agg(*scores).select(F.inline(F.array(*cells)))


def select_k_best(df: DataFrame, label: str, features: Sequence[str], k: int = 2) -> list[str]:
    """The ``k`` features with the highest scores, in their own order."""
    best = chi2_scores(df, label, features).orderBy(F.desc_nulls_last("score"), "feature").limit(k).collect()
    names = {row["feature"] for row in best}
    return [c for c in features if c in names]


def price_cuts(df: DataFrame, column: str, classes: int) -> list:
    """The values at evenly spaced ranks of the column, which divide it into classes."""
    values = df.select(column).persist(StorageLevel.MEMORY_AND_DISK)  # the passes read the column, not what made it
    try:
        total = values.agg(F.count(column)).first()[0]
        ranks = sorted({max(math.ceil(total * i / classes) - 1, 0) for i in range(1, classes)}) if total else []
        found = order_statistics(values, {column: ranks}, {column: total})
    finally:
        values.unpersist()
    return sorted({found[(column, rank)] for rank in ranks})


def price_class(column: str, cuts: Sequence) -> Column:
    """The class 0, 1, ... of a value; a value at a cut belongs to the lower class."""
    index = F.lit(0)
    for cut in cuts:
        index = index + F.when(F.col(column) > F.lit(cut), 1).otherwise(0)
    return F.when(F.col(column).isNotNull(), index)


def price_classes(df: DataFrame, column: str, classes: int, out: str) -> DataFrame:
    """Adds a class by the cuts of the table itself."""
    return df.withColumn(out, price_class(column, price_cuts(df, column, classes)))


def class_weights(label: str, weights: dict) -> Column:
    """Row weight by class, 1 for a class without one."""
    weight = F.lit(1.0)
    for value, factor in weights.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(float(factor))).otherwise(weight)
    return weight


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def fit_pca(df: DataFrame, features: Sequence[str], k: int | None = None) -> tuple[Scaling, PipelineModel]:
    """Principal components of the standardised columns, all of them unless ``k`` is given.

    The ML transform does not centre, so the rows are standardised first, at fit and at use.
    """
    scaling = fit_standard(df, features)
    stages = [assembler(features, "scaled"), PCA(k=k or len(features), inputCol="scaled", outputCol="components")]
    return scaling, Pipeline(stages=stages).fit(scaling.apply(df))


def explained_variance(df: DataFrame, model: PipelineModel) -> DataFrame:
    """(component, share) of a fitted reduction."""
    pca: PCAModel = model.stages[-1]
    shares = [(f"pc{i + 1}", float(v)) for i, v in enumerate(pca.explainedVariance.toArray())]
    return df.sparkSession.createDataFrame(shares, "component string, share double")
