"""Model quality as plain aggregations, comparisons of models, curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.operators.numbering import key_hash


def regression_columns(label: str = "label", prediction: str = "prediction") -> dict[str, Column]:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    squared = F.avg((y - p) * (y - p))
    spread = F.var_pop(y)
    tiny = 2.220446049250313e-16  # the machine epsilon of a double
    return {
        "mse": squared,
        "mse_10k": squared / F.lit(10000.0),
        "rmse": F.sqrt(squared),
        "mae": F.avg(F.abs(y - p)),
        "r2": F.lit(1.0) - F.try_divide(squared, spread),
        "mape": F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(tiny))) * 100,
        "explained_variance": F.lit(1.0) - F.try_divide(F.var_pop(y - p), spread),
    }


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """All regression measures from one pass, for all rows or per group."""
    both = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    measures = [c.alias(n) for n, c in regression_columns(label, prediction).items()]
    return both.groupBy(*by).agg(*measures)


def accuracy(label: str = "label", prediction: str = "prediction") -> Column:
    return F.avg((F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double"))


def decision_score(raw: str = "rawPrediction") -> Column:
    """Signed distance measure of the positive class."""
    return F.get(vector_to_array(F.col(raw)), F.lit(1))


def class_probability(probability: str = "probability", of: int = 0) -> Column:
    return F.get(vector_to_array(F.col(probability)), F.lit(of))


def importances(df: DataFrame, names: Sequence[str], model) -> DataFrame:
    """(feature, importance) of a fitted tree model; give component names when it was fitted on
    components."""
    values = [float(v) for v in model.featureImportances.toArray()]
    if len(values) != len(names):
        raise ValueError(f"{len(names)} names for {len(values)} importances")
    return df.sparkSession.createDataFrame(list(zip(names, values)), "feature string, importance double")


def best_iteration(log: DataFrame, iteration: str = "iter", metric: str = "RMSE", by: Sequence[str] = ()) -> DataFrame:
    """First, last and lowest value of a training log and the earliest iteration that has the lowest."""
    return log.groupBy(*by).agg(
        F.count("*").alias("iterations"),
        F.min_by(metric, iteration).alias("first_value"),
        F.max_by(metric, iteration).alias("last_value"),
        F.min(metric).alias("best_value"),
        F.min(F.struct(metric, iteration))[iteration].alias("best_iter"),
    )


def compare_models(predictions: dict[str, DataFrame], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAPE and explained variance of every model."""
    table = None
    for name, df in predictions.items():
        row = regression_metrics(df, label, prediction).select(
            F.lit(name).alias("model"), "rmse", "mape", "explained_variance")
        table = row if table is None else table.unionByName(row)
    return table


def compare_columns(df: DataFrame, models: dict[str, str], label: str = "label") -> DataFrame:
    """The same for predictions that are columns of one frame, from a single scan."""
    cells = F.array(*[F.struct(F.lit(name).alias("model"), F.col(column).cast("double").alias("prediction"))
                      for name, column in models.items()])
    long = df.select(F.col(label).alias("label"), F.inline(cells))
    return regression_metrics(long, by=["model"]).select("model", "rmse", "mape", "explained_variance")


def learning_curve(train: DataFrame, test: DataFrame, key: str, shares: Sequence[float],
                   fit: Callable[[DataFrame], object], label: str = "label", seed: int = 0) -> DataFrame:
    """Training and test RMSE after fitting on growing parts of the training rows.

    A part is cut by a hash of the key, so each contains the smaller ones.
    """
    table = None
    bucket = key_hash(F.col(key), seed) % 1_000_000
    for share in shares:
        part = train.where(bucket < int(round(share * 1_000_000)))
        model = fit(part)
        for name, rows in (("train", part), ("test", test)):
            row = model.transform(rows).agg(
                F.count("*").alias("rows"), regression_columns(label)["rmse"].alias("rmse"),
            ).select(F.lit(float(share)).alias("share"), F.lit(name).alias("measured_on"), "rows", "rmse")
            table = row if table is None else table.unionByName(row)
    return table


def fold_curve(train: DataFrame, key: str, fold: str, folds: int, shares: Sequence[float],
               fit: Callable[[DataFrame], object], label: str = "label", seed: int = 0) -> DataFrame:
    """The same curve measured by cross-validation: mean train and test RMSE over the folds."""
    table = None
    for k in range(folds):
        curve = learning_curve(train.where(F.col(fold) != k), train.where(F.col(fold) == k), key, shares, fit, label, seed)
        table = curve if table is None else table.unionByName(curve)
    return table.groupBy("share", "measured_on").agg(
        F.sum("rows").alias("rows"), F.avg("rmse").alias("rmse"))


#: Features of a line whose curve is read off sums of products, one sum for each pair.
MOST_LINE_FEATURES = 60


def _moments(rows: DataFrame, width: int, cells: dict[str, Column], label: str, features: str) -> dict[tuple, np.ndarray]:
    """Sums of all products of (1, features, label) for each cell, from one pass. Products are taken about the values of some
    row, which a line with an intercept makes up for."""
    x = vector_to_array(F.col(features))
    flat = rows.select(*[column.alias(name) for name, column in cells.items()],
                       *[F.get(x, F.lit(i)).alias(f"v{i}") for i in range(width)], F.col(label).cast("double").alias(f"v{width}"))
    some = flat.first()
    if some is None:
        return {}
    about = [F.lit(1.0)] + [F.col(f"v{i}") - F.lit(some[f"v{i}"]) for i in range(width + 1)]
    pairs = [(i, j) for i in range(width + 2) for j in range(i, width + 2)]
    sums = flat.groupBy(*cells).agg(*[F.sum(about[i] * about[j]).alias(f"s{i}_{j}") for i, j in pairs])
    found = {}
    for row in sums.collect():  # one row per cell
        m = np.zeros((width + 2, width + 2))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"s{i}_{j}"]
        found[tuple(row[name] for name in cells)] = m
    return found


def line_curve(rows: DataFrame, key: str, shares: Sequence[float], width: int, test: Column | None = None, fold: str | None = None,
               folds: int = 0, label: str = "label", features: str = "features", seed: int = 0) -> DataFrame:
    """The curve of least-squares lines on growing parts of the training rows, as ``learning_curve`` and ``fold_curve``
    give it, from one scan: sums of products by fold and share are added up to every share and fold, and each
    line and its errors are solved from them.

    ``test`` marks the rows to measure on; with ``fold`` each fold is measured by the lines of the others.
    """
    if width > MOST_LINE_FEATURES:
        raise ValueError(f"a curve from sums has at most {MOST_LINE_FEATURES} features")
    bucket = key_hash(F.col(key), seed) % 1_000_000
    part = F.lit(len(shares))
    for i in sorted(range(len(shares)), key=lambda i: -shares[i]):
        part = F.when(bucket < int(round(shares[i] * 1_000_000)), i).otherwise(part)
    held = F.col(fold).cast("int") if fold else F.when(test, 0).otherwise(-1)
    moments = _moments(rows, width, {"held": held, "part": part}, label, features)
    nothing = np.zeros((width + 2, width + 2))
    order = {i: shares[i] for i in range(len(shares))}
    found: dict[tuple[float, str], list[tuple[int, float]]] = {}
    for k in range(folds if fold else 1):
        unseen = sum((m for (h, _), m in moments.items() if h == k), nothing)
        for i, share in order.items():
            seen = sum((m for (h, p), m in moments.items() if h != k and p in order and order[p] <= share), nothing)
            line = np.linalg.lstsq(seen[:-1, :-1], seen[:-1, -1], rcond=1e-13)[0]
            against = np.append(-line, 1.0)
            for name, m in (("train", seen), ("test", unseen)):
                if m[0, 0]:
                    found.setdefault((float(share), name), []).append((int(round(m[0, 0])), float(np.sqrt(max(against @ m @ against, 0.0) / m[0, 0]))))
    out = [(share, name, sum(n for n, _ in own), sum(e for _, e in own) / len(own)) for (share, name), own in found.items()]
    return rows.sparkSession.createDataFrame(out, "share double, measured_on string, rows bigint, rmse double")
