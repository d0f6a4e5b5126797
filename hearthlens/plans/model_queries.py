"""Queries that fit models. Fitted figures with a closed form have SQL; tree ensembles and kernel
machines are checked by the invariants in the tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthlens.functions.text import round_exact
from hearthlens.operators import clean, evaluate, features, models, numbering, select, svm
from hearthlens.operators.profile import first_maximum
from hearthlens.plans import listings, reports
from hearthlens.plans.listings import LISTING_SQL
from hearthlens.plans.registry import query, table
from hearthlens.schemas import LISTING_FEATURES
from hearthlens.session import fresh_path

# Smaller than the library's defaults, so that a check at small scale takes seconds.
TREES, ROUNDS, DEPTH = 20, 10, 6


def modelling_rows(spark: SparkSession, folder: str, columns: Sequence[str] = LISTING_FEATURES) -> DataFrame:
    """The modelling table with vector and label, stored once because every fit reads it many times."""
    rows = models.training_frame(listings.listing_features(spark, folder), columns, "t_price", ["id"])
    path = fresh_path(spark, "modelling")
    features.hash_split(rows, "id", 0.2, seed=42).select("id", "split", "features", "label").write.parquet(path)
    return models.repeatable(spark.read.parquet(path), "id")


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


@query(f"with {LISTING_SQL} select round(regr_slope(t_price, area), 4) as slope, round(regr_intercept(t_price, area), 4) as intercept from cleaned")
def least_squares_line(spark, folder):
    """One feature needs no iterative fit: the slope is an aggregate."""
    kept = clean.apply_rules(listings.parsed(listings.listing_raw(spark, folder)), listings.rules())
    return kept.agg(F.round(F.regr_slope("t_price", "area"), 4).alias("slope"), F.round(F.regr_intercept("t_price", "area"), 4).alias("intercept"))


CURVE_BUCKET = "cast(('0x' || substr(md5(cast(id as varchar) || ':0'), 1, 13)) as bigint) % 1000000"
CURVE_SPLIT = "cast(('0x' || substr(md5(cast(id as varchar) || ':42'), 1, 13)) as bigint) % 1000000 < 200000"
SHARES = [0.25, 0.5, 1.0]


@query(f"with {LISTING_SQL}, s as (select *, {CURVE_BUCKET} as bucket, {CURVE_SPLIT} as test from cleaned), " + ", ".join(
    f"f{i} as (select regr_slope(t_price, area) as a, regr_intercept(t_price, area) as b from s where not test and bucket < {int(x * 1e6)})"
    for i, x in enumerate(SHARES)) + " " + " union all ".join(
    f"""select {x}::double as share, case when test then 'test' else 'train' end as measured_on, count(*) as rows,
  round(sqrt(avg(pow(t_price - a * area - b, 2))), 4) as rmse from s, f{i} where test or bucket < {int(x * 1e6)} group by 1, 2"""
    for i, x in enumerate(SHARES)))
def learning_curve(spark, folder):
    curve = evaluate.line_curve(modelling_rows(spark, folder, ["area"]), "id", SHARES, 1, test=F.col("split") == "test")
    return curve.withColumn("rmse", F.round("rmse", 4))


@query()
def cross_validated_learning_curve(spark, folder):
    rows = numbering.hashed_folds(modelling_rows(spark, folder), "id", 3)
    return evaluate.line_curve(rows, "id", [0.5, 1.0], len(LISTING_FEATURES), fold="fold", folds=3)


@query()
def forest_regression(spark, folder):
    train, test = parts(modelling_rows(spark, folder))
    model = models.fit_cached(models.random_forest(trees=TREES, depth=DEPTH), train)
    return evaluate.regression_metrics(model.transform(test))


@query()
def forest_against_line(spark, folder):
    train, test = parts(modelling_rows(spark, folder))
    forest = models.fit_cached(models.random_forest(trees=TREES, depth=DEPTH), train)
    line = models.fit_cached(models.least_squares(), train)
    return evaluate.compare_models({"forest": forest.transform(test), "least squares": line.transform(test)})


@query()
def forest_importance(spark, folder):
    train, _ = parts(modelling_rows(spark, folder))
    model = models.fit_cached(models.random_forest(trees=TREES, depth=DEPTH), train)
    found = evaluate.importances(train, LISTING_FEATURES, model)
    return reports.importance_bars(found).withColumn("shown", round_exact(F.col("importance"), 2))


@query()
def component_forest(spark, folder):
    """Standardise, all principal components, forest; importances are named by component."""
    rows = listings.listing_features(spark, folder).dropna(subset=LISTING_FEATURES + ["t_price"])
    path = fresh_path(spark, "components")
    rows.write.parquet(path)
    rows = features.hash_split(spark.read.parquet(path), "id", 0.2)
    train, test = parts(rows)
    score, model = models.scaled_pca_forest(train, LISTING_FEATURES, "t_price", models.random_forest(trees=TREES, depth=DEPTH))
    names = [f"pc{i + 1}" for i in range(len(LISTING_FEATURES))]
    measured = evaluate.regression_metrics(score(test)).select(F.lit("test").alias("feature"), F.col("rmse").alias("importance"))
    return evaluate.importances(train, names, model).unionByName(measured)


@query()
def forest_classes(spark, folder):
    """Forest on price classes cut by the training rows, features above the importance threshold."""
    train, test = parts(modelling_rows(spark, folder))
    known = features.price_class("label", features.price_cuts(train, "label", 4)).cast("double")
    train, test = train.withColumn("label", known), test.withColumn("label", known)
    model = models.fit_cached(models.forest_classifier(trees=TREES, depth=DEPTH), train)
    chosen = select.important(LISTING_FEATURES, model.featureImportances.toArray())
    return model.transform(test).agg(evaluate.accuracy().alias("accuracy")).withColumn("important", F.lit(",".join(chosen)))


@query()
def boosting_curve(spark, folder):
    train, test = parts(modelling_rows(spark, folder))
    model = models.fit_cached(models.boosted_trees(rounds=ROUNDS), train)
    curves = {"train": models.boosting_curve(model, train), "test": models.boosting_curve(model, test)}
    log = [(name, i, float(v)) for name, values in curves.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(log, "measured_on string, iter bigint, RMSE double")
    return evaluate.best_iteration(frame, by=["measured_on"])


@query()
def stacked_regression(spark, folder):
    train, test = parts(modelling_rows(spark, folder))
    bases = [models.random_forest(trees=TREES, depth=DEPTH, seed=42), models.boosted_trees(rounds=ROUNDS)]
    model = models.StackedRegressor(bases, "id").fit(train)
    return evaluate.regression_metrics(model.transform(test))


# --- support vector machines ---------------------------------------------------------------------

def points(spark: SparkSession, folder: str) -> DataFrame:
    """Two-dimensional points with a class: document length and share of distinct words, by quality."""
    words = F.split(F.lower("text"), r"\s+")
    docs = table(spark, folder, "documents").select(
        "doc_id", F.log(F.col("n_chars")).alias("X1"), (F.size(F.array_distinct(words)) / F.size(words)).alias("X2"))
    joined = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")
    path = fresh_path(spark, "points")
    joined.write.parquet(path)
    return models.repeatable(spark.read.parquet(path), "doc_id")


@query()
def linear_svm(spark, folder):
    """The penalties 1, 100 and none, on raw and standardised points, measured on test points."""
    train, test = parts(features.hash_split(points(spark, folder), "doc_id", 0.3))
    found = []
    scaling = features.fit_standard(train, ["X1", "X2"])
    for scale, apply in (("raw", lambda df: df), ("standard", scaling.apply)):
        rows, unseen = (features.assembler(["X1", "X2"]).transform(apply(df)).persist(StorageLevel.MEMORY_AND_DISK) for df in (train, test))
        for c in (1.0, 100.0, float("inf")):
            model = svm.linear_svm(c).fit(rows)
            scored = model.transform(unseen).withColumn("score", evaluate.decision_score())
            measured = scored.agg(F.count("*"), evaluate.accuracy(), F.min("score"), F.max("score")).first()
            found.append((scale, str(c), *measured, model.gap))
        rows.unpersist()
        unseen.unpersist()
    return spark.createDataFrame(found, "scale string, c string, rows bigint, accuracy double, lowest double, highest double, gap double")


@query()
def weighted_linear_svm(spark, folder):
    """The rarer class weighs ten times as much in the second fit."""
    split = features.hash_split(points(spark, folder), "doc_id", 0.3).withColumn("weight", features.class_weights("label", {0: 10}))
    train, test = parts(split)
    scaling = features.fit_standard(train, ["X1", "X2"])
    rows, unseen = (features.assembler(["X1", "X2"]).transform(scaling.apply(df)).persist(StorageLevel.MEMORY_AND_DISK) for df in (train, test))
    found = []
    for weight in (None, "weight"):
        scored = svm.linear_svm(1.0, weight=weight).fit(rows).transform(unseen)
        r = scored.agg(F.avg((F.col("prediction") == 0).cast("double")), evaluate.accuracy()).first()
        found.append((weight or "none", float(r[0]), float(r[1])))
    rows.unpersist()
    unseen.unpersist()
    return spark.createDataFrame(found, "weighting string, share_of_class_0 double, accuracy double")


@query()
def two_class_svm(spark, folder):
    """Two of the embedding classes, without regularisation."""
    pair = table(spark, folder, "embeddings").where((F.col("label") == 0) | (F.col("label") == 1))
    rows = pair.select("vec_id", F.col("label").cast("double"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)])
    rows = features.assembler([f"e{i}" for i in range(64)]).transform(rows)
    model = models.fit_cached(svm.linear_svm(float("inf")), rows.select("vec_id", "features", "label"))
    return model.transform(rows).groupBy("label").agg(F.count("*").alias("rows"), evaluate.accuracy().alias("accuracy"))


@query()
def kernel_svm(spark, folder):
    """Gaussian kernel machine with probabilities, on test points."""
    train, test = parts(features.hash_split(points(spark, folder), "doc_id", 0.3))
    scaling = features.fit_standard(train, ["X1", "X2"])
    model = svm.fit_kernel_svm(scaling.apply(train), ["X1", "X2"], c=100, gamma=10, probability=True)
    return model.transform(scaling.apply(test)).select("doc_id", "X1", "X2", "label", "prediction", "score", "probability_0")


@query()
def kernel_svm_search(spark, folder):
    """The best of all 81 settings, measured on separate validation rows."""
    rows = features.hash_split(points(spark, folder), "doc_id", 0.3)
    train, validation = parts(rows)
    scaling = features.fit_standard(train, ["X1", "X2"])
    grid = svm.search_kernel_svm(scaling.apply(train), scaling.apply(validation), ["X1", "X2"])
    return first_maximum(grid, "score", "position")
