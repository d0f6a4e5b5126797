import math
import random
import time

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from hearthlens.operators import evaluate, features, hinge, models, numbering, svm


@pytest.fixture(scope="module")
def rows(spark):
    """y = 3 a - 2 b + a step in c, with small noise; d is noise only."""
    rng = random.Random(11)
    data = []
    for i in range(600):
        a, b, c, d = (rng.uniform(0, 1) for _ in range(4))
        data.append((i, a, b, c, d, 3 * a - 2 * b + (4 if c > 0.5 else 0) + rng.gauss(0, 0.05)))
    df = spark.createDataFrame(data, "id bigint, a double, b double, c double, d double, y double")
    return models.repeatable(models.training_frame(df, ["a", "b", "c", "d"], "y", ["id"]), "id", 2).cache()


@pytest.fixture(scope="module")
def parts(rows):
    split = features.hash_split(rows, "id", 0.25).drop("x")
    return split.where("split = 'train'").drop("split").cache(), split.where("split = 'test'").drop("split").cache()


def rmse(model, df):
    return model.transform(df).agg(evaluate.regression_columns()["rmse"]).first()[0]


def spread(df):
    return df.agg(F.stddev_pop("label")).first()[0]


def test_least_squares(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.5 + 7).alias("y"))
    model = models.fit_cached(models.least_squares(), models.training_frame(df, ["x"], "y", ["id"]))
    assert model.coefficients[0] == pytest.approx(2.5) and model.intercept == pytest.approx(7)


def test_forest_beats_the_mean_and_ranks_features(parts):
    train, test = parts
    model = models.fit_cached(models.random_forest(trees=15, depth=6), train)
    assert rmse(model, test) < 0.5 * spread(test)
    found = {r["feature"]: r["importance"] for r in evaluate.importances(train, ["a", "b", "c", "d"], model).collect()}
    assert sum(found.values()) == pytest.approx(1) and max(found, key=found.get) == "c" and min(found, key=found.get) == "d"
    with pytest.raises(ValueError):
        evaluate.importances(train, ["a"], model)


def test_forest_repeats_on_the_same_layout(rows):
    one = models.random_forest(trees=5, depth=4).fit(models.repeatable(rows.repartition(7), "id", 2))
    two = models.random_forest(trees=5, depth=4).fit(models.repeatable(rows.coalesce(1), "id", 2))
    assert np.allclose(one.featureImportances.toArray(), two.featureImportances.toArray(), atol=1e-9)


def test_boosting_curve_falls(parts):
    train, test = parts
    model = models.fit_cached(models.boosted_trees(rounds=12), train)
    curve = models.boosting_curve(model, train)
    assert len(curve) == 12 and all(b <= a + 1e-12 for a, b in zip(curve, curve[1:]))
    assert curve[-1] == pytest.approx(rmse(model, train))


def test_boosting_names():
    model = models.boosted_trees_named(n_estimators=7, learning_rate=0.3, max_depth=4, random_state=1)
    assert (model.getMaxIter(), model.getStepSize(), model.getMaxDepth(), model.getSeed()) == (7, 0.3, 4, 1)
    with pytest.raises(ValueError):
        models.boosted_trees_named(tree_method="hist")


@pytest.mark.parametrize("order", ["contiguous", "hashed"])
def test_stacking(parts, order):
    train, test = parts
    bases = [models.random_forest(trees=8, depth=5, seed=42), models.boosted_trees(rounds=5)]
    model = models.StackedRegressor(bases, "id", folds=3, fold_order=order).fit(train)
    seen = model.out_of_fold
    assert seen.count() == train.count() == seen.select("id").distinct().count()
    assert {"base_0", "base_1", "fold"} <= set(seen.columns)
    scored = model.transform(test)
    assert scored.count() == test.count() and "prediction" in scored.columns
    assert rmse(model, test) < 0.5 * spread(test)


def test_stacking_predictions_are_out_of_fold(parts):
    train, _ = parts
    base = models.random_forest(trees=1, depth=12, seed=1)
    seen = models.StackedRegressor([base], "id", folds=3).fit(train).out_of_fold
    folded = numbering.contiguous_folds(train, "id", 3)
    fitted = base.fit(folded.where("fold != 1"))
    expected = {r["id"]: r["prediction"] for r in fitted.transform(folded.where("fold = 1")).collect()}
    found = {r["id"]: r["base_0"] for r in seen.where("fold = 1").collect()}
    assert found.keys() == expected.keys()
    unseen = seen.agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("base_0"), F.lit(2.0))))).first()[0]
    own = rmse(base.fit(train), train)
    assert unseen > own


def test_fits_of_many_rows_leave_the_memory_to_one_another(spark, parts, monkeypatch):
    monkeypatch.setattr(models, "SIDE_BY_SIDE", 10, raising=False)
    before, running, most, in_memory = set(spark.sparkContext._jsc.getPersistentRDDs().keySet()), [], [], []

    class Watched(models.Estimator):
        def _fit(self, dataset):
            kept = spark.sparkContext._jsc.getPersistentRDDs()
            in_memory.extend(kept[k].name() for k in kept.keySet() if k not in before and kept[k].getStorageLevel().useMemory())
            running.append(1)
            most.append(len(running))
            time.sleep(0.3)
            running.pop()
            return line

    line = models.least_squares().fit(parts[0])
    models.StackedRegressor([Watched()], "id", folds=3).fit(parts[0])
    assert most == [1] * 4 and not in_memory


def test_component_forest(rows):
    train = rows.select("id", "a", "b", "c", "d", F.col("label").alias("y"))
    score, model = models.scaled_pca_forest(train, ["a", "b", "c", "d"], "y", models.random_forest(trees=10, depth=6))
    scored = score(train)
    assert model.numFeatures == 4
    assert scored.agg(evaluate.regression_columns()["r2"]).first()[0] > 0.5


def test_components_keep_the_total_variance(spark, rows):
    scaling, model = features.fit_pca(rows, ["a", "b", "c"])
    assert features.explained_variance(rows, model).agg(F.sum("share")).first()[0] == pytest.approx(1)
    row = model.transform(scaling.apply(rows)).select(F.expr("0")).count()
    assert row == rows.count()


def test_class_forest(parts):
    train, test = parts
    train, test = (features.price_classes(df, "label", 2, "k").drop("label").withColumn("label", F.col("k").cast("double")) for df in (train, test))
    model = models.fit_cached(models.forest_classifier(trees=15, depth=6), train)
    assert model.transform(test).agg(evaluate.accuracy()).first()[0] > 0.85


def test_learning_curves(parts):
    train, test = parts
    fit = lambda df: models.fit_cached(models.least_squares(), df)
    curve = {(r["share"], r["measured_on"]): (r["rows"], r["rmse"]) for r in evaluate.learning_curve(train, test, "id", [0.3, 1.0], fit).collect()}
    assert curve[(1.0, "train")][0] == train.count() and 0 < curve[(0.3, "train")][0] < train.count()
    assert curve[(0.3, "test")][0] == curve[(1.0, "test")][0] == test.count()
    crossed = evaluate.fold_curve(numbering.hashed_folds(train, "id", 3), "id", "fold", 3, [1.0], fit).collect()
    assert {r["measured_on"]: r["rows"] for r in crossed} == {"train": 2 * train.count(), "test": train.count()}


@pytest.fixture(scope="module")
def ring(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        data.append((i, x, y, float(x * x + y * y < 0.5)))
    return spark.createDataFrame(data, "id bigint, X1 double, X2 double, label double").coalesce(1).cache()


def test_linear_machine_separates(spark):
    data = [(float(x), float(y), float(x + y > 10)) for x in range(10) for y in range(12) if abs(x + y - 10) > 1]
    df = features.assembler(["a", "b"]).transform(spark.createDataFrame(data, "a double, b double, label double").coalesce(1))
    for c in (100.0, math.inf):
        scored = svm.linear_svm(c, len(data), max_iter=60).fit(df).transform(df)
        assert scored.agg(evaluate.accuracy()).first()[0] == 1.0
        wrong = scored.withColumn("s", evaluate.decision_score()).where("(s > 0) != (label = 1)")
        assert wrong.count() == 0


def test_class_weights_favour_the_class(ring):
    rows = features.assembler(["X1", "X2"]).transform(ring.withColumn("w", features.class_weights("label", {1: 10})))
    plain = svm.linear_svm(1.0, 400, max_iter=30).fit(rows).transform(rows).agg(F.avg("prediction")).first()[0]
    heavy = svm.linear_svm(1.0, 400, max_iter=30, weight="w").fit(rows).transform(rows).agg(F.avg("prediction")).first()[0]
    assert heavy > plain


def test_mapped_rows_approach_the_kernel(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "i int, x array<double>")
    mapped = {r["i"]: np.array(r["m"]) for r in df.select("i", svm.fourier_features(F.col("x"), 3, 0.5, 4000).alias("m")).collect()}
    worst = max(abs(mapped[i] @ mapped[j] - math.exp(-0.5 * ((points[i] - points[j]) ** 2).sum())) for i in range(30) for j in range(30))
    assert worst < 0.12


def test_kernel_machine_learns_a_ring(ring):
    model = svm.fit_kernel_svm(ring, ["X1", "X2"], c=10, gamma=1.0, size=100, max_iter=25, probability=True)
    scored = model.transform(ring)
    assert scored.agg(evaluate.accuracy()).first()[0] > 0.9
    row = scored.agg(F.min("probability_0"), F.max("probability_0"),
                     F.avg(F.when(F.col("label") == 0, F.col("probability_0"))), F.avg(F.when(F.col("label") == 1, F.col("probability_0")))).first()
    assert 0 <= row[0] <= row[1] <= 1 and row[2] > row[3]


def test_search_covers_the_grid_and_keeps_the_first_of_equals(ring):
    train, check = ring.where("id % 2 = 0"), ring.where("id % 2 = 1")
    grid = svm.search_kernel_svm(train, check, ["X1", "X2"], [0.1, 10], [0.01, 1.0], size=60, max_iter=10)
    rows = grid.orderBy("position").collect()
    assert [(r["c"], r["gamma"]) for r in rows] == [(0.1, 0.01), (0.1, 1.0), (10.0, 0.01), (10.0, 1.0)]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert max(r["score"] for r in rows if r["gamma"] == 1.0) > 0.85


def test_two_classes_from_prices(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("p"))
    sizes = [r["count"] for r in features.price_classes(df, "p", 4, "k").groupBy("k").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2


def test_partitions_follow_the_rows():
    assert models.training_partitions(10, 8) == 1
    assert models.training_partitions(120_000, 8) == 6
    assert models.training_partitions(10 ** 7, 8) == 24
    assert models.training_partitions(10 ** 12, 4000) == 500_000


def test_machines_reach_the_proven_optimum(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 2)) * [1, 1000] + [0, 50_000]
    labels = (points[:, 0] + 0.7 * rng.normal(size=300) > 0.2).astype(float)
    weights = rng.integers(0, 4, size=300)
    rows = [(float(a), float(b), float(y), float(w)) for (a, b), y, w in zip(points, labels, weights)]
    df = features.assembler(["a", "b"]).transform(spark.createDataFrame(rows, "a double, b double, label double, w double")).repartition(3)
    copies = df.withColumn("copy", F.explode(F.expr("sequence(1, cast(w as int))"))).where("w > 0")
    for c in (0.01, 1.0, 100.0):
        model = svm.linear_svm(c, weight="w", tol=1e-6).fit(df)
        assert 0 <= model.gap <= max(1e-6, 1e-6 * model.getOrDefault(model.loss))
        w, b = np.array(model.coefficients), model.intercept
        signs, total = 2 * labels - 1, weights.sum()

        def loss(v, d):
            return v @ v / (2 * total * c) + (weights * np.maximum(0, 1 - signs * (points @ v + d))).sum() / total

        assert abs(loss(w, b) - model.getOrDefault(model.loss)) < 1e-9
        for _ in range(200):
            step = rng.normal(size=2) * 10.0 ** rng.uniform(-8, 0) / [1, 1000]
            assert loss(w + step, b - step @ points.mean(axis=0) + rng.normal() * 1e-3) >= model.getOrDefault(model.bound)
        other = svm.linear_svm(c, tol=1e-6).fit(copies)
        assert np.allclose(other.coefficients, w, atol=1e-5) and abs(other.intercept - b) < 1e-2
    with pytest.raises(ValueError):
        svm.linear_svm(1.0).fit(df.where("a > 1e9"))
    one_class = svm.linear_svm(1.0).fit(df.where("label = 1"))
    assert one_class.getOrDefault(one_class.loss) < 1e-6 and one_class.transform(df).where("prediction = 0").isEmpty()


def test_component_forest_keeps_two_columns(rows, monkeypatch):
    """Rows at hand for the fit are components and label, not the columns, scaled columns and vectors they are made of."""
    kept = []
    fit = models.fit_cached
    monkeypatch.setattr(models, "fit_cached", lambda estimator, df: kept.append(df.columns) or fit(estimator, df))
    score, _ = models.scaled_pca_forest(rows, ["a", "b", "c", "d"], "label", models.random_forest(trees=2, depth=2))
    assert kept == [["components", "label"]] and {"id", "prediction"} <= set(score(rows).columns)


def test_sums_of_machines_stay_in_the_tasks(ring, monkeypatch):
    """No pass sends the curvature of the machines to the driver: of 12 machines on 100 features it took 1 MB a task."""
    rows = ring.repartition(8)
    sent = []
    collect = type(rows).collect

    def counted(self):
        found = collect(self)
        sent.append(sum(len(v) for row in found for v in row if isinstance(v, (bytes, bytearray))))
        return found

    monkeypatch.setattr(hinge, "GATHERED", 2)  # and groups of tasks
    monkeypatch.setattr(type(rows), "collect", counted)
    x = F.array("X1", "X2")
    mappings = [hinge.FourierMap(2, gamma, 100, 0) for gamma in (0.1, 1.0, 10.0)]
    found = hinge.fit_machines(rows, x, [0.1, 1, 10, 100], mappings, tolerance=1e-3, max_rounds=60)
    assert 0 < max(sent) <= hinge.SMALL_SUMS and all(m.gap <= max(1e-3 * m.loss, 1e-6) for m in found)
    monkeypatch.setattr(hinge, "SMALL_SUMS", 1 << 40)
    for one, other in zip(found, hinge.fit_machines(rows, x, [0.1, 1, 10, 100], mappings, tolerance=1e-3, max_rounds=60)):
        assert np.allclose(one.coefficients, other.coefficients, atol=1e-6) and one.rounds == other.rounds and one.c == other.c


def test_machines_are_saved_and_read_again(spark, ring, tmp_path):
    rows = features.assembler(["X1", "X2"]).transform(ring)
    chain = Pipeline(stages=[svm.linear_svm(1.0), svm.KernelMachine(inputCols=["X1", "X2"], c=10.0, size=50, probability=True, predictionCol="curved")])
    model = chain.fit(rows)
    chain.write().overwrite().save(str(tmp_path / "chain"))
    model.write().overwrite().save(str(tmp_path / "model"))
    columns = ["id", "prediction", "curved", "score", "probability_0"]
    want = model.transform(rows).select(*columns).orderBy("id").collect()
    assert PipelineModel.load(str(tmp_path / "model")).transform(rows).select(*columns).orderBy("id").collect() == want
    again = Pipeline.load(str(tmp_path / "chain"))
    assert again.getStages()[1].getOrDefault("c") == 10.0 and again.copy().getStages()[1].getInputCols() == ["X1", "X2"]
    gaps = spark.createDataFrame([(0, 0.1, None, 1.0)], "id long, X1 double, X2 double, label double")
    shown = model.stages[1].transform(gaps).select("score", "curved", "probability_0").first()
    assert list(shown) == [None, None, None]


def test_stacks_are_saved_copied_and_put_in_pipelines(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random()) for i in range(120)]
    df = features.assembler(["a", "b"]).transform(
        spark.createDataFrame([(i, a, b, 2 * a - b + rng.gauss(0, 0.1)) for i, a, b in rows], "id long, a double, b double, label double"))
    stack = models.StackedRegressor([models.least_squares(), models.random_forest(trees=3, depth=2)], "id", folds=3, fold_order="hashed")
    chain = Pipeline(stages=[stack])
    model = chain.fit(df)
    chain.write().overwrite().save(str(tmp_path / "chain"))
    model.write().overwrite().save(str(tmp_path / "model"))
    want = model.transform(df).select("id", "prediction").orderBy("id").collect()
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.transform(df).select("id", "prediction").orderBy("id").collect() == want
    assert again.stages[0].out_of_fold.count() == 120 and again.copy().transform(df).select("id", "prediction").orderBy("id").collect() == want
    read = Pipeline.load(str(tmp_path / "chain")).getStages()[0]
    assert (read.key, read.folds, read.fold_order, len(read.bases), read.uid) == ("id", 3, "hashed", 2, stack.uid)
    assert read.bases[1].getNumTrees() == 3 and stack.copy().bases[1].getNumTrees() == 3
    other = Pipeline.load(str(tmp_path / "chain")).fit(df).transform(df).select("id", "prediction").orderBy("id").collect()
    assert [r.prediction for r in other] == pytest.approx([r.prediction for r in want], rel=1e-9)


def counted_rows(spark, df, column):
    """The rows with an accumulator that tells how often the column has been computed."""
    times = spark.sparkContext.accumulator(0)

    def seen(value):
        times.add(1)
        return value

    return df.withColumn(column, F.udf(seen, df.schema[column].dataType).asNondeterministic()(column)), times


def test_component_forest_reads_its_listings_once(spark, monkeypatch):
    from hearthlens.plans import exact_model_queries

    rng = random.Random(8)
    listed = [(i, rng.randrange(1, 5), rng.randrange(1, 8), float(rng.randrange(9))) for i in range(60)]
    rows, times = counted_rows(spark, spark.createDataFrame(listed, "id bigint, hall int, room int, t_price double"), "hall")
    monkeypatch.setattr(exact_model_queries.listings, "listing_features", lambda *_: rows)
    assert exact_model_queries.component_forest_of_one_split(spark, "").count() > 0
    assert times.value == 60


def test_cuts_and_folds_compute_their_column_once(spark):
    rows, times = counted_rows(spark, spark.range(40).select("id", (F.col("id") * 2.0).alias("p")), "p")
    assert features.price_cuts(rows, "p", 4) == [18.0, 38.0, 58.0] and times.value == 40
    rows, times = counted_rows(spark, spark.range(40), "id")
    folded = numbering.contiguous_folds(rows, "id", 3)
    assert times.value == 40
    assert [r["count"] for r in folded.groupBy("fold").count().orderBy("fold").collect()] == [14, 13, 13]


def test_step_lengths_are_tried_on_few_rows_at_once():
    import tracemalloc

    rng = np.random.default_rng(3)
    x, y, s = rng.normal(size=(20_000, 2)), np.sign(rng.normal(size=20_000)), rng.uniform(1, 3, 20_000)
    machine, direction = hinge.Machine(1.0, None, np.zeros(2), point=rng.normal(size=3), width=0.3), rng.normal(size=3)
    measure, length = hinge._sums_along([machine], [direction], np.zeros(2))
    tracemalloc.start()
    found = measure(x, y, s)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = np.c_[x, np.ones(len(x))]
    for step, value in zip(hinge.STEPS, found):
        z = 1 - y * (rows @ (machine.point + step * direction))
        assert value == pytest.approx(s @ np.where(z < 0, 0, np.where(z < 0.3, z * z / 0.6, z - 0.15)), rel=1e-9)
    assert length == len(found) and most < 20_000 * length * 8


def test_rows_are_mapped_and_measured_a_piece_at_a_time():
    """All rows of a block used to be mapped at once, which took more than the cache and the library's cosine most of the time."""
    import tracemalloc

    rng = np.random.default_rng(7)
    x, y, s = 30 * rng.normal(size=(20_000, 2)), np.sign(rng.normal(size=20_000)), rng.uniform(1, 3, 20_000)
    mapping = hinge.FourierMap(2, 3.0, 50, 0)
    machines = [hinge.Machine(c, mapping, np.zeros(50), point=rng.normal(size=51), width=0.3) for c in (1.0, 10.0)]
    measure, length = hinge._sums_at(machines, np.zeros(2))
    tracemalloc.start()
    found = measure(x, y, s)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    directions, offsets, scale = mapping.arrays()
    rows = np.c_[scale * np.cos(x @ directions + offsets), np.ones(len(x))]
    assert np.abs(hinge._rows(x[:5000], mapping.arrays(), np.zeros(2)) - rows[:5000]).max() < 1e-12
    for machine, sums in zip(machines, found.reshape(2, -1)):
        margins = 1 - y * (rows @ machine.point)
        dual, near = np.clip(margins / 0.3, 0, 1), (margins > 0) & (margins < 0.3)
        ups, downs = (s * dual * (y > 0)) @ rows, (s * dual * (y < 0)) @ rows
        bend = (rows[near] * s[near, None]).T @ rows[near] / 0.3
        want = [s @ (dual * (margins - 0.15 * dual)), s @ np.maximum(margins, 0), ups[-1], downs[-1], *ups[:-1], *downs[:-1],
                *((s * dual * y)[near] @ rows[near]), *bend[np.triu_indices(51)]]
        assert sums == pytest.approx(np.array(want), rel=1e-9, abs=1e-8)
    assert length == len(found) and most < rows.nbytes / 2
