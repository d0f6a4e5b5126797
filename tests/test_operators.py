import decimal
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlens.operators import clean, evaluate, features, joins, models, numbering, orderstats, profile


def frame(spark, values, parts=4, name="v", kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}").repartition(parts)


SAMPLES = {
    "heavy": [1.0] * 700 + [2.0] * 300,
    "two ends": [0.0] * 500 + [10.0] * 500,
    "skewed": [math.exp(random.Random(1).gauss(0, 4)) for _ in range(1)] + [math.exp(random.Random(i).gauss(0, 4)) for i in range(1500)],
    "distinct": [float(i) for i in random.Random(2).sample(range(100000), 1200)],
    "negative": [random.Random(3 + i).uniform(-1, 1) for i in range(900)],
    "mixed": [5.0] * 400 + [float(i % 97) for i in range(800)],
}


@pytest.mark.parametrize("name", SAMPLES)
def test_order_statistics_by_digits(spark, name):
    values = SAMPLES[name]
    ranks = [0, 1, len(values) // 3, len(values) // 2, 699 % len(values), len(values) - 2, len(values) - 1]
    df = frame(spark, values + [None] * 10)
    found = orderstats.order_statistics(df, {"v": ranks}, digit_bits=5)
    expected = sorted(values)
    assert {r: found[("v", r)] for r in ranks} == {r: expected[r] for r in ranks}


def test_order_statistics_of_several_columns_and_types(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10 ** 15), rng.random(), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a bigint, b double, c int").repartition(3)
    found = orderstats.order_statistics(df, {"a": [10, 500], "b": [500], "c": [999]})
    assert found[("a", 500)] == sorted(r[0] for r in rows)[500] and found[("a", 10)] == sorted(r[0] for r in rows)[10]
    assert found[("b", 500)] == sorted(r[1] for r in rows)[500] and found[("c", 999)] == 999


def test_large_integers_beyond_double_precision(spark):
    values = [2 ** 60 + i for i in range(300)]
    df = frame(spark, values, kind="bigint")
    found = orderstats.order_statistics(df, {"v": [0, 150, 299]}, digit_bits=64)
    assert [found[("v", r)] for r in (0, 150, 299)] == [values[0], values[150], values[299]]


@pytest.mark.parametrize("direct", [0, 10 ** 6])
def test_quantiles_agree_with_linear_interpolation(spark, direct):
    for values in SAMPLES.values():
        found = orderstats.exact_quantiles(frame(spark, values), {"v": [0, 0.25, 0.5, 0.99, 1]}, direct_values=direct)
        assert found["v"] == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.99, 1])), rel=1e-12)


def test_answers_do_not_depend_on_the_size(spark):
    rng = random.Random(11)
    doubles = [rng.gauss(0, 1) * 10.0 ** rng.randint(-320, 300) for _ in range(900)] + [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 1.7e308, -1.7e308, math.inf, -math.inf, 0.1, 0.1]
    long = [decimal.Decimal(rng.randrange(-10 ** 37, 10 ** 37)).scaleb(-10) for _ in range(len(doubles))]
    short = [decimal.Decimal(rng.randrange(-10 ** 9, 10 ** 9)).scaleb(-2) for _ in range(len(doubles))]
    whole = [rng.choice([-2 ** 63, 2 ** 63 - 1, 0, -1, rng.randrange(-10 ** 18, 10 ** 18)]) for _ in range(len(doubles))]
    rows = [(a, b, c, d, float(i % 7), i % 5 - 2) for i, (a, b, c, d) in enumerate(zip(doubles, long, short, whole))] + [(None,) * 6]
    df = spark.createDataFrame(rows, "a double, b decimal(38,10), c decimal(11,2), d bigint, e float, f smallint").repartition(4)
    ranks = [0, 1, 2, 300, 455, 456, 457, len(doubles) - 2, len(doubles) - 1]
    found = orderstats.order_statistics(df, {c: ranks for c in "abcdef"})
    for i, c in enumerate("abcdef"):
        want = sorted(row[i] for row in rows[:-1])
        assert [found[(c, r)] for r in ranks] == [want[r] for r in ranks], c
    points = {c: [k / 17 for k in range(18)] for c in "abcdef"}
    finite = df.where("a between -1e200 and 1e200")
    small, large = (orderstats.exact_quantiles(finite, points, direct_values=n) for n in (10 ** 6, 0))
    assert small == large
    assert orderstats.order_statistics(spark.createDataFrame([(math.nan,), (1.0,), (-math.inf,)], "v double"), {"v": [0, 1, 5]}) == {("v", 0): -math.inf, ("v", 1): 1.0}
    assert math.isnan(orderstats.order_statistics(spark.createDataFrame([(math.nan,), (1.0,)], "v double"), {"v": [1]})[("v", 1)])


def test_passes_of_order_statistics_are_short(spark):
    """Digits are counted in arrays: as column expressions they took a second for about ten thousand doubles on a core."""
    n = 400_000
    df = spark.range(0, n, 1, 4).select((F.pmod(F.col("id") * 7919, F.lit(n)) / 7 - 20_000).alias("a"), (-F.col("id") / 3).alias("b")).localCheckpoint()
    begin = time.monotonic()
    found = orderstats.order_statistics(df, {c: [0, n // 4, n // 2, n - 1] for c in "ab"})
    assert time.monotonic() - begin < 15
    assert [found[("a", r)] for r in (0, n // 4, n // 2, n - 1)] == [r / 7 - 20_000 for r in (0, n // 4, n // 2, n - 1)]
    assert [found[("b", r)] for r in (0, n // 4, n - 1)] == [-(n - 1 - r) / 3 for r in (0, n // 4, n - 1)]


def test_percentile_fixture(spark):
    assert orderstats.percentile(frame(spark, [1.0, 2.0, 4.0, 9.0]), "v", 0.99) == pytest.approx(8.85)
    assert orderstats.percentile(spark.createDataFrame([], "v double"), "v", 0.99) == 0.0
    assert orderstats.exact_quantiles(spark.createDataFrame([], "v double"), {"v": [0.5]}, direct_values=-1)["v"] == [None]


@pytest.mark.parametrize("parts", [1, 5])
def test_running_numbers(spark, parts):
    rng = random.Random(7)
    keys = list(range(2000))
    rows = [(0 if rng.random() < 0.4 else rng.randrange(50), k) for k in keys]
    df = spark.createDataFrame(rows, "v int, id int").repartition(parts)
    expected = {k: i + 1 for i, (_, k) in enumerate(sorted(rows))}
    for per in (100, 10 ** 6):
        found = numbering.number_rows(df, "v", "id", rows_per_range=per)
        assert {r["id"]: r["row_no"] for r in found.collect()} == expected
    ranges = numbering.number_rows(df, "v", "id", rows_per_range=100)
    assert set(ranges.columns) == {"v", "id", "row_no"}


def test_running_numbers_divide_a_heavy_value(spark):
    df = spark.range(1000).select(F.lit(1).alias("v"), "id")
    plan = numbering.number_rows(df, "v", "id", rows_per_range=100)
    assert [r["row_no"] for r in plan.orderBy("id").collect()] == list(range(1, 1001))


@pytest.mark.parametrize("n", [3, 10, 101])
def test_contiguous_folds(spark, n):
    found = numbering.contiguous_folds(spark.range(n).select((F.col("id") * 7).alias("id")), "id", 5)
    sizes = [n // 5 + (1 if i < n % 5 else 0) for i in range(5)]
    expected = [i for i, s in enumerate(sizes) for _ in range(s)]
    assert [r["fold"] for r in found.orderBy("id").collect()] == expected


@pytest.mark.parametrize("n, share, size", [(62597, 0.3, 18780), (10, 0.3, 3), (11, 0.2, 3), (5, 0.0, 0), (4, 1.0, 4)])
def test_exact_split_sizes(spark, n, share, size):
    found = features.exact_split(spark.range(n), "id", share, seed=1)
    assert found.where("split = 'test'").count() == size and found.count() == n


def test_split_does_not_depend_on_layout(spark):
    one = features.exact_split(spark.range(500).coalesce(1), "id", 0.2, 3).where("split = 'test'")
    many = features.exact_split(spark.range(500).repartition(7), "id", 0.2, 3).where("split = 'test'")
    assert sorted(r[0] for r in one.select("id").collect()) == sorted(r[0] for r in many.select("id").collect())


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_with_hot_key(spark, how):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 200).alias("k"))
    lookup = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    expected = sorted(tuple(r) for r in facts.join(lookup, "k", how).select("id", "k", "w").fillna(-1).collect())
    for rows in (10 ** 6, 50):
        found = joins.lookup_join(facts, lookup, "k", how, rows=rows, hot_share=0.05)
        assert sorted(tuple(r) for r in found.select("id", "k", "w").fillna(-1).collect()) == expected


def test_broadcast_is_size_checked(spark):
    facts, lookup = spark.range(100).select(F.col("id").alias("k")), spark.range(60).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    assert joins.fits_broadcast(lookup, 60) and not joins.fits_broadcast(lookup, 59) and not joins.fits_broadcast(lookup, 60, 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.lookup_join(facts, lookup, "k", rows=59, hot_share=0.5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan


def test_zip_and_grid(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"]), (2, [], ["z"])], "id int, n array<string>, u array<string>")
    assert [tuple(r) for r in joins.zip_lists(df, "n", "u", ("name", "url"), ["id"]).collect()] == [(1, 0, "a", "x"), (1, 1, "b", "y")]
    assert joins.parameter_grid(c=[1, 2], gamma=[3, 4]) == [{"c": 1, "gamma": 3}, {"c": 1, "gamma": 4}, {"c": 2, "gamma": 3}, {"c": 2, "gamma": 4}]


def test_group_means_drop_zero_only_group(spark):
    df = spark.createDataFrame([("A", 0.0), ("A", 0.0), ("B", 0.0), ("B", 4.0), ("C", None)], "city string, p double")
    assert [tuple(r) for r in profile.group_means(df, "city", "p", "m").collect()] == [("B", 4.0), ("C", None)]


def test_histogram_tails(spark):
    df = frame(spark, [-1.0, 0.0, 9.99, 10.0, 11.0, None])
    assert [r["n"] for r in profile.histogram(df, "v", 5, 0, 10).orderBy("bin").collect()] == [1, 0, 0, 0, 3]
    assert [r["n"] for r in profile.histogram(df, "v", 5, 10, 10).orderBy("bin").collect()] == [0] * 5
    assert [r["n"] for r in profile.histogram(df.where("v > 99"), "v", 3, 0, 10).orderBy("bin").collect()] == [0] * 3


def test_histogram_keeps_groups_without_a_counted_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -5.0)], "s string, v double")
    assert sorted(tuple(r) for r in profile.histogram(df, "v", 2, 0, 4, ["s"]).collect()) == [("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 1, 0)]


def test_density_sums_to_one_and_constant_column(spark):
    rows = profile.density_histogram(frame(spark, SAMPLES["negative"]), "v").collect()
    width = (max(SAMPLES["negative"]) - min(SAMPLES["negative"])) / 30
    assert sum(r["density"] for r in rows) * width == pytest.approx(1)
    assert sum(r["density"] for r in profile.density_histogram(frame(spark, [5.0] * 4), "v", 10).collect()) / 10 == pytest.approx(1)


def test_kernel_density_is_a_density(spark):
    rows = profile.kernel_density(frame(spark, SAMPLES["negative"]), "v", 80).orderBy("point").collect()
    step = rows[1]["x"] - rows[0]["x"]
    assert sum(r["density"] for r in rows) * step == pytest.approx(1, abs=0.01)
    assert profile.kernel_density(frame(spark, [5.0, 5.0]), "v").count() == 0


def test_pearson(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (4.0, 5.0, None), (None, 5.0, 1.0)], "x double, c double, y double")
    row = df.agg(profile.pearson("x", "c"), profile.pearson("x", "y")).first()
    assert row[0] == 0.0 and row[1] == pytest.approx(1.0)
    assert df.where("x > 99").agg(profile.pearson("x", "y")).first()[0] == 0.0


@pytest.mark.parametrize("parts", [1, 6])
def test_both_correlation_ways_agree(spark, parts):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(400, 4)) * [1, 1e3, 1, 1] + [0, 1e7, 5, 0]
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in row) + (3.0,) for row in data]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts)
    narrow = {(r["col_a"], r["col_b"]): r["r"] for r in profile.correlation_matrix(df, names).collect()}
    wide = {(r["col_a"], r["col_b"]): r["r"] for r in profile.correlation_matrix(df, names, narrow=0).collect()}
    expected = df.toPandas()[names].corr()
    assert narrow.keys() == wide.keys() and len(wide) == 25
    for (a, b), r in wide.items():
        if "e" in (a, b):
            assert r is None and narrow[(a, b)] is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9) and narrow[(a, b)] == pytest.approx(r, abs=1e-9)


def test_top_correlations_break_ties_by_name(spark):
    df = spark.createDataFrame([(1.0, 2.0, -1.0, 5.0), (2.0, 4.0, -2.0, 1.0), (3.0, 6.0, -3.0, 5.5)], "t double, b double, a double, c double")
    assert [r["feature"] for r in profile.top_correlations(df, ["b", "a", "c"], "t", 2).collect()] == ["a", "b"]


def test_describe(spark):
    row = profile.describe(frame(spark, [1.0, 2.0, 4.0, 9.0, None]), ["v"]).first()
    assert (row["count"], row["mean"], row["p25"], row["p50"], row["p75"], row["max"]) == (4, 4.0, 1.75, 3.0, 5.25, 9.0)
    assert row["std"] == pytest.approx(np.std([1, 2, 4, 9], ddof=1))


def test_tag_rates_of_missing_tag(spark):
    df = spark.createDataFrame([(1, None), (0, None)], "park int, light int")
    assert sorted(tuple(r) for r in profile.tag_rates(df, ["park", "light", "water"]).collect()) == [("light", 0.0), ("park", 50.0), ("water", 0.0)]


def test_first_maximum_keeps_the_earliest(spark):
    df = spark.createDataFrame([(2, 0.9), (1, 0.9), (0, 0.5)], "position int, score double")
    assert profile.first_maximum(df, "score", "position").first()["position"] == 1


def test_funnel_counts_a_row_once(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 5, 0), (3, None, 3), (4, 7, 3), (5, 7, 3)], "id int, a int, b int")
    rules = [clean.Rule("a missing", F.col("a").isNotNull()), clean.Rule("b zero", F.col("b") != 0)]
    rows = [tuple(r) for r in clean.funnel(df, rules, ["a", "b"]).orderBy("step").collect()]
    assert rows == [(0, "raw", 0, 5), (1, "a missing", 2, 3), (2, "b zero", 1, 2), (3, "duplicate", 1, 1)]
    assert sorted(r["id"] for r in clean.apply_rules(df, rules).collect()) == [4, 5]


def test_ratio_imputation(spark):
    df = spark.createDataFrame([("江阴", None, 10.0), ("无锡", 6.0, 20.0), ("x", None, 1.0)], "city string, w double, a double")
    found = {r["city"]: r["w"] for r in clean.impute_by_ratio(df, "city", "w", "a", {"江阴": "无锡"}).collect()}
    assert found == {"江阴": 3.0, "无锡": 6.0, "x": None}


def test_scaling(spark):
    constant = frame(spark, [5.0, 5.0, 5.0])
    assert [r[0] for r in features.fit_min_max(constant, ["v"]).apply(constant).collect()] == [0.0] * 3
    df = frame(spark, [1.0, 2.0, 4.0, 9.0])
    row = features.fit_standard(df, ["v"]).apply(df).agg(F.avg("v"), F.stddev_pop("v")).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(1)


def test_chi2_scores(spark):
    rows = [(0, 1.0, 3.0), (0, 2.0, 3.0), (1, 8.0, 3.0), (1, 9.0, 3.0), (1, 10.0, 3.0)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(3)
    found = {r["feature"]: r["score"] for r in features.chi2_scores(df, "y", ["a", "b"]).collect()}
    expected = (3 - 12) ** 2 / 12 + (27 - 18) ** 2 / 18
    assert found["a"] == pytest.approx(expected) and found["b"] == pytest.approx(0)
    assert features.select_k_best(df, "y", ["b", "a"], 1) == ["a"]
    with pytest.raises(ValueError):
        features.chi2_scores(df.withColumn("a", -F.col("a")), "y", ["a"])


def test_measures(spark):
    df = spark.createDataFrame([(2.0, 3.0), (2.5, 3.5), (7.0, 8.0)], "label double, prediction double")
    row = evaluate.regression_metrics(df).first()
    assert row["explained_variance"] == pytest.approx(1) and row["r2"] < 1
    assert row["mse"] == pytest.approx(1) and row["mae"] == pytest.approx(1)
    flat = spark.createDataFrame([(2.0, 3.0), (2.0, 1.0)], "label double, prediction double")
    assert evaluate.regression_metrics(flat).first()["r2"] is None


def test_best_iteration_takes_the_earliest(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 3.0), (2, 3.0), (3, 4.0)], "iter long, RMSE double")
    row = evaluate.best_iteration(df).first()
    assert (row["iterations"], row["first_value"], row["last_value"], row["best_value"], row["best_iter"]) == (4, 5.0, 4.0, 3.0, 1)


def test_both_target_correlation_ways_agree(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(v) if rng.random() > 0.1 else None for v in row) + (7.0,) for row in rng.normal(size=(300, 3)) + [0, 1e6, 5]]
    df = spark.createDataFrame(rows, "a double, b double, y double, c double").repartition(3)
    ways = [{r["feature"]: r["r"] for r in profile.target_correlations(df, ["a", "b", "c"], "y", narrow=n).collect()} for n in (8, 0)]
    assert ways[0]["c"] == ways[1]["c"] == 0.0
    assert ways[0] == pytest.approx(ways[1], abs=1e-9)
    empty = df.where("a > 1e9")
    assert [r["r"] for r in profile.target_correlations(empty, ["a", "b"], "y").collect()] == [0.0, 0.0]


def test_no_range_takes_much_more_than_its_share(spark):
    """A third of all rows share one value, which sits among other values."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 500).otherwise((F.col("id") * 37) % 1000).alias("v"))
    parts = numbering.ranged(df.coalesce(2), "v", "id", 30)
    largest = parts.groupBy("__range").count().agg(F.max("count")).first()[0]
    assert largest <= 500
    found = numbering.number_rows(df, "v", "id", rows_per_range=200)
    expected = sorted((r["v"], r["id"]) for r in df.collect())
    assert [(r["v"], r["id"]) for r in found.orderBy("row_no").collect()] == expected


def test_repeated_lookup_keys_are_refused_at_any_size(spark):
    facts = spark.createDataFrame([("a",), ("b",), (None,)], "city string")
    lookup = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "city string, gdp int")
    for rows in (1, 100):
        with pytest.raises(ValueError):
            joins.lookup_join(facts, lookup, "city", rows=rows)
    found = joins.lookup_join(facts, lookup.where("gdp > 1"), "city", rows=1).collect()
    assert sorted((r.city or "", r.gdp or 0) for r in found) == [("", 0), ("a", 2), ("b", 3)]


def test_rows_are_told_apart_by_value_where_digests_clash(spark):
    rows = [("a", "x", 1), ("a", "x", 0), ("b", None, 2), ("b", None, 2), ("b", "", 3), ("ab", "", 4), ("a", "b", 5), (None, None, 6), ("-", "-", 7)]
    df = spark.createDataFrame(rows, "s string, t string, n int").repartition(3)
    forged = [clean.row_digest, lambda names: F.lit(b"one"), lambda names: F.unhex(F.substring(F.sha2(F.coalesce("s", F.lit("")).cast("binary"), 256), 1, 2))]
    for digest in forged:
        assert sorted(map(repr, clean.drop_duplicates(df, digest=digest).collect())) == sorted(map(repr, df.distinct().collect()))
        kept = {(r.s, r.t): r.n for r in clean.drop_duplicates(df, ["s", "t"], digest).collect()}
        assert kept == {("a", "x"): 0, ("b", None): 2, ("b", ""): 3, ("ab", ""): 4, ("a", "b"): 5, (None, None): 6, ("-", "-"): 7}
        assert list(clean.duplicate_count(df, ["s", "t"], digest).first()) == [9, 7, 2]
    plan = clean.drop_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert keys and all("hashpartitioning(mark" in line or "hashpartitioning(own" in line for line in keys)
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,)], "v double")
    assert clean.drop_duplicates(zeros).count() == 3 and clean.drop_duplicates(zeros.limit(0)).count() == 0


def test_curve_from_one_scan_equals_separate_fits(spark):
    rng = random.Random(2)
    rows = [(i, 10 + rng.random(), rng.random(), i % 3, "test" if i % 5 == 0 else "train") for i in range(400)]
    rows = [(i, a, b, f, s, 3 * a - 2 * b + rng.gauss(0, 0.1)) for i, a, b, f, s in rows]
    df = features.assembler(["a", "b"]).transform(spark.createDataFrame(rows, "id long, a double, b double, fold int, split string, label double"))
    shares = [0.3, 1.0]
    one = evaluate.line_curve(df, "id", shares, 2, test=F.col("split") == "test")
    fit = lambda part: models.fit_cached(models.least_squares(), part)
    other = evaluate.learning_curve(df.where("split = 'train'"), df.where("split = 'test'"), "id", shares, fit)
    crossed, fitted = evaluate.line_curve(df, "id", shares, 2, fold="fold", folds=3), evaluate.fold_curve(df, "id", "fold", 3, shares, fit)
    for a, b in ((one, other), (crossed, fitted)):
        got, want = ({(r["share"], r["measured_on"]): (r["rows"], r["rmse"]) for r in c.collect()} for c in (a, b))
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-6) for k in got)
