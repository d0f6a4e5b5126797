import pytest
from pyspark.sql import functions as F

from hearthlens.plans import listings, reports

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def priced(spark):
    rows = [("济源", "a", 0.0, 0.0), ("济源", "b", 3000.0, 0.0), ("北京", "c", 60000.0, 900.0), ("北京", None, 70000.0, None), ("上海", "d", None, 800.0)]
    return spark.createDataFrame(rows, "city string, url string, show_price double, total_price_start double")


def test_city_charts(priced):
    assert reports.chart_series(reports.city_counts(priced), "city", "listings") == (["济源", "上海", "北京"], [2, 1, 1])
    assert reports.chart_series(reports.city_unit_price(priced), "city", "mean_unit_price") == (["北京", "济源", "上海"], [65000.0, 3000.0, None])
    # a city with zeros only is not in the chart
    assert reports.chart_series(reports.city_total_price(priced), "city", "mean_total_price") == (["北京", "上海"], [900.0, 800.0])


def test_importance_bars(spark):
    df = spark.createDataFrame([("b", 0.4), ("a", 0.4), ("c", 0.2)], "feature string, importance double")
    assert reports.chart_series(reports.importance_bars(df), "feature", "rank") == (["a", "b", "c"], [1, 2, 3])


def test_class_points(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (3.0, 4.0, 0), (5.0, 6.0, 2)], "X1 double, X2 double, y int")
    assert sorted(tuple(r) for r in reports.class_points(df).collect()) == [("Negative", 3.0, 4.0), ("Positive", 1.0, 2.0)]


def test_target_histograms_share_their_range(spark):
    df = spark.createDataFrame([("train", float(v)) for v in range(200)] + [("test", 1000.0), ("test", 50.0)], "split string, t_price double")
    rows = reports.target_histograms(df).collect()
    assert len(rows) == 84
    assert {s: sum(r["n"] for r in rows if r["split"] == s) for s in ("train", "test")} == {"train": 200, "test": 2}
    assert len({r["lower"] for r in rows}) == 42


def test_feature_table_has_the_modelling_columns(spark):
    from hearthlens.schemas import LISTING_FEATURES, LISTING_TARGET
    df = listings.listing_features(spark, FOLDER)
    assert set(LISTING_FEATURES + [LISTING_TARGET]) <= set(df.columns)
    row = df.agg(*[F.count(c).alias(c) for c in LISTING_FEATURES], F.count("*").alias("rows")).first()
    assert all(row[c] == row["rows"] > 0 for c in LISTING_FEATURES)


def test_same_result_for_other_layouts(spark):
    raw = listings.listing_raw(spark, FOLDER).cache()
    found = []
    for parts in (1, 7):
        rows = listings.parsed(raw.repartition(parts))
        found.append(sorted(tuple(r) for r in reports.city_total_price(rows, "t_price").select(
            "city", F.round("mean_total_price", 9)).collect()))
    raw.unpersist()
    assert found[0] == found[1]


def test_a_chart_has_a_bounded_number_of_rows(spark):
    rows = spark.range(5).selectExpr("id", "id as v")
    assert reports.chart_series(rows, "id", "v", most=5)[0] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        reports.chart_series(rows, "id", "v", most=4)
