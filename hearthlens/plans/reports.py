"""The tables behind the evaluation charts, from listing frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hearthlens.functions.text import fixed_point
from hearthlens.operators import profile
from hearthlens.operators.features import hash_split
from hearthlens.operators.numbering import rank_small
from hearthlens.schemas import LISTING_TARGET, TAGS


def city_counts(listings: DataFrame, column: str = "url") -> DataFrame:
    return profile.group_counts(listings, "city", column)


def city_unit_price(listings: DataFrame, column: str = "show_price") -> DataFrame:
    return profile.group_means(listings, "city", column, "mean_unit_price")


def city_total_price(listings: DataFrame, column: str = "total_price_start") -> DataFrame:
    return profile.group_means(listings, "city", column, "mean_total_price")


def split_listings(listings: DataFrame, key: str = "id", test_share: float = 0.3, seed: int = 0) -> DataFrame:
    return hash_split(listings, key, test_share, seed)


def target_histograms(split: DataFrame, target: str = LISTING_TARGET) -> DataFrame:
    return profile.capped_histograms(split, target, "split")


def top_correlations(split: DataFrame, features: Sequence[str], target: str = LISTING_TARGET, k: int = 10) -> DataFrame:
    """The strongest correlations of the training rows, with the number as the chart shows it."""
    train = split.where(F.col("split") == "train")
    return profile.top_correlations(train, features, target, k).withColumn("shown", fixed_point(F.col("abs_r"), 3))


def tag_rates(listings: DataFrame, tags: Sequence[str] = TAGS) -> DataFrame:
    return profile.tag_rates(listings, tags).withColumn("shown", fixed_point(F.col("rate"), 1))


def importance_bars(importances: DataFrame) -> DataFrame:
    return rank_small(importances, "importance", "feature").orderBy("rank")


def chart_series(report: DataFrame, name: str, value: str, most: int = 10_000) -> tuple[list, list]:
    """Names and values of an aggregated report as two lists, in its order. Meant for the report
    tables of this module, which have one row per city, bin, tag or feature; a table of more than
    ``most`` rows is no chart and an error."""
    rows = report.select(name, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a chart has at most {most} rows")
    return [row[0] for row in rows], [row[1] for row in rows]


def class_points(points: DataFrame, label: str = "y") -> DataFrame:
    """Points by class; rows of other classes are not drawn."""
    name = F.when(F.col(label).isin(1), "Positive").when(F.col(label).isin(0), "Negative")
    return points.where(F.col(label).isin(0, 1)).select(name.alias("class"), "X1", "X2")
