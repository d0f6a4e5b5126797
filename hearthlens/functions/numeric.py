"""Numbers: parsing with a fallback, kernels, densities, grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def page_count(total: Column, per_page: int = 10) -> Column:
    """Pages needed for ``total`` items given as text; 1 when the text is not a whole number."""
    return F.coalesce(F.ceil(total.try_cast("bigint") / F.lit(per_page)), F.lit(1)).cast("int")


def attribute_number(text: Column) -> Column:
    """The number after the first colon of the first comma-separated item of ``{"k":v,...}``;
    1 when there is none."""
    first = F.get(F.split(text, ","), F.lit(0))
    value = F.get(F.split(first, ":"), F.lit(1))
    return F.coalesce(value.try_cast("int"), F.lit(1))


def page_urls(df: DataFrame, base: str, pages: str, suffix: str = "/", prefix: str = "pg",
              page: str = "page", url: str = "page_url") -> DataFrame:
    """One row per page 1..n of every entity, with a freshly built address."""
    numbers = F.when(F.col(pages) >= 1, F.sequence(F.lit(1), F.col(pages).cast("int")))
    return df.withColumn(page, F.explode(numbers)).withColumn(
        url, F.concat(F.col(base), F.lit(prefix), F.col(page).cast("string"), F.lit(suffix)))


def gaussian_kernel(x: Column, y: Column, sigma: float) -> Column:
    """exp(-|x - y|^2 / (2 sigma^2)) of two arrays of numbers."""
    gaps = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    squared = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)
    return F.exp(-squared / F.lit(2.0 * sigma * sigma))


def normal_density(x: Column, mean: Column | float, std: Column | float) -> Column:
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    std = std if isinstance(std, Column) else F.lit(float(std))
    z = (x - mean) / std
    return F.exp(-z * z / F.lit(2.0)) / (std * F.lit(math.sqrt(2.0 * math.pi)))


def linspace(lo: Column, hi: Column, points: int) -> Column:
    """``points`` evenly spaced numbers from ``lo`` to ``hi``, both included, as an array."""
    if points == 1:
        return F.array(lo.cast("double"))
    step = (hi - lo) / F.lit(points - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.when(i == points - 1, hi.cast("double")).otherwise(lo + i * step),
    )


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))
