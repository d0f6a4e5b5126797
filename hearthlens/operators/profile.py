"""Group figures, descriptive statistics, correlations and distributions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.operators.orderstats import exact_quantiles, percentile
from hearthlens.operators.select import not_equal

NARROW = 8
#: Share of the sum of squares that has to be spread for sums of products to keep enough digits.
SURE_SPREAD = 1e-4
PAIRS_AT_ONCE = 30


def group_counts(df: DataFrame, by: str, column: str, out: str = "listings") -> DataFrame:
    """Rows with a value per group, highest first, ties by name."""
    return df.groupBy(by).agg(F.count(column).alias(out)).orderBy(F.desc(out), by)


def group_means(df: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """Mean of the values other than zero per group, highest first; a group of zeros disappears, a
    group of missing values stays without a mean."""
    return (
        df.where(not_equal(column, 0)).groupBy(by).agg(F.avg(column).alias(out))
        .orderBy(F.desc_nulls_last(out), by)
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum, one row per column."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    parts = []
    for i, c in enumerate(columns):
        parts += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
                  F.min(c).cast("double").alias(f"a{i}"), F.max(c).cast("double").alias(f"z{i}")]
    rows = []
    for i, c in enumerate(columns):
        low, middle, high = (F.lit(q).cast("double") for q in quartiles[c])
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"), F.col(f"a{i}").alias("min"), low.alias("p25"),
            middle.alias("p50"), high.alias("p75"), F.col(f"z{i}").alias("max")))
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def _number(x: Column) -> Column:
    """A value as a double, null for NaN."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _correlation(x: Column, y: Column) -> Column:
    """Pearson r over the rows that have both values, null when one side does not vary. NaN is no value."""
    x, y = _number(x), _number(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson r as an aggregate; 0.0 when a side does not vary or there are no rows."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.coalesce(_correlation(x, y), F.lit(0.0))


def _pair_moments(columns: list[str], centers: list[float], pairs: list[tuple[int, int]]):
    """Sums over the rows of a partition for the pairs of columns, where both have a value."""
    rows, cols = (np.array(side) for side in zip(*pairs))
    names = np.array(columns, dtype=object)
    shift = np.array(centers)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            values = batch.to_numpy(dtype="float64", na_value=np.nan) - shift
            present = ~np.isnan(values)
            x = np.where(present, values, 0.0)
            mask = present.astype("float64")
            sums = np.stack([mask.T @ mask, x.T @ mask, mask.T @ x, (x * x).T @ mask, mask.T @ (x * x), x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            picked = total[:, rows, cols]
            yield pd.DataFrame({"a": names[rows], "b": names[cols], "n": picked[0], "x": picked[1],
                                "y": picked[2], "xx": picked[3], "yy": picked[4], "xy": picked[5]})

    return moments


def _wide_correlations(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """(a, b, r) of the pairs from one pass: each partition sums its products as matrices, and only
    those sums are shuffled, one small row per pair and partition.

    The sums are taken about the mean of each column, which loses digits only where the rows of a pair
    lie far from it or do not vary. Those pairs, few in common data, are found by their sums and taken
    again by the aggregation that narrow tables use, some at a time, so width never changes an answer.
    """
    means = df.agg(*[F.avg(_number(F.col(c))) for c in columns]).first()
    centers = [m if m is not None else 0.0 for m in means]
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    sums = (
        doubles.mapInPandas(_pair_moments(columns, centers, pairs),
                            "a string, b string, n double, x double, y double, xx double, yy double, xy double")
        .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    )
    found, doubtful = {}, []
    seen = {(row["a"], row["b"]): row for row in sums.collect()}  # one row per pair of columns
    for i, j in pairs:
        pair = (columns[i], columns[j])
        row = seen.get(pair)
        if row is None or not row["n"]:
            found[pair] = None
            continue
        spread_x, spread_y = row["xx"] - row["x"] ** 2 / row["n"], row["yy"] - row["y"] ** 2 / row["n"]
        if spread_x > SURE_SPREAD * row["xx"] and spread_y > SURE_SPREAD * row["yy"]:
            found[pair] = (row["xy"] - row["x"] * row["y"] / row["n"]) / math.sqrt(spread_x) / math.sqrt(spread_y)
        else:
            doubtful.append(pair)
    for at in range(0, len(doubtful), PAIRS_AT_ONCE):
        part = doubtful[at:at + PAIRS_AT_ONCE]
        found.update(zip(part, df.agg(*[_correlation(F.col(x), F.col(y)) for x, y in part]).first()))
    return df.sparkSession.createDataFrame([(x, y, r) for (x, y), r in found.items()], "a string, b string, r double")


def correlation_matrix(df: DataFrame, columns: Sequence[str], narrow: int = NARROW) -> DataFrame:
    """All pairs (col_a, col_b, r) over the rows that have both values; null for a constant.

    Few columns are one aggregation inside the JVM. Many would be thousands of aggregation buffers
    per task, so their products are summed as matrices.
    """
    columns = list(columns)
    if len(columns) <= narrow:
        pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
        row = df.agg(*[_correlation(F.col(columns[i]), F.col(columns[j])).alias(f"r{i}_{j}") for i, j in pairs])
        cells = [
            F.struct(F.lit(columns[i]).alias("col_a"), F.lit(columns[j]).alias("col_b"),
                     F.col(f"r{min(i, j)}_{max(i, j)}").alias("r"))
            for i in range(len(columns)) for j in range(len(columns))
        ]
        return row.select(F.inline(F.array(*cells)))

    upper = _wide_correlations(df, columns, [(i, j) for i in range(len(columns)) for j in range(i, len(columns))])
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return upper.select(F.explode(both).alias("p"), "r").select(
        F.col("p.a").alias("col_a"), F.col("p.b").alias("col_b"), "r")


def target_correlations(df: DataFrame, features: Sequence[str], target: str, narrow: int = NARROW) -> DataFrame:
    """(feature, r, abs_r) of every feature with the target, 0.0 where a side does not vary."""
    features = list(features)
    if len(features) > narrow:
        columns = features + [target]
        found = _wide_correlations(df, columns, [(i, len(features)) for i in range(len(features))])
        r = F.coalesce("r", F.lit(0.0))
        return found.select(F.col("a").alias("feature"), r.alias("r"), F.abs(r).alias("abs_r"))
    row = df.agg(*[pearson(c, target).alias(f"r{i}") for i, c in enumerate(features)])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.abs(F.col(f"r{i}")).alias("abs_r"))
             for i, c in enumerate(features)]
    return row.select(F.inline(F.array(*cells)))


def top_correlations(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> DataFrame:
    return target_correlations(df, features, target).orderBy(F.desc("abs_r"), "feature").limit(k)


def histogram(df: DataFrame, value: str, bins: int, lo: float | Column, hi: float | Column,
              by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts (bin, n): values below ``lo`` are dropped, values from ``hi`` on are in the
    last bin, empty bins are kept and an empty range counts nothing."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    v = F.col(value).cast("double")
    inner = F.least(F.floor((v - lo) / ((hi - lo) / F.lit(bins))), F.lit(bins - 1)).cast("int")
    index = F.when((hi > lo) & (v >= lo), F.when(v >= hi, F.lit(bins - 1)).otherwise(inner))
    counted = df.select(*by, index.alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    # at most one entry per bin and group
    entries = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))
    filled = counted.groupBy(*by).agg(F.map_from_entries(entries).alias("found")).withColumn(
        "counts", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                              lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0).cast("bigint"))))
    return filled.select(*by, F.posexplode("counts").alias("bin", "n"))


def capped_histograms(df: DataFrame, value: str, split: str, bins: int = 42, q: float = 0.99,
                      least_cap: float = 100.0) -> DataFrame:
    """Counts per split over one shared range from 0 to the upper percentile of all splits."""
    cap = max(percentile(df, value, q), least_cap)
    width = cap / bins
    return histogram(df, value, bins, 0.0, cap, [split]).select(
        split, "bin", (F.col("bin") * F.lit(width)).alias("lower"), "n")


def density_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts between the extremes divided by n times the bin width, so the areas sum to one."""
    bounds = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"),
                             F.count(value).alias("n")).alias("b")).first()["b"]
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is not None and lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins
    return histogram(df, value, bins, lo, hi).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        F.try_divide(F.col("n"), F.lit(bounds["n"] * width)).alias("density"))


def kernel_density(df: DataFrame, value: str, points: int = 50, cut: float = 3.0) -> DataFrame:
    """Gaussian density estimate (x, density) on an even grid, bandwidth by Scott's rule.

    Every grid point is one running sum of a single aggregation: rows are neither multiplied by the
    grid nor shuffled.
    """
    s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("std"),
               F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    if not s["std"]:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    h = s["std"] * s["n"] ** -0.2
    lo, hi = s["lo"] - cut * h, s["hi"] + cut * h
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    v = F.col(value).cast("double")
    sums = df.agg(*[
        F.avg(F.exp(-F.pow((F.lit(g) - v) / F.lit(h), F.lit(2.0)) / 2.0)).alias(f"g{i}") for i, g in enumerate(grid)
    ])
    rows = [F.struct(F.lit(i).alias("point"), F.lit(g).alias("x"),
                     (F.col(f"g{i}") / F.lit(h * math.sqrt(2 * math.pi))).alias("density")) for i, g in enumerate(grid)]
    return sums.select(F.inline(F.array(*rows)))


def population_stats(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("rows"))


def joint_maximum(df: DataFrame, *columns: str) -> DataFrame:
    """The maximum of each column and over all of them."""
    tops = [F.max(c).alias(f"max_{c}") for c in columns]
    names = [f"max_{c}" for c in columns]
    overall = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return df.agg(*tops).withColumn("max_all", overall)


def tag_rates(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(tag, rate) in percent; a tag without a column, or without values, has rate 0."""
    present = [n for n in names if n in df.columns]
    row = df.agg(F.count("*").alias("__rows"), *[F.avg(n).alias(n) for n in present])
    cells = [
        F.struct(F.lit(n).alias("tag"),
                 (F.coalesce(F.col(n), F.lit(0.0)) * 100 if n in present else F.lit(0.0)).alias("rate"))
        for n in names
    ]
    return row.select(F.inline(F.array(*cells)))


def first_maximum(df: DataFrame, score: str, position: str) -> DataFrame:
    """The row with the highest score, the earliest position among equals."""
    return df.orderBy(F.desc_nulls_last(score), position).limit(1)
