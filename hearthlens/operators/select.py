"""Filters and projections with the null rules of the source tables, where a missing value differs
from every other value and so passes a negated test."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def not_in(column: str, values: Iterable) -> Column:
    return ~F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def not_equal(column: str, value) -> Column:
    return ~F.col(column).eqNullSafe(F.lit(value))


def spread(scan: DataFrame) -> DataFrame:
    """Gives every core a part of a scan that has too few: heavy work per row on a file or two would
    otherwise run in one task. A scan with enough partitions, as of any large table, is left alone.

    Meant for scans: counting the partitions of a shuffle would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that cost much to compute, once per row however often they are used later.

    A later filter is pushed through a projection by copying its expressions, so a pattern match
    would run again for every test of its result. A filter is not pushed through a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [f"`{c}`" for c in df.columns]
    once = df.select(*kept, F.explode(F.array(row)).alias("__once"))
    return once.select(*kept, *[F.col("__once")[n].alias(n) for n in columns])


def by_position(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns[start:stop]])


def all_but(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if c not in names])


def cast_all(df: DataFrame, kind: str = "double", lenient: bool = False) -> DataFrame:
    """Every column cast; a value that does not parse fails the job, or becomes null if lenient."""
    def one(name: str) -> Column:
        c = F.col(f"`{name}`")
        return (c.try_cast(kind) if lenient else c.cast(kind)).alias(name)

    return df.select(*[one(c) for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null at ingest, since aggregates skip nulls but not NaN."""
    return df.select(*[
        F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])


def truncate_to_int(column: Column) -> Column:
    return column.cast("double").cast("int")


def important(names: Iterable[str], importances: Iterable[float], threshold: float = 0.15) -> list[str]:
    """Features whose importance is above the threshold, in their own order."""
    return [n for n, i in zip(names, importances) if i > threshold]


def preview(df: DataFrame, order: list, rows: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def column_info(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and number of values that are not null."""
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns])
    described = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"),
                 F.col(f"`{name}`").alias("non_null"))
        for i, (name, kind) in enumerate(df.dtypes)
    ])
    return counts.select(F.inline(described))


def without_entity(df: DataFrame, column: str, name) -> DataFrame:
    return df.where(not_equal(column, name))
