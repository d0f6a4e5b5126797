"""Positions in a global order: running numbers, contiguous folds, ranks of small tables.

An unpartitioned window moves all rows into one task. Here the order is cut into ranges, rows are
numbered inside their range in parallel, and each range starts at the exact count of the rows before it.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthlens.operators.orderstats import order_statistics
from hearthlens.session import shared_folder

ROWS_PER_RANGE = 2_000_000


def ranged(df: DataFrame, order: str, tie: str, ranges: int) -> DataFrame:
    """The rows in ``ranges`` sorted partitions by the two columns, with the range of a row and its place
    in it from 0. A value that many rows share is divided by ``tie`` like any other stretch of the order.

    The range bounds come from a sample, so the rows are written once to the shared folder: what reads
    them later, or again after a lost executor, finds the same places.
    """
    shared_folder(df.sparkSession)
    placed = df.repartitionByRange(ranges, order, tie).sortWithinPartitions(order, tie)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower 33 bits count within a partition
    return placed.withColumns({"__range": F.spark_partition_id(), "__place": place}).checkpoint()


def number_rows(df: DataFrame, order: str, tie: str, out: str = "row_no",
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds 1..n in the order of the column ``order``, ties by the column ``tie``.

    ``tie`` has to be unique among equal ``order`` values, and both have to be free of nulls. The number
    of ranges follows the rows, and the number of jobs depends on neither rows nor values.
    """
    ranges = math.ceil(df.count() / rows_per_range)
    if ranges <= 1:
        return df.withColumn(out, F.row_number().over(Window.orderBy(order, tie)))
    parts = ranged(df, order, tie, ranges)
    # one row per range, so the running total and its broadcast are bounded by the number of ranges
    starts = parts.groupBy("__range").agg(F.count("*").alias("__n")).select(
        "__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    numbered = parts.join(F.broadcast(starts), "__range")
    return numbered.withColumn(out, F.col("__before") + F.col("__place") + 1).drop("__range", "__place", "__before")


def contiguous_folds(df: DataFrame, key: str, folds: int, out: str = "fold") -> DataFrame:
    """Adds 0..folds-1 so that every fold is one run of the order by the unique numeric ``key`` and
    the first n mod ``folds`` folds are one row longer.

    Only the first key of each fold is looked up, so the rows themselves are not moved.
    """
    keys = df.select(key).persist(StorageLevel.MEMORY_AND_DISK)  # the passes read the keys, not what made them
    try:
        total = keys.count()
        longer, base = total % folds, total // folds
        starts, at = [], 0
        for fold in range(folds):
            starts.append(at)
            at += base + (1 if fold < longer else 0)
        firsts = order_statistics(keys, {key: [s for s in starts[1:] if s < total]}, {key: total})
    finally:
        keys.unpersist()
    fold = F.lit(0)
    for i, start in enumerate(starts[1:], start=1):
        if start < total:
            fold = F.when(F.col(key) >= F.lit(firsts[(key, start)]), F.lit(i)).otherwise(fold)
    return df.withColumn(out, fold)


def hashed_folds(df: DataFrame, key: str, folds: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Adds 0..folds-1 from a hash of the key: no counting and no order, about equal folds."""
    return df.withColumn(out, (key_hash(F.col(key), seed) % folds).cast("int"))


def key_hash(key: Column, seed: int = 0) -> Column:
    """52 bits of an md5 of the key and the seed: stable across layouts, sessions and engines, and
    exactly representable as a double."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def rank_small(df: DataFrame, value: str, name: str, out: str = "rank") -> DataFrame:
    """Ranks a table whose size is the number of features: highest value first, ties by name."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.desc_nulls_last(value), name)))
