"""Enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 0.005


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is at most so many rows and bytes; reads no more than ``rows`` + 1 rows."""
    length = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            length = length + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        else:
            length = length + 16
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(length.cast("bigint")).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left",
                rows: int = BROADCAST_ROWS, hot_share: float = HOT_SHARE) -> DataFrame:
    """Adds the columns of ``lookup``, which has one row per key, to every fact. A key that the lookup
    repeats is an error at any size; its rows without a key match nothing.

    A lookup of checked size is broadcast. A bigger one is joined by a shuffle, after the keys that
    may hold a large share of the facts are taken out: their few lookup rows are broadcast, so a
    key with a third of all facts never meets in one task. Facts without a key go the same way.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    if not lookup.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        raise ValueError(f"{key} is not unique in the lookup table")
    if fits_broadcast(lookup, rows):
        return facts.join(F.broadcast(lookup), key, how)
    # one lookup row for each of them: every key with at least this share is in the list, and the list has at most about 1 / share keys
    hot = [k for k in facts.where(F.col(key).isNotNull()).stat.freqItems([key], hot_share).first()[0]]
    hot_lookup = lookup.where(F.col(key).isin(hot)) if hot else lookup.limit(0)
    is_hot = F.col(key).isNull() | (F.col(key).isin(hot) if hot else F.lit(False))
    spread = facts.where(is_hot).join(F.broadcast(hot_lookup), key, how)
    shuffled = facts.where(~is_hot).join(lookup, key, how)
    return spread.unionByName(shuffled)


def zip_lists(df: DataFrame, names: str, values: str, out: tuple[str, str], keep: list[str],
              position: str = "pos") -> DataFrame:
    """One row per position of two parallel arrays, as long as the shorter one."""
    pairs = F.arrays_zip(F.col(names).alias("a"), F.col(values).alias("b"))
    shorter = F.least(F.size(names), F.size(values))
    paired = F.when(shorter > 0, F.slice(pairs, F.lit(1), shorter))
    return df.select(*keep, F.posexplode(paired).alias(position, "pair")).select(
        *keep, position, F.col("pair.a").alias(out[0]), F.col("pair.b").alias(out[1]))


def zip_to_map(names: Column, values: Column) -> Column:
    return F.map_from_arrays(names, values)


def parameter_grid(**lists: list) -> list[dict]:
    """All combinations of parameter lists, the first list varying slowest."""
    grid = [{}]
    for name, values in lists.items():
        grid = [{**point, name: value} for point in grid for value in values]
    return grid
