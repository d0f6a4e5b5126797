"""Sinks of the collected and merged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthlens.session import allow_any_charset


def write_per_city(df: DataFrame, path: str, city: str = "city", fmt: str = "parquet",
                   mode: str = "append") -> None:
    """One folder per city. The rebalance hint gathers a city's rows into few files, and adaptive
    execution splits a city that is too big for one task."""
    writer = df.hint("rebalance", city).write.mode(mode).partitionBy(city).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_merged(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The merged national table."""
    df.write.mode(mode).parquet(path)


def write_gbk_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A CSV in the GBK encoding with a header line."""
    allow_any_charset(df.sparkSession)
    df.write.mode(mode).csv(path, header=True, encoding="GBK")


def write_name_line(df: DataFrame, path: str, name: str, position: str, most: int = 1_000_000) -> None:
    """Names joined by commas in the order of ``position``, always one line in one file.

    A line is one value, which one task holds, so a table with more than ``most`` names is refused.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a line has at most {most} names")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(name).alias("name"))))
    line = df.agg(F.array_join(F.transform(pairs, lambda p: p["name"]), ",").alias("value"))
    line.write.mode("overwrite").text(path)


def pending(listed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Entities that are listed but not stored yet."""
    return listed.join(stored.select(*keys).distinct(), keys, "left_anti")
