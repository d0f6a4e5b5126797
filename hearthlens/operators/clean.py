"""Cleaning rules as an ordered list, giving the kept rows and the audit of what each rule removed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.operators.encode import mentions
from hearthlens.operators.joins import fits_broadcast


@dataclass(frozen=True)
class Rule:
    """Rows stay when ``keep`` is true; a null test removes the row."""

    name: str
    keep: Column


PARKING_WORDS = ["车位出售", "地下车位"]


def listing_rules(villa: Column, parking_words: Sequence[str] = tuple(PARKING_WORDS), total_price: str = "t_price",
                  title: str = "title", architecture: str = "architecture_text", level: str = "level_text",
                  height: str = "height") -> list[Rule]:
    """The second-hand listing rules in the order of the cleaning log."""
    villa = F.coalesce(villa, F.lit(False))
    return [
        Rule("missing total price", F.col(total_price).isNotNull()),
        Rule("parking space", ~mentions(F.col(title), parking_words)),
        Rule("missing building structure", F.col(architecture).isNotNull()),
        Rule("missing floor info", F.col(level).isNotNull() | villa),
        Rule("villa", ~villa),
        Rule("no floors", ~F.col(height).eqNullSafe(0)),
    ]


def first_failure(rules: Sequence[Rule]) -> Column:
    """Index of the first rule a row breaks, null for a row that is kept."""
    return F.coalesce(*[
        F.when(~F.coalesce(rule.keep, F.lit(False)), F.lit(i)) for i, rule in enumerate(rules)
    ])


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    for rule in rules:
        df = df.where(rule.keep)
    return df


def row_digest(columns: Sequence[str]) -> Column:
    """256 bits of all values of a row, each with its length; a null is told from an empty value, and a negative zero
    is a zero."""
    def part(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        value = F.when(value == "-0.0", "0.0").otherwise(value)
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256))


def _equal_rows(df: DataFrame, names: Sequence[str], digest: Callable[[Sequence[str]], Column]) -> DataFrame:
    """(own, rest, copies): the distinct values of the columns, the least other values beside them, and how many rows have
    them.

    Rows are grouped by a digest of 32 bytes, copies being put together before they are shuffled, so no text is a
    key. The least and the greatest row of a digest are then compared in full; should they differ, the
    rows of that digest are told apart by their values.
    """
    others = [c for c in df.columns if c not in names]
    own, rest = (F.struct(*[F.col(f"`{c}`") for c in group]) for group in (names, others or names))
    marked = df.select(digest(names).alias("mark"), own.alias("own"), rest.alias("rest"))
    grouped = marked.groupBy("mark").agg(F.min("own").alias("own"), F.max("own").alias("most"), F.min("rest").alias("rest"), F.count("*").alias("copies"))
    alike = F.col("own").eqNullSafe(F.col("most"))
    apart = marked.join(grouped.where(~alike).select("mark"), "mark", "left_semi").groupBy("own").agg(F.min("rest").alias("rest"), F.count("*").alias("copies"))
    return grouped.where(alike).select("own", "rest", "copies").unionByName(apart)


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None, digest: Callable[[Sequence[str]], Column] = row_digest) -> DataFrame:
    """One row of each group of rows that are equal in the columns, by default in all of them. Of rows that differ in
    other columns the least values of these are kept."""
    names = list(columns or df.columns)
    found = _equal_rows(df, names, digest)
    return found.select(*[F.col("own" if c in names else "rest")[c].alias(c) for c in df.columns])


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None, digest: Callable[[Sequence[str]], Column] = row_digest) -> DataFrame:
    """total, distinct and duplicate rows; equal rows are counted before they are shuffled. Numbers are grouped as
    they are, texts by their digest."""
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    if any(kinds[c] in ("string", "binary") for c in names):
        groups = _equal_rows(df.select(*[f"`{c}`" for c in names]), names, digest)
    else:
        groups = df.groupBy(*[f"`{c}`" for c in names]).agg(F.count("*").alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("distinct_rows"),
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def funnel(df: DataFrame, rules: Sequence[Rule], distinct_on: Sequence[str] | None = None) -> DataFrame:
    """Rows removed by each rule, in order, and the rows remaining after it.

    A row that breaks several rules is counted once, at the first. With ``distinct_on`` a last step
    counts duplicate rows among those kept, by a digest of 256 bits. The input is read once.
    """
    failure = first_failure(rules)
    if distinct_on is None:
        failed = df.select(failure.alias("failed"), F.lit(1).cast("bigint").alias("copies"))
    else:  # rows are put together by their digest, kept ones by their values and the others by their rule
        named = F.when(failure.isNull(), row_digest(distinct_on))
        failed = df.groupBy(failure.alias("failed"), named.alias("mark")).agg(F.count("*").alias("copies"))
    counts = failed.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("failed") == i, F.col("copies"))), F.lit(0)).alias(f"r{i}") for i in range(len(rules))],
        F.coalesce(F.sum(F.when(F.col("failed").isNull(), F.col("copies") - 1)), F.lit(0)).alias("copies"),
    )
    steps = [F.struct(F.lit(0).alias("step"), F.lit("raw").alias("rule"),
                      F.lit(0).cast("bigint").alias("removed"), F.col("total").alias("remaining"))]
    remaining = F.col("total")
    removals = [(rule.name, f"r{i}") for i, rule in enumerate(rules)]
    if distinct_on is not None:
        removals.append(("duplicate", "copies"))
    for step, (name, column) in enumerate(removals, start=1):
        remaining = remaining - F.col(column)
        steps.append(F.struct(F.lit(step).alias("step"), F.lit(name).alias("rule"),
                              F.col(column).alias("removed"), remaining.alias("remaining")))
    return counts.select(F.inline(F.array(*steps)))


def impute_by_ratio(df: DataFrame, entity: str, column: str, size: str, donors: dict[str, str]) -> DataFrame:
    """A missing value is filled from a named donor entity, scaled by the ratio of their sizes.

    A named donor that ``df`` has more than once is an error, so the broadcast holds at most one row
    for each of them.
    """
    donor_of = F.create_map(*[F.lit(x) for pair in donors.items() for x in pair])
    given = df.where(F.col(entity).isin(list(donors.values()))).select(
        F.col(entity).alias("__donor"), F.col(column).alias("__value"), F.col(size).alias("__size"))
    if not fits_broadcast(given, len(set(donors.values()))):
        raise ValueError(f"a donor is not unique in {entity}")
    filled = F.coalesce(F.col(column), F.try_divide(F.col("__value") * F.col(size), F.col("__size")))
    return (
        df.withColumn("__donor", donor_of[F.col(entity)])
        .join(F.broadcast(given), "__donor", "left")
        .withColumn(column, filled)
        .select(*df.columns)
    )
