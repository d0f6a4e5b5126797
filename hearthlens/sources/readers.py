"""Scans of the stored files: CSV variants, per-city folders, training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hearthlens.schemas import TRAINING_JSON, TRAINING_LOG, doubles
from hearthlens.session import allow_any_charset


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file or folder with a header line and a declared schema."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_csv_named(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV whose own header is replaced by ``names``.

    The header line is skipped rather than read as data, so columns stay castable; they are read
    as text because the caller casts them afterwards.
    """
    schema = ", ".join(f"`{name}` string" for name in names)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def read_gbk_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV in the GBK encoding, Chinese header included."""
    allow_any_charset(spark)
    return spark.read.schema(schema).csv(path, header=True, encoding="GBK", enforceSchema=False)


def read_strict_numeric(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """An all-numeric CSV: a leading byte-order mark is tolerated, columns without a name are
    dropped and a value that is not a number fails the job.

    ``names`` are the file's header names in order, with ``""`` for an unnamed column. Text that is
    empty where a number belongs fails too, as parsing it as a number would.
    """
    kept = [name for name in names if name]
    padded = [name or f"_unnamed{i}" for i, name in enumerate(names)]
    # read as text and cast: pruning unnamed columns then never parses them, and ANSI casts raise
    text = spark.read.csv(path, header=True, schema=", ".join(f"`{n}` string" for n in padded),
                          mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)

    def number(name: str) -> Column:
        value = F.col(f"`{name}`")
        bad = F.raise_error(F.concat(F.lit(f"not a number in column {name}: "), F.coalesce(value, F.lit(""))))
        parsed = value.try_cast("double")
        return F.when(parsed.isNull(), bad.cast("double")).otherwise(parsed).alias(name)

    return text.select(*[number(name) for name in kept])


def read_per_city(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """All cities of a folder laid out as ``city=<name>/``; the city comes from the folder name,
    so a filter on it prunes folders before any file is opened."""
    with_city = StructType(list(schema.fields)).add("city", "string")
    return spark.read.schema(with_city).format(fmt).option("header", True).load(path)


def read_per_city_files(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """CSV files named ``<city>.csv``, every row tagged with the name of its file."""
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (
        spark.read.schema(schema).csv(pattern, header=True)
        .withColumn("city", F.regexp_extract(name, r"([^/]+)\.csv$", 1))
    )


def read_tsv_log(spark: SparkSession, path: str, schema: StructType = TRAINING_LOG) -> DataFrame:
    """A tab-separated training log."""
    return spark.read.schema(schema).csv(path, header=True, sep="\t")


def read_json_log(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON training log, one row per iteration.

    A log that is one pretty-printed document needs ``multi_line``; logs stored one per line are
    splittable and should be read without it.
    """
    log = spark.read.schema(TRAINING_JSON).json(path, multiLine=multi_line)
    return log.select("meta.name", F.inline("iterations")).select(
        "name",
        F.col("iteration").alias("iter"),
        F.get("learn", F.lit(0)).alias("RMSE"),
        "passed_time",
        "remaining_time",
    )


def read_describe_means(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The mean row of a stored profile table as (column, mean) rows.

    The file has a statistic name first and one column per feature. The row is found by its name,
    not its position, because file order is not kept by a parallel scan; a file without that row
    gives no rows.
    """
    schema = StructType().add("stat", "string")
    for field in doubles(names).fields:
        schema = schema.add(field)
    means = spark.read.schema(schema).csv(path, header=True, enforceSchema=True).where("stat = 'mean'")
    return means.unpivot("stat", names, "column", "mean").drop("stat")
