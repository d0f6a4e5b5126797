"""From raw documents to packed training sequences: language, toxicity, near-duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthlens.llm import language, minhash, packing, toxicity
from hearthlens.llm.common import emptied, free_name
from hearthlens.operators.numbering import number_rows
from hearthlens.session import fresh_path

#: A document whose language is less sure than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: A document that is toxic with at least this probability is rejected.
TOXIC = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is known and sure. A null text, or one without a letter, has no
    language and goes."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))), key="doc_id")
    name = free_name(docs, "language")
    found = docs.withColumn(name, language.predicted(spark, model, docs["text"]))
    return found.where((F.col(name)["lang_pred"] != language.UNKNOWN) & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)).drop(name)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not toxic, by a chain trained on the labels of those that are here."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    chain = toxicity.fit(toxicity.labelled(docs, labels), toxicity.CATEGORIES, key="key")
    name = free_name(docs, "toxicity")
    return docs.withColumn(name, toxicity.predicted(spark, chain, docs["text"])).where(F.col(name)["p_toxic"] < TOXIC).drop(name)


def row_identities(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows that have an id, with a column whose number stands for one (doc_id, text) in the order of the id
    and the text's digest. Where no id has two texts, which takes one count of ids and digests, that is the id."""
    named = docs.where(docs["doc_id"].isNotNull())
    digest = free_name(docs, "digest")
    marked = named.withColumn(digest, F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    several = marked.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a < b")
    if several.isEmpty():
        return named, "doc_id"
    number = free_name(docs, "number")
    numbers = number_rows(marked.select("doc_id", digest).distinct(), "doc_id", digest, number)
    return marked.join(numbers, ["doc_id", digest]).select(*docs.columns, number), number


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, on runs of five words and a similarity of 0.8: the one
    with the smallest id, and of an id with several texts that with the smallest digest. Texts that share an id
    and nothing else are different documents and stay. Of rows equal in id and text one stays, by the
    hash of its other columns. Rows without an id stay."""
    named, row = row_identities(docs)
    kept = minhash.near_duplicates(named, words=5, percent=80, key=row).where("kept")
    name = free_name(named, "kept_id")
    chosen = named.join(kept.select(F.col(row).alias(name)).distinct(), named[row] == F.col(name), "left_semi")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    first = chosen.groupBy(F.col(row).alias(name)).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("first"))
    return first.select("first.*").unionByName(docs.where(docs["doc_id"].isNull()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(packing.text_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, 2048), 2048)


STAGES = [("language", language_stage), ("toxicity", toxicity_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]

#: Models and tokens are beyond SQL; the stages are tested against plainer versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    previous = None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if previous:
            emptied(spark, previous)
        previous = path
    return docs
