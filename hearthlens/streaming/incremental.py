"""Incremental load: what is stored already is skipped.

The batch guard is :func:`hearthlens.sources.pending`. For folders that keep growing the same guard
is a file stream: its checkpoint remembers which files were loaded, and each batch leaves out the
entities that the target already holds, by an index of their keys, so a repeated run adds nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from hearthlens.streaming.keyindex import key_index


def load_new_entities(spark: SparkSession, source: str, schema: StructType, target: str, key: str,
                      checkpoint: str, fmt: str = "parquet", slots: int = 256) -> None:
    """Appends the rows of entities that ``target`` does not hold yet, then stops. The keys that are stored are kept in an
    index beside the target, of ``slots`` slots, and a batch reads those slots only that may hold one of its keys.

    An entity is complete once a batch has stored it, as one stored file per entity is; its later
    rows count as repeated collection. Every batch is a folder of the target named by the
    checkpoint and the batch number, and a repeated batch replaces its own folder, so a run that
    dies between writing and remembering does not store rows twice.
    """
    load = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    stream = spark.readStream.schema(schema).format(fmt).load(source)

    index = key_index(f"{target.rstrip('/')}-keys", [key], slots)

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            path = f"{target.rstrip('/')}/load={load}/batch={number}"
            index.pending(batch, load, number).write.mode("overwrite").parquet(path)
            # the rows come first: a run that dies in between stores this batch again before any other
            index.add(spark.read.schema(schema).parquet(path), load, number)
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_loaded(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The stored rows with the load and batch that stored them."""
    return spark.read.schema(StructType(list(schema.fields)).add("load", "string").add("batch", "long")).parquet(target)
