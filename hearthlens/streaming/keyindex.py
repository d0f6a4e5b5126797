"""An index of stored keys: hash slots, each with a Bloom filter, so that a batch opens only the slots that may hold one
of its keys.

A key's hash names its slot and four bits of the slot's bitmap of 32,768. Every batch that stores keys adds one
bitmap row per slot that it touches and the keys themselves, in one folder per slot. To tell which keys of a batch
are stored already, the bitmaps of a slot are put together, the batch's keys are tested on them, and only the folders
of slots with a possible hit are read, where the keys are compared. A key without a hit is new for certain.

A slot is meant for some 2,000 keys; with more, hits become likelier and more folders are read, the answers stay right.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of a bitmap as the bitmap functions make it, and bits that a key sets.
BITMAP_BITS, KEY_BITS = 32_768, 4


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stored table, or None before anything has been stored there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass(frozen=True)
class KeyIndex:
    """The index in a folder. ``slots`` is chosen when it is made, about one for 2,000 expected keys, and stays."""

    path: str
    keys: tuple[str, ...]
    slots: int = 256

    def _placed(self, df: DataFrame) -> DataFrame:
        """The distinct keys with their slot and bits."""
        columns = [F.col(c) for c in self.keys]
        # the seed keeps the two hashes apart
        return df.select(*columns).distinct().withColumns({
            "slot": F.pmod(F.xxhash64(*columns), F.lit(self.slots)).cast("int"), "mark": F.xxhash64(F.lit(17), *columns)})

    def _bit(self, i: int) -> Column:
        return F.shiftrightunsigned("mark", 15 * i).bitwiseAND(F.lit(BITMAP_BITS - 1))

    def add(self, df: DataFrame, load: str, batch: int) -> None:
        """Stores the keys of a batch. The same batch stored again replaces itself."""
        place = f"load={load}/batch={batch}"
        placed = self._placed(df)
        kept = placed.select(*self.keys, "slot")
        kept.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/keys/{place}")
        bits = placed.select("slot", F.explode(F.array(*[self._bit(i) for i in range(KEY_BITS)])).alias("bit"))
        bits.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.mode("overwrite").parquet(f"{self.path}/bitmaps/{place}")

    def _stored_but(self, spark: SparkSession, what: str, schema: str, load: str | None, batch: int | None) -> DataFrame | None:
        found = _read(spark, f"{self.path}/{what}", f"{schema}, load string, batch long")
        if found is None or load is None:
            return found
        return found.where(~((F.col("load") == load) & (F.col("batch") == batch)))

    def slots_to_open(self, df: DataFrame, load: str | None = None, batch: int | None = None) -> list[int]:
        """The slots that may hold a key of the batch, at most all of them. What the batch itself has stored in an earlier
        attempt does not count."""
        bitmaps = self._stored_but(df.sparkSession, "bitmaps", "slot int, bitmap binary", load, batch)
        if bitmaps is None:
            return []
        joined = bitmaps.groupBy("slot").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

        def is_set(i: int) -> Column:
            byte = F.conv(F.hex(F.substring("bitmap", (self._bit(i) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2), self._bit(i) % 8)) % 2 == 1

        maybe = self._placed(df).join(joined, "slot")
        for i in range(KEY_BITS):
            maybe = maybe.where(is_set(i))
        return sorted(row["slot"] for row in maybe.select("slot").distinct().collect())

    def candidates(self, df: DataFrame, load: str | None = None, batch: int | None = None) -> DataFrame | None:
        """The stored keys of the slots that the batch has to open; other folders are not read."""
        slots = self.slots_to_open(df, load, batch)
        if not slots:
            return None
        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in self.keys)
        stored = self._stored_but(df.sparkSession, "keys", f"{kinds}, slot int", load, batch)
        return None if stored is None else stored.where(F.col("slot").isin(slots)).select(*self.keys)

    def pending(self, df: DataFrame, load: str | None = None, batch: int | None = None) -> DataFrame:
        """The rows whose key is not stored yet; a row with a missing key is never stored."""
        stored = self.candidates(df, load, batch)
        return df if stored is None else df.join(stored.distinct(), list(self.keys), "left_anti")


def key_index(path: str, keys: Sequence[str], slots: int = 256) -> KeyIndex:
    return KeyIndex(path.rstrip("/"), tuple(keys), slots)
