"""Token ids in binary shard files with a minimal perfect hash index.

A shard is one file:

    magic "TKIDX001" | width of an id in bytes, records, distinct keys, buckets (four u4) | ids in all (u8)
    pilots   i4 per bucket         what sends the keys of a bucket to free slots
    prints   u4 per distinct key   fingerprint of the key that owns the slot
    firsts   u4 per distinct key   number of the key's first record
    copies   u4 per distinct key   its records, which follow one another
    keys     i8 per record, nulls  u1 per record
    offsets  u8 per record and one more, in ids
    payload  raw little-endian ids

A key goes to its slot by two hashes and one pilot, so a lookup reads a constant number of fields and
one run of ids; the fingerprint, and then the stored key, refuse a key that is not there. Shards hold
documents in ascending key order, each file the ones after the file before.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthlens.llm.common import ship, stored
from hearthlens.llm.tokens import encoder, id_batches

MAGIC = b"TKIDX001"
HEAD = struct.Struct("<8sIIIIQ")
SHARD_BYTES = 32 << 20
KEYS_PER_BUCKET = 2
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _mixed(x: int) -> int:
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & _MASK
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & _MASK
    return x ^ (x >> 33)


def key_hashes(keys: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of a key; a null key is a key of its own."""
    seed = np.where(nulls.astype(bool), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
    first = mix(keys.astype("<i8").view("<u8") ^ seed)
    return first, mix(first + np.uint64(_STEP))


def slot_of(second: int, pilot: int, slots: int) -> int:
    return -pilot - 1 if pilot < 0 else _mixed(second ^ (pilot * _STEP & _MASK)) % slots


def build_index(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of the buckets and the slot of each key. Buckets are placed largest first; a bucket of
    one key takes a free slot directly, written as a negative pilot."""
    slots = len(first)
    count = max(1, -(-slots // KEYS_PER_BUCKET))
    bucket = (first % np.uint64(count)).astype(np.int64)
    sizes = np.bincount(bucket, minlength=count)
    by_bucket = np.argsort(bucket, kind="stable")
    ends = np.cumsum(sizes)
    pilots, where = np.zeros(count, dtype="<i4"), np.zeros(slots, dtype=np.int64)
    taken = bytearray(slots)
    values = second.tolist()
    order = np.argsort(-sizes, kind="stable").tolist()
    singles = []
    for b in order:
        if sizes[b] <= 1:
            if sizes[b]:
                singles.append(b)
            continue
        members = by_bucket[ends[b] - sizes[b]:ends[b]].tolist()
        pilot = 0
        while True:
            found = {slot_of(values[m], pilot, slots) for m in members}
            if len(found) == len(members) and not any(taken[s] for s in found):
                break
            pilot += 1
        pilots[b] = pilot
        for m in members:
            where[m] = slot_of(values[m], pilot, slots)
            taken[where[m]] = 1
    free = iter([s for s in range(slots) if not taken[s]])
    for b in singles:
        slot = next(free)
        pilots[b] = -slot - 1
        where[by_bucket[ends[b] - 1]] = slot
    return pilots, where


def write_shard(keys: list[int | None], ids: list[bytes]) -> bytes:
    """The file of records in ascending key order, nulls first; equal keys stand together."""
    nulls = np.array([k is None for k in keys], dtype="u1")
    numbers = np.array([k or 0 for k in keys], dtype="<i8")
    lengths = np.array([len(raw) // 4 for raw in ids], dtype="<u8")
    offsets = np.concatenate([np.zeros(1, dtype="<u8"), np.cumsum(lengths, dtype="<u8")])
    payload = np.frombuffer(b"".join(ids), dtype="<u4")
    width = 4 if payload.size and payload.max() > 0xFFFF else 2
    starts = np.ones(len(keys), dtype=bool)
    starts[1:] = (numbers[1:] != numbers[:-1]) | (nulls[1:] != nulls[:-1])
    firsts = np.flatnonzero(starts)
    copies = np.diff(np.append(firsts, len(keys)))
    first, second = key_hashes(numbers[firsts], nulls[firsts])
    pilots, where = build_index(first, second)
    prints, places, times = (np.zeros(len(firsts), dtype="<u4") for _ in range(3))
    prints[where] = (second >> np.uint64(32)).astype("<u4")
    places[where] = firsts
    times[where] = copies
    return b"".join([
        HEAD.pack(MAGIC, width, len(keys), len(firsts), len(pilots), payload.size), pilots.tobytes(), prints.tobytes(),
        places.tobytes(), times.tobytes(), numbers.tobytes(), nulls.tobytes(), offsets.tobytes(),
        payload.astype(f"<u{width}").tobytes()])


class Shard:
    """Reads the bytes of one shard file."""

    def __init__(self, raw: bytes):
        magic, self.width, self.records, self.slots, buckets, self.total = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def section(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += found.nbytes
            return found

        self.pilots = section("<i4", buckets)
        self.prints, self.places, self.times = (section("<u4", self.slots) for _ in range(3))
        self.keys = section("<i8", self.records)
        self.nulls = section("u1", self.records)
        self.offsets = section("<u8", self.records + 1)
        self.payload = section(f"<u{self.width}", self.total)

    def find(self, key: int | None) -> range:
        """Numbers of the records of a key."""
        if not self.slots:
            return range(0)
        first, second = (int(h[0]) for h in key_hashes(np.array([key or 0], dtype="<i8"), np.array([key is None])))
        return self._found(key, first, second)

    def _found(self, key: int | None, first: int, second: int) -> range:
        slot = slot_of(second, int(self.pilots[first % len(self.pilots)]), self.slots)
        place = int(self.places[slot])
        if int(self.prints[slot]) != second >> 32 or (key is None) != bool(self.nulls[place]) or (key or 0) != int(self.keys[place]):
            return range(0)
        return range(place, place + int(self.times[slot]))

    def ids(self, record: int) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.payload[int(self.offsets[record]):int(self.offsets[record + 1])].astype("<u4").tobytes()

    def each(self) -> Iterator[tuple[int | None, int, bytes]]:
        """key, ids before it in the shard, and ids of every record, found through the index."""
        first, second = key_hashes(self.keys, self.nulls)
        number = 0
        while number < self.records:
            key = None if self.nulls[number] else int(self.keys[number])
            found = self._found(key, int(first[number]), int(second[number]))
            if found.start != number or not len(found):
                raise ValueError(f"the index leads to another record than that of {key}")
            for record in found:
                yield key, int(self.offsets[record]), self.ids(record)
            number = found.stop


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, key: str = "doc_id", text: str = "text",
              shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes whole texts and writes them as shard files in ascending key order, nulls first.

    Texts are dealt to ranges of the key once, encoded where they arrive, and never held beyond one
    shard. Null texts are empty documents; repeated rows are written as often as they occur, ordered
    by a hash of their text. Spark's text writer puts each shard into a file of its own and commits
    all files of the job or none.
    """
    ship(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        keys, ids, held = [], [], 0
        rows = (row for batch in batches for part in id_batches(batch.column(0), tokens.encode(batch.column(1)), end_id)
                for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
        for name, raw in rows:
            keys.append(name)
            ids.append(raw)
            held += len(raw) // 2 + 40
            # equal keys stay together, unless they alone are more than a shard
            if held >= shard_bytes and (keys[0] != name or held >= 4 * shard_bytes):
                last = len(keys)
                while keys[0] != name and last and keys[last - 1] == name:
                    last -= 1
                yield _file(write_shard(keys[:last], ids[:last]))
                keys, ids = keys[last:], ids[last:]
                held = sum(len(raw) // 2 + 40 for raw in ids)
        if keys:
            yield _file(write_shard(keys, ids))

    order = [F.col("__key").asc_nulls_first(), F.xxhash64("__text")]
    (docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(shards, "value binary").select(F.col("value").cast("string"))
     .write.option("maxRecordsPerFile", 1).text(path))


def _file(raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["value"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, start_in_shard, ids) of every record in the files, each found through the index."""
    ship(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for row in Shard(raw.as_buffer().to_pybytes()).each():
                    rows.append(row)
                    held += len(row[2])
                    if held > 8 << 20:
                        yield _records(name, rows)
                        rows, held = [], 0
                yield _records(name, rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(
        records, "shard string, key long, start_in_shard long, ids binary")


def _records(shard: str, rows: list[tuple]) -> pa.RecordBatch:
    keys, starts, ids = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(rows), pa.string()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
        ["shard", "key", "start_in_shard", "ids"])


def fetch(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """(key, ids) of a short list of keys, one row per record; keys that are not there give no row.
    Each file is asked for each key in constant time."""
    ship(spark)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                shard = Shard(raw.as_buffer().to_pybytes())
                hits = [(key, shard.ids(record)) for key in keys for record in shard.find(key)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.binary())], ["key", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(wanted, "key long, ids binary")


def layout(records: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) with ``start`` counted over all files in key order.

    Only these small rows are kept; what precedes a shard is summed over one row per shard.
    """
    small = stored(records.select(
        "shard", "key", "start_in_shard", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    totals = small.groupBy("shard").agg(F.min(F.struct("key", F.col("shard").alias("s"))).alias("first"), F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("before"))
    return small.join(before, "shard").select(
        "key", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
