"""Packing of documents into training sequences of one length.

Documents are cut into pieces of at most a sequence. The pieces are dealt to random groups by a hash
of document, position and place in the scan, and each group is packed by itself, first-fit decreasing:
the leftmost bin with room is found in a tournament tree over the room left in the bins, in a logarithmic number of
steps. What the pieces of the emptiest bins can do to fill larger gaps of the others is done last, by
cutting them. Groups stream through a task a few thousand pieces at a time, so memory is bounded
whatever share of the rows a document or a partition has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hearthlens.llm.common import ship, worker_task
from hearthlens.llm.tokens import TASK, encoder

#: Gaps of a sequence below this are left as padding instead of cutting a document once more.
LEAST_CUT = 24

PIECE = [("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("raw", pa.binary())]
PIECE_FIELDS = "start long, length int, doc_tokens long, raw binary"
PACKED = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
          ("sequence_id", pa.int64()), ("offset", pa.int64())]


class TournamentTree:
    """The room left in bins, each inner node holding the most of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes room in the leftmost bin that has it."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bin_no = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            a, b = room[2 * node], room[2 * node + 1]
            room[node] = a if a > b else b
        return bin_no


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins, as lists of positions in ``sizes``. No size may exceed the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = [[] for _ in sizes]
    tree = TournamentTree(max(1, len(sizes)), capacity)
    for i in order:
        if sizes[i]:
            bins[tree.first_fit(sizes[i])].append(i)
    return [b for b in bins if b]


def plan(sizes: list[int], capacity: int, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Bins of (piece, first id of the piece, ids). Pieces in the emptiest bins are cut to fill the
    gaps of fuller ones, so that at most one bin has a gap of ``least_cut`` or more, unless that gap
    is what nothing is left for."""
    bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, capacity)]
    used = [sum(part[2] for part in b) for b in bins]
    # fullest last: gaps are filled from the front of the order, givers taken from its end
    order = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    giver = len(order) - 1
    for taker, b in enumerate(order):
        while taker < giver and capacity - used[b] >= least_cut:
            g = order[giver]
            piece, start, length = bins[g].pop()
            taken = min(length, capacity - used[b])
            bins[b].append((piece, start + length - taken, taken))
            used[b] += taken
            used[g] -= taken
            if taken < length:
                bins[g].append((piece, start, length - taken))
            if not bins[g]:
                giver -= 1
    return [b for b in bins if b]


def _cut(keys: pa.Array, flat: np.ndarray, counts: np.ndarray, length: int) -> pa.RecordBatch:
    """The pieces of documents whose ids follow one another in ``flat``, in 2 bytes an id if they fit."""
    pieces = -(-counts // length)
    row = np.repeat(np.arange(len(counts)), pieces)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
    size = np.minimum(counts[row] - start, length)
    width = 4 if flat.size and flat.max() > 0xFFFF else 2
    bounds = (width * np.concatenate([[0], np.cumsum(size)])).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.astype(f"<u{width}").tobytes())])
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(row)), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(counts[row], pa.int64()), raw],
        ["key", *(name for name, _ in PIECE)])


def text_pieces(docs: DataFrame, vocabulary: str, end_id: int | None, length: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of the ids of whole texts, each followed by ``end_id``, encoded and cut in one pass. A
    null text is empty; repeated rows and null keys stay; other columns are not read."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    @worker_task(TASK)
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in batches:
            at = 0
            for flat, counts in tokens.encode(batch.column(1)):
                keys = batch.column(0).slice(at, len(counts))
                at += len(counts)
                if end_id is not None:
                    flat, counts = np.insert(flat, np.cumsum(counts), np.uint32(end_id)), counts + 1
                yield _cut(keys, flat, counts, length)

    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(
        pieces, f"key {kind}, {PIECE_FIELDS}").withColumnRenamed("key", key)


def token_pieces(tokens: DataFrame, length: int = 2048, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The pieces of ids that are already there, as little-endian unsigned 32-bit integers. A document
    without ids has no piece; repeated rows and null keys stay; other columns are not read."""
    ship(tokens.sparkSession)
    kind = tokens.schema[key].dataType.simpleString()

    @worker_task(TASK)
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                raws = [raw or b"" for raw in part.column(1).to_pylist()]
                counts = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) // 4
                yield _cut(part.column(0), np.frombuffer(b"".join(raws), dtype="<u4"), counts, length)

    return tokens.select(F.col(key).alias("__key"), F.col(ids).alias("__ids")).mapInArrow(
        pieces, f"key {kind}, {PIECE_FIELDS}").withColumnRenamed("key", key)


def pack(pieces: DataFrame, length: int = 2048, group_pieces: int = 4096, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids, doc_tokens, sequence_id and offset.

    ``pieces`` are what ``text_pieces`` or ``token_pieces`` give for the same length. ``ids`` are
    little-endian unsigned 32-bit integers. ``sequence_id`` is unique and has no meaning beyond that; in
    a sequence the offsets run from 0 without a gap.
    """
    ship(pieces.sparkSession)
    kind = pieces.schema[key].dataType.simpleString()

    @worker_task(TASK)
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, group, held, kind = TaskContext.get().partitionId() << 44, 0, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            held.extend(zip(*(column.to_pylist() for column in batch.columns)))
            while len(held) >= 2 * group_pieces:  # the last group is then a full one as well
                yield from _packed(held[:group_pieces], length, base + (group << 20), kind)
                held, group = held[group_pieces:], group + 1
        if held:
            yield from _packed(held, length, base + (group << 20), kind)

    # rows that repeat a key, or have none, are told apart by their place, which a task that is repeated finds
    # again, as the pieces come from a scan
    place = F.monotonically_increasing_id()
    dealt = pieces.withColumnRenamed(key, "key").withColumn("deal", F.xxhash64("key", "start", place, F.lit(seed)))
    return (
        dealt.repartition("deal").sortWithinPartitions("deal", "key", "start").drop("deal")
        .mapInArrow(packed, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
        .withColumnRenamed("key", key)
    )


def _batch(rows: list[tuple], fields: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * (len(fields) + 1)
    types = [kind, *(t for _, t in fields)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", *(n for n, _ in fields)])


def _packed(rows: list[tuple], length: int, first_id: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out = []
    for number, bin_parts in enumerate(plan([r[2] for r in rows], length)):
        offset = 0
        for i, skip, size in bin_parts:
            name, start, whole, total, raw = rows[i]
            ids = np.frombuffer(raw, dtype="<u4" if len(raw) == 4 * whole else "<u2")[skip:skip + size]
            out.append((name, start + skip, size, ids.astype("<u4").tobytes(), total, first_id + number, offset))
            offset += size
        if len(out) >= 512:
            yield _batch(out, PACKED, kind)
            out = []
    yield _batch(out, PACKED, kind)
