"""Token ids of whole texts, with the work shared by units that occur again and again.

A byte-level pre-tokenizer never joins the two sides of a space that a non-space follows, nor a letter
and the ASCII punctuation after it, the apostrophe apart. A text is cut there, the distinct units of a
batch are found by dictionary encoding, and a unit is encoded once as long as its worker remembers it.
A text in which a space is followed by white space is encoded as a whole, so the ids are always those
of the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hearthlens.llm.common import ship, worker_table, worker_task

#: A space before white space or at the end, or the mark that cuts are written with.
_WHOLE = " ([\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]|$)|\\x00"
_LETTER_MARK = "([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\\[-`{-~])"
#: Units that a worker remembers; a full table is emptied, so memory stays bounded.
MAX_UNITS = 500_000
#: Bytes of text that are handled at once; a longer text is handled by itself.
RUN_BYTES = 6 << 20
#: The kind of tasks that use an encoder.
TASK = "tokens"

Codes = tuple[np.ndarray, np.ndarray]


class UnitTable:
    """Numbers that a function gives to units: ``compute`` gets units, or whole texts, and returns the
    numbers of all of them one after the other and how many each has."""

    def __init__(self, compute: Callable[[list[str]], Codes], max_units: int = MAX_UNITS):
        self.compute = compute
        self.max_units = max_units
        pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back at once
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def _known(self, units: list[str]) -> np.ndarray:
        if len(self.index) > self.max_units:
            self._clear()
        new = [u for u in units if u not in self.index]
        if new:
            flat, lengths = self.compute(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        return np.fromiter(map(self.index.__getitem__, units), dtype=np.int64, count=len(units))

    def texts(self, texts: pa.Array) -> Iterator[Codes]:
        """The numbers of consecutive texts, a missing one being empty, and how many each has."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            limit = (ends[at - 1] if at else 0) + RUN_BYTES
            stop = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
            yield self._run(pc.fill_null(texts.slice(at, stop - at), ""))
            at = stop

    def _run(self, texts: pa.Array) -> Codes:
        whole = pc.match_substring_regex(texts, _WHOLE)
        apart = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        plain = pc.if_else(whole, "", texts)
        marked = pc.replace_substring_regex(pc.replace_substring(plain, " ", "\x00 "), _LETTER_MARK, "\\1\x00\\2")
        parts = pc.split_pattern(marked, "\x00")
        coded = parts.flatten().dictionary_encode()
        numbers = self._known(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat, lengths = _gathered(self.flat, self.starts[numbers], self.lengths[numbers])
        sums = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        counts = np.diff(sums)
        if len(apart):
            more, sizes = self.compute([texts[int(i)].as_py() for i in apart])
            counts[apart] = sizes
            out = np.empty(int(counts.sum()), dtype=flat.dtype)
            special = np.zeros(len(counts), dtype=bool)
            special[apart] = True
            where = np.repeat(special, counts)
            out[where] = more
            out[~where] = flat[np.repeat(~special, np.diff(sums))]
            flat = out
        return flat, counts


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Codes:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    before = np.cumsum(lengths) - lengths
    at = np.repeat(starts - before, lengths)
    at += np.arange(len(at))
    return flat[at], lengths


def _joined(lists: Sequence[Sequence[int]]) -> Codes:
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((i for part in lists for i in part), dtype="<u4", count=int(lengths.sum()))
    return flat, lengths


class PieceTable:
    """Results of a function of a pre-token, for units cut into pre-tokens by a pattern."""

    def __init__(self, pattern: str, compute: Callable[[bytes], object], max_pieces: int = 200_000):
        import regex

        self.find = regex.compile(pattern).findall
        self.compute = compute
        self.max_pieces = max_pieces
        self.known: dict[str, object] = {}

    def lookup(self, units: Sequence[str]) -> list[list]:
        """For each unit the results of its pre-tokens. New ones are computed in sorted order, in which
        those that begin alike follow one another."""
        split = [self.find(unit) for unit in units]
        if len(self.known) > self.max_pieces:
            self.known.clear()
        for piece in sorted(set().union(*split) - self.known.keys()):
            self.known[piece] = self.compute(piece.encode("utf-8", "surrogatepass"))
        get = self.known.__getitem__
        return [list(map(get, pieces)) for pieces in split]


class Encoder:
    """ids of texts by a vocabulary of the tokenizers library, special strings taken as plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        sizes = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=np.int64)
        sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]  # one character a byte

        def each(units: list[str]) -> Codes:
            return _joined([e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)])

        def compute(units: list[str]) -> Codes:
            """Words after a space are encoded as one text and told apart by their bytes."""
            spaced = [i for i, u in enumerate(units) if u.startswith(" ") and u[1:].isalpha()]
            others = sorted(set(range(len(units))) - set(spaced))
            words = [units[i] for i in spaced]
            flat, _ = each(["".join(words)])
            ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in words], dtype=np.int64)
            at = np.concatenate([[0], np.searchsorted(np.cumsum(sizes[flat]), ends, side="right")])
            rest, rest_lengths = each([units[i] for i in others])
            lengths, starts = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
            lengths[spaced], starts[spaced] = np.diff(at), at[:-1]
            lengths[others], starts[others] = rest_lengths, len(flat) + np.cumsum(rest_lengths) - rest_lengths
            return _gathered(np.concatenate([flat, rest]), starts, lengths)

        self.units = UnitTable(compute)

    def encode(self, texts: pa.Array) -> Iterator[Codes]:
        """The ids of consecutive texts and how many each has; a missing text is empty."""
        return self.units.texts(texts)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file, as long as the worker has tasks of this kind."""
    return worker_table(TASK, path, lambda: Encoder(path))


def id_batches(keys: pa.Array, runs: Iterator[Codes], end_id: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of key and ids, as little-endian unsigned 32-bit integers followed by ``end_id``."""
    at = 0
    for flat, counts in runs:
        if end_id is not None:
            flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
            counts = counts + 1
        step, done = 0, 0
        ends = np.cumsum(counts)
        while step < len(counts):  # a batch of Arrow holds less than 2 GB
            stop = max(step + 1, int(np.searchsorted(ends, done + (1 << 26), side="right")))
            part = flat[done:ends[stop - 1]].astype("<u4")
            bounds = np.concatenate([[0], 4 * (ends[step:stop] - done)]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), stop - step, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(part.tobytes())])
            yield pa.RecordBatch.from_arrays([keys.slice(at, stop - step), ids], ["key", "ids"])
            at += stop - step
            done, step = int(ends[stop - 1]), stop


def tokenised(docs: DataFrame, vocabulary: str, end_id: int | None, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(key, ids) of every row in its present partition and order: the ids of the whole text as
    little-endian unsigned 32-bit integers, followed by ``end_id``. A null text is empty; a null key
    and repeated rows stay as they are; other columns are not read.
    """
    ship(docs.sparkSession)

    @worker_task(TASK)
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in batches:
            yield from id_batches(batch.column(0), tokens.encode(batch.column(1)), end_id)

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
            .mapInArrow(encode, f"key {kind}, ids binary").withColumnRenamed("key", key))
