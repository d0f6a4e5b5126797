"""Byte-level BPE as a finite-state transducer, and streaming decoding.

The merges are compiled into a transducer over bytes. The encoding of every prefix of a pre-token is
unique, and its last token is the one token ending there that the merges leave next to the token before
it; so a prefix extended by a byte is decided by the encodings of the prefixes that one more token can
still start from. A state holds those: for each open start, the tokens not yet agreed on by all of them
and the node of the vocabulary's trie reached since. It is made, and numbered, only when a text first
leads there (lazy determinisation); the step then costs one table lookup per byte. Tokens that every
open start agrees on are emitted at once: no token is longer than the longest of the vocabulary, which
bounds the lookahead.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthlens.llm.common import ship
from hearthlens.llm.tokens import Codes, PieceTable, UnitTable, id_batches

#: States and transitions kept by a worker; beyond them the lazily made part is dropped and made anew.
MAX_TRANSITIONS = 700_000
MAX_PAIRS = 400_000
#: Units that a worker remembers beside its states.
MAX_UNITS = 400_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a piece by merging the leftmost pair of lowest rank until no pair is a token."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Emits the tokens of a pre-token while it reads its bytes."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS):
        self.ranks = ranks
        self.tokens = {rank: piece for piece, rank in ranks.items()}
        self.max_transitions = max_transitions
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        # the trie of the vocabulary: the following node of a node and a byte, the token of a node
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner = bytearray(1)
        for piece, rank in ranks.items():
            node = 0
            for byte in piece:
                self.inner[node] = 1
                following = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if following == len(self.token_at):
                    self.token_at.append(-1)
                    self.inner.append(0)
                node = following
            self.token_at[node] = rank
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._number((None, (((), 0),)))

    def _number(self, state: tuple) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = len(self.states)
            self.numbers[state] = number
            self.states.append(state)
        return number

    def _stays(self, before: int | None, token: int) -> bool:
        """Whether the merges leave ``token`` whole, and apart from the token before it."""
        alone = self.whole.get(token)
        if alone is None:
            alone = self.whole[token] = merge(self.tokens[token], self.ranks) == [token]
        if not alone or before is None:
            return alone
        found = self.pairs.get((before, token))
        if found is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            found = merge(self.tokens[before] + self.tokens[token], self.ranks) == [before, token]
            self.pairs[(before, token)] = found
        return found

    def _advance(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes a transition: open starts go on in the trie, and the one that completes the token of
        this prefix opens a new start behind it."""
        last, starts = self.states[number]
        open_starts, ended = [], None
        for pending, node in starts:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at[node]
            if ended is None and token >= 0 and self._stays(pending[-1] if pending else last, token):
                ended = pending + (token,)
            if self.inner[node]:
                open_starts.append((pending, node))
        if ended is None:
            raise ValueError("the vocabulary does not hold every byte, or its merges are not in rank order")
        open_starts.append((ended, 0))
        agreed = 0
        shortest = min(len(pending) for pending, _ in open_starts)
        while agreed < shortest and len({pending[agreed] for pending, _ in open_starts}) == 1:
            agreed += 1
        out = ended[:agreed]
        if agreed:
            last = out[-1]
        rest = tuple((pending[agreed:], node) for pending, node in open_starts)
        if all(pending for pending, _ in rest):
            last = None  # no open start looks at it any more
        result = (self._number((last, rest)), out)
        if len(self.step) < self.max_transitions:
            self.step[number << 8 | byte] = result
        return result

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token. A pre-token that is itself a token is that token."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        if len(self.states) > self.max_transitions or len(self.step) >= self.max_transitions:
            self._forget()
        state, out, step = self.start, [], self.step
        for byte in piece:
            found = step.get(state << 8 | byte)
            if found is None:
                found = self._advance(state, byte)
            state = found[0]
            if found[1]:
                out.extend(found[1])
        return out + list(self.states[state][1][-1][0])


class Utf8Stream:
    """Decodes bytes as they come, by a state machine: the bytes still wanted and the range of the next
    one. A sequence that cannot go on becomes U+FFFD, once for each maximal part."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def wanted(tail: bytes) -> int:
        """Bytes that the character started by ``tail`` still wants, 0 if it is whole or broken."""
        lead = tail[0]
        length = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
        for byte in tail[1:]:
            if not low <= byte <= high:
                return 0
            low, high = 0x80, 0xBF
        return max(0, length - len(tail))

    def feed(self, chunk: bytes) -> str:
        """The characters that are complete."""
        data = self.held + chunk
        end = len(data)
        for back in range(1, min(3, end) + 1):
            if data[end - back] & 0xC0 != 0x80:
                if self.wanted(data[end - back:]):
                    end -= back
                break
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes texts by a transducer, pre-token by pre-token, and decodes ids as a stream."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.table[rank] = piece
        encode = self.transducer.encode
        self.pieces = PieceTable(pattern, lambda piece: np.array(encode(piece), dtype="<u4").tobytes(), 200_000)

        def compute(units: list[str]) -> Codes:
            parts = [b"".join(found) for found in self.pieces.lookup(units)]
            return np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4

        self.units = UnitTable(compute, MAX_UNITS)

    def encode(self, texts: pa.Array) -> Iterator[Codes]:
        """The ids of consecutive texts and how many each has; a missing text is empty."""
        return self.units.texts(texts)

    def decode(self, ids: bytes, chunk: int = 4096) -> Iterator[str]:
        """The text of ids, in parts that hold whole characters."""
        stream, table = Utf8Stream(), self.table
        numbers = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(numbers), chunk):
            yield stream.feed(b"".join(map(table.__getitem__, numbers[at:at + chunk].tolist())))
        yield stream.close()


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, vocabulary file and pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[(path, pattern)] = Codec(read_ranks(path), pattern)
    return _CODECS[(path, pattern)]


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids) of every row, where it is: the ids of the whole text as little-endian unsigned 32-bit
    integers, each match of ``pattern`` by itself. With ``decoded`` the ids are also decoded again, as a
    stream, in a column of that name. A null text is empty; a null key and repeated rows stay; other
    columns are not read. ``pattern`` has to take the space before a word with the word, as byte-level
    patterns do."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            for part in id_batches(batch.column(0), coder.encode(batch.column(1))):
                if decoded:
                    texts = pa.array(["".join(coder.decode(raw)) for raw in part.column(1).to_pylist()], pa.string())
                    part = pa.RecordBatch.from_arrays([*part.columns, texts], ["key", "ids", "decoded"])
                yield part

    fields = f"key {kind}, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(encoded, fields).withColumnRenamed("key", key)


def decode(tokens: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text): ids decoded as a stream of whole characters; null ids are an empty text."""
    ship(tokens.sparkSession)
    kind = tokens.schema[key].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            at, texts, held = 0, [], 0
            raws = batch.column(1).to_pylist()
            for raw in raws:
                texts.append("".join(coder.decode(raw or b"")))
                held += len(texts[-1])
                if held > 8 << 20:
                    yield _texts(batch, at, texts)
                    at, texts, held = at + len(texts), [], 0
            yield _texts(batch, at, texts)

    return (tokens.select(F.col(key).alias("__key"), F.col(ids).alias("__ids"))
            .mapInArrow(decoded, f"key {kind}, ids binary, text string").withColumnRenamed("key", key))


def _texts(batch: pa.RecordBatch, at: int, texts: list[str]) -> pa.RecordBatch:
    part = batch.slice(at, len(texts))
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["key", "ids", "text"])
