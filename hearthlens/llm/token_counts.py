"""Unigram token counts with the dynamic programme shared along a trie.

A text is cut into pre-tokens, and the tokens of a pre-token are those of its best segmentation under a
unigram model: the one with the highest sum of log-probabilities, and the fewest tokens among equals.
Distinct pre-tokens are inserted in a trie over bytes. The node of a prefix keeps the forward score of
the prefix and its number of tokens, computed once from the nodes above it, so pre-tokens that begin
alike share that work, and the node at the end of a pre-token is its stored count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthlens.llm.common import ship
from hearthlens.llm.tokens import Codes, PieceTable, UnitTable
from hearthlens.llm.transducer import read_ranks

#: Nodes that a worker keeps; a larger trie is dropped and grown anew, so memory stays bounded.
MAX_NODES = 800_000


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities of tokens by their rank in the file: the r-th has the share 1 / (r + 2.7)
    before normalisation, the usual shape of word frequencies."""
    total = sum(1.0 / (rank + 2.7) for rank in ranks.values())
    return {piece: -math.log((rank + 2.7) * total) for piece, rank in ranks.items()}


class ForwardTrie:
    """A trie of prefixes with their forward score and token count. ``scores`` has to hold every byte."""

    def __init__(self, scores: dict[bytes, float], max_nodes: int = MAX_NODES):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.max_nodes = max_nodes
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score = [0.0]
        self.count = [0]

    def insert(self, token: bytes) -> int:
        """Tokens of a pre-token; nodes that are not there yet are scored from those above them."""
        if len(self.score) > self.max_nodes:
            self._clear()
        child, path, node = self.child, [0], 0
        for end, byte in enumerate(token, 1):
            edge = node << 8 | byte
            node = child.get(edge, -1)
            if node < 0:
                node = child[edge] = self._score(token, end, path)
            path.append(node)
        return self.count[node]

    def _score(self, token: bytes, end: int, path: list[int]) -> int:
        scores, best, fewest = self.scores, -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            own = scores.get(token[start:end])
            if own is None:
                continue
            above = path[start]
            total, tokens = self.score[above] + own, self.count[above] + 1
            if total > best or (total == best and tokens < fewest):
                best, fewest = total, tokens
        if best == -math.inf:
            raise ValueError("the vocabulary does not hold every byte")
        self.score.append(best)
        self.count.append(fewest)
        return len(self.score) - 1


class Counter:
    """(pre-tokens, tokens) of texts."""

    def __init__(self, scores: dict[bytes, float], pattern: str):
        self.pieces = PieceTable(pattern, ForwardTrie(scores).insert)

        def compute(units: list[str]) -> Codes:
            """Two numbers for each unit: its pre-tokens and its tokens."""
            counts = self.pieces.lookup(units)
            both = np.array([(len(c), sum(c)) for c in counts], dtype="<u4").reshape(-1)
            return both, np.full(len(units), 2, dtype=np.int64)

        self.units = UnitTable(compute)

    def count(self, texts: pa.Array) -> np.ndarray:
        """A row of both numbers for each text; a missing text is empty."""
        rows = [np.zeros((0, 2), dtype=np.int64)]
        for flat, counts in self.units.texts(texts):
            sums = np.concatenate([np.zeros((1, 2), dtype=np.int64), np.cumsum(flat.reshape(-1, 2).astype(np.int64), axis=0)])
            ends = np.cumsum(counts // 2)
            rows.append(sums[ends] - sums[ends - counts // 2])
        return np.concatenate(rows)


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    """One counter per worker process, vocabulary file and pattern."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[(path, pattern)] = Counter(zipf_scores(read_ranks(path)), pattern)
    return _COUNTERS[(path, pattern)]


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pretokens, n_tokens) of every row, where it is: nothing is shuffled.

    A null or empty text has no tokens; a null key and repeated rows stay; other columns are not read.
    ``pattern`` has to take the space before a word with the word, as byte-level patterns do.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary, pattern)
        for batch in batches:
            found = counts.count(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["key", "n_pretokens", "n_tokens"])

    return (docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
            .mapInArrow(counted, f"key {kind}, n_pretokens long, n_tokens long").withColumnRenamed("key", key))
