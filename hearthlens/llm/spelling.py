"""Words that differ by one letter, found in a trie of letter-group counts, and the form each is a variant of.

A word is a vector: how many letters it has of each of a row of letter groups. One replaced letter adds
one to at most one count and takes one from another; one deleted letter takes one away. The words of a
length stand in a trie whose levels are the successive counts. A search walks it depth first with a budget
of one surplus and one deficit, and compares the words that it reaches letter by letter.

The upper levels of the trie are the cells that Spark deals out: a word is sent to each cell that its budget can
reach, and each task builds and searches the rest of the trie below one cell at a time. Of two
words only one searches for the other: the longer one, or the one in the earlier cell.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthlens.llm.common import ship, stored

#: Letter groups, one trie level each, from the most telling; letters in none of them are a group of their own.
GROUPS = ("e", "t", "a", "o", "n", "i", "h", "r", "s", "d", "l", "u", "bcf", "gjm", "kpq", "vwxyz")
#: Levels that make a cell, after the length.
CELL_LEVELS = 3
#: Letters of stored words below one cell; a cell with more is divided by a hash of the word.
CELL_LETTERS = 200_000
#: Bytes of two words side by side that are compared at once.
COMPARED_BYTES = 32 << 20
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 400_000

_RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = 97, least_length: int = 5) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z and U+00C0 to U+00FF) of whole texts with A-Z in lower case, counted
    in part, so a word may have several rows.

    Where ``slip`` divides the checksum of ``<key>:<run>``, the run loses the letter at that checksum modulo
    its length; with ``slip`` 0 none does. Words shorter than ``least_length`` are left out. A null
    text has no words, a text without a key loses no letters, repeated rows count again.
    """
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def part() -> pa.RecordBatch:
            rows = [(w, n) for w, n in found.items() if len(w) - w.count(b"\xc3") >= least_length]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()).cast(pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if not content.is_valid:
                    continue
                # bytes.lower() changes A-Z alone, and no byte of a longer character is one of them
                words = Counter(_RUN.findall(content.as_buffer().to_pybytes().lower()))
                if slip and own is not None:
                    sums = np.fromiter(map(zlib.crc32, words, itertools.repeat(zlib.crc32(own.encode() + b":"))), dtype=np.int64, count=len(words))
                    runs = list(words)
                    for i in np.flatnonzero(sums % slip == 0).tolist():
                        run = runs[i].decode()
                        at = int(sums[i]) % len(run)
                        found[(run[:at] + run[at + 1:]).encode()] += words.pop(runs[i])
                found.update(words)
                if len(found) > COUNTED_WORDS:
                    yield part()
        yield part()

    return docs.select(F.col(key).cast("string").alias("__key"), F.col(text).alias("__text")).mapInArrow(counted, "word string, n long")


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of each letter group for words of one length, given in one byte a letter."""
    group = np.full(256, len(GROUPS), dtype=np.uint8)
    for number, letters in enumerate(GROUPS):
        group[list(letters.encode("latin-1"))] = number
    if not words or not words[0]:
        return np.zeros((len(words), len(GROUPS) + 1), dtype=np.int32)
    letters = group[np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)]
    return np.stack([(letters == number).sum(axis=1) for number in range(len(GROUPS) + 1)], axis=1).astype(np.int32)


class CountTrie:
    """Words of one length in a trie of their vectors. A node is a range of the sorted vectors that agree
    above its level; levels in which all vectors of a range agree have one child."""

    def __init__(self, words: list[bytes]):
        counts = vectors(words)
        self.order = np.lexsort(counts.T[::-1])
        self.counts = counts[self.order]
        self.letters = _matrix([words[i] for i in self.order])

    def reached(self, counts: np.ndarray, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """(searches, first, end): leaves whose counts are within the budgets of the searching words.
        The walk is depth first, with all words that still have a budget at a node."""
        searches = np.arange(len(counts))
        budget = np.stack([np.full(len(counts), surplus, dtype=np.int32), np.full(len(counts), deficit, dtype=np.int32)])
        stack = [(0, 0, len(self.counts), searches, budget)]
        levels = self.counts.shape[1]
        while stack:
            level, first, end, searches, budget = stack.pop()
            if not len(searches):
                continue
            if level == levels:
                yield searches, first, end
                continue
            column = self.counts[first:end, level]
            wanted = counts[searches, level]
            if column[0] == column[-1]:
                edges = [0, end - first]
            else:
                edges = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), end - first]
            for left, right in zip(edges, edges[1:]):
                change = column[left] - wanted
                rest = budget - np.stack([np.maximum(change, 0), np.maximum(-change, 0)])
                live = (rest >= 0).all(axis=0)
                stack.append((level + 1, first + left, first + right, searches[live], rest[:, live]))


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)


def one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one replaced letter, or by one letter that only ``a`` has."""
    wide, narrow = a.shape[1], b.shape[1]
    if wide == narrow:
        return (a != b).sum(axis=1) == 1
    if narrow == 0:
        return np.ones(len(a), dtype=bool)
    ahead, behind = a[:, :narrow] != b, (a[:, 1:] != b)[:, ::-1]
    same_ahead = np.where(ahead.any(axis=1), ahead.argmax(axis=1), narrow)
    same_behind = np.where(behind.any(axis=1), behind.argmax(axis=1), narrow)
    return same_ahead + same_behind >= narrow


def near_pairs(trie: CountTrie, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(searching, stored) places of words that are one apart. Searching words have the length of the stored
    ones or one letter more."""
    letters, width = _matrix(words), trie.letters.shape[1]
    longer = letters.shape[1] - width
    some = max(1, COMPARED_BYTES // (2 * max(width, 1)))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def compared() -> tuple[np.ndarray, np.ndarray]:
        left, right = (np.concatenate(part) for part in zip(*held))
        good = one_apart(letters[left], trie.letters[right])
        return left[good], trie.order[right[good]]

    for searches, first, end in trie.reached(vectors(words), 0 if longer else 1, 1):
        for begin in range(0, len(searches), max(1, some // (end - first))):
            own = searches[begin:begin + max(1, some // (end - first))]
            held.append((np.repeat(own, end - first), np.tile(np.arange(first, end), len(own))))
            size += len(own) * (end - first)
            if size >= some:
                yield compared()
                held, size = [], 0
    if held:
        yield compared()


def _summed(words: list[bytes], other: list[bytes], other_n: np.ndarray, own: np.ndarray, near: np.ndarray) -> list[tuple[bytes, int, int, bytes]]:
    """(word, near words, greatest n among them, the first word with it) of the words in ``own``."""
    rank = np.empty(len(other), dtype=np.int64)
    by_rank = np.lexsort((np.array(other), -other_n))
    rank[by_rank] = np.arange(len(other))
    counts = np.bincount(own, minlength=len(words))
    best = np.full(len(words), len(other), dtype=np.int64)
    np.minimum.at(best, own, rank[near])
    return [(words[i], int(counts[i]), int(other_n[by_rank[best[i]]]), other[by_rank[best[i]]]) for i in np.flatnonzero(counts).tolist()]


#: What a row of a cell is: a stored word, or a word that searches from the cell itself, from an earlier cell of the same
#: length, or with one letter more. Stored words come first.
STORED, INSIDE, BESIDE, LONGER = range(4)


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches cell after cell, rows sorted by cell and role. Yields partial sums for both words of a pair."""
    cell, words, counts, trie = None, [], [], None
    for batch in batches:
        texts = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        numbers = batch.column("n").to_numpy()
        at, rows = 0, []
        for (name, role), group in itertools.groupby(zip(batch.column("cell").to_pylist(), batch.column("role").to_pylist())):
            size = sum(1 for _ in group)
            part, part_n = texts[at:at + size], numbers[at:at + size]
            at += size
            if role == STORED:
                if name != cell:
                    cell, words, counts, trie = name, [], [], None
                words.extend(part)
                counts.append(part_n)
                continue
            if name != cell:
                continue  # a part of a divided cell that holds no word
            if trie is None:
                trie, counts = CountTrie(words), [np.concatenate(counts)]
            some = max(1, COMPARED_BYTES // (16 * max(len(words[0]), 64)))
            for begin in range(0, size, some):
                mine, mine_n = part[begin:begin + some], part_n[begin:begin + some]
                for left, right in near_pairs(trie, mine):
                    if role == INSIDE:  # both words search here, one counts
                        earlier = np.array(mine)[left] < np.array(words)[right]
                        left, right = left[earlier], right[earlier]
                    if len(left):
                        rows += _summed(mine, words, counts[0], left, right) + _summed(words, mine, mine_n, right, left)
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0].decode("latin-1") for r in rows]), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([-r[2] for r in rows], pa.int64()), pa.array([r[3].decode("latin-1") for r in rows])], ["word", "n_near", "less", "best"])


def _steps() -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(role, change of length, changes of the cell's counts) of the cells that one word searches."""
    for change in itertools.product((-1, 0, 1), repeat=CELL_LEVELS):
        if change.count(1) <= 1 and change.count(-1) <= 1:
            if not any(change):
                yield INSIDE, 0, change
            elif change > (0,) * CELL_LEVELS:
                yield BESIDE, 0, change
        if change.count(1) == 0 and change.count(-1) <= 1:
            yield LONGER, -1, change


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, less, best): for each distinct word that has near words how many there are, the greatest n
    among them with its sign changed, and the first word with it. ``words`` are (word, n), stored."""
    size = F.length("word")
    cell = ["c"] + [f"c{i}" for i in range(CELL_LEVELS)]
    placed = words.select("word", "n", size.alias("c"), *[
        (size - F.length(F.translate("word", letters, ""))).alias(name) for name, letters in zip(cell[1:], GROUPS)])
    cells = placed.groupBy(*cell).agg(F.ceil(F.sum(F.length("word")) / CELL_LETTERS).cast("int").alias("parts"))
    stored_words = placed.join(cells, cell).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("role", F.lit(STORED))
    steps = F.array(*[F.struct(F.lit(role).alias("role"), *[F.lit(d).alias(f"d{i}") for i, d in enumerate((longer, *change))])
                      for role, longer, change in _steps()])
    searching = placed.withColumn("step", F.explode(steps)).select("word", "n", "step.role", *[
        (F.col(name) + F.col(f"step.d{i}")).alias(name) for i, name in enumerate(cell)])
    searching = searching.join(cells, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = stored_words.select("word", "n", "role", *cell, "part").unionByName(searching.select("word", "n", "role", *cell, "part"))
    dealt = rows.select(F.concat_ws(".", *cell, "part").alias("cell"), "role", "word", "n").repartition("cell").sortWithinPartitions("cell", "role")
    found = dealt.mapInArrow(_search_cells, "word string, n_near long, less long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by joining the table with itself until nothing moves: every
    round doubles the steps taken, and n doubles with a step, so six rounds do for any count."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, least_count: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each distinct word with at least ``least_count`` occurrences.

    ``words`` are rows (word, n) whose n add up for one word; rows with a null or empty word do not count; letters
    have to lie below U+0100. Two words are near if one inserted, deleted or replaced letter parts them.
    ``form`` is the near word with the greatest n, the first in code-point order among equals, if
    its n is at least twice the word's. ``root`` is reached by following forms, the word itself if it has none.
    An empty table gives an empty one.
    """
    ship(words.sparkSession)
    counted = stored(words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    near = near_words(counted)
    clear = -F.col("near.less") >= 2 * F.col("n")
    found = stored(counted.join(near.select("word", "n_near", F.col("form").alias("near")), "word", "left").select(
        "word", F.when(clear, F.col("near.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(clear, -F.col("near.less")).alias("form_n")))
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
