"""Stretches of a text that repeat with a period, found by splitting at words that are too rare.

A run is a stretch of consecutive words in which words one period apart are equal, that is at least
three periods and 24 words long and that no neighbouring word extends. Every word of a run therefore
occurs at least three times in it. A word that occurs less often within a segment splits the segment; the
pieces are counted again, which makes further words rare, until nothing changes. What is left is
short, and only there lags are scanned: short lags over all segments at once, longer ones by comparing
neighbouring blocks of one lag by their hash, so that a segment of n words costs about n log n.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.llm.common import free_name, ship

#: The fewest words and the fewest periods of a run.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Lags up to this one are scanned over all segments at once.
DIRECT_LAGS = 32
#: Bytes of text that are looked at together; a longer text is looked at alone.
TOGETHER_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _pieces(breaks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches without a break that have the least length."""
    edges = np.flatnonzero(np.concatenate([[True], breaks, [True]]))
    begin, end = edges[:-1], edges[1:] - 1
    long_enough = end - begin >= least
    return begin[long_enough], end[long_enough]


def surviving(codes: np.ndarray, owner: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Segments (begin, end) in which each word occurs at least ``least_periods`` times, by splitting at
    rarer words again and again. Words of different owners are never in one segment. A segment that a
    round leaves whole is settled and not counted again."""
    settled: list[tuple[int, int]] = []
    place = np.arange(len(codes), dtype=np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(codes)]]) if len(codes) else np.zeros(1, dtype=np.int64)
    begin, end = cuts[:-1], cuts[1:]
    keep = end - begin >= least_words
    begin, end = begin[keep], end[keep]
    words = int(codes.max()) + 1 if len(codes) else 1
    while len(begin):
        sizes = end - begin
        segment = np.repeat(np.arange(len(begin)), sizes)
        offset = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(begin - offset[:-1], sizes) + np.arange(offset[-1])
        _, inverse, counts = np.unique(segment * words + codes[where], return_inverse=True, return_counts=True)
        rare = counts[inverse] < least_periods
        whole = np.add.reduceat(rare, offset[:-1]) == 0
        settled.extend(zip(begin[whole].tolist(), end[whole].tolist()))
        parted = ~whole[segment]
        place, rare, segment = where[parted], rare[parted], segment[parted]
        if not len(place):
            break
        # a break stands before each first word of a segment and in the place of each rare word
        first = np.concatenate([[True], segment[1:] != segment[:-1]])
        slot = np.arange(len(place)) + np.cumsum(first)
        breaks = np.zeros(int(slot[-1]) + 1, dtype=bool)
        breaks[slot[first] - 1] = True
        breaks[slot[rare]] = True
        origin = np.zeros(len(breaks) + 1, dtype=np.int64)
        origin[slot] = place
        begin, end = _pieces(breaks, least_words)
        begin, end = origin[begin], origin[end - 1] + 1
    return sorted(settled)


def _reach(codes: np.ndarray, lag: int, at: int, low: int, high: int) -> tuple[int, int]:
    """The widest [l, r) around ``at`` in which words are equal to those one lag later, within [low, high)."""
    right, step = at, 64
    while right < high:
        stop = min(right + step, high)
        other = np.flatnonzero(codes[right:stop] != codes[right + lag:stop + lag])
        if len(other):
            right += int(other[0])
            break
        right, step = stop, step * 2
    left, step = at, 64
    while left > low:
        stop = max(left - step, low)
        other = np.flatnonzero(codes[stop:left] != codes[stop + lag:left + lag])
        if len(other):
            left = stop + int(other[-1]) + 1
            break
        left, step = stop, step * 2
    return left, right


def runs_within(codes: np.ndarray, segments: list[tuple[int, int]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
                direct: int = DIRECT_LAGS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) inside the segments. The smallest lag of a stretch is its period: by
    Fine and Wilf a stretch of three lags that also repeats with a smaller one is the run of that lag."""
    if not segments:
        return []
    found: dict[tuple[int, int], int] = {}
    parts, origin, mark = [], [], -1
    for begin, end in segments:
        parts += [codes[begin:end], np.array([mark])]
        origin += [np.arange(begin, end), np.array([end])]
        mark -= 1
    line, origin = np.concatenate(parts), np.concatenate(origin)
    longest = max(end - begin for begin, end in segments)
    for lag in range(1, min(direct, longest // least_periods) + 1):
        begin, end = _pieces(line[:-lag] != line[lag:], max(least_words - lag, (least_periods - 1) * lag))
        for l, r in zip(origin[begin].tolist(), origin[end - 1].tolist()):
            found.setdefault((l, r + 1 + lag), lag)
    for begin, end in segments:
        if (end - begin) // least_periods > direct:
            _long_lags(codes, begin, end, direct, least_words, least_periods, found)
    return sorted((l, r - l, lag) for (l, r), lag in found.items())


def _long_lags(codes: np.ndarray, begin: int, end: int, direct: int, least_words: int, least_periods: int, found: dict[tuple[int, int], int]) -> None:
    """Runs of one segment with a lag beyond ``direct``: a stretch of two lags in which words equal those one
    lag later holds a block of one lag, at a multiple of it, that equals the next block."""
    size = end - begin
    mixed = (codes[begin:end].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    power = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, 0xD6E8FEB86659FD93, dtype=np.uint64)]))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * power[:-1])])
    known = np.zeros(size + 1, dtype=np.int64)  # the end of a run that began here or before
    for (l, r) in [key for key in found if begin <= key[0] and key[1] <= end]:
        known[l - begin:r - begin] = np.maximum(known[l - begin:r - begin], r - begin)
    for lag in range(direct + 1, size // least_periods + 1):
        blocks = np.diff(sums[::lag])
        hits = np.flatnonzero(blocks[:-1] * power[lag] == blocks[1:]) * lag
        for at in hits[known[hits] < hits + 2 * lag].tolist():
            if known[at] >= at + 2 * lag or (codes[begin + at:begin + at + lag] != codes[begin + at + lag:begin + at + 2 * lag]).any():
                continue
            left, right = _reach(codes, lag, begin + at, begin, end - lag)
            if right - left >= max(least_words - lag, (least_periods - 1) * lag):
                found.setdefault((left, right + lag), lag)
                known[left - begin:right + lag - begin] = np.maximum(known[left - begin:right + lag - begin], right + lag - begin)


def _together(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size >= TOGETHER_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_runs(texts: list[bytes | None], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each text its words, its runs and the text without repetitions, words joined by one space."""
    for group in _together(texts):
        # words end at the six white-space bytes of ASCII alone, which is what bytes.split() does
        words = [text.split() for text in group]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        numbers = defaultdict(itertools.count().__next__)
        codes = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
        first = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(words)), sizes)
        runs = defaultdict(list)
        for start, length, period in runs_within(codes, surviving(codes, owner, least_words, least_periods), least_words, least_periods):
            runs[int(owner[start])].append((start - int(first[owner[start]]), length, period))
        for i, own in enumerate(words):
            kept = own
            if i in runs:
                dropped = np.zeros(len(own), dtype=bool)
                for start, length, period in runs[i]:
                    dropped[start + period:start + length] = True
                kept = [own[j] for j in np.flatnonzero(~dropped)]
            yield len(own), sorted(runs.get(i, ()), key=lambda run: (run[0], run[2])), b" ".join(kept)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS,
                  least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row, where it is: nothing is shuffled.

    ``runs`` are structs of start (word number), length and period in words, by start and period.
    ``collapsed`` is the text without the words that repeat: of each run its first period stays.
    A null or empty text has no words, no runs and an empty collapsed text; a null key and repeated
    rows stay; other columns are not read.
    """
    if least_words < least_periods or least_periods < 3:
        raise ValueError("a run needs three periods, and a word for each of them")
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for group in _together(texts):
                counts, runs, rest = [], [], []
                for n, own, collapsed in find_runs(group, least_words, least_periods):
                    counts.append(n)
                    runs.append([dict(start=s, length=l, period=p) for s, l, p in own])
                    rest.append(collapsed)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(group)), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.binary()).cast(pa.string())],
                    ["key", "n_words", "runs", "collapsed"])
                at += len(group)

    return (docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
            .mapInArrow(searched, f"key {kind}, n_words long, runs {RUN_TYPE}, collapsed string").withColumnRenamed("key", key))


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with one text in ten made periodic from some word on, as the key's checksum says. Rows
    without a key or words keep their text."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    sum_name, words_name = free_name(docs, "__h"), free_name(docs, "__words")
    words, g = F.col(words_name), F.floor(F.col(sum_name) / 10)
    n = F.size(words).cast("long")
    begin = F.when(n > 0, g % n)
    period = 1 + F.floor((n - begin) / (3 + g % 8))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                        lambda i: words[F.when(i < begin, i).otherwise(begin + (i - begin) % period).cast("int")])
    marked = docs.withColumn(sum_name, h).withColumn(words_name, F.when(F.col(sum_name) % 10 == 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    return marked.withColumn(text, F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col(text))).drop(sum_name, words_name)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, by start and period among equals; null without runs."""
    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (left > right) | ((left == right) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))
