"""Exact top-k search by inner product with pivot-table elimination.

The distances of every vector to many pivots are computed once. By the triangle inequality the largest
difference between the pivot distances of a query and of a candidate is a lower bound of their distance,
and with the two lengths an upper bound of their inner product. Candidates are held in blocks of
vectors with the same nearest pivot. A query first visits its own block, which gives it a k-th score to
beat; then only the blocks whose bound reaches that score, and in each block the candidates in the order
of their bounds, until the next bound is below the k-th score. Nothing is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearthlens.llm.common import ship, stored

PIVOTS = 24
#: Vectors that pivots are chosen from, about.
PIVOT_SAMPLE = 1000
BLOCK_ROWS = 4096
#: Blocks at most, so that what is broadcast about them has a bound; beyond it blocks grow.
MAX_BLOCKS = 8192
#: Squared lengths below this are sums of integers that a double holds exactly.
EXACT = 2.0 ** 50
#: Largest size of an integer component, whose square a double still holds.
LARGEST = 2.0 ** 500
STEP = 256


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, v): floor(scale * x) of each component as a double. Null vectors and vectors with a null or
    non-finite component take no part, a component beyond 2^500 is an error; other columns are not read."""
    raw = F.col(vector)

    def whole(x):
        y = F.lit(scale) * x.cast("double")
        # from 2^52 a double is whole, and a long need not hold it
        return (F.when(F.abs(y) < 2.0 ** 52, F.floor(y).cast("double")).when(F.abs(y) <= LARGEST, y)
                .otherwise(F.raise_error(F.lit("a component is beyond 2^500")).cast("double")))

    fit = F.forall(raw, lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)))
    return vectors.where(raw.isNotNull() & F.col(key).isNotNull()).where(fit).select(
        F.col(key).cast("long").alias("id"), F.transform(raw, whole).alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the sampled vector farthest from those chosen."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        best = int(nearest.argmax())
        if nearest[best] == 0:
            break
        chosen.append(best)
        nearest = np.minimum(nearest, ((sample - sample[best]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones filled with zeros."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], lengths)] = values[ends[0]:ends[-1]]
    return out


def _distances(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    own, others = (matrix ** 2).sum(axis=1), (pivots ** 2).sum(axis=1)
    if max(own.max(initial=0.0), others.max(initial=0.0)) < EXACT:
        return np.sqrt(own[:, None] + others[None, :] - 2 * matrix @ pivots.T)
    # differences lose a share of the distance, where the sum above would lose a share of the longer length
    return np.sqrt(np.column_stack([((matrix - pivot) ** 2).sum(axis=1) for pivot in pivots]))


def _apart(high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """What a pivot's larger distance surely has over the smaller one, with the share that rounding can lose."""
    return high - low - (width + 8) * 2.0 ** -52 * (high + low)


def upper_bounds(lengths: np.ndarray, lower: np.ndarray, own: float) -> np.ndarray:
    """The most that an inner product can be, from squared lengths and a lower bound of the distance,
    widened by what rounding can lose."""
    bound = (lengths + own - lower ** 2) / 2
    return bound + 1e-9 * (lengths + own) + 1e-6


def _exact(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers of any size, which have to fit 64 bits in the end."""
    whole = [int(x) for x in query]
    found = [sum(int(a) * b for a, b in zip(row, whole)) for row in matrix.tolist()]
    if any(not -(1 << 63) <= score < 1 << 63 for score in found):
        raise ValueError("a score does not fit 64 bits")
    return np.array(found, dtype=np.int64)


class Block:
    """Candidates of a block with their pivot table."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, pivots: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.table = _distances(matrix, pivots).T.copy()
        self.lengths = (matrix ** 2).sum(axis=1)

    def best(self, query_id: int, query: np.ndarray, distances: np.ndarray, own: float, k: int, least: float) -> list[tuple[int, int]]:
        """(score, id) of candidates that may be among the k best, given a k-th score already known."""
        lower = np.zeros(len(self.ids))
        for row, distance in zip(self.table, distances):
            np.maximum(lower, _apart(np.maximum(row, distance), np.minimum(row, distance), len(query)), out=lower)
        bounds = upper_bounds(self.lengths, lower, own)
        alive = np.flatnonzero((bounds >= least) & (self.ids != query_id))
        order = alive[np.argsort(-bounds[alive], kind="stable")]
        scores, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for start in range(0, len(order), STEP):
            if len(scores) >= k:
                least = max(least, float(scores[k - 1]))
            if bounds[order[start]] < least:
                break  # bounds only fall from here
            part = order[start:start + STEP]
            # products of integers are summed exactly as doubles while no sum of their sizes reaches 2^53
            found = (self.matrix[part] @ query).astype(np.int64) if math.sqrt(own) * math.sqrt(self.lengths[part].max()) < 2.0 ** 52 else _exact(self.matrix[part], query)
            kept = found >= least
            scores, ids = np.concatenate([scores, found[kept]]), np.concatenate([ids, self.ids[part[kept]]])
            best = np.lexsort((ids, ~scores))[:k]
            scores, ids = scores[best], ids[best]
        return list(zip(scores.tolist(), ids.tolist()))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
          scale: float = 64.0, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(query_id, rank, id, score): for each row whose key is divisible by ``every`` the k other rows
    with the highest integer inner product, ties to the smaller key.

    Rows with the key of the query are its own and never candidates; a query key that occurs with equal
    vectors is searched once; with unequal ones its vectors are searched as one query each and ranked
    together. Shorter vectors count as filled with zeros. Fewer rows than k give fewer results. A null
    key takes no part. A score that does not fit 64 bits is an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    plain = stored(integer_vectors(vectors, key, vector, scale))
    facts = plain.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = facts["n"], facts["width"] or 0
    schema = "query_id long, rank int, id long, score long"
    if not n or not width:
        return spark.createDataFrame([], schema)
    share = min(1.0, PIVOT_SAMPLE / n)
    drawn = plain.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).orderBy("id").limit(2 * PIVOT_SAMPLE).collect()
    if not drawn:
        drawn = plain.limit(1).collect()
    sample = np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in drawn])
    chosen = choose_pivots(sample, pivots)
    shared = spark.sparkContext.broadcast(chosen)  # pivots times components

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(1), width)
            distances = _distances(matrix, shared.value)
            nearest = pa.array(distances.argmin(axis=1).astype("int32"))
            raw = pa.array([row.tobytes() for row in matrix], pa.binary())
            far = pa.array([row.tobytes() for row in distances], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), nearest, raw, far], ["id", "cell", "v", "far"])

    placed_rows = plain.mapInArrow(placed, "id long, cell int, v binary, far binary")
    rows_per_block = max(block_rows, math.ceil(n / max_blocks))
    sizes = {r["cell"]: r["count"] for r in placed_rows.select("cell").groupBy("cell").count().collect()}  # one per pivot
    parts, first, blocks = {}, {}, 0
    for cell, size in sorted(sizes.items()):
        parts[cell], first[cell] = math.ceil(size / rows_per_block), blocks
        blocks += parts[cell]
    of_cell = lambda numbers: F.create_map(*[F.lit(x) for pair in sorted(numbers.items()) for x in pair])[F.col("cell")]
    block = (of_cell(first) + F.pmod(F.xxhash64("id"), of_cell(parts).cast("long"))).cast("int")
    table = stored(placed_rows.select(block.alias("block"), "id", "v", "far"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            far = _wide(batch.column(1), len(chosen))
            lengths = (_wide(batch.column(2), width) ** 2).sum(axis=1)
            rows = np.column_stack([far, lengths])
            for number in np.unique(numbers):
                own = rows[numbers == number]
                low, high = own.min(axis=0), own.max(axis=0)
                if number in seen:
                    low, high = np.minimum(low, seen[number][0]), np.maximum(high, seen[number][1])
                seen[number] = [low, high]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int32()), pa.array([x[0].tobytes() for x in seen.values()], pa.binary()),
             pa.array([x[1].tobytes() for x in seen.values()], pa.binary())], ["block", "low", "high"])

    low, high = np.full((blocks, len(chosen) + 1), np.inf), np.full((blocks, len(chosen) + 1), -np.inf)
    for row in table.select("block", "far", "v").mapInArrow(ranges, "block int, low binary, high binary").groupBy("block").agg(
            F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")).toLocalIterator():
        low[row["block"]] = np.min([np.frombuffer(x) for x in row["lows"]], axis=0)
        high[row["block"]] = np.max([np.frombuffer(x) for x in row["highs"]], axis=0)
    bounds = spark.sparkContext.broadcast((low, high))  # at most ``max_blocks`` and one per pivot

    queries = table.where(F.pmod("id", F.lit(every)) == 0).select("block", "id", "v", "far").distinct()
    home = _searched(table, queries.select("block", F.col("id").alias("q"), F.col("v").alias("qv"), F.lit(-math.inf).alias("least")), shared, k, width)
    home = stored(home)
    # rows with unequal vectors for one key share its k-th score, which any of them may reach
    kth = _ranked(home, k).where(F.col("rank") == k).select(F.col("query_id").alias("kq"), F.col("score").cast("double").alias("kth"))
    open_queries = queries.join(kth, F.col("id") == F.col("kq"), "left").select("block", "id", "v", "far", F.coalesce("kth", F.lit(-math.inf)).alias("least"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = bounds.value
        for batch in batches:
            out = []
            far, matrix = _wide(batch.column(3), len(chosen)), _wide(batch.column(2), width)
            for at, (number, name, least) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist())):
                gap = np.maximum(_apart(lows[:, :-1], far[at], width), _apart(far[at], highs[:, :-1], width)).max(axis=1).clip(0.0)
                most = upper_bounds(highs[:, -1], gap, float((matrix[at] ** 2).sum()))
                raw = matrix[at].tobytes()
                out += [(int(b), name, raw, least) for b in np.flatnonzero(most >= least) if b != number]
                if len(out) > 4096:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    visits = open_queries.mapInArrow(spread, "block int, q long, qv binary, least double")
    others = _searched(table, visits, shared, k, width)
    return _ranked(home.unionByName(others), k)


def _wide(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[]] * 4
    types = [pa.int32(), pa.int64(), pa.binary(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "q", "qv", "least"])


def _searched(table: DataFrame, visits: DataFrame, pivots, k: int, width: int) -> DataFrame:
    """(query_id, id, score) of the best candidates of each block for the queries that visit it. A block
    and its visitors meet in one task: the candidates first, then the queries in small batches."""
    rows = table.select("block", F.lit(0).alias("turn"), "id", "v", F.lit(0.0).alias("least")).unionByName(
        visits.select("block", F.lit(1).alias("turn"), F.col("q").alias("id"), F.col("qv").alias("v"), "least"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, candidates, ids, matrix = None, None, [], []
        for batch in batches:
            out = []
            for number, turn, name, raw, least in zip(*(column.to_pylist() for column in batch.columns)):
                if number != block:
                    block, candidates, ids, matrix = number, None, [], []
                if turn == 0:
                    ids.append(name)
                    matrix.append(raw)
                    continue
                if candidates is None:
                    candidates = Block(np.array(ids, dtype=np.int64), np.frombuffer(b"".join(matrix)).reshape(-1, width), pivots.value)
                    matrix = []
                query = np.frombuffer(raw)
                distances = _distances(query[None, :], pivots.value)[0]
                out += [(name, found, score) for score, found in candidates.best(name, query, distances, float(query @ query), k, least)]
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "score"])

    return rows.repartition("block").sortWithinPartitions("block", "turn").mapInArrow(search, "query_id long, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
