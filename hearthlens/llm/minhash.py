"""Near-duplicates by an inverted join of MinHash signatures, confirmed on the full shingle sets.

Texts with equal shingle sets are one class, so copies are never paired. A class is posted under each
pair of a signature coordinate and its value. Two classes of the wanted similarity agree on most
coordinates, so it is enough to post the rarest ones: with T agreements out of K asked for, two such
classes share one of the first K - T + 1 postings in the order of rarity (the prefix), and classes with
fewer than T postings that anyone shares are skipped altogether. The rarity of a posting is its count
over all classes, so postings that a common passage makes frequent come last.

Lists of classes under one posting are first merged with a leader each, which needs as many pairs as the
list has members; the pairs with at least T agreements are confirmed on the full sets, and these links
join classes into components. Members of a list that still lie in different components are then compared
with each other on the full sets, in blocks. So what is pruned is what is already joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.llm.common import ship, stored, worker_task
from hearthlens.llm.components import components

#: Coordinates of a signature, and agreements asked for. A pair at a similarity of 0.8 has 51 on
#: average with a standard deviation of 3.2; fewer than 34 come with a probability below one in a million.
COORDINATES = 64
AGREEMENTS = 34
#: Leaders that lists of one group of near copies are merged with.
LEADERS = 4
#: Identifiers that are broadcast to pick texts, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents of a block, and shingles that two blocks are compared on at a time.
BLOCK = 384
COLUMNS_AT_ONCE = 4096

_SEEDS = np.random.default_rng(20_240_601)
_MASKS = _SEEDS.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_FACTORS = _SEEDS.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``words`` words of a whole text, A-Z lower-cased;
    of all its words if there are fewer; empty without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and space and 09 to 0D
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    runs = max(1, len(hashes) - words + 1)
    length = min(words, len(hashes))
    total = np.full(runs, np.uint64(length))
    for i in range(length):
        total = (total + hashes[i:i + runs]) * _BASE
        total ^= total >> np.uint64(29)
    return np.unique(total)


def signature(values: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of 64 hash functions, numbered by coordinate: int64 whose
    upper half is the coordinate and whose lower half is the value."""
    least = np.empty(COORDINATES, dtype=np.uint64)
    step = max(1, (1 << 16) // max(1, len(values)))
    for at in range(0, COORDINATES, step):
        part = (values[None, :] ^ _MASKS[at:at + step, None]) * _FACTORS[at:at + step, None]
        least[at:at + step] = (part >> np.uint64(32)).min(axis=1)
    return ((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | least).astype(np.int64)


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, digest, signature) of every row: size and 128-bit digest of the shingle set."""
    ship(docs.sparkSession)

    @worker_task("minhash")
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, parts = [], [], []
            for value in batch.column(1):
                found = shingles(value.as_py(), words)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                parts.append(signature(found) if len(found) else np.zeros(0, dtype=np.int64))
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            ends = np.cumsum([0] + [len(p) for p in parts])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "n", "digest", "signature"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        signed, "id long, n long, digest binary, signature array<long>")


def _prefixes(classes: DataFrame, agreements: int) -> DataFrame:
    """(key, id): the postings of each class that a class with enough agreements may share first."""
    posted = classes.select("id", F.explode("signature").alias("key"))
    frequent = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = posted.join(frequent, "key")
    # at most one entry per coordinate; those nobody shares are the rarest and take up the prefix first
    gathered = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))
    live = gathered.where(F.size("keys") >= agreements)
    kept = F.slice("keys", F.lit(1), F.size("keys") - agreements + 1)
    return live.select("id", F.explode(kept).alias("k")).select("id", F.col("k.key").alias("key"))


def _leader(key: Column, value: Column) -> Column:
    """Numbers the members of a list in one of four orders, picked by its coordinate; its own inverse."""
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in (0, -1, 0x5DEECE66D1234567, -0x3A5C96E1B7D20F4B)][:LEADERS]),
                        (F.shiftright(key, 32) % LEADERS + 1).cast("int"))
    return value.bitwiseXOR(mask)


def _agreeing(pairs: DataFrame, classes: DataFrame, agreements: int, percent: int) -> DataFrame:
    """The pairs (a, b) with enough agreements, and sizes that allow the similarity."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("__n"), F.col("signature").alias("__s"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("__m"), F.col("signature").alias("__t"))
    both = pairs.join(left, "a").join(right, "b")
    sizes = (F.least("__n", "__m") * 100 >= F.greatest("__n", "__m") * percent)
    return both.where(sizes).where(F.size(F.array_intersect("__s", "__t")) >= agreements).select("a", "b")


def _sets(ids: DataFrame, docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(id, shingles): the full sets, as sorted 64-bit hashes, of the documents with the distinct ``ids``."""
    @worker_task("minhash")
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(value.as_py(), words) for value in batch.column(1)]
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            ends = np.cumsum([0] + [len(s) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "shingles"])

    chosen = stored(ids.select(F.col("id").alias("__id")))
    wanted = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return texts.join(wanted, F.col("id") == F.col("__id"), "left_semi").mapInArrow(full, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    @worker_task("minhash")
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            one, other = batch.column(2), batch.column(3)
            x, y = (side.values.to_numpy().view(np.uint64) for side in (one, other))
            left, right = one.offsets.to_numpy(), other.offsets.to_numpy()
            for i in range(len(batch)):
                p, q = x[left[i]:left[i + 1]], y[right[i]:right[i + 1]]
                common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                kept.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(_sets(ids, docs, words, key, text))
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def _block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between documents of two blocks, given as (side, id, component, set), that lie in different
    components: enough of them to join all components that any link joins."""
    left = [r for r in rows if r[0] == 0]
    right = [r for r in rows if r[0] == 1] or left
    both = left + right if right is not left else left
    flat = np.concatenate([r[3] for r in both])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    row = np.repeat(np.arange(len(both)), [len(r[3]) for r in both])
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    common = np.zeros((len(left), len(right)))
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS_AT_ONCE):
        low, high = np.searchsorted(number, [start, start + COLUMNS_AT_ONCE])
        part = np.zeros((len(both), COLUMNS_AT_ONCE), dtype=np.float32)
        part[row[low:high], number[low:high] - start] = 1.0
        common += part[:len(left)] @ (part[len(left):] if right is not left else part).T
    n = np.array([len(r[3]) for r in left])[:, None]
    m = np.array([len(r[3]) for r in right])[None, :]
    linked = 100 * common >= percent * (n + m - common)
    linked &= np.array([r[2] for r in left])[:, None] != np.array([r[2] for r in right])[None, :]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, j in np.argwhere(linked).tolist():
        one, other = find(left[i][2]), find(right[j][2])
        if one != other:
            root[one] = other
            out.append((left[i][1], right[j][1]))
    return out


def _links_apart(postings: DataFrame, found: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """Links (a, b) between members of a list that lie in different components, as many as it takes to
    join the components.

    A shingle that no other document of these lists has is in no intersection, so a document whose
    shared part is too small for the similarity is left out. The others are gathered by the leaders of
    their lists, a few per document, and each group is divided into blocks: a task meets two blocks, of
    bounded size, and compares their full sets as a product of matrices.
    """
    labelled = postings.join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy("key").agg(F.min("id").alias("group"), F.min("c").alias("__x"), F.max("c").alias("__y")).where("__x < __y")
    apart = stored(labelled.join(mixed.select("key", "group"), "key").select("group", "id", "c").distinct())
    sets = stored(_sets(apart.select("id").distinct(), docs, words, key, text).dropDuplicates(["id"]))
    alone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    short = sets.select("id", F.size("shingles").alias("n")).join(alone.groupBy("id").agg(F.count("*").alias("u")), "id").where(
        (F.col("n") - F.col("u")) * 100 < F.col("n") * percent)
    able = apart.join(short.select("id"), "id", "left_anti")
    groups = able.groupBy("group").agg(F.count("*").alias("__n"), F.min("c").alias("__x"), F.max("c").alias("__y")).where("__x < __y")
    blocks = F.ceil(F.col("__n") / BLOCK).cast("int")
    placed = able.join(groups.select("group", blocks.alias("blocks")), "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"),
        F.when(F.col("own") <= F.col("met"), 0).otherwise(1).alias("side"), "id", "c")

    @worker_task("minhash")
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []

        def links() -> pa.RecordBatch:
            out = _block_links(rows, percent) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            group, x, y, side, ids, c = (batch.column(i).to_pylist() for i in range(6))
            values, ends = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
            for i in range(len(batch)):
                if (group[i], x[i], y[i]) != place:
                    yield links()
                    place, rows = (group[i], x[i], y[i]), []
                rows.append((side[i], ids[i], c[i], values[ends[i]:ends[i + 1]].copy()))
        yield links()

    return (dealt.join(sets, "id").select("group", "x", "y", "side", "id", "c", "shingles")
            .repartition("group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(compared, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, agreements: int = AGREEMENTS, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Two rows are linked if 100 times the intersection of their shingle sets is at least ``percent``
    times the union. ``component_id`` is the smallest key that links lead to, and ``kept`` tells the row
    that has it. Rows with a null, empty or wordless text have an empty set and no links. Rows that
    share a key are one document. A row without a key has no component and is kept. Other columns are
    not read.
    """
    rows = stored(signatures(docs, words, key, text))
    named = rows.where("n > 0 and id is not null")
    # the smallest document of each set stands for it
    least = named.groupBy("digest").agg(F.min("id").alias("id"))
    classes = stored(named.join(least, ["digest", "id"], "left_semi").dropDuplicates(["digest"]).select("id", "n", "signature"))
    postings = stored(_prefixes(classes, agreements))

    heads = postings.groupBy("key").agg(F.min(_leader(F.col("key"), F.col("id"))).alias("__head"), F.count("*").alias("__c")).where("__c > 1")
    stars = postings.join(heads.select("key", _leader(F.col("key"), F.col("__head")).alias("__leader")), "key").where("id != __leader")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = stored(_agreeing(stars.select(*ordered("id", "__leader")).distinct(), classes, agreements, percent))
    links = stored(_confirmed(pairs, docs, words, percent, key, text))
    found = components(links)

    more = stored(_links_apart(postings, found, docs, words, percent, key, text))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    # a key that stands for several sets joins them as well, since it is one document
    class_of = least.select("digest", F.col("id").alias("__class")).join(found, F.col("__class") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "__class").alias("component_id"))
    with_class = rows.select("id", "n", "digest").join(class_of, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return with_class.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                             F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
