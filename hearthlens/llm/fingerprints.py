"""SimHash fingerprints of 128 bits and search within a Hamming radius, in DataFrame functions only.

The terms of a text are its runs of five words, or all its words if there are fewer. Every occurrence of
a term votes, so a term weighs what it occurs. A term is hashed to 128 bits, and each bit votes for or
against the bit of the fingerprint. Two counters of 32 bits share one sum, so the 128 votes are 64 sums
over the exploded terms of a text, which one aggregation in the JVM takes without moving a term.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthlens.llm.common import stored

WORDS = 5
SPACE = "[\\x09-\\x0D ]+"
#: Neighbouring rows that are handled in one bucket, and buckets at most: their table is broadcast.
BUCKET_ROWS = 2048
MAX_BUCKETS = 500_000
CUTS = 256
BITS = 128
#: Texts that are near copies, as in the pipeline, and the share of pairs just as similar to be found.
SIMILARITY = 0.8
RECALL = 0.95
#: Differing bits that a table of the search allows in its block.
FLIPS = 2
_PAIR = 0x0000000100000001
_LOW = 0xFFFFFFFF


def _word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, SPACE), ""), lambda word: F.xxhash64(word))


def _votes(rows: DataFrame, hashes: str, by: list[str]) -> DataFrame:
    """Rows grouped by the columns ``by`` with the two halves ``f0`` and ``f1`` of the fingerprint of an
    array of word hashes. Ties and texts without a term leave a bit at 0."""
    size = F.size(hashes)
    terms = rows.withColumn("__words", size).withColumn("__i", F.explode(F.sequence(F.lit(0), F.greatest(size - WORDS, F.lit(0)))))
    # positions beyond a short text are null, and the hash passes over nulls
    first = F.xxhash64(*[F.get(hashes, F.col("__i") + j) for j in range(WORDS)])
    hashed = terms.select(*by, F.when(F.col("__words") > 0, first).alias("t0"), F.col("__words"))
    hashed = hashed.select(*by, F.coalesce("t0", F.lit(0)).alias("t0"),
                           F.when(F.col("__words") > 0, F.xxhash64("t0", F.lit(1))).otherwise(F.lit(0)).alias("t1"),
                           F.when(F.col("__words") > 0, F.lit(1)).otherwise(F.lit(0)).alias("w"))
    sums = [F.sum(F.shiftrightunsigned(t, j).bitwiseAND(F.lit(_PAIR))).alias(f"{t}_{j}") for t in ("t0", "t1") for j in range(32)]
    voted = hashed.groupBy(*by).agg(*sums, F.sum("w").alias("w"))

    def half(t: str) -> Column:
        bits = []
        for j in range(32):
            low, high = F.col(f"{t}_{j}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"{t}_{j}", 32)
            bits += [F.when(2 * low > F.col("w"), F.lit(1 << j)).otherwise(F.lit(0).cast("long")),
                     F.when(2 * high > F.col("w"), F.shiftleft(F.lit(1).cast("long"), j + 32)).otherwise(F.lit(0).cast("long"))]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return voted.select(*by, half("t0").alias("f0"), half("t1").alias("f1"))


def as_text(f0: str | Column, f1: str | Column) -> Column:
    """A fingerprint as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The share of equal bits."""
    return F.lit(1.0) - distance(a, b) / F.lit(128.0)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, f0, f1 and fingerprint of every row. A null text is empty; a text without words has the
    fingerprint 0. Rows of equal key and text are told apart by their position in the scan; other
    columns are not read."""
    rows = docs.select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row"),
                       _word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("__hashes"))
    found = _votes(rows, "__hashes", ["__key", "__row"])
    return found.select(F.col("__key").alias(key), "f0", "f1", as_text("f0", "f1").alias("fingerprint"))


def _bucket(docs: DataFrame, bucket_rows: int, max_buckets: int) -> Column:
    """Buckets of about ``bucket_rows`` neighbouring keys, numbered in key order; -1 for a null key.
    Quantiles cut the keys into 256 ranges, and each range is divided evenly."""
    points = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    facts = docs.agg(F.count("__key").alias("n"), F.min("__key").alias("low"), F.max("__key").alias("high"),
                     F.percentile_approx("__key", points, 10_000).alias("cuts")).first()
    n, size = facts["n"], max(bucket_rows, math.ceil(facts["n"] / max_buckets))
    if n <= size:
        return F.when(F.col("__key").isNull(), F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
    starts = sorted({facts["low"], *(c for c in facts["cuts"] if c > facts["low"])})
    ends = starts[1:] + [facts["high"] + 1]
    pieces = max(1, math.ceil(n / len(starts) / size))
    widths = [max(1, math.ceil((b - a) / pieces)) for a, b in zip(starts, ends)]
    at = F.size(F.filter(F.lit(starts).cast("array<bigint>"), lambda s: s <= F.col("__key")))
    start, width = (F.get(F.lit(values).cast("array<bigint>"), at - 1) for values in (starts, widths))
    # the remainder is taken off first, so that the quotient is exact for any key
    over = F.col("__key") - start
    number = (at.cast("long") - 1) * F.lit(1 << 32) + ((over - F.pmod(over, width)) / width).cast("long")
    return F.coalesce(number, F.lit(-1).cast("long"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS,
                        max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """For each row the fingerprints of its text, of its edited text and of the next row's text.

    Rows follow each other by descending key, nulls last, then by a hash of the text; the first follows
    the last. The edited text has its last half of the code points replaced by as many first ones of the
    next text. Rows are dealt to buckets of neighbouring keys; the first row of a bucket is also sent to
    the bucket before it, so each row finds its next one in its own task and texts move once. A null
    text is empty; repeated rows stay; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    dealt = rows.withColumn("__bucket", _bucket(rows, bucket_rows, max_buckets))
    # one row per bucket, whose number is bounded
    heads = dealt.groupBy("__bucket").agg(F.max("__key").alias("__head"))
    everything = Window.orderBy("__bucket")
    targets = heads.select("__bucket", "__head", F.coalesce(
        F.lead("__bucket").over(everything), F.min("__bucket").over(everything)).alias("__target"))
    with_target = dealt.join(F.broadcast(targets), "__bucket")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("s"))
    guest = F.struct(F.col("__target").alias("b"), F.lit(True).alias("s"))
    places = F.when(F.col("__key").eqNullSafe(F.col("__head")), F.array(own, guest)).otherwise(F.array(own))
    spread = with_target.select("__key", "__text", F.explode(places).alias("__p")).select(
        "__key", "__text", F.col("__p.b").alias("bucket"), F.col("__p.s").alias("guest"))

    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("__key"), F.xxhash64("__text"))
    follow = spread.select("__key", "__text", "bucket", "guest", F.row_number().over(order).alias("row"),
                           F.lead("__text").over(order).alias("__next"))
    chars = F.char_length("__text").cast("long")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("__text", F.lit(1), (chars - half).cast("int")),
                      F.substring(F.coalesce("__next", F.lit("")), F.lit(1), half))
    texts = follow.select("bucket", "row", "guest", "__key", chars.alias("n_chars"), "__text", edited.alias("__edited"))
    both = F.when(F.col("guest"), F.array(_word_hashes(F.col("__text")))).otherwise(
        F.array(_word_hashes(F.col("__text")), _word_hashes(F.col("__edited"))))
    by = ["bucket", "row", "guest", "__key", "n_chars", "edited_sha256"]
    variants = texts.select(*by[:-1], F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), both.alias("__both")).select(
        *by, F.posexplode_outer("__both").alias("variant", "__hashes"))
    # the grouping holds the bucket, by which the rows already lie together: nothing moves from here on
    voted = _votes(variants, "__hashes", [*by, "variant"])
    pick = lambda half, variant: F.max(F.when(F.col("variant") == variant, F.col(half)))
    wide = voted.groupBy(*by).agg(pick("f0", 0).alias("f0"), pick("f1", 0).alias("f1"), pick("f0", 1).alias("e0"), pick("f1", 1).alias("e1"))
    after = Window.partitionBy("bucket").orderBy("row")
    final = wide.select("*", F.lead("f0").over(after).alias("x0"), F.lead("f1").over(after).alias("x1")).where(~F.col("guest"))
    pairs = {name: (F.col(f"{name}0"), F.col(f"{name}1")) for name in "fex"}
    return final.select(
        F.col("__key").alias(key), "n_chars", "edited_sha256", as_text("f0", "f1").alias("fingerprint"),
        as_text("e0", "e1").alias("edited_fingerprint"), likeness(pairs["f"], pairs["e"]).alias("near_edited"),
        likeness(pairs["f"], pairs["x"]).alias("near_next"), "f0", "f1")


def radius_for(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The smallest radius that holds a pair of texts of this Jaccard similarity with this probability.

    Sets of one size whose similarity is j have the cosine 2j / (1 + j), and a bit of their fingerprints
    differs with the probability of their angle over pi, each bit by itself.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    found = 0.0
    for radius in range(BITS + 1):
        found += math.comb(BITS, radius) * share ** radius * (1 - share) ** (BITS - radius)
        if found >= recall:
            return radius
    return BITS


def _block(a: Column, b: Column, low: int, high: int) -> Column:
    """Bits ``low`` to ``high`` of a fingerprint whose halves are ``a`` and ``b``; at most 64."""
    if high <= 64:
        bits = F.shiftrightunsigned(a, low)
    elif low >= 64:
        bits = F.shiftrightunsigned(b, low - 64)
    else:
        bits = F.shiftrightunsigned(a, low).bitwiseOR(F.shiftleft(b, 64 - low))
    return bits if high - low == 64 else bits.bitwiseAND(F.lit((1 << high - low) - 1))


def _flips(width: int, most: int) -> list[int]:
    """All signed 64-bit masks of ``width`` bits with at most ``most`` ones."""
    masks = [sum(1 << j for j in places) for n in range(most + 1) for places in combinations(range(width), n)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(q0, q1, f0, f1, bits) of all fingerprints of ``prints`` at most ``radius`` bits from one of
    ``queries``, itself included; both have the columns f0 and f1.

    The 128 bits are divided into blocks, each with a table keyed by its bits, and each block has a most
    of differing bits. The mosts and one for every block add up to one more than the radius, so that
    fingerprints within it keep to the most of a block somewhere. A query looks up its own key and all
    keys that differ from it by so much; a pair is kept in the first table that finds it. Equal
    fingerprints are one row, so copies of a text are never paired with each other. ``blocks`` defaults
    to as many as let no block differ by more than two bits.
    """
    blocks = blocks or max(2, -(-(radius + 1) // (FLIPS + 1)))
    if radius < 0 or not 2 <= blocks <= BITS:
        raise ValueError("the radius may not be negative, and there have to be 2 to 128 blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    mosts = [(radius + 1 + i) // blocks - 1 for i in range(blocks)]
    used = [i for i in range(blocks) if mosts[i] >= 0]

    def tables(rows: DataFrame, names: tuple[str, str]) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("table"), _block(F.col("f0"), F.col("f1"), edges[i], edges[i + 1]).alias("key")) for i in used]
        return rows.select("f0", "f1").distinct().select(
            F.col("f0").alias(names[0]), F.col("f1").alias(names[1]), F.explode(F.array(*keys)).alias("at")).select(*names, "at.table", "at.key")

    masks = F.create_map(*[x for i in used for x in (F.lit(i), F.lit(_flips(edges[i + 1] - edges[i], mosts[i])).cast("array<bigint>"))])
    left = tables(queries, ("q0", "q1")).select("q0", "q1", "table", "key", F.explode(masks[F.col("table")]).alias("mask")).select(
        "q0", "q1", "table", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    right = tables(prints, ("f0", "f1"))
    a, b = F.col("q0").bitwiseXOR(F.col("f0")), F.col("q1").bitwiseXOR(F.col("f1"))
    first = F.coalesce(*[F.when(F.bit_count(_block(a, b, edges[i], edges[i + 1])) <= mosts[i], F.lit(i)) for i in used])
    bits = distance((F.col("q0"), F.col("q1")), (F.col("f0"), F.col("f1")))
    near = (F.col("l.key") == F.col("r.key")) & (F.col("l.table") == F.col("r.table"))
    # the planner does not see how many keys a query has, so it would broadcast them
    return left.alias("l").hint("merge").join(right.alias("r"), near & (bits <= radius) & (first == F.col("l.table"))).select(
        "q0", "q1", "f0", "f1", bits.alias("bits"))


def near_counts(prints: DataFrame, key: str = "doc_id", every: int = 50, radius: int | None = None) -> DataFrame:
    """The rows of ``prints`` with ``n_near``: for keys divisible by ``every`` the number of other rows
    whose fingerprint is within the radius, null for the others, which are not searched for. The radius
    defaults to what finds near copies, see ``radius_for``."""
    radius = radius_for() if radius is None else radius
    kept = stored(prints)
    queried = F.coalesce(F.pmod(F.col(key), F.lit(every)) == 0, F.lit(False))
    sizes = kept.groupBy("f0", "f1").agg(F.count("*").alias("__n"))
    pairs = within_radius(sizes, kept.where(queried), radius)
    counted = pairs.join(sizes, ["f0", "f1"]).groupBy("q0", "q1").agg((F.sum("__n") - 1).alias("n_near"))
    searched = kept.where(queried).join(counted, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1")), "left").drop("q0", "q1")
    return searched.unionByName(kept.where(~queried).withColumn("n_near", F.lit(None).cast("long")))
