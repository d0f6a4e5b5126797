"""Connected components of a graph given by its links, without gathering any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthlens.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the smallest of them. Links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    up = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.unionByName(up).where("x < y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node that has a link to another one: the smallest node that can be
    reached. Large-star and small-star steps alternate until the links are stars, which takes about the
    logarithm of the longest path in rounds; each round is one grouping and one join on a node, so a
    node with very many links is pre-aggregated and its join is divided. Repeated links and links of a
    node with itself are harmless, null ends are left out.
    """
    now = stored(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()).where("a < b").distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)),
                        F.coalesce(F.sum(F.xxhash64("a", "b", F.lit(1)) % 1_000_003), F.lit(0))).first()
        if state == before or not state[0]:
            break
        before = state
        now = stored(_small_star(_large_star(now)))
    else:
        raise RuntimeError("the components did not settle")
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
