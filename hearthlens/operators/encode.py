"""Ordinal codes and text tags of the listing attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The ordinal codes of the cleaning log.
ORIENTATION = {"E": 0, "S": 1, "W": 2, "N": 3}
FURNISHMENT = {"other": 0, "unfinished": 1, "simple": 2, "well-decorated": 3}
LEVEL = {"basement": 0, "bottom": 1, "low": 2, "middle": 3, "high": 4, "top": 5}
ARCHITECTURE = {"bungalow": 0, "slab": 1, "slab-tower": 2, "tower": 3}
REGION = {"northeast": 0, "north": 1, "east": 2, "northwest": 3, "southwest": 4, "central-south": 5}

# The same codes for the words used in the listing texts.
ORIENTATION_WORDS = {"东": 0, "南": 1, "西": 2, "北": 3}
FURNISHMENT_WORDS = {"其他": 0, "毛坯": 1, "简装": 2, "精装": 3}
LEVEL_WORDS = {"地下室": 0, "底层": 1, "低楼层": 2, "中楼层": 3, "高楼层": 4, "顶层": 5}
ARCHITECTURE_WORDS = {"平房": 0, "板楼": 1, "板塔结合": 2, "塔楼": 3}

# The notes name the tags but not their wording; these words are defaults to be replaced.
TAG_WORDS = {
    "park": ["公园"],
    "light": ["采光"],
    "p_lot": ["车位"],
    "water": ["海景", "江景", "河景", "湖景"],
    "business": ["商圈", "商场", "CBD"],
    "transport": ["地铁", "交通便利"],
    "l_tax": ["满五", "满二", "唯一"],
}


def ordinal(column: Column, codes: dict[str, int]) -> Column:
    """The code of a word, null for a word without one."""
    lookup = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(lookup, column)


def orientation_code(text: Column) -> Column:
    """Code of the first direction of the first orientation token."""
    return ordinal(F.substring(text, 1, 1), ORIENTATION_WORDS)


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains one of the words; a missing text contains none."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return F.coalesce(found, F.lit(False))


def tags(text: Column, words: dict[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """0/1 per tag."""
    return {name: mentions(text, listed).cast("int") for name, listed in (words or TAG_WORDS).items()}
