"""Typed attributes of a second-hand listing out of its text fields.

The source notes name the resulting columns but not the text layout; the patterns below are this
library's reading of it. Each part of a house text has its own pattern, so parts may be absent, unknown
or out of order; a follow text is matched once and rewritten to a fixed number of fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.functions.text import first_token
from hearthlens.operators.encode import ARCHITECTURE_WORDS, FURNISHMENT_WORDS, LEVEL_WORDS
from hearthlens.operators.select import compute_once

# The units of the time on the market, in days.
DAYS_PER_UNIT = {"天": 1, "个月": 30, "年": 365}

# One pattern per attribute; the parts of a text may come in any order.
HOUSE_PARTS = [
    r"(?:^|[|\s])(\d+)室",
    r"(?:^|[|\s室])(\d+)厅",
    r"(?:^|[|\s厅])(\d+(?:\.\d+)?)平米",
    r"(?:^|\|)\s*([东南西北][东南西北 ]*)(?:\||$)",
    rf"(?:^|[|\s])({'|'.join(FURNISHMENT_WORDS)})\s*(?:\||$)",
    rf"(?:^|[|\s])({'|'.join(LEVEL_WORDS)})\s*(?:[(共|]|$)",
    r"共(\d+)层",
    rf"(?:^|[|\s])({'|'.join(ARCHITECTURE_WORDS)})\s*(?:\||$)",
]
FOLLOW_INFO = rf"(?s)^\s*(?:(\d+)人关注)?[\s/]*(?:(今天|刚刚)|(\d+)({'|'.join(DAYS_PER_UNIT)})以?前)?.*$"


def _fields(text: Column, pattern: str, count: int) -> Column:
    return F.split(F.regexp_replace(text, pattern, "|".join(f"${i + 1}" for i in range(count))), r"\|")


def _house_fields(text: Column) -> Column:
    return F.array(*[F.regexp_extract(text, pattern, 1) for pattern in HOUSE_PARTS])


def _field(fields: Column, index: int) -> Column:
    text = F.trim(F.get(fields, F.lit(index)))
    return F.when(text != "", text)


def house_info_columns(info: Column) -> dict[str, Column]:
    """Rooms, halls, area, orientation, furnishment, level, floors and building type of texts like
    ``3室2厅 | 89.5平米 | 南 北 | 精装 | 中楼层(共18层) | 板楼``; a part that is absent is null."""
    return _house_columns(_house_fields(info))


def follow_info_columns(info: Column) -> dict[str, Column]:
    """Followers and days on the market of texts like ``12人关注 / 3个月以前发布``."""
    return _follow_columns(_fields(info, FOLLOW_INFO, 4))


def _house_columns(parts: Column) -> dict[str, Column]:
    return {
        "room": _field(parts, 0).try_cast("int"),
        "hall": _field(parts, 1).try_cast("int"),
        "area": _field(parts, 2).try_cast("double"),
        "orientation_text": first_token(_field(parts, 3)),
        "furnishment_text": _field(parts, 4),
        "level_text": _field(parts, 5),
        "height": _field(parts, 6).try_cast("int"),
        "architecture_text": _field(parts, 7),
    }


def _follow_columns(parts: Column) -> dict[str, Column]:
    factors = F.create_map(*[F.lit(x) for pair in DAYS_PER_UNIT.items() for x in pair])
    days = F.try_element_at(factors, _field(parts, 3))
    return {
        "follower": _field(parts, 0).try_cast("int"),
        "span": F.when(_field(parts, 1).isNotNull(), F.lit(0)).otherwise(_field(parts, 2).try_cast("int") * days),
    }


def price_columns(total: Column, unit: Column) -> dict[str, Column]:
    """Total price in 10,000 yuan and unit price in yuan per square metre, without their units."""
    return {
        "t_price": F.translate(total, ", 万", "").try_cast("double"),
        "u_price": F.translate(unit, ", 单价元/平米㎡", "").try_cast("double"),
    }


def parse_listings(df: DataFrame, keep: Sequence[str], house_info: str = "house_info", follow_info: str = "follow_info",
                   total_price: str = "total_price", unit_price: str = "unit_price") -> DataFrame:
    """The kept columns and all typed attributes; each text is matched once per row.

    The attributes are typed where the texts are matched, in one function over both: as columns of their own each filter
    and code would repeat them, and the method that Spark makes of them all is too long for the JVM to compile.
    """
    fields = F.struct(_house_fields(F.col(house_info)).alias("house"), _fields(F.col(follow_info), FOLLOW_INFO, 4).alias("follow"))
    typed = F.transform(F.array(fields), lambda f: F.struct(*[
        c.alias(n) for n, c in {**_house_columns(f["house"]), **_follow_columns(f["follow"])}.items()]))
    matched = compute_once(df, __typed=F.get(typed, F.lit(0)))
    names = [*_house_columns(F.lit(None)), *_follow_columns(F.lit(None))]
    prices = price_columns(F.col(total_price), F.col(unit_price))
    return matched.select(*keep, *[F.col("__typed")[n].alias(n) for n in names], *[c.alias(n) for n, c in prices.items()])
