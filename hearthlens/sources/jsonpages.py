"""Stored JSON result pages, flattened to tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from hearthlens.schemas import json_page


def _leaves(schema: StructType, prefix: tuple[str, ...] = ()):
    for field in schema.fields:
        path = prefix + (field.name,)
        if isinstance(field.dataType, StructType):
            yield from _leaves(field.dataType, path)
        else:
            yield path


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested struct fields become columns with dotted names; arrays stay arrays."""
    columns = []
    for path in _leaves(df.schema):
        quoted = ".".join(f"`{part}`" for part in path)
        columns.append(F.col(quoted).alias(".".join(path)))
    return df.select(*columns)


def json_items(df: DataFrame, payload: str, item: StructType, keep: list[str] | None = None) -> DataFrame:
    """One row per list item of a JSON page, nested fields under dotted names.

    A page that is not valid JSON has no items and is found by ``broken_pages``. Fields that the declared
    item lacks are not read and are found by ``undeclared_fields``; pages of another shape are read with
    their own schema and joined by ``union_all_columns``.
    """
    page = F.from_json(F.col(payload), json_page(item), {"mode": "PERMISSIVE"})
    items = df.select(*(keep or []), F.inline(page["data"]["list"]))
    return flatten_structs(items)


def broken_pages(df: DataFrame, payload: str) -> DataFrame:
    """The rows whose text is not valid JSON, as they are; a null is no text."""
    return df.where(F.col(payload).isNotNull() & F.try_parse_json(payload).isNull())


def undeclared_fields(df: DataFrame, payload: str, item: StructType, by: list[str]) -> DataFrame:
    """(by, field, items): how many items have a field that the declared item lacks, nested fields under
    dotted names."""
    page = F.from_json(F.col(payload), "data struct<list: array<string>>", {"mode": "PERMISSIVE"})
    items = df.select(*by, F.explode(page["data"]["list"]).alias("raw"))

    def unknown(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        here = F.get_json_object("raw", "$" + "".join(f"['{p}']" for p in path)) if path else F.col("raw")
        names = F.array_except(F.json_object_keys(here), F.array(*[F.lit(n) for n in schema.names]))
        dotted = F.transform(names, lambda n: F.concat(F.lit("".join(p + "." for p in path)), n))
        found = [F.coalesce(dotted, F.array().cast("array<string>"))]
        for field in schema.fields:
            if isinstance(field.dataType, StructType):
                found += unknown(field.dataType, (*path, field.name))
        return found

    return items.select(*by, F.explode(F.concat(*unknown(item, ()))).alias("field")).groupBy(*by, "field").agg(F.count("*").alias("items"))


#: Groups of pages with a shape of their own that one table is made of.
MOST_SHAPES = 200


def _column_type(found: str) -> str:
    """The declared type of a shape: objects become structs, decimals doubles, and what differs from item to item text."""
    shape = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found.replace("OBJECT<", "STRUCT<"))
    return re.sub(r"\b(VOID|VARIANT|TIMESTAMP|DATE)\b(?!`)", "STRING", shape)


def item_shapes(df: DataFrame, payload: str, by: list[str], path: str = "$.data.list") -> DataFrame:
    """(by, shape): the type that all items of a group's pages fit, found by reading them. Pages that are not JSON, or have
    no list there, have no items."""
    return _items(df, payload, by, path).groupBy(*by).agg(F.schema_of_variant_agg("item").alias("shape"))


def _items(df: DataFrame, payload: str, keep: list[str], path: str) -> DataFrame:
    found = F.try_variant_get(F.try_parse_json(F.col(payload)), path, "array<variant>")
    return df.select(*keep, F.explode(found).alias("item"))


def json_items_of_any_shape(df: DataFrame, payload: str, by: list[str], keep: list[str] | None = None, path: str = "$.data.list") -> DataFrame:
    """One row per list item of JSON pages whose fields nobody declared, nested fields under dotted names.

    The pages are read twice: once for the shape of each group of ``by``, and once for the values. A column is as wide as
    the widest of its types in the groups, text where they do not agree; a field that a group lacks is null there.
    """
    keep = list(dict.fromkeys([*by, *(keep or [])]))
    shapes = item_shapes(df, payload, by, path).limit(MOST_SHAPES + 1).collect()
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"more than {MOST_SHAPES} groups of pages")
    items = _items(df, payload, keep, path)
    frames = []
    for shape in shapes:
        if not shape["shape"].startswith("OBJECT<") or shape["shape"] == "OBJECT<>":
            continue
        group = F.lit(True)
        for c in by:
            group = group & F.col(c).eqNullSafe(F.lit(shape[c]))
        typed = items.where(group).select(*keep, F.try_variant_get("item", "$", _column_type(shape["shape"])).alias("item"))
        fields = flatten_structs(typed.select("item.*"))
        frames.append(flatten_structs(typed.select(*keep, "item.*")).select(*[f"`{c}`" for c in [*keep, *(c for c in fields.columns if c not in keep)]]))
    if not frames:
        return df.select(*keep).limit(0)
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            kinds.setdefault(name, set()).add(kind)
    wide = {name: next(iter(own)) if len(own) == 1 else "double" if own <= {"bigint", "double"} else "string" for name, own in kinds.items()}
    return union_all_columns([frame.select(*[F.col(f"`{name}`").cast(wide[name]).alias(name) for name in frame.columns]) for frame in frames])


def union_all_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column that a frame lacks is null there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)
