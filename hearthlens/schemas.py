"""Declared schemas: nothing in the library infers types from data."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

# The feature columns and the target of the second-hand listings table.
TAGS = ["park", "light", "p_lot", "water", "business", "transport", "l_tax"]
LISTING_FEATURES = TAGS + [
    "hall", "room", "area", "orientation", "furnishment", "level", "height", "architecture",
    "follower", "span", "gdp", "region", "green_rate", "c_population", "c_area", "c_water_resources",
]
LISTING_TARGET = "t_price"

# The feature columns, target and marker of the new-house table.
NEWHOUSE_FEATURES = [
    "gdp", "region", "green_rate", "c_population", "c_area", "c_water_resources", "min_frame_area",
    "max_frame_area", "biz", "decoration", "longitude", "latitude", "min_frame_rooms",
    "max_frame_rooms", "average_price", "near_main_road", "shopping", "bus", "equipment",
    "bussiness_circle", "built_house", "bj_tj", "small_frame", "medicine", "three_jia", "water_scene",
    "tech_house", "vr", "brand_seller", "metro", "round_line", "greenland", "house_type",
    "sale_status", "has_short_video", "open_date", "lowest_total_price", "is_cooperation",
    "reference_lowest_total_price", "reference_highest_total_price", "is_support_online_sale",
    "popular", "villa", "experts_recommend",
]
NEWHOUSE_TARGET = "reference_unit_price"
NEWHOUSE_MARKER = "rand"


def doubles(names: list[str]) -> StructType:
    return StructType([StructField(name, DoubleType()) for name in names])


def strings(names: list[str]) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


LISTING_RAW = strings(["title", "position", "house_info", "follow_info", "total_price", "unit_price", "city"])
LISTING_FEATURE_TABLE = doubles(LISTING_FEATURES + [LISTING_TARGET])
NEWHOUSE_FEATURE_TABLE = doubles(NEWHOUSE_FEATURES + [NEWHOUSE_TARGET, NEWHOUSE_MARKER])

CITY_MACRO = StructType([
    StructField("city", StringType()),
    StructField("gdp", DoubleType()),
    StructField("region", IntegerType()),
    StructField("green_rate", DoubleType()),
    StructField("c_population", DoubleType()),
    StructField("c_area", DoubleType()),
    StructField("c_water_resources", DoubleType()),
    StructField("soe_count", IntegerType()),
])

SVM_POINTS = StructType([
    StructField("X1", DoubleType()), StructField("X2", DoubleType()), StructField("y", IntegerType()),
])

TRAINING_LOG = StructType([StructField("iter", LongType()), StructField("RMSE", DoubleType())])
TIME_LOG = StructType([
    StructField("iter", LongType()), StructField("Passed", LongType()), StructField("Remaining", LongType()),
])
TRAINING_JSON = StructType([
    StructField("meta", StructType([
        StructField("iteration_count", LongType()),
        StructField("name", StringType()),
    ])),
    StructField("iterations", ArrayType(StructType([
        StructField("learn", ArrayType(DoubleType())),
        StructField("iteration", LongType()),
        StructField("passed_time", DoubleType()),
        StructField("remaining_time", DoubleType()),
    ]))),
])


def json_page(item: StructType) -> StructType:
    """The payload of one stored result page: ``{"data": {"list": [item, ...]}}``."""
    return StructType([StructField("data", StructType([StructField("list", ArrayType(item))]))])
