"""The listing tables of the domain, derived from the given order, customer and supplier tables.

A nation stands for a city and an order for a listing: its date, status, price and customer become
the texts that a listing page shows. The texts are then parsed, cleaned and encoded by the library
like collected ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthlens.functions.listing import parse_listings
from hearthlens.operators import encode
from hearthlens.operators.clean import Rule, apply_rules, listing_rules
from hearthlens.operators.joins import lookup_join
from hearthlens.operators.select import spread
from hearthlens.plans.registry import table
from hearthlens.session import fresh_path

# Which listing word a column value of the given tables is shown as.
TITLE = """concat(city, case when c_mktsegment = 'MACHINERY' and o_orderstatus = 'P' and o_orderpriority = '1-URGENT'
  then ' 别墅' else ' 住宅' end, case when o_totalprice < 5000 then ' 地下车位' else '' end)"""
ORIENTATION = """case o_orderpriority when '1-URGENT' then '东' when '2-HIGH' then '南 北' when '3-MEDIUM' then '西'
  when '4-NOT SPECIFIED' then '北' else '东南' end"""
FURNISHMENT = """case c_mktsegment when 'BUILDING' then '精装' when 'AUTOMOBILE' then '简装' when 'MACHINERY' then '毛坯'
  when 'HOUSEHOLD' then '其他' else '精装' end"""
LEVEL = """case when month(o_orderdate) = 1 then '地下室' when month(o_orderdate) <= 3 then '底层'
  when month(o_orderdate) <= 5 then '低楼层' when month(o_orderdate) <= 8 then '中楼层'
  when month(o_orderdate) <= 10 then '高楼层' when month(o_orderdate) = 11 then '顶层' end"""
ARCHITECTURE = """case when c_acctbal < 0 then null when o_orderstatus = 'F' then '板楼' when o_orderstatus = 'O' then '塔楼'
  when month(o_orderdate) < 10 then '板塔结合' else '平房' end"""
AREA_PRICE = """case o_orderpriority when '1-URGENT' then 5000 when '2-HIGH' then 4500 when '3-MEDIUM' then 4000
  when '4-NOT SPECIFIED' then 3500 else 3000 end"""
PUBLISHED = """case o_orderstatus when 'F' then concat(day(o_orderdate), '天以前发布')
  when 'O' then concat(quarter(o_orderdate), '个月以前发布') else concat(year(o_orderdate) - 1994, '年前发布') end"""
TAG_TEXT = """concat_ws(' ', case when o_orderpriority = '1-URGENT' then '满五唯一' end,
  case when c_mktsegment = 'AUTOMOBILE' then '近地铁' end, case when c_mktsegment = 'MACHINERY' then 'CBD商圈' end,
  case when o_orderstatus = 'O' then '湖景房' end, case when month(o_orderdate) between 6 and 8 then '采光好' end,
  case when quarter(o_orderdate) = 4 then '带车位' end, case when o_orderpriority = '5-LOW' then '公园旁' end)"""


def cities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("city_key"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("region_key"))


def listing_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One listing per order: id, city and the text fields of a listing card plus its tags."""
    orders = spread(table(spark, folder, "orders")).withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_nationkey").alias("city_key"))
    joined = lookup_join(lookup_join(orders, customers, "c_custkey", "inner"), cities(spark, folder), "city_key", "inner")
    area = f"cast(cast(floor(o_totalprice / ({AREA_PRICE})) as int) + 20 as string)"
    house = f"""concat_ws(' | ', concat(year(o_orderdate) - 1994, '室', quarter(o_orderdate), '厅'),
      concat({area}, '.5平米'), {ORIENTATION}, {FURNISHMENT},
      concat(coalesce({LEVEL}, ''), '(共', day(o_orderdate) - 1, '层)'), {ARCHITECTURE})"""
    return joined.select(
        F.col("o_orderkey").alias("id"),
        "city",
        F.expr(TITLE).alias("title"),
        F.concat_ws("-", "city", "c_mktsegment").alias("position"),
        F.expr(house).alias("house_info"),
        F.expr(f"concat(cast(floor(abs(c_acctbal) / 100) as int), '人关注 / ', {PUBLISHED})").alias("follow_info"),
        F.expr("case when o_totalprice <= 495000 then cast(cast(floor(o_totalprice / 1000) as int) as string) end").alias("total_price"),
        F.expr("concat(format_number(cast(floor(o_totalprice / 7) as int), 0), '元/平')").alias("unit_price"),
        F.expr(TAG_TEXT).alias("tags"),
    )


def parsed(raw: DataFrame) -> DataFrame:
    """The raw listing with its typed attributes."""
    return parse_listings(raw, ["id", "city", "title", "tags"])


def rules() -> list[Rule]:
    return listing_rules(F.col("title").contains("别墅"))


def encoded(listings: DataFrame) -> DataFrame:
    """Codes and tags of parsed listings."""
    return listings.select(
        "id", "city",
        *[c.alias(n) for n, c in encode.tags(F.col("tags")).items()],
        "hall", "room", "area",
        encode.orientation_code(F.col("orientation_text")).alias("orientation"),
        encode.ordinal(F.col("furnishment_text"), encode.FURNISHMENT_WORDS).alias("furnishment"),
        encode.ordinal(F.col("level_text"), encode.LEVEL_WORDS).alias("level"),
        "height",
        encode.ordinal(F.col("architecture_text"), encode.ARCHITECTURE_WORDS).alias("architecture"),
        "follower", "span", "t_price",
    )


def city_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Figures per city: both tables are summed per city before anything is joined."""
    people = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("city_key")).agg(
        F.round(F.sum("c_acctbal"), 2).alias("gdp"), F.count("*").cast("double").alias("c_population"),
        F.round(F.avg("c_acctbal") / 100, 4).alias("green_rate"))
    firms = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("city_key")).agg(
        F.count("*").cast("double").alias("c_area"), F.round(F.sum("s_acctbal"), 2).alias("c_water_resources"))
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("region_key"), "r_name")
    words = {"AFRICA": "northeast", "AMERICA": "north", "ASIA": "east", "EUROPE": "northwest", "MIDDLE EAST": "southwest"}
    code = encode.ordinal(F.col("r_name"), {name: encode.REGION[word] for name, word in words.items()})
    table_ = lookup_join(cities(spark, folder), region, "region_key")
    table_ = table_.join(people, "city_key", "left").join(firms, "city_key", "left")
    return table_.select("city", "gdp", code.alias("region"), "green_rate", "c_population",
                         F.coalesce("c_area", F.lit(0.0)).alias("c_area"),
                         F.coalesce("c_water_resources", F.lit(0.0)).alias("c_water_resources"))


def listing_features(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed, cleaned and encoded listings with the figures of their city: the modelling table."""
    listings = encoded(apply_rules(parsed(listing_raw(spark, folder)), rules()))
    path = fresh_path(spark, "city_macro")
    city_macro(spark, folder).write.parquet(path)  # one row per city: summed once, then checked and joined
    return lookup_join(listings, spark.read.parquet(path), "city")


def stored_features(spark: SparkSession, folder: str) -> DataFrame:
    """The modelling table written once, for work that reads it several times."""
    path = fresh_path(spark, "listing_features")
    listing_features(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


# The same attributes straight from the given columns, for checking the parsed ones.
LISTING_SQL = f"""
listing_base as (
  select o.*, c.c_acctbal, c.c_mktsegment, n.n_name as city,
    c_mktsegment = 'MACHINERY' and o_orderstatus = 'P' and o_orderpriority = '1-URGENT' as villa
  from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
),
listing as (
  select o_orderkey as id, city, villa, o_totalprice < 5000 as parking,
    cast(year(o_orderdate) - 1994 as integer) as room, cast(quarter(o_orderdate) as integer) as hall,
    cast(floor(o_totalprice / ({AREA_PRICE})) as integer) + 20.5::double as area,
    case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2
      when '4-NOT SPECIFIED' then 3 else 0 end as orientation,
    case c_mktsegment when 'AUTOMOBILE' then 2 when 'MACHINERY' then 1 when 'HOUSEHOLD' then 0 else 3 end as furnishment,
    case when month(o_orderdate) = 1 then 0 when month(o_orderdate) <= 3 then 1 when month(o_orderdate) <= 5 then 2
      when month(o_orderdate) <= 8 then 3 when month(o_orderdate) <= 10 then 4 when month(o_orderdate) = 11 then 5 end as level,
    cast(day(o_orderdate) - 1 as integer) as height,
    case when c_acctbal < 0 then null when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 3
      when month(o_orderdate) < 10 then 2 else 0 end as architecture,
    cast(floor(abs(c_acctbal) / 100) as integer) as follower,
    cast(case o_orderstatus when 'F' then day(o_orderdate) when 'O' then quarter(o_orderdate) * 30
      else (year(o_orderdate) - 1994) * 365 end as integer) as span,
    case when o_totalprice <= 495000 then floor(o_totalprice / 1000) end as t_price,
    floor(o_totalprice / 7) as u_price,
    cast(o_orderpriority = '5-LOW' as integer) as park, cast(month(o_orderdate) between 6 and 8 as integer) as light,
    cast(quarter(o_orderdate) = 4 as integer) as p_lot, cast(o_orderstatus = 'O' as integer) as water,
    cast(c_mktsegment = 'MACHINERY' as integer) as business, cast(c_mktsegment = 'AUTOMOBILE' as integer) as transport,
    cast(o_orderpriority = '1-URGENT' as integer) as l_tax
  from listing_base
),
cleaned as (
  select * from listing where t_price is not null and not parking and architecture is not null
    and (level is not null or villa) and not villa and height <> 0
)
"""

MACRO_SQL = """
macro as (
  select n_name as city, r_regionkey as region, p.gdp, p.c_population, p.green_rate,
    coalesce(f.c_area, 0) as c_area, coalesce(f.c_water_resources, 0) as c_water_resources
  from nation join region on n_regionkey = r_regionkey
  left join (select c_nationkey, round(sum(c_acctbal), 2) as gdp, cast(count(*) as double) as c_population,
      round(avg(c_acctbal) / 100, 4) as green_rate from customer group by 1) p on p.c_nationkey = n_nationkey
  left join (select s_nationkey, cast(count(*) as double) as c_area, round(sum(s_acctbal), 2) as c_water_resources
      from supplier group by 1) f on f.s_nationkey = n_nationkey
)
"""
