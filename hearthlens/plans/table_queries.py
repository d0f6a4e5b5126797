"""Queries for scans, sinks, filters, projections, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from hearthlens import sources
from hearthlens.functions.numeric import page_urls
from hearthlens.operators import joins, numbering, orderstats, profile, select
from hearthlens.operators.evaluate import best_iteration
from hearthlens.plans.listings import cities
from hearthlens.plans.registry import query, table
from hearthlens.session import fresh_path
from hearthlens.streaming.incremental import load_new_entities, read_loaded
from hearthlens.streaming.keyindex import key_index


def _schema(df: DataFrame, *names: str) -> StructType:
    fields = {f.name: f for f in df.schema.fields}
    return StructType([fields[n] for n in names])


def _orders_by_city(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the name of the customer's city."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    owners = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("city_key"))
    named = joins.lookup_join(owners, cities(spark, folder), "city_key", "inner").select("c_custkey", "city")
    return joins.lookup_join(orders, named, "c_custkey", "inner").drop("c_custkey")


# --- scans and sinks -----------------------------------------------------------------------------

@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 5000")
def csv_scan(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = fresh_path(spark, "csv_scan")
    customers.write.csv(path, header=True)
    return sources.read_csv(spark, path, customers.schema).where("c_acctbal > 5000")


@query("""select cast(trunc(p_retailprice) as integer) as t_price, cast(p_size as double) as area, p_name as title
from part where p_size > 25""")
def csv_scan_with_imposed_names(spark, folder):
    parts = table(spark, folder, "part").select("p_retailprice", "p_size", "p_name")
    path = fresh_path(spark, "csv_named")
    parts.write.csv(path, header=True)
    text = sources.read_csv_named(spark, path, ["t_price", "area", "title"])
    return text.select(select.truncate_to_int(F.col("t_price")).alias("t_price"),
                       F.col("area").cast("double").alias("area"), "title").where("area > 25")


@query("""select row_number() over (order by page_id) as row_no, page_id, url,
  concat('第', row_number() over (order by page_id), '篇文章:', url) as line from pages""")
def gbk_article_addresses(spark, folder):
    schema = StructType([StructField("编号", LongType()), StructField("地址URL", StringType())])
    path = fresh_path(spark, "gbk")
    sources.write_gbk_csv(table(spark, folder, "pages").select(F.col("page_id").alias("编号"), F.col("url").alias("地址URL")), path)
    listed = sources.read_gbk_csv(spark, path, schema).toDF("page_id", "url")
    numbered = numbering.number_rows(listed, "page_id", "page_id")
    return numbered.select(F.col("row_no").cast("bigint").alias("row_no"), "page_id", "url",
                           F.concat(F.lit("第"), F.col("row_no").cast("string"), F.lit("篇文章:"), F.col("url")).alias("line"))


@query("""select l_linenumber, count(*) as n, sum(l_quantity) as quantity, round(sum(l_discount), 4) as discount
from lineitem group by 1""")
def strict_numeric_scan(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("l_linenumber"), "l_quantity", "l_discount", F.lit("x").alias(" "))
    path = fresh_path(spark, "strict")
    rows.write.csv(path, header=True)
    read = sources.read_strict_numeric(spark, path, ["l_linenumber", "l_quantity", "l_discount", ""])
    return read.groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_discount"), 4).alias("discount"))


@query("""select n_name as city, count(*) as n, round(sum(o_totalprice), 2) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by 1""")
def per_city_sink_and_scan(spark, folder):
    rows = _orders_by_city(spark, folder)
    path = fresh_path(spark, "per_city")
    sources.write_per_city(rows, path)
    read = sources.read_per_city(spark, path, _schema(rows, "o_orderkey", "o_totalprice"))
    return read.groupBy("city").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""select n_name as city, o_orderkey, o_totalprice
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where n_name = 'NATION_7'""")
def per_city_pruned_scan(spark, folder):
    rows = _orders_by_city(spark, folder)
    path = fresh_path(spark, "per_city_csv")
    sources.write_per_city(rows, path, fmt="csv")
    read = sources.read_per_city(spark, path, _schema(rows, "o_orderkey", "o_totalprice"), fmt="csv")
    return read.where(F.col("city") == "NATION_7").select("city", "o_orderkey", "o_totalprice")


@query("""select source, count(*) as n from (
  select c_custkey as id, c_name as name, c_acctbal as balance, 'customer' as source from customer
  union all select s_suppkey, s_name, null, 'supplier' from supplier) group by 1""")
def merged_sink_and_scan(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.lit("customer").alias("source"))
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("source"))
    path = fresh_path(spark, "merged")
    sources.write_merged(sources.union_all_columns([customers, suppliers]), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query("select string_agg(n_name, ',' order by n_nationkey) as value from nation")
def city_name_line(spark, folder):
    path = fresh_path(spark, "names")
    sources.write_name_line(table(spark, folder, "nation"), path, "n_name", "n_nationkey")
    return spark.read.text(path)


@query("""select 'l_quantity' as "column", round(avg(l_quantity), 6) as mean from lineitem
union all select 'l_extendedprice', round(avg(l_extendedprice), 6) from lineitem
union all select 'l_discount', round(avg(l_discount), 6) from lineitem""")
def describe_table_means(spark, folder):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = profile.describe(table(spark, folder, "lineitem"), names)
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    stored = rows.unpivot("column", [F.col(s).cast("double").alias(s) for s in stats], "stat", "value").groupBy("stat").pivot(
        "column", names).agg(F.first("value"))
    path = fresh_path(spark, "describe")
    stored.write.csv(path, header=True)
    return sources.read_describe_means(spark, path, names).select("column", F.round("mean", 6).alias("mean"))


@query("""select event_type, count(*) as iterations, round(arg_min(value, event_id), 6) as first_value,
  round(arg_max(value, event_id), 6) as last_value, round(min(value), 6) as best_value,
  arg_min(event_id, struct_pack(v := value, i := event_id)) as best_iter
from events group by 1""")
def training_log_best(spark, folder):
    path = fresh_path(spark, "log")
    log = table(spark, folder, "events").select(F.col("event_id").alias("iter"), F.col("value").alias("RMSE"), "event_type")
    log.write.partitionBy("event_type").csv(path, header=True, sep="\t")
    schema = StructType([StructField("iter", LongType()), StructField("RMSE", DoubleType()), StructField("event_type", StringType())])
    found = best_iteration(sources.read_tsv_log(spark, path, schema), by=["event_type"])
    return found.select("event_type", "iterations", *[F.round(c, 6).alias(c) for c in ("first_value", "last_value", "best_value")],
                        "best_iter")


@query("""select event_id as iter, value as "RMSE", 0.5 * value as passed_time, event_type as name from events
union all select event_id + 1, value / 2, value, event_type from events""")
def json_training_log(spark, folder):
    step = F.struct(F.array("value").alias("learn"), F.col("event_id").alias("iteration"),
                    (F.col("value") * 0.5).alias("passed_time"), F.lit(0.0).alias("remaining_time"))
    following = F.struct(F.array(F.col("value") / 2).alias("learn"), (F.col("event_id") + 1).alias("iteration"),
                         F.col("value").alias("passed_time"), F.lit(0.0).alias("remaining_time"))
    logs = table(spark, folder, "events").select(
        F.struct(F.lit(2).alias("iteration_count"), F.col("event_type").alias("name")).alias("meta"),
        F.array(step, following).alias("iterations"))
    path = fresh_path(spark, "json_log")
    logs.write.json(path)
    return sources.read_json_log(spark, path, multi_line=False).select("iter", "RMSE", "passed_time", "name")


@query("""select event_id as iter, value as "RMSE", event_type as name from events
union all select event_id + 1, value / 2, event_type from events""")
def pretty_printed_training_log(spark, folder):
    """Logs that are one document over many lines each: read whole, a file being one record."""
    step = F.struct(F.array("value").alias("learn"), F.col("event_id").alias("iteration"), F.lit(0.0).alias("passed_time"), F.lit(0.0).alias("remaining_time"))
    following = F.struct(F.array(F.col("value") / 2).alias("learn"), (F.col("event_id") + 1).alias("iteration"), F.lit(0.0).alias("passed_time"),
                         F.lit(0.0).alias("remaining_time"))
    events = table(spark, folder, "events").withColumn("part", F.pmod("event_id", F.lit(8)))
    logs = events.groupBy("event_type", "part").agg(F.flatten(F.collect_list(F.array(step, following))).alias("iterations")).select(
        F.struct(F.lit(2).alias("iteration_count"), F.col("event_type").alias("name")).alias("meta"), "iterations", "event_type", "part")
    printed = logs.select(F.to_json(F.struct("meta", "iterations"), {"pretty": "true"}).alias("value"), "event_type", "part")
    path = fresh_path(spark, "pretty_log")
    printed.repartition("event_type", "part").write.partitionBy("event_type", "part").text(path)
    return sources.read_json_log(spark, f"{path}/*/*").select("iter", "RMSE", "name")


@query("""select c_custkey, c_name from customer c
where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'F' and o_orderpriority = '1-URGENT')""")
def pending_entities(spark, folder):
    stored = table(spark, folder, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"))
    return sources.pending(table(spark, folder, "customer").select("c_custkey", "c_name"), stored, ["c_custkey"])


@query("select s_nationkey, count(*) as n, round(sum(s_acctbal), 2) as balance from supplier group by 1")
def incremental_load(spark, folder):
    """The same supplier files are offered twice; the second run adds nothing."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    offered, target = fresh_path(spark, "offered"), fresh_path(spark, "stored")
    for attempt in ("first", "second"):
        suppliers.write.mode("append").parquet(offered)
        load_new_entities(spark, offered, suppliers.schema, target, "s_suppkey", fresh_path(spark, attempt))
    return read_loaded(spark, target, suppliers.schema).groupBy("s_nationkey").agg(
        F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""select o_orderkey, o_orderkey % 100 < 50 as is_new from orders where o_orderkey % 100 = 7 or (o_orderkey % 100 = 57 and o_orderkey % 1000 <> 57)""")
def orders_not_in_the_index(spark, folder):
    """Orders with an even half of the keys are stored; a batch brings new ones and a few that are there."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    index = key_index(fresh_path(spark, "index"), ["o_orderkey"], slots=64)
    stored = orders.where("o_orderkey % 100 >= 50 and (o_orderkey % 100 <> 57 or o_orderkey % 1000 = 57)")
    for batch in range(2):
        index.add(stored.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == batch), "orders", batch)
    found = index.pending(orders.where("o_orderkey % 100 in (7, 57)"))
    return found.select("o_orderkey", (F.col("o_orderkey") % 100 < 50).alias("is_new"))


# --- filters and projections ---------------------------------------------------------------------

MARKED = "case o_orderstatus when 'F' then 1 when 'O' then 0 end"


@query(f"select o_orderkey, {MARKED} as rand from orders where {MARKED} is distinct from 1")
def not_in_keeps_null(spark, folder):
    marked = table(spark, folder, "orders").select("o_orderkey", F.expr(MARKED).alias("rand"))
    return marked.where(select.not_in("rand", [1]))


@query("select doc_id, quality from labels where quality in (1)")
def membership(spark, folder):
    return table(spark, folder, "labels").where(F.col("quality").isin(1)).select("doc_id", "quality")


@query(f"select o_orderkey, {MARKED} as show_price from orders where {MARKED} is distinct from 0")
def not_equal_keeps_null(spark, folder):
    priced = table(spark, folder, "orders").select("o_orderkey", F.expr(MARKED).alias("show_price"))
    return priced.where(select.not_equal("show_price", 0))


@query("select vec_id, label from embeddings where label = 0 or label = 1")
def either_class(spark, folder):
    return table(spark, folder, "embeddings").where((F.col("label") == 0) | (F.col("label") == 1)).select("vec_id", "label")


@query("select l_quantity, l_discount, count(*) as n from lineitem group by 1, 2")
def projection_by_name(spark, folder):
    return table(spark, folder, "lineitem").select(*["l_quantity", "l_discount"]).groupBy("l_quantity", "l_discount").agg(
        F.count("*").alias("n"))


@query("select s_suppkey, s_name, s_nationkey from supplier")
def projection_all_but_last(spark, folder):
    return select.by_position(table(spark, folder, "supplier"), stop=-1)


@query("select p_name, p_brand, p_type from part")
def projection_by_position(spark, folder):
    return select.by_position(table(spark, folder, "part"), 1, 4)


@query("select p_partkey, p_name, p_brand, p_type, p_size from part")
def projection_without_target(spark, folder):
    return select.all_but(table(spark, folder, "part"), "p_retailprice")


@query("select c_custkey as id, c_name as title, c_nationkey as city, c_acctbal as t_price, c_mktsegment as kind from customer")
def rename_all_columns(spark, folder):
    return table(spark, folder, "customer").toDF("id", "title", "city", "t_price", "kind")


@query("select s_suppkey, 'national' as city from supplier")
def constant_column(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey").withColumn("city", F.lit("national"))


@query("select o_orderkey, round(o_totalprice / 10000, 6) as total_10k from orders")
def computed_column(spark, folder):
    return table(spark, folder, "orders").withColumn("total_10k", F.round(F.col("o_totalprice") / 10000, 6)).select(
        "o_orderkey", "total_10k")


@query("select cast(p_partkey as double) as p_partkey, cast(p_size as double) as p_size, p_retailprice from part")
def cast_all_to_double(spark, folder):
    text = table(spark, folder, "part").select(*[F.col(c).cast("string") for c in ("p_partkey", "p_size", "p_retailprice")])
    return select.cast_all(text)


@query("select c_custkey, cast(trunc(c_acctbal) as integer) as price from customer")
def truncate_text_to_int(spark, folder):
    text = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("price"))
    return text.select("c_custkey", select.truncate_to_int(F.col("price")).alias("price"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def preview_rows(spark, folder):
    return select.preview(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"),
                          [F.desc("o_totalprice"), "o_orderkey"])


@query(f"""with t as (select o_orderkey, o_orderstatus, {MARKED} as rand from orders)
select 0 as position, 'o_orderkey' as "column", 'bigint' as type, count(o_orderkey) as non_null from t
union all select 1, 'o_orderstatus', 'string', count(o_orderstatus) from t
union all select 2, 'rand', 'int', count(rand) from t""")
def column_info(spark, folder):
    return select.column_info(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.expr(MARKED).alias("rand")))


@query("select n_nationkey, n_name from nation where n_name <> 'NATION_1'")
def without_bad_entity(spark, folder):
    return select.without_entity(table(spark, folder, "nation").select("n_nationkey", "n_name"), "n_name", "NATION_1")


# --- joins, sorts, sets --------------------------------------------------------------------------

@query("""select o_orderkey, o_totalprice, n_name as city, r_name as region from orders
left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey""")
def city_enrichment(spark, folder):
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region"))
    named = joins.lookup_join(cities(spark, folder), region, "region_key").select("city_key", "city", "region")
    owners = joins.lookup_join(
        table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("city_key")), named, "city_key")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    return joins.lookup_join(orders, owners.drop("city_key"), "c_custkey").drop("c_custkey")


@query("""select l_suppkey, l_returnflag, l_quantity, s_name, s_acctbal from lineitem
left join supplier on l_suppkey = s_suppkey""")
def hot_key_enrichment(spark, folder):
    """The join for lookups beyond the broadcast bound, forced by a bound of two rows."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    lookup = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_acctbal")
    big = table(spark, folder, "supplier").count() - 1
    return joins.lookup_join(items, lookup, "l_suppkey", rows=big, hot_share=0.02)


@query("""with links as (
  select page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) as names,
    regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) as urls from pages)
select page_id, cast(i - 1 as integer) as pos, names[i] as name, urls[i] as url
from (select *, unnest(range(1, len(names) + 1)) as i from links)""")
def zip_names_and_addresses(spark, folder):
    lists = table(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1)).alias("names"),
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)">[^<]*</a>'), F.lit(1)).alias("urls"))
    return joins.zip_lists(lists, "names", "urls", ("name", "url"), ["page_id"])


@query("""select 'l_discount' as "column", round(avg(l_discount), 6) as mean from lineitem
union all select 'l_tax', round(avg(l_tax), 6) from lineitem""")
def zip_header_and_values(spark, folder):
    names = ["l_discount", "l_tax"]
    row = table(spark, folder, "lineitem").agg(F.array(*[F.round(F.avg(n), 6) for n in names]).alias("mean_row"))
    headers = F.array(*[F.lit(n) for n in names])
    return row.select(F.explode(joins.zip_to_map(headers, F.col("mean_row"))).alias("column", "mean"))


@query("""select n_name as city, count(c_name) as listings from customer join nation on c_nationkey = n_nationkey
group by 1 order by 2 desc, 1""")
def city_listing_count(spark, folder):
    counted = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("city_key")).agg(
        F.count("c_name").alias("listings"))
    return joins.lookup_join(counted, cities(spark, folder), "city_key", "inner").select("city", "listings").orderBy(
        F.desc("listings"), "city")


@query("""select p_brand, p_type, round(avg(p_retailprice), 4) as score from part group by 1, 2
order by 3 desc, 1, 2 limit 1""")
def best_of_grid(spark, folder):
    cells = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("score"))
    placed = cells.withColumn("position", F.struct("p_brand", "p_type"))
    return profile.first_maximum(placed, "score", "position").drop("position")


@query("""select c_custkey as id, c_name as name, c_acctbal as balance, cast(null as varchar) as mark from customer
union all select s_suppkey, s_name, null, 'supplier' from supplier""")
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, folder, "supplier").select(
        F.lit("supplier").alias("mark"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return sources.union_all_columns([customers, suppliers])


@query("""select value, count(*) as n from (select c_nationkey as value from customer union all select s_nationkey from supplier)
group by 1""")
def bag_concatenation(spark, folder):
    left = table(spark, folder, "customer").select(F.col("c_nationkey").alias("value"))
    right = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("value"))
    return left.unionAll(right).groupBy("value").agg(F.count("*").alias("n"))


@query("""with pages_per as (select n_name, 'https://' || lower(n_name) || '.example/ershoufang/' as base,
  cast(ceil(count(*) / 10.0) as integer) as pages from customer join nation on c_nationkey = n_nationkey group by 1)
select n_name as city, page, base || 'pg' || page || '/' as page_url
from (select *, unnest(range(1, pages + 1)) as page from pages_per)""")
def page_addresses(spark, folder):
    counted = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("city_key")).agg(F.count("*").alias("n"))
    named = joins.lookup_join(counted, cities(spark, folder), "city_key", "inner")
    sized = named.select("city", F.concat(F.lit("https://"), F.lower("city"), F.lit(".example/ershoufang/")).alias("base"),
                         F.ceil(F.col("n") / 10).cast("int").alias("pages"))
    return page_urls(sized, "base", "pages").select("city", F.col("page").cast("bigint").alias("page"), "page_url")


# --- positions -----------------------------------------------------------------------------------

@query("""select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as row_no from orders""")
def running_numbers(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    rows = orders.count()
    numbered = numbering.number_rows(orders, "o_totalprice", "o_orderkey", rows_per_range=max(rows // 16, 1))
    return numbered.select("o_orderkey", F.col("row_no").cast("bigint").alias("row_no"))


@query("""select o_orderstatus, o_orderkey, row_number() over (order by case o_orderstatus when 'F' then 1 else 0 end, o_orderkey)
as row_no from orders""")
def running_numbers_with_ties(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderstatus", "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("grade"))
    rows = orders.count()
    numbered = numbering.number_rows(orders, "grade", "o_orderkey", rows_per_range=max(rows // 16, 1))
    return numbered.select("o_orderstatus", "o_orderkey", F.col("row_no").cast("bigint").alias("row_no"))


@query("select o_orderkey, cast(ntile(7) over (order by o_orderkey) - 1 as integer) as fold from orders")
def contiguous_folds(spark, folder):
    return numbering.contiguous_folds(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 7)


HASH = "cast(('0x' || substr(md5(cast(o_orderkey as varchar) || ':{seed}'), 1, 13)) as bigint)"


@query(f"select cast({HASH.format(seed=3)} % 5 as integer) as fold, count(*) as n from orders group by 1")
def hashed_folds(spark, folder):
    return numbering.hashed_folds(table(spark, folder, "orders"), "o_orderkey", 5, seed=3).groupBy("fold").agg(
        F.count("*").alias("n"))


@query("""with r as (select l_extendedprice as v, row_number() over (order by l_extendedprice) - 1 as k from lineitem),
n as (select count(*) as n from lineitem)
select k as "rank", v as value from r, n where k in (0, n // 3, n // 2, n - 1)""")
def order_statistics(spark, folder):
    items = table(spark, folder, "lineitem").select("l_extendedprice")
    n = items.count()
    ranks = sorted({0, n // 3, n // 2, n - 1})
    found = orderstats.order_statistics(items, {"l_extendedprice": ranks})
    return spark.createDataFrame([(r, float(found[("l_extendedprice", r)])) for r in ranks], "rank bigint, value double")
