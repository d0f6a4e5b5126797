"""Queries for group figures, descriptive statistics, correlations, distributions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthlens.functions.numeric import linspace, normal_density
from hearthlens.operators import evaluate, features, numbering, profile
from hearthlens.operators.clean import duplicate_count
from hearthlens.operators.joins import lookup_join
from hearthlens.operators.orderstats import exact_quantiles
from hearthlens.plans import listings, reports
from hearthlens.plans.listings import LISTING_SQL, MACRO_SQL
from hearthlens.plans.registry import query, table
from hearthlens.schemas import TAGS
from hearthlens.session import fresh_path

CITY_ORDERS = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
# every fifth price band is shown as zero, so that zeros have to be left out
SHOWN = "case when o_orderpriority = '5-LOW' then 0 when o_orderstatus = 'P' then null else o_totalprice end"


def city_prices(spark: SparkSession, folder: str) -> DataFrame:
    """(city, count and sum of the shown prices other than zero), summed per customer before any join."""
    orders = table(spark, folder, "orders").select("o_custkey", F.expr(SHOWN).alias("show_price"))
    per_owner = orders.where(~F.col("show_price").eqNullSafe(0.0)).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("show_price").alias("total"), F.count("show_price").alias("n"))
    owners = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("city_key"))
    per_city = per_owner.join(owners, "c_custkey").groupBy("city_key").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return lookup_join(per_city, listings.cities(spark, folder), "city_key", "inner")


@query(f"""select n_name as city, round(avg({SHOWN}), 4) as mean_price from {CITY_ORDERS}
where {SHOWN} is distinct from 0 group by 1 order by 2 desc nulls last, 1""")
def city_mean_price(spark, folder):
    """The same figure as group_means(city), with the sums taken before the joins."""
    mean = F.round(F.try_divide("total", "n"), 4)
    return city_prices(spark, folder).select("city", mean.alias("mean_price")).orderBy(F.desc_nulls_last("mean_price"), "city")


@query("""select p_brand as city, round(avg(price), 4) as mean_price from
(select p_brand, case when p_type = 'PROMO' then 0 else p_retailprice end as price from part)
where price is distinct from 0 group by 1 order by 2 desc nulls last, 1""")
def group_means(spark, folder):
    parts = table(spark, folder, "part").select(
        F.col("p_brand").alias("city"), F.when(F.col("p_type") == "PROMO", 0.0).otherwise(F.col("p_retailprice")).alias("price"))
    return profile.group_means(parts, "city", "price", "mean_price").select("city", F.round("mean_price", 4).alias("mean_price"))


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(
    f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c}) as min,
round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75,
max({c}) as max from lineitem""" for c in DESCRIBED))
def describe(spark, folder):
    rows = profile.describe(table(spark, folder, "lineitem"), DESCRIBED)
    return rows.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                       *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


MOMENTS = "coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)"


@query(" union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round({MOMENTS.format(a=a, b=b)}, 6) + 0.0 as r from lineitem"
    for a in DESCRIBED for b in DESCRIBED))
def correlation_matrix(spark, folder):
    return profile.correlation_matrix(table(spark, folder, "lineitem"), DESCRIBED).select("col_a", "col_b", F.round("r", 6).alias("r"))


WIDE = ["room", "hall", "area", "orientation", "furnishment", "level", "height", "architecture", "follower", "span", "t_price"]


@query(f"with {LISTING_SQL} select * from (" + " union all ".join(
    f"""select '{a}' as col_a, '{b}' as col_b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) + 0.0 as r
from listing where {a} is not null and {b} is not null""" for a in WIDE for b in WIDE) + ")")
def wide_correlation_matrix(spark, folder):
    path = fresh_path(spark, "encoded")
    listings.encoded(listings.parsed(listings.listing_raw(spark, folder))).select(*WIDE).write.parquet(path)
    rows = spark.read.parquet(path)
    return profile.correlation_matrix(rows, WIDE).select("col_a", "col_b", F.round("r", 6).alias("r"))


@query("select * from (" + " union all ".join(
    f"select '{c}' as feature, round({MOMENTS.format(a=c, b='l_extendedprice')}, 6) + 0.0 as r from lineitem"
    for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"]) + ") order by r desc, feature")
def target_correlations(spark, folder):
    found = profile.target_correlations(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
                                        "l_extendedprice")
    return found.select("feature", F.round("r", 6).alias("r")).orderBy(F.desc("r"), "feature")


FEATURES = ["room", "hall", "area", "orientation", "furnishment", "level", "height", "architecture", "follower", "span"] + TAGS


@query(f"with {LISTING_SQL} select feature, round(abs_r, 6) as abs_r from (" + " union all ".join(
    f"select '{c}' as feature, abs({MOMENTS.format(a=c, b='t_price')}) as abs_r from cleaned" for c in FEATURES)
    + ") order by abs_r desc, feature limit 10")
def top_correlations(spark, folder):
    rows = listings.listing_features(spark, folder)
    return profile.top_correlations(rows, FEATURES, "t_price").select("feature", F.round("abs_r", 6).alias("abs_r"))


@query("select round(coalesce(quantile_cont(o_totalprice, 0.99), 0), 6) as p99 from orders")
def price_percentile(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice")
    value = exact_quantiles(orders, {"o_totalprice": [0.99]}, direct_values=0)["o_totalprice"][0]
    return spark.createDataFrame([(round(value, 6),)], "p99 double")


BINS = """bins as (select unnest(range(0, {n})) as bin)"""


@query(f"""with {BINS.format(n=20)}, found as (
  select cast(case when l_extendedprice >= 90000 then 19 else least(floor((l_extendedprice - 20000) / (70000 / 20.0::double)), 19) end as integer) as bin,
    count(*) as n from lineitem where l_extendedprice >= 20000 group by 1)
select cast(b.bin as integer) as bin, coalesce(f.n, 0) as n from bins b left join found f on f.bin = b.bin""")
def price_histogram(spark, folder):
    return profile.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 20, 20000.0, 90000.0)


SPLIT = "case when cast(('0x' || substr(md5(cast({key} as varchar) || ':{seed}'), 1, 13)) as bigint) % 1000000 < {cut} then 'test' else 'train' end"
ORDER_SPLIT = SPLIT.format(key="o_orderkey", seed=43, cut=200000)


@query(f"""with s as (select o_totalprice as v, {ORDER_SPLIT} as split from orders),
cap as (select greatest(quantile_cont(v, 0.99), 100) as cap from s), {BINS.format(n=42)},
found as (select split, cast(case when v >= cap then 41 else least(floor(v / (cap / 42)), 41) end as integer) as bin, count(*) as n
  from s, cap where v >= 0 group by 1, 2)
select p.split, cast(b.bin as integer) as bin, round(b.bin * (select cap / 42 from cap), 4) as lower, coalesce(f.n, 0) as n
from (select distinct split from s) p cross join bins b left join found f on f.split = p.split and f.bin = b.bin""")
def capped_target_histograms(spark, folder):
    split = features.hash_split(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.2, seed=43)
    return profile.capped_histograms(split, "o_totalprice", "split").select(
        "split", "bin", F.round("lower", 4).alias("lower"), "n")


@query(f"""with s as (select min(p_retailprice) as lo, max(p_retailprice) as hi, count(*) as n from part), {BINS.format(n=30)},
found as (select cast(least(floor((p_retailprice - lo) / ((hi - lo) / 30)), 29) as integer) as bin, count(*) as c from part, s group by 1)
select cast(b.bin as integer) as bin, round(lo + b.bin * ((hi - lo) / 30), 6) as lower,
  round(coalesce(c, 0) / (n * ((hi - lo) / 30)), 9) as density
from bins b cross join s left join found f on f.bin = b.bin""")
def density_histogram(spark, folder):
    return profile.density_histogram(table(spark, folder, "part"), "p_retailprice").select(
        "bin", F.round("lower", 6).alias("lower"), F.round("density", 9).alias("density"))


@query("""with s as (select stddev_samp(o_totalprice) * pow(count(*), -0.2) as h, min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
g as (select i as point, lo - 3 * h + (hi - lo + 6 * h) * i / 49 as x, h from s, (select unnest(range(0, 50)) as i))
select cast(point as integer) as point, round(x, 4) as x,
  round(1e6 * avg(exp(-pow((x - o_totalprice) / h, 2) / 2)) / (any_value(h) * sqrt(2 * pi())), 6) as density_per_million
from g, orders group by point, x""")
def kernel_density(spark, folder):
    return profile.kernel_density(table(spark, folder, "orders"), "o_totalprice").select(
        "point", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_per_million"))


@query("select round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std from lineitem")
def population_stats(spark, folder):
    return profile.population_stats(table(spark, folder, "lineitem"), "l_quantity").select(
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""with s as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as sd, min(p_retailprice) as lo, max(p_retailprice) as hi from part)
select cast(i as integer) as i, round(lo + (hi - lo) * i / 199, 6) as x,
  round(1 / (sd * sqrt(2 * pi())) * exp(-pow(lo + (hi - lo) * i / 199 - m, 2) / (2 * sd * sd)), 9) as density
from s, (select unnest(range(0, 200)) as i)""")
def normal_curve(spark, folder):
    s = table(spark, folder, "part").agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("sd"),
                                         F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    grid = s.select("m", "sd", F.posexplode(linspace(F.col("lo"), F.col("hi"), 200)).alias("i", "x"))
    return grid.select("i", F.round("x", 6).alias("x"), F.round(normal_density(F.col("x"), F.col("m"), F.col("sd")), 9).alias("density"))


@query(f"select {ORDER_SPLIT} as split, count(*) as rows from orders group by 1")
def split_sizes(spark, folder):
    return profile.split_sizes(features.hash_split(table(spark, folder, "orders"), "o_orderkey", 0.2, seed=43))


@query("""select max(l_quantity) as max_l_quantity, max(l_tax) as max_l_tax, greatest(max(l_quantity), max(l_tax)) as max_all from lineitem""")
def joint_maximum(spark, folder):
    return profile.joint_maximum(table(spark, folder, "lineitem"), "l_quantity", "l_tax")


@query(f"with {LISTING_SQL} " + " union all ".join(f"select '{t}' as tag, round(avg({t}) * 100, 6) as rate from cleaned" for t in TAGS)
       + " union all select 'metro' as tag, 0.0::double as rate")
def tag_rates(spark, folder):
    rows = listings.listing_features(spark, folder)
    return profile.tag_rates(rows, TAGS + ["metro"]).select("tag", F.round("rate", 6).alias("rate"))


@query("""with c as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)
select cast(sum(n) as bigint) as total_rows, count(*) as distinct_rows, cast(sum(n) - count(*) as bigint) as duplicate_rows from c""")
def duplicate_audit(spark, folder):
    return duplicate_count(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- report data ---------------------------------------------------------------------------------

@query(f"""select n_name as city, count(o_orderkey) as listings from {CITY_ORDERS} group by 1 order by 2 desc, 1""")
def report_city_counts(spark, folder):
    return reports.city_counts(listings.listing_raw(spark, folder).select("id", "city"), "id")


@query(f"""with {LISTING_SQL} select city, round(avg(u_price), 4) as mean_unit_price from listing where u_price is distinct from 0
group by 1 order by 2 desc nulls last, 1""")
def report_city_unit_price(spark, folder):
    rows = listings.parsed(listings.listing_raw(spark, folder))
    return reports.city_unit_price(rows, "u_price").select("city", F.round("mean_unit_price", 4).alias("mean_unit_price"))


@query(f"""with {LISTING_SQL} select city, round(avg(t_price), 4) as mean_total_price from listing where t_price is distinct from 0
group by 1 order by 2 desc nulls last, 1""")
def report_city_total_price(spark, folder):
    rows = listings.parsed(listings.listing_raw(spark, folder))
    return reports.city_total_price(rows, "t_price").select("city", F.round("mean_total_price", 4).alias("mean_total_price"))


LISTING_SPLIT = SPLIT.format(key="id", seed=0, cut=300000)


@query(f"""with {LISTING_SQL} select {LISTING_SPLIT} as split, count(*) as rows from cleaned group by 1""")
def report_split_sizes(spark, folder):
    return profile.split_sizes(reports.split_listings(listings.listing_features(spark, folder)))


@query(f"""with {LISTING_SQL}, s as (select t_price as v, {LISTING_SPLIT} as split from cleaned),
cap as (select greatest(quantile_cont(v, 0.99), 100) as cap from s), {BINS.format(n=42)},
found as (select split, cast(case when v >= cap then 41 else least(floor(v / (cap / 42)), 41) end as integer) as bin, count(*) as n
  from s, cap where v >= 0 group by 1, 2)
select p.split, cast(b.bin as integer) as bin, round(b.bin * (select cap / 42 from cap), 4) as lower, coalesce(f.n, 0) as n
from (select distinct split from s) p cross join bins b left join found f on f.split = p.split and f.bin = b.bin""")
def report_target_histograms(spark, folder):
    rows = reports.split_listings(listings.stored_features(spark, folder))
    return reports.target_histograms(rows).select("split", "bin", F.round("lower", 4).alias("lower"), "n")


@query(f"with {LISTING_SQL} select feature, round(abs_r, 6) as abs_r, printf('%.3f', abs_r) as shown from (" + " union all ".join(
    f"select '{c}' as feature, abs({MOMENTS.format(a=c, b='t_price')}) as abs_r from cleaned where {LISTING_SPLIT} = 'train'"
    for c in FEATURES) + ") order by 2 desc, feature limit 10")
def report_top_correlations(spark, folder):
    rows = reports.split_listings(listings.listing_features(spark, folder))
    return reports.top_correlations(rows, FEATURES).select("feature", F.round("abs_r", 6).alias("abs_r"), "shown")


@query(f"with {LISTING_SQL} " + " union all ".join(
    f"select '{t}' as tag, round(avg({t}) * 100, 6) as rate, printf('%.1f', avg({t}) * 100) as shown from cleaned" for t in TAGS))
def report_tag_rates(spark, folder):
    return reports.tag_rates(listings.listing_features(spark, folder)).select("tag", F.round("rate", 6).alias("rate"), "shown")


HEAT = FEATURES + ["gdp", "region", "green_rate", "c_population", "c_area", "c_water_resources", "t_price"]


@query(f"with {LISTING_SQL}, {MACRO_SQL}, f as (select * from cleaned join macro using (city)) select * from (" + " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 5) + 0.0 as r from f"
    for a in HEAT for b in HEAT) + ")")
def report_heat_map(spark, folder):
    rows = listings.stored_features(spark, folder)
    return profile.correlation_matrix(rows, HEAT).select("col_a", "col_b", F.round("r", 5).alias("r"))


@query("""select case quality when 1 then 'Positive' else 'Negative' end as class, round(ln(n_chars), 9) as "X1", toxic as "X2"
from labels join documents using (doc_id)""")
def report_class_points(spark, folder):
    points = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.round(F.log("n_chars"), 9).alias("X1"), F.col("toxic").alias("X2"), F.col("quality").alias("y"))
    return reports.class_points(points)


# --- measures of fixed predictors ----------------------------------------------------------------

METRICS = """round(avg(pow(y - p, 2)), 4) as mse, round(avg(pow(y - p, 2)) / 10000, 6) as mse_10k, round(sqrt(avg(pow(y - p, 2))), 6) as rmse,
round(avg(abs(y - p)), 6) as mae, round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) + 0.0 as r2,
round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) * 100, 4) as mape,
round(1 - var_pop(y - p) / var_pop(y), 6) + 0.0 as explained_variance"""
METRIC_DIGITS = {"mse": 4, "mse_10k": 6, "rmse": 6, "mae": 6, "r2": 6, "mape": 4, "explained_variance": 6}


@query(f"with s as (select l_returnflag, l_extendedprice as y, l_quantity * 2000 as p from lineitem) select l_returnflag, {METRICS} from s group by 1")
def regression_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction"))
    found = evaluate.regression_metrics(rows, by=["l_returnflag"])
    return found.select("l_returnflag", *[F.round(c, d).alias(c) for c, d in METRIC_DIGITS.items()])


@query("""select l_returnflag, round(avg(cast(cast(l_discount >= 0.05 as integer) = cast(l_linestatus = 'F' as integer) as double)), 9) as accuracy
from lineitem group by 1""")
def accuracy(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("label"), (F.col("l_discount") >= 0.05).cast("int").alias("prediction"))
    return rows.groupBy("l_returnflag").agg(F.round(evaluate.accuracy(), 9).alias("accuracy"))


@query(f"""with {LISTING_SQL}, g as (select regr_slope(t_price, area) as a, regr_intercept(t_price, area) as b, avg(t_price) as m from cleaned),
s as (select t_price as y, m as p, 'mean' as model from cleaned, g
  union all select t_price, area * a + b, 'line' from cleaned, g union all select t_price, area * 4, 'rule' from cleaned)
select model, rmse, mape, explained_variance from (select model, {METRICS} from s where y > 0 group by 1)""")
def model_comparison(spark, folder):
    rows = listings.stored_features(spark, folder).select(F.col("t_price").alias("label"), F.col("area"))
    fit = rows.agg(F.regr_slope("label", "area").alias("a"), F.regr_intercept("label", "area").alias("b"), F.avg("label").alias("m")).first()
    scored = rows.where("label > 0").select("label", F.lit(fit["m"]).alias("mean"), (F.col("area") * fit["a"] + fit["b"]).alias("line"),
                                            (F.col("area") * 4).alias("rule"))
    found = evaluate.compare_columns(scored, {"mean": "mean", "line": "line", "rule": "rule"})
    return found.select("model", *[F.round(c, METRIC_DIGITS[c]).alias(c) for c in ("rmse", "mape", "explained_variance")])


@query("""with r as (select p_brand as feature, round(avg(p_retailprice), 4) as importance from part group by 1)
select feature, importance, row_number() over (order by importance desc, feature) as rank from r""")
def importance_rank(spark, folder):
    """Ranks named scores; brands stand for features, so the table stays as small as one."""
    scores = table(spark, folder, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("importance"))
    return numbering.rank_small(scores, "importance", "feature").withColumn("rank", F.col("rank").cast("bigint"))
