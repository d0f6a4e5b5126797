"""Queries for scaling, splitting, selection, reduction and kernels."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hearthlens.functions.numeric import clamp, gaussian_kernel
from hearthlens.operators import features, models, profile, select
from hearthlens.plans.registry import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("with s as (select " + ", ".join(f"min({c}) as a_{c}, max({c}) - min({c}) as w_{c}" for c in NUMBERS) + " from lineitem) select "
       + ", ".join(KEYS) + ", " + ", ".join(f"round(({c} - a_{c}) / w_{c}, 6) + 0.0 as {c}" for c in NUMBERS) + " from lineitem, s")
def min_max_scaled(spark, folder):
    rows = table(spark, folder, "lineitem").select(*KEYS, *NUMBERS)
    scaled = features.fit_min_max(rows, NUMBERS).apply(rows)
    return scaled.select(*KEYS, *[F.round(c, 6).alias(c) for c in NUMBERS])


ORDER_TEST = "cast(('0x' || substr(md5(cast(o_orderkey as varchar) || ':0'), 1, 13)) as bigint) % 1000000 < 200000"


@query(f"""with t as (select *, {ORDER_TEST} as test from orders),
s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as sd from t where not test)
select o_orderkey, case when test then 'test' else 'train' end as split, round((o_totalprice - m) / sd, 6) + 0.0 as scaled from t, s""")
def standard_scaled_by_train(spark, folder):
    rows = features.hash_split(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.2)
    scaling = features.fit_standard(rows.where("split = 'train'"), ["o_totalprice"])
    return scaling.apply(rows).select("o_orderkey", "split", F.round("o_totalprice", 6).alias("scaled"))


@query(f"select o_orderkey, case when {ORDER_TEST} then 'test' else 'train' end as split from orders")
def hash_split(spark, folder):
    return features.hash_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("""with h as (select o_orderkey, row_number() over (order by cast(('0x' || substr(md5(cast(o_orderkey as varchar) || ':42'), 1, 13)) as bigint), o_orderkey) as k,
  count(*) over () as n from orders)
select o_orderkey, case when k <= ceil(round(0.3 * n, 9)) then 'test' else 'train' end as split from h""")
def exact_split(spark, folder):
    return features.exact_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 0.3, seed=42)


CHI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _chi_sql(features_: list[str]) -> str:
    return "with o as (select l_returnflag, count(*) as n, " + ", ".join(f"sum({c}) as {c}" for c in features_) + """ from lineitem group by 1),
t as (select sum(n) as n, """ + ", ".join(f"sum({c}) as {c}" for c in features_) + " from o) " + " union all ".join(
        f"select '{c}' as feature, round(sum(pow(o.{c} - o.n / t.n * t.{c}, 2) / (o.n / t.n * t.{c})), 4) as score from o, t" for c in features_)


@query(_chi_sql(CHI))
def chi2_scores(spark, folder):
    return features.chi2_scores(table(spark, folder, "lineitem"), "l_returnflag", CHI).select("feature", F.round("score", 4).alias("score"))


@query(f"with scores as ({_chi_sql(CHI)}) select feature from scores order by score desc, feature limit 2")
def best_two_features(spark, folder):
    best = features.select_k_best(table(spark, folder, "lineitem"), "l_returnflag", CHI, 2)
    return spark.createDataFrame([(name,) for name in best], "feature string")


@query("""select p_partkey, case when p_type = 'PROMO' then 10.0::double else 1.0::double end as weight from part""")
def class_weights(spark, folder):
    return table(spark, folder, "part").select("p_partkey", features.class_weights("p_type", {"PROMO": 10}).alias("weight"))


@query("""with flat as (select vec_id, label, unnest(embedding) as x, unnest(range(1, 65)) as i from embeddings),
center as (select i, avg(x::double) as m from flat where label = 0 group by i)
select vec_id, round(exp(-sum(pow(x::double - m, 2)) / 2), 6) as k from flat join center using (i) group by vec_id""")
def gaussian_kernel_to_centroid(spark, folder):
    vectors = table(spark, folder, "embeddings")
    means = vectors.where("label = 0").agg(*[F.avg(F.get("embedding", F.lit(i))).alias(f"m{i}") for i in range(64)]).first()
    center = F.array(*[F.lit(float(m)) for m in means])
    return vectors.select("vec_id", F.round(gaussian_kernel(F.col("embedding"), center, 1.0), 6).alias("k"))


@query("""select c_custkey, floor(sqrt(abs(c_acctbal))) as low, ceil(sqrt(abs(c_acctbal))) as high, round(c_acctbal / 7, 2) as rounded,
  round(pow(c_acctbal / 1000, 2), 6) as squared, round(exp(c_acctbal / 10000), 6) as grown, greatest(least(c_acctbal, 5000), 0) as clamped
from customer""")
def math_functions(spark, folder):
    b = F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        "c_custkey", F.floor(F.sqrt(F.abs(b))).cast("double").alias("low"), F.ceil(F.sqrt(F.abs(b))).cast("double").alias("high"),
        F.round(b / 7, 2).alias("rounded"), F.round(F.pow(b / 1000, F.lit(2.0)), 6).alias("squared"),
        F.round(F.exp(b / 10000), 6).alias("grown"), clamp(b, 0.0, 5000.0).alias("clamped"))


@query("""select p_partkey, p_retailprice as label, cast(p_size as double) as first_value, cast(p_partkey % 7 as double) as second_value from part""")
def feature_matrix(spark, folder):
    parts = table(spark, folder, "part").withColumn("rest", F.col("p_partkey") % 7)
    rows = models.training_frame(parts, ["p_size", "rest"], "p_retailprice", ["p_partkey"])
    x = vector_to_array("features")
    return rows.select("p_partkey", "label", F.get(x, F.lit(0)).alias("first_value"), F.get(x, F.lit(1)).alias("second_value"))


@query("select round(" + " + ".join(f"sum(({c} - m{i}) * ({c} - m{i})) / any_value(d{i} * d{i})" for i, c in enumerate(CHI)) + ", 3) as total from lineitem, (select "
       + ", ".join(f"avg({c}) as m{i}, stddev_pop({c}) as d{i}" for i, c in enumerate(CHI)) + " from lineitem)")
def pca_total_variance(spark, folder):
    """All components together hold the squared deviations of all standardised columns."""
    rows = table(spark, folder, "lineitem")
    scaling, model = features.fit_pca(rows, CHI)
    parts = vector_to_array("components")
    length = F.aggregate(parts, F.lit(0.0), lambda total, c: total + c * c)
    return model.transform(scaling.apply(rows)).agg(F.round(F.sum(length), 3).alias("total"))


@query("""with s as (select (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as a,
  (l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over () as b from lineitem),
c as (select avg(a * b) as r from s)
select 'pc1' as component, round((1 + abs(r)) / 2, 6) as share from c union all select 'pc2', round((1 - abs(r)) / 2, 6) from c""")
def pca_two_columns(spark, folder):
    """Two standardised columns have components of variance 1 + |r| and 1 - |r|."""
    rows = table(spark, folder, "lineitem")
    _, model = features.fit_pca(rows, ["l_quantity", "l_extendedprice"])
    return features.explained_variance(rows, model).select("component", F.round("share", 6).alias("share"))


@query("""with s as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as a,
  (l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over () as b from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, round((a * a + b * b), 4) as length from s""")
def pca_keeps_lengths(spark, folder):
    """All components together are a rotation: each row keeps its squared length."""
    names = ["l_quantity", "l_extendedprice"]
    rows = table(spark, folder, "lineitem").select(*KEYS, *names)
    scaling, model = features.fit_pca(rows, names)
    parts = vector_to_array("components")
    length = F.aggregate(parts, F.lit(0.0), lambda total, c: total + c * c)
    return model.transform(scaling.apply(rows)).select(*KEYS, F.round(length, 4).alias("length"))


@query("""select p_brand, case when p_retailprice > q3 then 3 when p_retailprice > q2 then 2 when p_retailprice > q1 then 1 else 0 end as price_class,
  count(*) as n from part, (select quantile_disc(p_retailprice, 0.25) as q1, quantile_disc(p_retailprice, 0.5) as q2,
  quantile_disc(p_retailprice, 0.75) as q3 from part) group by 1, 2""")
def price_classes(spark, folder):
    return features.price_classes(table(spark, folder, "part"), "p_retailprice", 4, "price_class").groupBy("p_brand", "price_class").agg(
        F.count("*").alias("n"))


SPREAD = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("with s as (" + " union all ".join(
    f"select '{c}' as feature, abs(corr({c}, l_extendedprice)) as a, count({c}) as n, sum({c}) as total from lineitem" for c in SPREAD)
    + ") select feature, n, round(total, 2) as total from s where a / (select sum(a) from s) > 0.15")
def projection_by_importance(spark, folder):
    """Keeps the columns whose share of all absolute correlations with the price is above the threshold."""
    rows = table(spark, folder, "lineitem")
    found = {r["feature"]: r["abs_r"] for r in profile.target_correlations(rows, SPREAD, "l_extendedprice").collect()}
    kept = select.important(SPREAD, [found[c] / sum(found.values()) for c in SPREAD])
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in kept]).unpivot([], kept, "feature", "value")
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))
