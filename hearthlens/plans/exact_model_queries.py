"""Models in settings whose answer SQL can give: trees of one split on columns of few values, lines on one
feature, and machines on classes that a margin separates. Each compares predictions row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthlens.operators import evaluate, features, joins, models, numbering, select, svm
from hearthlens.operators.profile import first_maximum
from hearthlens.plans import listings, reports
from hearthlens.plans.listings import LISTING_SQL
from hearthlens.plans.model_queries import CURVE_BUCKET, CURVE_SPLIT, modelling_rows, parts
from hearthlens.plans.registry import query, table
from hearthlens.schemas import NEWHOUSE_FEATURE_TABLE, NEWHOUSE_FEATURES, NEWHOUSE_MARKER, NEWHOUSE_TARGET, strings
from hearthlens.session import fresh_path
from hearthlens.sources import json_items, read_csv_named, read_per_city, write_merged, write_per_city

FEW = ["hall", "room", "orientation", "furnishment", "level", "height"]
ROWS = f"{LISTING_SQL}, s as (select *, {CURVE_SPLIT} as test from cleaned), train as (select * from s where not test)"


def split_sql(name: str, source: str, columns: Sequence[str], label: str, gain: str) -> str:
    """The best split x <= cut of one tree node: column number ``f``, cut, and the mean label of both sides."""
    long = " union all ".join(f"select {i} as f, cast({c} as double) as v, cast({label} as double) as y from {source}" for i, c in enumerate(columns))
    return f"""{name}_g as (select f, v, cast(count(*) as double) as n, sum(y) as s from ({long}) group by 1, 2),
{name}_c as (select f, v, sum(n) over w as nl, sum(s) over w as sl, sum(n) over p as nt, sum(s) over p as st
  from {name}_g window w as (partition by f order by v), p as (partition by f)),
{name} as (select f, v as cut, sl / nl as low, (st - sl) / (nt - nl) as high from {name}_c where nl < nt
  order by {gain} desc, f, v limit 1)"""


def side_sql(name: str, columns: Sequence[str]) -> str:
    value = " ".join(f"when {i} then cast({c} as double)" for i, c in enumerate(columns))
    return f"case when case {name}.f {value} end <= {name}.cut then {name}.low else {name}.high end"


VARIANCE = "sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)"
GINI = "(sl * sl + (nl - sl) * (nl - sl)) / nl + ((st - sl) * (st - sl) + (nt - nl - st + sl) * (nt - nl - st + sl)) / (nt - nl)"
BEST = split_sql("best", "train", FEW, "t_price", VARIANCE)


def _one_split(**params):
    """Five equal trees of one split: no sample is drawn."""
    return models.random_forest(trees=5, depth=1, bootstrap=False, **params)


# --- forests -------------------------------------------------------------------------------------

@query(f"with {ROWS}, {BEST} select id, round({side_sql('best', FEW)}, 4) as prediction from s, best where test")
def forest_of_one_split(spark, folder):
    train, test = parts(modelling_rows(spark, folder, FEW))
    return models.fit_cached(_one_split(), train).transform(test).select("id", F.round("prediction", 4).alias("prediction"))


@query(f"""with {ROWS}, {BEST}, i as (select unnest({FEW}) as feature, unnest({list(range(len(FEW)))}) as number)
select feature, cast(number = f as integer)::double as importance, row_number() over (order by number = f desc, feature) as rank from i, best""")
def forest_of_one_split_importance(spark, folder):
    train, _ = parts(modelling_rows(spark, folder, FEW))
    found = evaluate.importances(train, FEW, models.fit_cached(_one_split(), train))
    return reports.importance_bars(found).withColumn("rank", F.col("rank").cast("bigint"))


COMPONENTS = ["(hall - mh) / sh + (room - mr) / sr", "(hall - mh) / sh - (room - mr) / sr"]


@query(f"""with {ROWS}, m as (select avg(hall) as mh, stddev_pop(hall) as sh, avg(room) as mr, stddev_pop(room) as sr from train),
u as (select id, t_price, test, {COMPONENTS[0]} as u0, {COMPONENTS[1]} as u1 from s, m), t as (select * from u where not test),
{split_sql("best", "t", ["u0", "u1"], "t_price", VARIANCE)}
select id, round({side_sql('best', ["u0", "u1"])}, 4) as prediction from u, best where test""")
def component_forest_of_one_split(spark, folder):
    """Two standardised columns have their sum and difference as components."""
    rows = listings.listing_features(spark, folder).select("id", F.col("hall").cast("double"), F.col("room").cast("double"), "t_price")
    path = fresh_path(spark, "components")
    rows.dropna().write.parquet(path)  # standardising, components, forest and scores each read the rows again
    train, test = parts(features.hash_split(spark.read.parquet(path), "id", 0.2, seed=42))
    score, _ = models.scaled_pca_forest(train, ["hall", "room"], "t_price", _one_split(maxBins=64))
    return score(test).select("id", F.round("prediction", 4).alias("prediction"))


CLASSES = f"""with {ROWS}, c as (select quantile_disc(t_price, 0.5) as q from train), k as (select s.*, cast(t_price > q as integer) as k from s, c),
kt as (select * from k where not test), {split_sql("best", "kt", FEW, "k", GINI)}"""


@query(f"""{CLASSES}, p as (select id, k, {side_sql('best', FEW)} as p1, ({FEW})[f + 1] as important from k, best where test)
select id, k::double as label, cast(p1 > 0.5 as integer)::double as prediction, round(1 - p1, 6) as probability_0, important from p""")
def forest_classes_of_one_split(spark, folder):
    """Two price classes cut by the training rows, with the probability of the lower one."""
    train, test = parts(modelling_rows(spark, folder, FEW))
    known = features.price_class("label", features.price_cuts(train, "label", 2)).cast("double")
    train, test = train.withColumn("label", known), test.withColumn("label", known)
    forest = models.forest_classifier(trees=5, depth=1, bootstrap=False, featureSubsetStrategy="all")
    model = models.fit_cached(forest, train)
    chosen = select.important(FEW, model.featureImportances.toArray())
    return model.transform(test).select("id", "label", "prediction", F.round(evaluate.class_probability(), 6).alias("probability_0"),
                                        F.lit(",".join(chosen)).alias("important"))


# --- boosting and stacking -----------------------------------------------------------------------

@query(f"""with {ROWS}, {split_sql("one", "train", FEW, "t_price", VARIANCE)},
a as (select s.*, {side_sql('one', FEW)} as p1 from s, one), r as (select *, 2 * (t_price - p1) as gap from a), rt as (select * from r where not test),
{split_sql("two", "rt", FEW, "gap", VARIANCE)},
b as (select r.*, p1 + 0.1 * {side_sql('two', FEW)} as p2 from r, two)
select case when test then 'test' else 'train' end as measured_on, unnest([0, 1])::bigint as iter,
  unnest([round(sqrt(avg(pow(t_price - p1, 2))), 4), round(sqrt(avg(pow(t_price - p2, 2))), 4)]) as RMSE from b group by 1""")
def boosting_of_two_splits(spark, folder):
    """Settings by the names that other libraries use."""
    train, test = parts(modelling_rows(spark, folder, FEW))
    model = models.fit_cached(models.boosted_trees_named(n_estimators=2, max_depth=1, learning_rate=0.1, random_state=42), train)
    curves = {"train": models.boosting_curve(model, train), "test": models.boosting_curve(model, test)}
    log = [(name, i, round(float(v), 4)) for name, values in curves.items() for i, v in enumerate(values)]
    return spark.createDataFrame(log, "measured_on string, iter bigint, RMSE double")


@query(f"""with {ROWS}, fit as (select * from train where id % 5 <> 0), {split_sql("best", "fit", FEW, "t_price", VARIANCE)}
select id, round({side_sql('best', FEW)}, 4) as prediction, 0::bigint as best_round, true as stopped_early from s, best where test""")
def boosting_stopped_early(spark, folder):
    """Every fifth training row is held back with the opposite price, so each round after the first makes these worse."""
    train, test = parts(modelling_rows(spark, folder, FEW))
    held = F.col("id") % 5 == 0
    train = train.withColumn("label", F.when(held, -F.col("label")).otherwise(F.col("label")))
    model, curve = models.boosted_until_best(train, held, rounds=20, depth=1)
    best = curve.agg(F.min_by("iter", "validation"), F.max(F.when(F.col("best"), F.col("iter")))).first()
    return model.transform(test).select("id", F.round("prediction", 4).alias("prediction"), F.lit(best[1]).cast("bigint").alias("best_round"),
                                        F.lit(best[0] == best[1] and model.getNumTrees < 20).alias("stopped_early"))


@query(f"""with {ROWS}, n as (select *, ntile(5) over (order by id) as fold from train),
f as (select k, regr_slope(t_price, area) as a, regr_intercept(t_price, area) as b from n, range(1, 6) g(k) where fold <> k group by 1),
o as (select t_price, a * area + b as p from n join f on fold = k), m as (select regr_slope(t_price, p) as c, regr_intercept(t_price, p) as d from o),
w as (select regr_slope(t_price, area) as a, regr_intercept(t_price, area) as b from train)
select id, round(c * (a * area + b) + d, 4) as prediction from s, w, m where test""")
def stacked_lines(spark, folder):
    """A line on one feature, stacked by a line on its out-of-fold predictions."""
    train, test = parts(modelling_rows(spark, folder, ["area"]))
    model = models.StackedRegressor([models.least_squares()], "id", folds=5, use_features=False).fit(train)
    return model.transform(test).select("id", F.round("prediction", 4).alias("prediction"))


SHARES = [0.5, 1.0]
FOLDED = [(i, x, k) for i, x in enumerate(SHARES) for k in range(3)]


@query(f"with {LISTING_SQL}, s as (select t_price, area, h % 1000000 as bucket, h % 3 as fold from (select *, {CURVE_BUCKET.removesuffix(' % 1000000')} as h from cleaned)), "
       + ", ".join(f"f{i}{k} as (select regr_slope(t_price, area) as a, regr_intercept(t_price, area) as b from s where fold <> {k} and bucket < {int(x * 1e6)})"
                   for i, x, k in FOLDED) + " select share, measured_on, sum(rows)::bigint as rows, round(avg(rmse), 4) as rmse from ("
       + " union all ".join(f"""select {x}::double as share, case when fold = {k} then 'test' else 'train' end as measured_on, count(*) as rows,
  sqrt(avg(pow(t_price - a * area - b, 2))) as rmse from s, f{i}{k} where fold = {k} or bucket < {int(x * 1e6)} group by 1, 2""" for i, x, k in FOLDED)
       + ") group by 1, 2")
def cross_validated_line_curve(spark, folder):
    rows = numbering.hashed_folds(modelling_rows(spark, folder, ["area"]), "id", 3)
    curve = evaluate.line_curve(rows, "id", SHARES, 1, fold="fold", folds=3)
    return curve.withColumn("rmse", F.round("rmse", 4))


# --- machines on separable classes ---------------------------------------------------------------

def _machine_rows(spark: SparkSession, folder: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with the standardised columns X1 and X2, the scaler being of training rows."""
    rows = listings.stored_features(spark, folder).select(
        "id", F.col("hall").cast("double").alias("X1"), F.col("room").cast("double").alias("X2"), F.expr(label).cast("double").alias("label"))
    train, test = parts(features.hash_split(rows, "id", 0.2, seed=42))
    scaling = features.fit_standard(train, ["X1", "X2"])
    return models.repeatable(scaling.apply(train), "id"), scaling.apply(test)


@query(f"with {ROWS} select id, cast(hall > 2 as integer)::double as prediction, hall > 2 as positive from s where test")
def linear_svm_of_separable_classes(spark, folder):
    train, test = _machine_rows(spark, folder, "hall > 2")
    vectors = features.assembler(["X1", "X2"])
    model = models.fit_cached(svm.linear_svm(100.0), vectors.transform(train))
    return model.transform(vectors.transform(test)).select("id", "prediction", (evaluate.decision_score() > 0).alias("positive"))


@query(f"with {ROWS} select cast(t_price > 250 as integer)::double as label, count(*) as rows, count(*) as agreeing, true as same_line from s where test group by 1")
def weights_are_repeated_rows(spark, folder):
    """A class of weight three against the same rows three times: one line, the same predictions."""
    train, test = _machine_rows(spark, folder, "t_price > 250")
    vectors = features.assembler(["X1", "X2"])
    weighted = vectors.transform(train.withColumn("weight", features.class_weights("label", {1: 3})))
    repeated = weighted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    one, other = (models.fit_cached(svm.linear_svm(1.0, weight=w, tol=1e-8), rows) for w, rows in (("weight", weighted), (None, repeated)))
    same = max(abs(a - b) for a, b in zip([*one.coefficients, one.intercept], [*other.coefficients, other.intercept])) < 1e-3
    scored = one.transform(vectors.transform(test)).select("label", "features", F.col("prediction").alias("first"))
    return other.transform(scored).groupBy("label").agg(
        F.count("*").alias("rows"), F.count_if(F.col("first") == F.col("prediction")).alias("agreeing"), F.lit(same).alias("same_line"))


PENALTIES = [0.001, 0.01, 1.0, 100.0]
# The best machine on one column of few values: its line passes through two corners of the loss, or through one of them with the
# slope that balances the penalty. ``g`` are the distinct rows with their share, ``l`` the corners w v + b = e.
BEST_LOSS = f"""with {ROWS}, p as (select unnest({PENALTIES})::double as c),
r as (select cast(hall as double) as v, case when t_price > 250 then 1.0 else -1.0 end as y from train),
g as (select v, y, count(*) / sum(count(*)) over () as share from r group by v, y),
l as (select v, e from (select distinct v from g), (select unnest([-1.0, 1.0]) as e)),
k as (select distinct a.v, a.e, (b.e - a.e) / (b.v - a.v) as w from l a join l b on a.v <> b.v),
m as (select v, e, w, coalesce(lead(w) over (partition by v, e order by w), w + 2) as next, lag(w) over (partition by v, e order by w) is null as first from k),
pieces as (select v, e, (w + next) / 2 as w from m union all select v, e, w - 1 from m where first),
slopes as (select pieces.v, pieces.e, pieces.w, sum(case when 1 - y * (pieces.w * (g.v - pieces.v) + pieces.e) > 0 then -y * (g.v - pieces.v) * share else 0 end) as slope
  from pieces, g group by 1, 2, 3),
points as (select c, w, e - w * v as b from p, k union select c, -slope * n * c, e + slope * n * c * v from p, slopes, (select count(*) as n from r)),
losses as (select c, w, b, w * w / (2 * c * n) + sum(share * greatest(0, 1 - y * (w * v + b))) as loss from points, g, (select count(*) as n from r) group by c, w, b, n)
select c, (select count(*) from r) as rows, round(min(loss), 5) as loss, true as proven from losses group by c"""


@query(BEST_LOSS)
def proven_svm_loss(spark, folder):
    """The loss of machines on overlapping classes, each proven to be the best one to a millionth, against all
    lines that can be the best."""
    rows = listings.stored_features(spark, folder).select("id", F.col("hall").cast("double").alias("X1"), F.expr("cast(t_price > 250 as double)").alias("label"))
    train, _ = parts(features.hash_split(rows, "id", 0.2, seed=42))
    train = features.assembler(["X1"]).transform(models.repeatable(train, "id")).persist(StorageLevel.MEMORY_AND_DISK)
    found, n = [], train.count()
    for c in PENALTIES:
        model = svm.linear_svm(c, tol=1e-6).fit(train)
        found.append((c, n, round(model.getOrDefault(model.loss), 5), model.gap <= 1e-6))
    train.unpersist()
    return spark.createDataFrame(found, "c double, rows bigint, loss double, proven boolean")


@query(f"with {ROWS} select id, cast(hall in (2, 3) as integer)::double as prediction, hall not in (2, 3) as likely_0 from s where test")
def kernel_svm_of_a_ring(spark, folder):
    """The middle of a column against both ends, which no line separates."""
    train, test = _machine_rows(spark, folder, "hall in (2, 3)")
    model = svm.fit_kernel_svm(train, ["X1", "X2"], c=100, gamma=1, probability=True)
    return model.transform(test).select("id", "prediction", (F.col("probability_0") > 0.5).alias("likely_0"))


@query("""select c_custkey, cast(n_regionkey in (1, 2, 3) as integer)::double as prediction, 81::bigint as settings
from customer join nation on c_nationkey = n_nationkey""")
def kernel_svm_of_the_best_setting(spark, folder):
    """The whole grid of penalties and kernel widths, then the best one on every row."""
    owners = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("X2"), F.col("c_nationkey").alias("city_key"))
    rows = joins.lookup_join(owners, listings.cities(spark, folder), "city_key", "inner").select(
        "c_custkey", F.col("region_key").cast("double").alias("X1"), "X2", F.col("region_key").isin(1, 2, 3).cast("double").alias("label"))
    path = fresh_path(spark, "ring")
    rows.write.parquet(path)
    rows = models.repeatable(spark.read.parquet(path), "c_custkey")
    train, validation = parts(features.hash_split(rows, "c_custkey", 0.3))
    scaling = features.fit_standard(train, ["X1", "X2"])
    train, validation = scaling.apply(train), scaling.apply(validation)
    grid = svm.search_kernel_svm(train, validation, ["X1", "X2"])
    best = first_maximum(grid, "score", "position").first()
    model = svm.fit_kernel_svm(train, ["X1", "X2"], best["c"], best["gamma"])
    return model.transform(train.unionByName(validation)).select("c_custkey", "prediction", F.lit(grid.count()).cast("bigint").alias("settings"))


# --- chains --------------------------------------------------------------------------------------

def _newhouse(column: str, at: int) -> str:
    if column == "average_price":
        return "floor(o_totalprice / 20000)"
    return f"(o_orderkey * {at + 3} + floor(o_totalprice / 1000)) % {2 + at % 9}"


NEWHOUSE = ", ".join([f"cast({_newhouse(c, i)} as double) as {c}" for i, c in enumerate(NEWHOUSE_FEATURES)]
                     + [f"cast(floor(o_totalprice / 1000) as double) as {NEWHOUSE_TARGET}",
                        f"cast(case when o_orderpriority = '5-LOW' then 1 else 0 end as double) as {NEWHOUSE_MARKER}"])


def _measures(model: str, prediction: str) -> str:
    gap = f"({NEWHOUSE_TARGET} - {prediction})"
    return f"""select '{model}' as model, round(sqrt(avg(pow({gap}, 2))), 4) as rmse,
  round(avg(abs({gap}) / greatest(abs({NEWHOUSE_TARGET}), 2.220446049250313e-16)) * 100, 4) as mape,
  round(1 - var_pop({gap}) / var_pop({NEWHOUSE_TARGET}), 6) as explained_variance from p"""


@query(f"""with s as (select o_orderkey as id, {CURVE_SPLIT.replace("cast(id ", "cast(o_orderkey ")} as test, {NEWHOUSE} from orders where o_orderpriority <> '5-LOW'),
train as (select * from s where not test), {split_sql("best", "train", NEWHOUSE_FEATURES, NEWHOUSE_TARGET, VARIANCE)},
w as (select regr_slope({NEWHOUSE_TARGET}, average_price) as a, regr_intercept({NEWHOUSE_TARGET}, average_price) as b from train),
p as (select s.*, {side_sql('best', NEWHOUSE_FEATURES)} as tree, a * average_price + b as line from s, best, w where test)
{_measures("forest", "tree")} union all {_measures("least squares", "line")}""")
def new_house_forest_against_line(spark, folder):
    """Stored texts, marked rows out, numbers, min-max scaling by the training rows, then both models."""
    path = fresh_path(spark, "newhouse")
    table(spark, folder, "orders").selectExpr("cast(o_orderkey as double) as id", *NEWHOUSE.split(", ")).write.csv(path, header=True)
    stored = read_csv_named(spark, path, ["id", *NEWHOUSE_FEATURE_TABLE.names])
    kept = select.cast_all(stored).where(select.not_in(NEWHOUSE_MARKER, [1.0])).withColumn("id", F.col("id").cast("bigint"))
    train, test = parts(features.hash_split(kept, "id", 0.2, seed=42))
    scaling = features.fit_min_max(train, NEWHOUSE_FEATURES)

    def scored(columns: Sequence[str], estimator) -> DataFrame:
        known, unseen = (models.training_frame(scaling.apply(df), columns, NEWHOUSE_TARGET, ["id"]) for df in (train, test))
        return models.fit_cached(estimator, known).transform(unseen)

    found = evaluate.compare_models({"forest": scored(NEWHOUSE_FEATURES, _one_split()), "least squares": scored(["average_price"], models.least_squares())})
    return found.select("model", F.round("rmse", 4).alias("rmse"), F.round("mape", 4).alias("mape"), F.round("explained_variance", 6).alias("explained_variance"))


SHOP_ITEM = strings(["name"]).add("show_price", "double").add("total_price_start", "double")


@query("""with i as (select n_name as city, case when o_orderpriority = '5-LOW' then 0 else floor(o_totalprice / 7) end as price
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus <> 'P'),
c as (select city, count(*) as listings from i group by 1), m as (select city, round(avg(price), 4) as mean_unit_price from i where price <> 0 group by 1)
select row_number() over (order by listings desc, city) - 1 as place, city, listings, mean_unit_price from c left join m using (city)""")
def json_pages_to_city_charts(spark, folder):
    """JSON pages, some of them broken, to tables per city, the merged table and the series of a chart."""
    orders = select.spread(table(spark, folder, "orders")).withColumnRenamed("o_custkey", "c_custkey")
    owners = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("city_key"))
    named = joins.lookup_join(joins.lookup_join(orders, owners, "c_custkey", "inner"), listings.cities(spark, folder), "city_key", "inner")
    price = F.expr("cast(case when o_orderpriority = '5-LOW' then 0 else floor(o_totalprice / 7) end as double)")
    item = F.struct(F.col("o_orderkey").cast("string").alias("name"), price.alias("show_price"), F.col("o_totalprice").alias("total_price_start"))
    page = F.to_json(F.struct(F.struct(F.array(item).alias("list")).alias("data")))
    pages = named.select("city", F.when(F.col("o_orderstatus") == "P", F.lit("ERROR")).otherwise(page).alias("payload"))
    cities, national = fresh_path(spark, "city_tables"), fresh_path(spark, "national")
    write_per_city(json_items(pages, "payload", SHOP_ITEM, ["city"]), cities)
    write_merged(read_per_city(spark, cities, SHOP_ITEM), national)
    rows = spark.read.parquet(national)
    names, counts = reports.chart_series(reports.city_counts(rows, "name"), "city", "listings")
    means = dict(zip(*reports.chart_series(reports.city_unit_price(rows), "city", "mean_unit_price")))
    series = [(i, city, n, means.get(city)) for i, (city, n) in enumerate(zip(names, counts))]
    found = spark.createDataFrame(series, "place bigint, city string, listings bigint, mean_unit_price double")
    return found.withColumn("mean_unit_price", F.round("mean_unit_price", 4))
