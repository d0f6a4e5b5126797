import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from hearthlens import sources
from hearthlens.session import fresh_path, shared_folder, working_folders
from hearthlens.streaming.incremental import load_new_entities, read_loaded
from hearthlens.streaming.keyindex import key_index


def write(path, data, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(data)


def test_strict_numeric_tolerates_mark_and_unnamed_column(spark, tmp_path):
    path = str(tmp_path / "n.csv")
    write(path, "t_price,area,\n1.5,2,\n3,1e2,x\n", "utf-8-sig")
    df = sources.read_strict_numeric(spark, path, ["t_price", "area", ""])
    assert df.columns == ["t_price", "area"]
    assert sorted(tuple(r) for r in df.collect()) == [(1.5, 2.0), (3.0, 100.0)]


@pytest.mark.parametrize("bad", ["abc", ""])
def test_strict_numeric_fails_on_other_text(spark, tmp_path, bad):
    path = str(tmp_path / "n.csv")
    write(path, f"t_price,area\n1.5,2\n{bad},3\n")
    with pytest.raises(Exception, match="not a number"):
        sources.read_strict_numeric(spark, path, ["t_price", "area"]).collect()


def test_gbk(spark, tmp_path):
    path = str(tmp_path / "1.csv")
    write(path, "编号,地址URL\n1,http://x/中\n", "gbk")
    schema = StructType([StructField("编号", LongType()), StructField("地址URL", StringType())])
    assert [tuple(r) for r in sources.read_gbk_csv(spark, path, schema).collect()] == [(1, "http://x/中")]


def test_gbk_in_a_session_that_others_built(spark, tmp_path):
    rows = [(1, "http://x/中"), (2, "文章")]
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    try:
        sources.write_gbk_csv(spark.createDataFrame(rows, "`编号` bigint, `地址URL` string").coalesce(1), str(tmp_path / "gbk"))
        stored, = (tmp_path / "gbk").glob("*.csv")
        assert stored.read_bytes().decode("gbk") == "编号,地址URL\n1,http://x/中\n2,文章\n"
        spark.conf.set("spark.sql.legacy.javaCharsets", "false")
        schema = StructType([StructField("编号", LongType()), StructField("地址URL", StringType())])
        assert [tuple(r) for r in sources.read_gbk_csv(spark, str(stored), schema).collect()] == rows
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def test_imposed_names_skip_the_header(spark, tmp_path):
    path = str(tmp_path / "h.csv")
    write(path, "x,y\n1.0,2\n")
    assert [tuple(r) for r in sources.read_csv_named(spark, path, ["t_price", "park"]).collect()] == [("1.0", "2")]


def test_city_from_file_name(spark, tmp_path):
    schema = StructType([StructField("url", StringType()), StructField("show_price", DoubleType())])
    write(str(tmp_path / "c" / "北京.csv"), "url,show_price\na,1\nb,2\n")
    write(str(tmp_path / "c" / "上 海.csv"), "url,show_price\nc,3\n")
    df = sources.read_per_city_files(spark, str(tmp_path / "c"), schema)
    assert sorted((r["url"], r["city"]) for r in df.collect()) == [("a", "北京"), ("b", "北京"), ("c", "上 海")]


def test_city_folders_are_pruned(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "big").otherwise("小城").alias("city"))
    path = fresh_path(spark, "cities")
    sources.write_per_city(df, path)
    read = sources.read_per_city(spark, path, StructType([StructField("id", LongType())]))
    assert read.groupBy("city").count().orderBy("count").collect()[0]["city"] == "小城"
    plan = read.where("city = '小城'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(city" in plan


def test_describe_means(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    write(path, ",park,light\ncount,3,3\nmean,0.5,0.25\nstd,1,1\n")
    assert sorted(tuple(r) for r in sources.read_describe_means(spark, path, ["park", "light"]).collect()) == [("light", 0.25), ("park", 0.5)]
    write(path, ",park,light\ncount,3,3\n")
    assert sources.read_describe_means(spark, path, ["park", "light"]).count() == 0


def test_logs(spark, tmp_path):
    write(str(tmp_path / "l.tsv"), "iter\tRMSE\n0\t106.9\n1\t97.9\n")
    assert [tuple(r) for r in sources.read_tsv_log(spark, str(tmp_path / "l.tsv")).collect()] == [(0, 106.9), (1, 97.9)]
    write(str(tmp_path / "l.json"), '{\n"meta":{"name":"experiment","iteration_count":2},\n"iterations":[\n'
          '{"learn":[106.9],"iteration":0,"passed_time":0.1,"remaining_time":0.9},\n{"learn":[97.9],"iteration":1,"passed_time":0.2,"remaining_time":0.8}\n]}')
    rows = sources.read_json_log(spark, str(tmp_path / "l.json")).collect()
    assert [(r["name"], r["iter"], r["RMSE"]) for r in rows] == [("experiment", 0, 106.9), ("experiment", 1, 97.9)]


def test_name_line_is_one_line_or_refused(spark):
    df = spark.createDataFrame([(2, "包头"), (1, "保定"), (3, "北海")], "pos int, name string").repartition(3)
    for most in (3, 1_000_000):
        path = fresh_path(spark, "names")
        sources.write_name_line(df, path, "name", "pos", most)
        assert [r[0] for r in spark.read.text(path).collect()] == ["保定,包头,北海"]
    with pytest.raises(ValueError):
        sources.write_name_line(df, fresh_path(spark, "names"), "name", "pos", 2)


def test_pending(spark):
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "city string")
    stored = spark.createDataFrame([("b",), ("b",)], "city string")
    assert sorted(r[0] for r in sources.pending(listed, stored, ["city"]).collect()) == ["a", "c"]


def test_incremental_load_adds_each_entity_once(spark):
    schema = StructType([StructField("city", StringType()), StructField("v", LongType())])
    source, target, mark = fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "mark")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema).write.mode("append").parquet(source)
    load_new_entities(spark, source, schema, target, "city", mark)
    load_new_entities(spark, source, schema, target, "city", mark)
    spark.createDataFrame([("b", 9), ("c", 4)], schema).write.mode("append").parquet(source)
    load_new_entities(spark, source, schema, target, "city", mark)
    load_new_entities(spark, source, schema, target, "city", fresh_path(spark, "other"))
    rows = sorted((r["city"], r["v"]) for r in read_loaded(spark, target, schema).collect())
    assert rows == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


class _Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master
        self.checkpoints = None

    def getCheckpointDir(self):
        return self.checkpoints

    def setCheckpointDir(self, folder):
        self.checkpoints = folder


class _Session:
    def __init__(self, master, setting=None):
        self.sparkContext = _Context(master)
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}


def test_only_a_local_session_gets_a_folder_of_its_own():
    local = _Session("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.sparkContext.checkpoints
    named = _Session("spark://host:7077", "/shared/spark")
    assert shared_folder(named) == "/shared/spark" == named.sparkContext.checkpoints
    with pytest.raises(RuntimeError):
        shared_folder(_Session("spark://host:7077"))


def test_reading_leaves_the_declared_schema_alone(spark):
    schema = StructType([StructField("v", LongType())])
    path = fresh_path(spark, "cities")
    sources.write_per_city(spark.createDataFrame([("a", 1), ("b", 2)], "city string, v long"), path)
    for _ in range(2):
        assert sorted(tuple(r) for r in sources.read_per_city(spark, path, schema).collect()) == [(1, "a"), (2, "b")]
    assert schema.names == ["v"]


def test_working_folders_are_removed(spark, tmp_path):
    with working_folders(spark):
        path, kept = fresh_path(spark, "work"), str(tmp_path / "kept")
        spark.range(5).write.parquet(path)
        spark.range(5).write.parquet(kept)
        fresh_path(spark, "never written")
        assert spark.read.parquet(path).count() == 5
    assert not os.path.exists(path) and spark.read.parquet(kept).count() == 5
    with pytest.raises(ZeroDivisionError):
        with working_folders(spark):
            path = fresh_path(spark, "work")
            spark.range(5).write.parquet(path)
            1 / 0
    assert not os.path.exists(path)


def test_pages_of_shapes_that_nobody_declared(spark):
    pages = [("a", '{"data":{"list":[{"x":1,"n":{"y":2.5,"z":null}},{"x":2}]}}'), ("a", '{"data":{"list":[{"x":"three"}]}}'), ("b", '{"data":{"list":[{"x":7,"w":[1,2]}]}}'),
             ("c", "ERROR"), ("d", '{"data":{"list":[]}}'), ("e", '{"other":1}'), (None, '{"data":{"list":[{"x":true}]}}'), ("f", None)]
    df = spark.createDataFrame(pages, "source string, payload string")
    found = sources.json_items_of_any_shape(df, "payload", ["source"])
    rows = sorted([{k: v for k, v in r.asDict().items() if v is not None} for r in found.collect()], key=repr)
    assert rows == sorted([{"source": "a", "x": "1", "n.y": 2.5}, {"source": "a", "x": "2"}, {"source": "a", "x": "three"},
                           {"source": "b", "x": "7", "w": [1, 2]}, {"x": "true"}], key=repr)
    assert {r["source"]: r["shape"] for r in sources.item_shapes(df, "payload", ["source"]).collect()}["b"].startswith("OBJECT<")
    nothing = sources.json_items_of_any_shape(df.where("source = 'c'"), "payload", ["source"])
    assert nothing.columns == ["source"] and nothing.collect() == []


def test_a_batch_opens_only_the_slots_that_may_hold_its_keys(spark):
    index = key_index(fresh_path(spark, "index"), ["k", "n"], slots=200)
    stored = spark.range(20_000).select(F.concat(F.lit("key "), "id").alias("k"), (F.col("id") % 7).cast("int").alias("n"))
    none = stored.where("k is null")
    assert index.slots_to_open(stored) == [] and index.pending(stored.limit(3)).count() == 3
    for batch in range(3):
        index.add(stored.where(F.pmod(F.crc32(F.col("k").cast("binary")), F.lit(3)) == batch), "a", batch)
    index.add(none, "a", 3)
    fresh = spark.range(50_000, 50_190).select(F.concat(F.lit("key "), "id").alias("k"), (F.col("id") % 7).cast("int").alias("n"))
    batch = fresh.unionByName(stored.where("k in ('key 5', 'key 77', 'key 19999')")).unionByName(spark.createDataFrame([(None, 1), ("key 5", 6)], "k string, n int"))
    opened = index.slots_to_open(batch)
    read = index.candidates(batch).count()
    assert 3 <= len(opened) <= 20 and read <= 2_000, "a tenth of 20,000 keys"
    left = index.pending(batch)
    assert left.count() == 192 and left.where("k = 'key 5' and n = 6").count() == 1 and left.where("k is null").count() == 1
    assert index.pending(stored).isEmpty() and index.pending(none).isEmpty()
    # a batch that is stored again does not see its own first attempt
    again = stored.where(F.pmod(F.crc32(F.col("k").cast("binary")), F.lit(3)) == 2)
    assert index.pending(again, "a", 2).count() == again.count() and index.pending(again, "a", 1).isEmpty()
    plan = index.candidates(batch)._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters" in line and "slot" in line for line in plan.splitlines()), "folders of other slots are not read"
