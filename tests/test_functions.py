import math
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hearthlens.functions import codec, listing, markup, numeric, pagetree, text
from hearthlens.operators import encode, select
from hearthlens.sources import flatten_structs, json_items, union_all_columns

KEY = "0123456789abcdef"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_page_count(spark):
    rows = [("95",), ("100",), ("abc",), (None,), ("9.5",)]
    assert [r[0] for r in values(spark, rows, "t string", numeric.page_count(F.col("t")))] == [10, 10, 1, 1, 1]


def test_attribute_number(spark):
    rows = [('{"totalPage":7,"curPage":1}',), ("junk",), (None,), ("{a:x,b:2}",)]
    assert [r[0] for r in values(spark, rows, "t string", numeric.attribute_number(F.col("t")))] == [7, 1, 1, 1]


def test_page_urls_are_fresh_for_every_page(spark):
    df = spark.createDataFrame([("https://a/", 3), ("https://b/", 0)], "base string, n int")
    found = [r["page_url"] for r in numeric.page_urls(df, "base", "n").orderBy("page").collect()]
    assert found == ["https://a/pg1/", "https://a/pg2/", "https://a/pg3/"]


def test_gaussian_kernel(spark):
    found = values(spark, [([1.0, 2.0, 1.0], [0.0, 4.0, -1.0])], "a array<double>, b array<double>",
                   numeric.gaussian_kernel(F.col("a"), F.col("b"), 2.0))
    assert found[0][0] == pytest.approx(math.exp(-9 / 8), abs=1e-15)


def test_linspace_and_density(spark):
    grid = values(spark, [(0.0, 5.5)], "lo double, hi double", numeric.linspace(F.col("lo"), F.col("hi"), 200))[0][0]
    assert len(grid) == 200 and grid[0] == 0.0 and grid[-1] == 5.5 and grid[1] == pytest.approx(5.5 / 199)
    assert values(spark, [(0.0,)], "x double", numeric.normal_density(F.col("x"), 0, 1))[0][0] == pytest.approx(0.3989422804)


def test_escaping(spark):
    assert values(spark, [('<a & "b">',)], "t string", text.escape_markup(F.col("t")))[0][0] == "&lt;a &amp; &quot;b&quot;&gt;"
    assert values(spark, [("&amp;lt; &lt;",)], "t string", text.unescape_markup(F.col("t")))[0][0] == "&lt; <"


@pytest.mark.parametrize("value", [2.675, 0.125, 0.375, 427.335, -2.675, 1e6, 0.0, 1.005])
def test_formatting_follows_the_binary_value(spark, value):
    shown, rounded = values(spark, [(value,)], "v double", text.fixed_point(F.col("v")), text.round_exact(F.col("v")))[0]
    assert shown == f"{value:.2f}" and rounded == round(value, 2)


def test_first_token(spark):
    rows = [("南 北",), ("  东\t西",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", text.first_token(F.col("t")))] == ["南", "东", None, None]


def test_encryption_round_trip_and_bad_text(spark):
    df = spark.createDataFrame([("a中文",), ("",)], "t string").withColumn("e", codec.encrypt_text(F.col("t"), KEY))
    assert [r[0] for r in df.select(codec.decrypt_text(F.col("e"), KEY)).collect()] == ["a中文", ""]
    rows = [("%%%",), ("YWJj",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", codec.decrypt_text(F.col("t"), KEY))] == [None] * 4


def test_article_fragments_keep_reading_order(spark):
    df = spark.createDataFrame([(1, "https://img/1")], "id int, url string")
    html = F.concat(F.lit("<p>one\ntwo</p><p></p><img data-src=\""), codec.encrypt_text(F.col("url"), KEY),
                    F.lit('"/><img data-src="bad"/><p>three</p>'))
    rows = markup.article_fragments(df.select("id", html.alias("html")), "html", ["id"], KEY).orderBy("pos").collect()
    assert [(r["kind"], r["content"]) for r in rows] == [("text", "one\ntwo"), ("image", "https://img/1"), ("text", "three")]


def test_links_and_images(spark):
    html = """<a href="/x?a=1&amp;b=2" class="c">A <b>bold</b></a><abbr href="no">n</abbr><a name="t">none</a>
      <a alt="图片 1" target="_blank" href="https://s/1">pic</a><img class="i" src="//h/1.png"><img alt="no source">"""
    df = spark.createDataFrame([(1, html)], "id int, html string")
    links = markup.page_links(df, "html", ["id"]).orderBy("pos").collect()
    assert [(r["name"], r["href"]) for r in links] == [("A bold", "/x?a=1&b=2"), ("pic", "https://s/1")]
    page = F.col("nodes")
    found = markup.read_pages(df, "html", ["id"]).select(markup.matching_anchors(page, {"alt": "图片", "href": "^https://s/"}), markup.image_sources(page)).first()
    assert list(found) == [["https://s/1"], ["https://h/1.png"]]


def test_attribute_of_class(spark):
    html = '<div class="page-box-x" data-total-count="9"></div><div data-total-count="95" class="a page-box b">'
    page = markup.read_pages(spark.createDataFrame([(html,), (None,), ("",)], "t string"), "t", [])
    found = page.select(markup.attribute_of_class(F.col("nodes"), "page-box", "data-total-count")).collect()
    assert [r[0] for r in found] == ["95", None, None]


CARDS = """<ul class="x"><li>menu</li></ul><ul class="sellListContent" log-mod="list"><li class="clear"><div class="title"><a href="/1">T &amp; 1</a><span>new</span></div>
<div class="flood"><div class="positionInfo"><span class="icon"></span><a>Garden</a> - <a>Centre</a></div></div>
<div class="address"><div class="houseInfo"><span class="houseIcon"></span>3室2厅 | 89平米</div></div><div class="followInfo">12人关注 / 3个月以前发布</div>
<div class="priceInfo"><div class="totalPrice totalPrice2"><i> </i><span class="">235</span><i>万</i></div><div class="unitPrice"><span>26,404元/平</span></div></div></li>
<li><div class="title"><a>Bare</a></div></li></ul><ul><li><div class="title"><a>Outside</a></div></li></ul>"""


def test_listing_cards(spark):
    df = spark.createDataFrame([(1, CARDS), (2, "<html>no list</html>")], "id int, html string")
    rows = [tuple(r) for r in markup.listing_cards(df, "html", ["id"]).orderBy("pos").collect()]
    assert rows == [
        (1, 0, "T & 1", "Garden-Centre", "3室2厅 | 89平米", "12人关注 / 3个月以前发布", "235", "26,404元/平"),
        (1, 1, "Bare", "", None, None, None, None),
    ]


def test_house_info(spark):
    rows = [("3室2厅 | 89.5平米 | 南 北 | 精装 | 中楼层(共18层) | 2010年建 | 板塔结合",), ("1室0厅 | 40平米 | 东南 | 毛坯 | (共6层)",),
            ("联排别墅 | 300平米",), (None,)]
    names = ["room", "hall", "area", "orientation_text", "furnishment_text", "level_text", "height", "architecture_text"]
    columns = listing.house_info_columns(F.col("t"))
    found = values(spark, rows, "t string", *[columns[n] for n in names])
    assert found[0] == (3, 2, 89.5, "南", "精装", "中楼层", 18, "板塔结合")
    assert found[1] == (1, 0, 40.0, "东南", "毛坯", None, 6, None)
    assert found[2] == (None, None, 300.0, None, None, None, None, None)
    assert found[3] == (None,) * 8
    rows = [("联排别墅 | 3室2厅 | 120平米 | 南 | 毛坯 | 共3层",), ("塔楼 | 高楼层 (共30层) | 精装 | 北 | 61平米 | 2室1厅",), ("",)]
    found = values(spark, rows, "t string", *[columns[n] for n in names])
    assert found[0] == (3, 2, 120.0, "南", "毛坯", None, 3, None)
    assert found[1] == (2, 1, 61.0, "北", "精装", "高楼层", 30, "塔楼")
    assert found[2] == (None,) * 8


def test_follow_info_and_prices(spark):
    rows = [("12人关注 / 3个月以前发布",), ("0人关注 / 今天发布",), ("5人关注 / 一年前",), ("12",), ("3人关注 / 2年前发布",)]
    columns = listing.follow_info_columns(F.col("t"))
    assert values(spark, rows, "t string", columns["follower"], columns["span"]) == [(12, 90), (0, 0), (5, None), (None, None), (3, 730)]
    columns = listing.price_columns(F.col("a"), F.col("b"))
    rows = [("235.5", "26,404元/平"), ("100万", "单价9800元/平米"), (None, "")]
    assert values(spark, rows, "a string, b string", columns["t_price"], columns["u_price"]) == [(235.5, 26404.0), (100.0, 9800.0), (None, None)]


def test_json_pages(spark):
    item = StructType([StructField("a", LongType()), StructField("b", StructType([StructField("c", LongType())])), StructField("s", StringType())])
    df = spark.createDataFrame([('{"data":{"list":[{"a":1,"b":{"c":2}},{"a":3}]}}',), ("ERROR",), ('{"data":{"list":[]}}',)], "p string")
    found = json_items(df, "p", item)
    assert found.columns == ["a", "b.c", "s"]
    assert [tuple(r) for r in found.orderBy("a").collect()] == [(1, 2, None), (3, None, None)]
    assert flatten_structs(spark.range(1).select(F.struct(F.struct(F.lit(1).alias("y")).alias("x")).alias("w"))).columns == ["w.x.y"]


def test_union_all_columns(spark):
    a = spark.createDataFrame([(1,), (1,)], "a int")
    b = spark.createDataFrame([("z", 2)], "b string, a int")
    assert sorted(tuple(r) for r in union_all_columns([a, b]).fillna("-").collect()) == [(1, "-"), (1, "-"), (2, "z")]


def test_negated_filters_keep_null(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (5,)], "v int")
    assert [r[0] for r in df.where(select.not_in("v", [1])).collect()] == [0, None, 5]
    assert [r[0] for r in df.where(select.not_equal("v", 0)).collect()] == [1, None, 5]


def test_casting(spark):
    df = spark.createDataFrame([("1.9", "x"), ("2", "3")], "a string, b string")
    assert [tuple(r) for r in select.cast_all(df, lenient=True).collect()] == [(1.9, None), (2.0, 3.0)]
    with pytest.raises(Exception):
        select.cast_all(df).collect()
    assert [r[0] for r in df.select(select.truncate_to_int(F.col("a"))).collect()] == [1, 2]
    nan = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, i int")
    assert [tuple(r) for r in select.nan_to_null(nan).collect()] == [(None, 1), (2.0, 2)]


def test_projections(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `c.d` int")
    assert select.by_position(df, 0, 2).columns == ["a", "b"] and select.by_position(df, stop=-1).columns == ["a", "b"]
    assert select.all_but(df, "b").columns == ["a", "c.d"]
    assert [tuple(r) for r in select.column_info(df).collect()][2] == (2, "c.d", "int", 1)
    assert select.important(["a", "b", "c"], [0.15, 0.2, 0.65]) == ["b", "c"]


def test_codes_and_tags(spark):
    rows = [("东南", "满五唯一 近地铁"), ("北", None), ("x", "湖景")]
    found = values(spark, rows, "o string, t string", encode.orientation_code(F.col("o")), *encode.tags(F.col("t")).values())
    assert found == [(0, 0, 0, 0, 0, 0, 1, 1), (3, 0, 0, 0, 0, 0, 0, 0), (None, 0, 0, 0, 1, 0, 0, 0)]
    assert values(spark, [("basement",), ("top",), ("none",)], "l string", encode.ordinal(F.col("l"), encode.LEVEL)) == [(0,), (5,), (None,)]


def test_compute_once_stops_filters(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    found = select.compute_once(df, n=F.regexp_extract("t", r"(\d)", 1)).where("n != '1'")
    assert [r["n"] for r in found.orderBy("t").collect()] == ["0", "2"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_cards_with_inner_lists_two_lists_and_mixed_case(spark):
    page = """<ul class="other"><li>no</li></ul>
      <UL class='sellListContent' id=x><LI class=a><div class="title"><a>one</a></div><ul><li>x</li><li>y</li></ul>
      <div class='totalPrice'><span>5</span></div></LI><li><div class="title"><a>two</a></div></li></UL>
      <ul class="sellListContent"><li><DIV class=title><A>three</A></DIV></li></ul>"""
    rows = markup.listing_cards(spark.createDataFrame([(1, page)], "id int, html string"), "html", ["id"]).collect()
    assert [(r.pos, r.title, r.total_price) for r in rows] == [(0, "one", "5"), (1, "two", None), (2, "three", None)]


def tree_of(page):
    """(place, parent, last, name or text) of the nodes, attributes beside."""
    found = pagetree.read_page(page)
    return [(i, found.parent[i], found.last[i], found.tag[i] or found.text[i], dict(found.attributes[i])) for i in range(len(found.tag))]


def test_links_of_untidy_pages(spark):
    html = """<!-- <a href="old">o</a> --><script>var s = "<a href='js'>j</a>";</script><a title="1 > 0" href="x">q</a><a href="y">y"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    assert [tuple(r) for r in markup.page_links(df, "html", ["id"]).collect()] == [(1, 0, "q", "x"), (1, 1, "y", "y")]


def test_pages_become_trees():
    assert tree_of("<ul><li>1<ul><li>2<li>3</ul><li>4</ul>") == [
        (0, -1, 9, "ul", {}), (1, 0, 7, "li", {}), (2, 1, 2, "1", {}), (3, 1, 7, "ul", {}), (4, 3, 5, "li", {}), (5, 4, 5, "2", {}),
        (6, 3, 7, "li", {}), (7, 6, 7, "3", {}), (8, 0, 9, "li", {}), (9, 8, 9, "4", {})]
    assert tree_of("<p>a<p>b<div>c</p>d") == [
        (0, -1, 1, "p", {}), (1, 0, 1, "a", {}), (2, -1, 3, "p", {}), (3, 2, 3, "b", {}), (4, -1, 6, "div", {}), (5, 4, 5, "c", {}), (6, 4, 6, "d", {})]
    assert tree_of("a < b <c d='1>2' E=g h>i</C  ></x>")[:2] == [(0, -1, 0, "a < b ", {}), (1, -1, 2, "c", {"d": "1>2", "e": "g", "h": ""})]
    assert tree_of("<title>a <b> &amp;</title><br/><IMG src=//x/y?a=1&amp;b=2>") == [
        (0, -1, 1, "title", {}), (1, 0, 1, "a <b> &", {}), (2, -1, 2, "br", {}), (3, -1, 3, "img", {"src": "//x/y?a=1&b=2"})]
    for broken in ("<", "<a", "<a href", "<a href='x", "<!--", "<!-- <a>", "<script>", "</", "<a <b <c", "<a =b c==d \"e\">", "&#xffffffff;", "\x00<p\x00>"):
        tree_of(broken)


def test_long_and_deep_pages_take_linear_time():
    start = time.time()
    for page in ("<" * 200_000, "<a " * 60_000, "<a b='" * 40_000, "<!--" * 50_000, "<div>" * 20_000 + "</x>" * 20_000 + "</div>" * 20_000,
                 "<ul>" * 600 + "<li></li>" * 10_000, "<script>" * 40_000, "&amp" * 50_000):
        pagetree.read_page(page)
    assert time.time() - start < 20
    deep = pagetree.read_page("<b>" * 600)
    assert max(deep.parent) == pagetree.MOST_DEPTH - 1 and len(deep.tag) == 600


def test_links_are_taken_while_pages_are_read(spark):
    """The nodes of a page stay in the task, which gives the links only; the column functions find the same ones."""
    rng = random.Random(2)
    bits = ['<a href="/x">', "<a>", "</a>", "<p>", "</p>", "q", "&amp;", "<!-- ", "-->", "<div a='1'>", "</div>", '<a HREF="/&lt;">', "<br/>", "<script>", "</script>"]
    rows = [(i, None if i % 50 == 0 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, html string").coalesce(1)
    links = markup.page_links(df, "html", ["id"])
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "attributes" not in plan
    by_columns = markup.read_pages(df, "html", ["id"]).select("id", F.posexplode(markup.anchors(F.col("nodes"))).alias("pos", "a")).select("id", "pos", "a.*").where("href is not null")
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, by_columns.collect()))


def test_listing_texts_are_typed_where_they_are_matched(spark):
    """Filters and codes read the attributes: they do not cut and type the parts of a text again."""
    rows = spark.createDataFrame([(1, "3室2厅 | 89.5平米 | 南 北 | 精装 | 中楼层(共18层) | 板楼", "12人关注 / 3个月以前发布", "320", "5,000元/平"),
                                  (2, "1室 | 南北", None, None, "")], "id int, house_info string, follow_info string, total_price string, unit_price string")
    kept = listing.parse_listings(rows, ["id"]).where("height <> 0 and level_text is not null and room > 1")
    above = kept._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "trim(" not in above and "_cast(__" not in above
    assert [(r.id, r.room, r.hall, r.area, r.orientation_text, r.height, r.follower, r.span) for r in kept.collect()] == [(1, 3, 2, 89.5, "南", 18, 12, 90)]
