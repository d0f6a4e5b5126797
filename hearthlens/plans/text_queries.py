"""Queries for stored pages, JSON payloads, listing texts and their cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from hearthlens.functions import codec, markup, numeric, text
from hearthlens.functions.listing import follow_info_columns
from hearthlens.operators import clean, encode
from hearthlens.operators.select import spread
from hearthlens.plans import listings
from hearthlens.plans.listings import LISTING_SQL, MACRO_SQL
from hearthlens.plans.registry import query, table
from hearthlens.sources import broken_pages, json_items, json_items_of_any_shape, undeclared_fields, union_all_columns

# A key for data that the queries encrypt themselves; keys of real data are configuration.
TEST_KEY = "0123456789abcdef"

ITEM = StructType([
    StructField("url", StringType()),
    StructField("show_price", DoubleType()),
    StructField("extra", StructType([StructField("k", LongType()), StructField("user", StringType())])),
    StructField("tags", StringType()),
])


# --- pages ---------------------------------------------------------------------------------------

@query("""with a as (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as links from pages)
select page_id, cast(i - 1 as integer) as pos, regexp_extract(links[i], '>([^<]*)<', 1) as name,
  regexp_extract(links[i], 'href="([^"]*)"', 1) as href
from (select *, unnest(range(1, len(links) + 1)) as i from a)""")
def page_links(spark, folder):
    return markup.page_links(spread(table(spark, folder, "pages")), "html", ["page_id"])


LINK_ROWS = """with a as (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as links from pages),
r as (select page_id, unnest(links) as href from a)"""


@query(f"""{LINK_ROWS} select page_id, href, count(*) as n from r where regexp_matches(href, '^/[a-z]') group by 1, 2""")
def matching_anchors(spark, folder):
    found = markup.matching_anchors(F.col("nodes"), {"href": "^/[a-z]"})
    return markup.read_pages(spread(table(spark, folder, "pages")), "html", ["page_id"]).select("page_id", F.explode(found).alias("href")).groupBy("page_id", "href").agg(
        F.count("*").alias("n"))


@query(f"""{LINK_ROWS} select page_id, 'https:' || href as source, count(*) as n from r group by 1, 2""")
def image_sources(spark, folder):
    """The pages have no images, so their links are turned into some."""
    shown = F.replace("html", F.lit("<a href="), F.lit('<img class="i71-img" src='))
    pages = spread(table(spark, folder, "pages")).select("page_id", shown.alias("html"))
    return markup.read_pages(pages, "html", ["page_id"]).select("page_id", F.explode(markup.image_sources(F.col("nodes"))).alias("source")).groupBy(
        "page_id", "source").agg(F.count("*").alias("n"))


UNTIDY = ("""<!-- <a href="/old">o</a> --><script>var s = "<a href='/js'>j</a>";</script><a title="1 > 0" href="/x">q</a>""",
          """<a href=/y class='b c'>y""")


@query("""with a as (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as links from pages)
select page_id, i as pos, regexp_extract(links[i], '>([^<]*)<', 1) as name, regexp_extract(links[i], 'href="([^"]*)"', 1) as href
from (select *, unnest(range(1, len(links) + 1))::int as i from a)
union all select page_id, 0, 'q', '/x' from a union all select page_id, len(links)::int + 1, 'y', '/y' from a""")
def untidy_page_links(spark, folder):
    """Pages with links in a comment and a script, a quoted bracket and a link that nobody closed."""
    html = F.concat(F.lit(UNTIDY[0]), F.col("html"), F.lit(UNTIDY[1]))
    return markup.page_links(spread(table(spark, folder, "pages")).select("page_id", html.alias("html")), "html", ["page_id"])


def _unescaped(column: str) -> str:
    for name, sign in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        column = f"replace({column}, '{name}', '{sign}')"
    return column


@query(f"""with f as (select page_id, url, list_transform(string_split(html, '<p>')[2:], lambda x: regexp_extract(x, '^(.*?)(</p>|</article>|$)', 1, 's')) as found from pages),
t as (select page_id, url, len(found) as n, unnest(found) as raw, unnest(range(len(found))) as i from f)
select page_id, i::int as pos, 'text' as kind, {_unescaped("regexp_replace(raw, '<[^>]*>', '', 'g')")} as content from t where content <> ''
union all select page_id, len(found)::int, 'image', url from f""")
def article_fragments(spark, folder):
    """Every page gets an encrypted image address at its end and one that does not decrypt."""
    pages = spread(table(spark, folder, "pages"))
    image = F.concat(F.lit('<img data-src="'), codec.encrypt_text(F.col("url"), TEST_KEY), F.lit('"/><img data-src="%%%">'))
    return markup.article_fragments(pages.select("page_id", F.concat("html", image).alias("html")), "html", ["page_id"], TEST_KEY)


@query("""select doc_id, cast(case when lang = 'de' then 1 else ceil(n_chars / 10.0) end as integer) as pages from documents""")
def page_counts(spark, folder):
    total = F.when(F.col("lang") == "de", F.lit("many")).otherwise(F.col("n_chars").cast("string"))
    html = F.concat(F.lit('<div class="fc-main"></div><div class="page-box clear" data-total-count="'), total, F.lit('"></div>'))
    pages = spread(table(spark, folder, "documents")).select("doc_id", html.alias("html"))
    count = markup.attribute_of_class(F.col("nodes"), "page-box", "data-total-count")
    return markup.read_pages(pages, "html", ["doc_id"]).select("doc_id", numeric.page_count(count).alias("pages"))


@query("""select event_id, cast(case when event_type = 'error' then 1 else json_extract(props, '$.k')::integer end as integer) as pages from events""")
def page_data_attribute(spark, folder):
    data = F.when(F.col("event_type") == "error", F.lit("no data")).otherwise(
        F.concat(F.lit('{"totalPage":'), F.get_json_object("props", "$.k"), F.lit(',"curPage":1}')))
    return spread(table(spark, folder, "events")).select("event_id", numeric.attribute_number(data).alias("pages"))


@query("""select doc_id, text as decoded from documents where source <> 'src0'""")
def decrypted_texts(spark, folder):
    stored = F.when(F.col("source") == "src0", F.lit("%%% not base64")).otherwise(codec.encrypt_text(F.col("text"), TEST_KEY))
    docs = spread(table(spark, folder, "documents")).select("doc_id", stored.alias("stored"))
    return docs.select("doc_id", codec.decrypt_text(F.col("stored"), TEST_KEY).alias("decoded")).where("decoded is not null")


@query("select doc_id, md5(text) as digest, length(text) as chars from documents")
def decoded_base64(spark, folder):
    back = codec.decode_utf8(codec.decode_base64(F.base64(F.encode("text", "UTF-8"))))
    return spread(table(spark, folder, "documents")).select("doc_id", F.md5(back).alias("digest"), F.length(back).cast("bigint").alias("chars"))


@query("""select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped from pages""")
def escaped_markup(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", text.escape_markup(F.col("html")).alias("escaped"))


@query("select o_orderkey, printf('%.2f', o_totalprice / 1000) as shown from orders")
def formatted_prices(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", text.fixed_point(F.col("o_totalprice") / 1000).alias("shown"))


# --- JSON ----------------------------------------------------------------------------------------

def _payload() -> F.Column:
    """A page of two items per event; the second has no price, a broken page has no items."""
    user = F.col("user_id").cast("string")
    first = F.struct(F.concat(F.lit("/u/"), user).alias("url"), F.col("value").alias("show_price"),
                     F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), user.alias("user")).alias("extra"),
                     F.col("event_type").alias("tags"))
    second = F.struct(F.lit("/none").alias("url"), F.lit(None).cast("double").alias("show_price"),
                      F.struct(F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("string").alias("user")).alias("extra"),
                      F.lit(None).cast("string").alias("tags"))
    page = F.to_json(F.struct(F.struct(F.array(first, second).alias("list")).alias("data")))
    return F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(page)


@query("""select event_id, '/u/' || user_id as url, value as show_price, json_extract(props, '$.k')::bigint as "extra.k",
  cast(user_id as varchar) as "extra.user", event_type as tags from events where event_type <> 'error'
union all select event_id, '/none', null, null, null, null from events where event_type <> 'error'""")
def json_flatten(spark, folder):
    events = spread(table(spark, folder, "events")).select("event_id", _payload().alias("payload"))
    return json_items(events, "payload", ITEM, ["event_id"])


@query("""select event_type as city, count(*) as items, count(show_price) as priced, count(rooms) as with_rooms from (
  select event_type, value as show_price, null as rooms from events where event_type <> 'error'
  union all select event_type, null, null from events where event_type <> 'error'
  union all select event_type, null, json_extract(props, '$.k') from events where event_type = 'click') group by 1""")
def json_pages_of_two_shapes(spark, folder):
    events = spread(table(spark, folder, "events"))
    first = json_items(events.select("event_type", _payload().alias("payload")), "payload", ITEM, ["event_type"])
    rooms = F.to_json(F.struct(F.struct(F.array(F.struct(F.get_json_object("props", "$.k").cast("int").alias("rooms"))).alias("list")).alias("data")))
    shape = StructType([StructField("rooms", LongType())])
    second = json_items(events.where("event_type = 'click'").select("event_type", rooms.alias("payload")), "payload", shape, ["event_type"])
    both = union_all_columns([first, second])
    return both.groupBy(F.col("event_type").alias("city")).agg(
        F.count("*").alias("items"), F.count("show_price").alias("priced"), F.count("rooms").alias("with_rooms"))


@query("""select event_type as source, event_id, '/u/' || user_id as url, case event_type when 'view' then null when 'click' then null else value end as show_price,
  case event_type when 'click' then json_extract(props, '$.k')::bigint end as "extra.k", case event_type when 'click' then user_id = 1 end as "extra.owner",
  case event_type when 'view' then cast(value as varchar) end as area from events where event_type <> 'error'""")
def json_pages_of_unknown_shapes(spark, folder):
    """Pages of three shapes, none of them declared: with a price, with nested fields, and with a number written as text."""
    user, value = F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"), F.col("value")
    number = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    shapes = {"view": F.struct(user, F.col("event_id").alias("event_id"), value.cast("string").alias("area")),
              "click": F.struct(user, F.col("event_id").alias("event_id"), F.struct(number, (F.col("user_id") == 1).alias("owner")).alias("extra"))}
    item = F.to_json(F.struct(user, F.col("event_id").alias("event_id"), value.alias("show_price")))
    for name, shape in shapes.items():
        item = F.when(F.col("event_type") == name, F.to_json(shape)).otherwise(item)
    page = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.concat(F.lit('{"data":{"list":['), item, F.lit("]}}")))
    pages = spread(table(spark, folder, "events")).select(F.col("event_type").alias("source"), page.alias("payload"))
    return json_items_of_any_shape(pages, "payload", ["source"])


@query("select event_type as source, count(*) as broken from events where event_type = 'error' group by 1")
def json_broken_pages(spark, folder):
    pages = spread(table(spark, folder, "events")).select(F.col("event_type").alias("source"), _payload().alias("payload"))
    return broken_pages(pages, "payload").groupBy("source").agg(F.count("*").alias("broken"))


@query("""select event_type as source, unnest(['tags', 'extra.user']) as field, unnest([count(event_type), count(user_id)]) as items
from events where event_type <> 'error' group by 1""")
def json_undeclared_fields(spark, folder):
    """The pages are read as if two of their fields had not been declared."""
    declared = StructType([ITEM["url"], ITEM["show_price"], StructField("extra", StructType([StructField("k", LongType())]))])
    pages = spread(table(spark, folder, "events")).select(F.col("event_type").alias("source"), _payload().alias("payload"))
    return undeclared_fields(pages, "payload", declared, ["source"])


# --- listing texts -------------------------------------------------------------------------------

def card_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stored listing page per listing: its own card, and a card that shows the title only."""
    raw = listings.listing_raw(spark, folder)

    def part(css: str, inner) -> F.Column:
        return F.concat(F.lit(f'<div class="{css} clear">'), inner, F.lit("</div>"))

    def link(value) -> F.Column:
        return F.concat(F.lit('<a target="_blank" href="/x">'), value, F.lit("</a>"))

    def span(value) -> F.Column:
        return F.concat(F.lit("<i> </i><span class=\"\">"), value, F.lit("</span><i>万</i>"))

    pieces = F.split("position", "-")
    title = part("title", link(F.concat("title", F.lit(" &amp; more"))))
    full = F.concat(
        F.lit('<li class="clear LOGCLICKDATA"><div class="info">'), title,
        part("flood", part("positionInfo", F.concat(F.lit('<span class="positionIcon"></span>'), link(F.get(pieces, F.lit(0))),
                                                   F.lit("   -  "), link(F.get(pieces, F.lit(1)))))),
        part("address", part("houseInfo", F.concat(F.lit('<span class="houseIcon"></span>'), "house_info"))),
        part("followInfo", F.concat(F.lit('<span class="starIcon"></span>'), "follow_info")),
        F.coalesce(part("totalPrice", span(F.col("total_price"))), F.lit("")),
        part("unitPrice", span(F.col("unit_price"))), F.lit("</div></li>"))
    bare = F.concat(F.lit('<li class="list_app">'), title, F.lit("</li>"))
    page = F.concat(F.lit('<html><ul class="nav"><li>menu</li></ul><ul class="sellListContent" log-mod="list">'), full, bare, F.lit("</ul></html>"))
    return raw.select("id", page.alias("html"))


CARD_TEXT = """
card_text as (
  select o_orderkey as id, city, concat(city, case when villa then ' 别墅' else ' 住宅' end, case when o_totalprice < 5000 then ' 地下车位' else '' end) as title,
    concat(city, '-', c_mktsegment) as position,
    case when o_totalprice <= 495000 then cast(cast(floor(o_totalprice / 1000) as integer) as varchar) end as total_price,
    cast(floor(o_totalprice / 7) as integer) as unit_number
  from listing_base
)"""


@query(f"""with {LISTING_SQL}, {CARD_TEXT}
select id, 0 as pos, title || ' & more' as title, position, total_price, format('{{:,}}元/平', unit_number) as unit_price, 6 as house_parts,
  (select follower from listing l where l.id = c.id) as follower from card_text c
union all select id, 1, title || ' & more', '', null, null, null, null from card_text""")
def listing_cards(spark, folder):
    cards = markup.listing_cards(card_pages(spark, folder), "html", ["id"])
    # a listing without a building type shows one part less
    parts = F.size(F.split("house_info", r"\|")) + F.when(F.col("house_info").rlike("板|塔|平房"), 0).otherwise(1)
    follower = follow_info_columns(F.col("follow_info"))["follower"]
    return cards.select("id", "pos", "title", "position", "total_price", "unit_price",
                        F.when(F.col("house_info").isNotNull(), parts).alias("house_parts"), follower.alias("follower"))


@query(f"""with {LISTING_SQL} select id, room, hall, area, orientation, furnishment, level, height, architecture from listing""")
def house_info_parsed(spark, folder):
    rows = listings.encoded(listings.parsed(listings.listing_raw(spark, folder)))
    return rows.select("id", "room", "hall", "area", "orientation", "furnishment", "level", "height", "architecture")


@query(f"""with {LISTING_SQL} select id, follower, span, t_price, u_price from listing""")
def follow_and_price_parsed(spark, folder):
    return listings.parsed(listings.listing_raw(spark, folder)).select("id", "follower", "span", "t_price", "u_price")


@query("""select p_partkey, split_part(p_name, ' ', 1) as token from part""")
def first_token(spark, folder):
    spaced = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit(" "))
    return table(spark, folder, "part").select("p_partkey", text.first_token(spaced).alias("token"))


@query("""select p_partkey, p_brand || '-' || p_type || '-' || p_size as position from part""")
def joined_pieces(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", text.join_pieces(F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("position"))


@query("""select p_type, p_brand, case p_type when 'ECONOMY' then 0 when 'SMALL' then 1 when 'MEDIUM' then 2 when 'LARGE' then 3 end as code,
  count(*) as n from part group by 1, 2, 3""")
def ordinal_codes(spark, folder):
    words = {"ECONOMY": "other", "SMALL": "unfinished", "MEDIUM": "simple", "LARGE": "well-decorated"}
    code = encode.ordinal(F.col("p_type"), {name: encode.FURNISHMENT[word] for name, word in words.items()})
    return table(spark, folder, "part").groupBy("p_type", "p_brand", code.alias("code")).agg(F.count("*").alias("n"))


@query(f"""with {LISTING_SQL} select id, park, light, p_lot, water, business, transport, l_tax from listing""")
def text_tags(spark, folder):
    return listings.listing_raw(spark, folder).select("id", *[c.alias(n) for n, c in encode.tags(F.col("tags")).items()])


@query("""select doc_id, cast(contains(text, 'license') or contains(text, 'License') as integer) as license,
  cast(contains(text, '@') as integer) as address from documents""")
def document_tags(spark, folder):
    found = encode.tags(F.col("text"), {"license": ["license", "License"], "address": ["@"]})
    return spread(table(spark, folder, "documents")).select("doc_id", *[c.alias(n) for n, c in found.items()])


FUNNEL_DISTINCT = ["city", "room", "hall", "orientation_text", "furnishment_text", "level_text", "architecture_text"]


@query(f"""with {LISTING_SQL}, failed as (
  select *, case when t_price is null then 1 when parking then 2 when architecture is null then 3
    when level is null and not villa then 4 when villa then 5 when height = 0 then 6 end as rule from listing
), steps as (
  select * from (values (0, 'raw'), (1, 'missing total price'), (2, 'parking space'), (3, 'missing building structure'),
    (4, 'missing floor info'), (5, 'villa'), (6, 'no floors'), (7, 'duplicate')) t(step, rule)
), counts as (
  select s.step, s.rule, case when s.step = 7 then (select count(*) - count(distinct (city, room, hall, orientation, p.o_orderpriority, furnishment, level, architecture))
      from failed f join orders p on p.o_orderkey = f.id where f.rule is null)
    else (select count(*) from failed f where f.rule = s.step) end as removed from steps s
)
select step, rule, removed, cast((select count(*) from listing) - sum(removed) over (order by step) as bigint) as remaining from counts""")
def cleaning_funnel(spark, folder):
    return clean.funnel(listings.parsed(listings.listing_raw(spark, folder)), listings.rules(), FUNNEL_DISTINCT)


@query(f"with {LISTING_SQL} select id, city, t_price, level, height from cleaned")
def cleaned_listings(spark, folder):
    kept = clean.apply_rules(listings.parsed(listings.listing_raw(spark, folder)), listings.rules())
    return listings.encoded(kept).select("id", "city", "t_price", "level", "height")


@query("select lang, count(*) as n from (select distinct lang, source, text from documents) group by 1")
def distinct_documents(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("lang", "source", "text")
    return clean.drop_duplicates(docs).groupBy("lang").agg(F.count("*").alias("n"))


@query("""with s as (select s_nationkey as city_key, count(*) as c_area, round(sum(s_acctbal), 2) as water from supplier group by 1),
n as (select n_name as city, coalesce(c_area, 0) as c_area, case when n_name in ('NATION_2', 'NATION_7') then null else water end as water
  from nation left join s on city_key = n_nationkey)
select n.city, round(coalesce(n.water, d.water * n.c_area / nullif(d.c_area, 0)), 4) as c_water_resources from n
left join n d on d.city = case n.city when 'NATION_2' then 'NATION_12' when 'NATION_7' then 'NATION_17' end""")
def ratio_imputation(spark, folder):
    summed = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("city_key")).agg(
        F.count("*").alias("c_area"), F.round(F.sum("s_acctbal"), 2).alias("water"))
    known = listings.cities(spark, folder).join(summed, "city_key", "left").select(
        "city", F.coalesce("c_area", F.lit(0)).alias("c_area"),
        F.when(~F.col("city").isin("NATION_2", "NATION_7"), F.col("water")).alias("water"))
    filled = clean.impute_by_ratio(known, "city", "water", "c_area", {"NATION_2": "NATION_12", "NATION_7": "NATION_17"})
    return filled.select("city", F.round("water", 4).alias("c_water_resources"))


@query(f"""with {LISTING_SQL}, {MACRO_SQL}
select id, city, park, light, p_lot, water, business, transport, l_tax, hall, room, area, orientation, furnishment, level, height,
  architecture, follower, span, gdp, region, green_rate, c_population, c_area, c_water_resources, t_price
from cleaned left join macro using (city)""")
def listing_features(spark, folder):
    return listings.listing_features(spark, folder)
