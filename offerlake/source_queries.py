"""Registered queries over detail pages, shops' lists and models' answers, each with its SQL."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.operators import ingest
from offerlake.operators import scan as scanning
from offerlake.plans.lineage import checkpointed
from offerlake.plans.roles import dealt
from offerlake.queries import query, read
from offerlake.sources import answers, details, shops

# Detail pages: each part is a product and each supplier a producer; every seventh page is broken in some way


@query(
    """SELECT p_partkey AS page_id, CASE WHEN k = 6 THEN NULL ELSE trim(p_name) END AS product_name, CASE WHEN k = 6 THEN NULL ELSE p_brand END AS producer_name,
    CASE WHEN k IN (1, 6) THEN NULL ELSE 'https://pages.example/maker/' || p_size END AS producer_url, CASE WHEN k = 6 THEN NULL ELSE p_type END AS style,
    CASE WHEN k = 6 THEN NULL WHEN k = 2 THEN 'https://pages.example/og/' || p_partkey ELSE '/label/' || p_partkey || '.jpg' END AS label,
    CASE WHEN k IN (3, 6) THEN NULL ELSE CAST(p_size / 4.0 AS DOUBLE) END AS abv_value, CASE WHEN k = 6 OR p_size % 2 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS ibu_value,
    CASE WHEN k = 6 THEN NULL ELSE CAST(p_size / 10.0 AS DOUBLE) END AS rating_value, CASE WHEN k = 6 THEN NULL ELSE CAST(p_size AS BIGINT) * 1000 + 234 END AS rating_count_value
    FROM (SELECT *, p_partkey % 7 AS k FROM part)"""
)
def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 7, F.col("p_size")
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    maker = F.when(k == 1, safe("p_brand")).otherwise(F.concat(F.lit("<a href='/maker/"), size.cast("string"), F.lit("'> "), safe("p_brand"), F.lit("</a>")))
    image = F.when(k == 2, F.concat(F.lit("<meta property='og:image' content='https://pages.example/og/"), F.col("p_partkey").cast("string"), F.lit("'>"))).otherwise(
        F.concat(F.lit("<div class='label big'><a><img src='/label/"), F.col("p_partkey").cast("string"), F.lit(".jpg'></a></div>"))
    )
    page = F.concat(
        F.lit("<html><h1>Site</h1><script>'<div class=name><h1>no</h1>'</script><div class='box'><div class=\"name\"><h1>\n "),
        safe("p_name"),
        F.lit(" </h1><p class='brewery'>"),
        maker,
        F.when(k == 4, "</b></div2></p>").otherwise("</p>"),  # ends that nothing began
        F.lit("<p class='style'>"),
        safe("p_type"),
        F.when(k == 5, "").otherwise("</p>"),  # an end that is missing
        F.lit("</div>"),
        image,
        F.lit("<div class='details'>"),
        F.when(k == 3, "").otherwise(F.concat(F.lit("<p class='abv'>"), (size / 4).cast("string"), F.lit("% ABV</p>"))),
        F.lit("<p class='ibu'>"),
        F.when(size % 2 == 0, "N/A IBU").otherwise(F.concat(size.cast("string"), F.lit(" IBU"))),
        F.lit("</p><span class='num'>("),
        (size / 10).cast("string"),
        F.lit(")</span><p class='raters'>"),
        size.cast("string"),
        F.lit(",234 Ratings</p></div>"),
    )
    pages = dealt(read(spark, sf_dir, "part")).select(F.col("p_partkey").alias("url"), F.when(k != 6, page).otherwise("<div class='name'><b>gone").alias("html"))
    facts = details.products(pages, "https://pages.example")
    columns = ("product_name", "producer_name", "producer_url", "style", "label", "abv_value", "ibu_value", "rating_value", "rating_count_value")
    return facts.select(F.col("url").alias("page_id"), *columns)


@query(
    """SELECT s_suppkey AS page_id, s_name AS producer_name, n_name AS location, CASE WHEN s_suppkey % 2 = 0 THEN 'Micro Brewery' END AS producer_type,
    CASE s_suppkey % 3 WHEN 0 THEN 'https://pages.example/brewery_logos/' || s_suppkey WHEN 1 THEN '/basic/' || s_suppkey END AS logo,
    'https://maker.example/' || s_suppkey AS website, CAST(s_suppkey AS BIGINT) * 1000 + 7 AS total_products_value, CAST(s_nationkey AS BIGINT) AS rating_count_value
    FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
)
def producer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    shared = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("brewery_logos/"), key)).otherwise("plain.png")
    page = F.concat(
        F.lit("<head><meta property='og:image' content='https://pages.example/"),
        shared,
        F.lit("'></head><div class='basic'>"),
        F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("<img src='/basic/"), key, F.lit("'>"))).otherwise(""),
        F.lit("<div><h1>"),
        F.col("s_name"),
        F.lit("</h1><p>Subsidiary of Somebody<p>123<p> "),
        F.col("n_name"),
        F.lit(" <p>"),
        F.when(F.col("s_suppkey") % 2 == 0, "Micro Brewery").otherwise(F.col("n_name")),
        F.lit("</div></div><div class=social><a href='/x'>Mail</a><a href='https://maker.example/"),
        key,
        F.lit("'><i class='fa-globe'></i></a></div><div class='stats'><div class='item'><b class='title'>Total Beers</b><b class='count'>"),
        F.format_number(F.col("s_suppkey") * 1000 + 7, 0),
        F.lit("</b></div><div class='item'><b class='title'>Ratings</b><b class='count'>"),
        F.col("s_nationkey").cast("string"),
        F.lit("</b></div><div class='item'><b class='title'>Odd</b></div></div>"),
    )
    made = dealt(read(spark, sf_dir, "supplier")).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    facts = details.producers(made.select(F.col("s_suppkey").alias("url"), page.alias("html")))
    columns = ("producer_name", "location", "producer_type", "logo", "website", "total_products_value", "rating_count_value")
    return facts.select(F.col("url").alias("page_id"), *columns)


# Answers of models: each part's answer in one of eight shapes, with talk and broken objects around it

_OBJECT_SQL = """concat('{"brewery_name_en": "', p_brand, '", "beer_name_en": "  ', p_name, ' ", "beer_name_jp": ', p_size, ', "search_hint": " ", "product_type": "',
    CASE p_size % 4 WHEN 0 THEN 'beer' WHEN 1 THEN 'other' WHEN 2 THEN 'glass' ELSE 'keg' END, '", "is_set": ',
    CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN '0' ELSE '"yes"' END, ', "queries": ["q', p_size, '", 7, " ", "', p_type, '"], "selected_index": ', p_size % 5 - 1, '}')"""


@query(
    f"""SELECT p_partkey, k BETWEEN 0 AND 5 AS has_object, CASE WHEN k < 6 THEN o END AS object, CASE WHEN k < 6 THEN p_brand END AS producer_en,
    CASE WHEN k < 6 THEN p_name END AS name_en, CAST(NULL AS VARCHAR) AS name_jp, CAST(NULL AS VARCHAR) AS search_hint,
    CASE WHEN k < 6 THEN CASE p_size % 4 WHEN 2 THEN 'glass' WHEN 1 THEN CASE WHEN p_size % 3 = 1 THEN 'beer' ELSE 'set' END ELSE 'beer' END ELSE 'beer' END AS product_type,
    CASE WHEN k < 6 THEN p_size % 3 <> 1 ELSE false END AS is_set, CASE WHEN k < 6 THEN concat('q', p_size, '|', p_type) END AS queries,
    CASE WHEN k < 6 THEN p_size % 5 - 1 END AS selected_index
    FROM (SELECT *, p_partkey % 8 AS k, {_OBJECT_SQL} AS o FROM part)"""
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 8, F.col("p_size")
    digits, quote = size.cast("string"), F.lit('"')
    kind = F.when(size % 4 == 0, "beer").when(size % 4 == 1, "other").when(size % 4 == 2, "glass").otherwise("keg")
    is_set = F.when(size % 3 == 0, "true").when(size % 3 == 1, "0").otherwise('"yes"')
    said = F.concat(
        F.lit('{"brewery_name_en": "'), "p_brand", F.lit('", "beer_name_en": "  '), "p_name", F.lit(' ", "beer_name_jp": '), digits,
        F.lit(', "search_hint": " ", "product_type": "'), kind, F.lit('", "is_set": '), is_set, F.lit(', "queries": ["q'), digits,
        F.lit('", 7, " ", "'), "p_type", F.lit('"], "selected_index": '), (size % 5 - 1).cast("string"), F.lit("}"),
    )
    answer = (
        F.when(k == 0, said)
        .when(k == 1, F.concat(F.lit("```json\n"), said, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Here's {what} I \"found: {} "), said, F.lit(" Hope that {helps}!")))
        .when(k == 3, F.concat(F.lit('{"draft": '), F.substring(said, 1, 40), quote, F.lit(" no, rather: "), said))
        .when(k == 4, F.concat(F.lit('[{"a": 1}, '), said))
        .when(k == 5, F.concat(said, F.lit("}}} ]"), said))
        .when(k == 6, F.substring(said, 1, 60))
    )
    rows = dealt(read(spark, sf_dir, "part")).select("p_partkey", "p_name", answer.alias("answer"))
    found = answers.extraction(answers.read_answers(rows), "p_name")
    return found.select(
        "p_partkey", F.col("object").isNotNull().alias("has_object"), "object", "producer_en", "name_en", "name_jp", "search_hint", "product_type", "is_set",
        F.array_join("queries", "|").alias("queries"), "selected_index",
    )


@query(
    f"""SELECT p_partkey, nth, maker, name FROM (
      SELECT p_partkey, 1 AS nth, CAST(NULL AS VARCHAR) AS maker, concat('q', p_size) AS name, p_size >= 10 AS fits FROM part
      UNION ALL SELECT p_partkey, CASE WHEN p_size >= 10 THEN 2 ELSE 1 END, NULL, p_type, true FROM part
      UNION ALL SELECT p_partkey, 0, p_brand, p_name, p_size % 2 = 0 FROM part) WHERE fits"""
)
def suggested_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.when(F.col("p_size") % 2 == 0, "Maker-Slug").otherwise("")
    said = F.to_json(
        F.struct(
            F.col("p_brand").alias("english_brewery_name"), slug.alias("brewery_slug"), F.col("p_name").alias("english_beer_name"),
            F.array(F.concat(F.lit("q"), F.col("p_size").cast("string")), F.lit("  "), "p_type").alias("queries"),
        )
    )
    rows = dealt(read(spark, sf_dir, "part")).select("p_partkey", F.concat(F.lit("```"), said, F.lit("```")).alias("answer"))
    return answers.queries_to_try(answers.read_answers(rows, noisy=False), "p_partkey")


# List pages of four shops, thirty parts a page: two JSON shops, two HTML layouts

_LISTED = "(SELECT *, p_partkey % 4 AS s, CAST(p_partkey // 120 AS INTEGER) AS page, row_number() OVER (PARTITION BY p_partkey % 4, p_partkey // 120 ORDER BY p_partkey) - 1 AS pos FROM part)"
SHOPS = [
    replace(shops.LAYOUTS["products.json by update"], shop="one", base_url="https://one.example"),
    replace(shops.LAYOUTS["products.json by publication"], shop="two", base_url="https://two.example"),
    replace(shops.LAYOUTS["inner boxes"], shop="three", base_url="https://three.example"),
    replace(shops.LAYOUTS["collection"], shop="four", base_url="https://four.example"),
]


_SHOP_OFFERS_SQL = f"""SELECT ['one', 'two', 'three', 'four'][s + 1] AS shop, page, CAST(pos AS INTEGER) AS pos,
    CASE s WHEN 2 THEN concat('https://three.example/shopdetail/', p_partkey) ELSE concat('https://', ['one', 'two', '', 'four'][s + 1], '.example/products/h', p_partkey) END AS url,
    CASE WHEN s = 3 AND p_size % 2 = 0 THEN concat('[', p_brand, '] ', p_name) ELSE p_name END AS name,
    CASE s WHEN 2 THEN concat(p_size, ',000円') WHEN 3 THEN concat(p_size, '500円') ELSE concat(p_size * 100, '円') END AS price,
    CASE WHEN s < 2 THEN concat('//cdn/', p_partkey) WHEN s = 2 THEN concat('https://three.example/i/', p_partkey) ELSE concat('https://cdn/', p_partkey) END AS image,
    CASE WHEN p_size % 3 = 0 THEN 'Sold Out' ELSE 'In Stock' END AS stock_status,
    CASE WHEN s = 0 AND p_size % 2 = 0 THEN TIMESTAMP '2025-03-01 10:00:00' WHEN s < 2 THEN TIMESTAMP '2025-01-02 00:30:00' END AS first_seen
    FROM {_LISTED} WHERE s <> 0 OR p_size % 5 <> 0"""


def _shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    out = size % 3 == 0
    product = F.struct(
        F.col("p_name").alias("title"), F.concat(F.lit("h"), key).alias("handle"),
        F.when(size % 5 == 0, F.array(F.lit("cheese"))).otherwise(F.array(F.lit("x"), F.lit("Craft Beer"))).alias("tags"),
        F.when(size % 2 == 0, "2025-03-01T12:00:00+02:00").otherwise("no time").alias("updated_at"), F.lit("2025-01-02T00:30:00Z").alias("published_at"),
        F.array(F.struct(F.concat((size * 100).cast("string"), F.lit(".00")).alias("price"), (~out).alias("available")), F.struct(F.lit("1").alias("price"), F.lit(False).alias("available"))).alias("variants"),
        F.array(F.struct(F.concat(F.lit("//cdn/"), key).alias("src"))).alias("images"),
    )
    box = F.concat(
        F.lit("<div class='innerBox'><div class='imgWrap'><a href='/shopdetail/"), key, F.lit("/all_items/page1/'><img src='/i/"), key, F.lit("'></a></div><div class='detail'><p class='name'>"),
        "p_name", F.lit("<p class='price'>"), size.cast("string"), F.lit(",000円</p>"), F.when(out, "<p class='quantity'>sold out</p>").otherwise("<p class='quantity'>10 left"), F.lit("</div></div>"),
    )
    card = F.concat(
        F.lit("<li class='--collection-product-item'><a href='/products/h"), key, F.lit("'><img data-src='//cdn/"), key, F.lit("'></a><div class='--item-card-brand-name'>"),
        F.when(size % 2 == 0, F.col("p_brand")).otherwise("four"), F.lit("</div><b class='--item-card-title'>"), "p_name", F.lit("</b><i class='price-item'>¥"), size.cast("string"),
        F.lit(",500 税込</i>"), F.when(out, "<u>SOLD OUT</u>").otherwise(""), F.lit("</li>"),
    )
    shop = F.element_at(F.array(*(F.lit(rule.shop) for rule in SHOPS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    html_item = F.when(F.col("p_partkey") % 4 == 2, box).otherwise(card)
    parts = read(spark, sf_dir, "part").select("p_partkey", shop.alias("shop"), F.floor(F.col("p_partkey") / 120).cast("int").alias("page"), product.alias("product"), html_item.alias("item"))
    listed = parts.groupBy("shop", "page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "product", "item"))).alias("all"))
    as_json = F.to_json(F.struct(F.transform("all", lambda p: p.product).alias("products")))
    as_html = F.concat(F.lit("<ul>"), F.array_join(F.transform("all", lambda p: p.item), "\n"), F.lit("<li>end"))
    body = F.when(F.col("shop").isin("one", "two"), as_json).otherwise(as_html)
    return listed.select("shop", "page", F.encode(body, "utf-8").alias("body"))


@query(_SHOP_OFFERS_SQL)
def shop_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a JSON page's place counts all its products, also those that aren't wanted
    found = shops.offers(_shop_pages(spark, sf_dir), SHOPS)
    return found.withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz"))


@query(
    """SELECT o_orderkey, TIMESTAMP '2001-01-01' + to_seconds(CAST(left(o_orderpriority, 1) AS INTEGER) - 1)
      + to_microseconds(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey DESC) - 1) AS seen FROM orders"""
)
def scan_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.left("o_orderpriority", F.lit(1)).cast("int") - 1
    base = F.lit(datetime.datetime(2001, 1, 1)).cast("timestamp_ntz")
    timed = ingest.scan_times(read(spark, sf_dir, "orders"), base, place, "o_orderpriority", F.desc("o_orderdate"), F.col("o_orderkey"))
    return timed.select("o_orderkey", "seen")


@query(
    """SELECT p_partkey AS url, CASE WHEN p_size % 7 <> 0 THEN p_name END AS name,
    CASE p_size % 3 WHEN 0 THEN concat(p_size, '100円') WHEN 1 THEN concat(p_size, '000円') END AS price FROM part"""
)
def offer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    tag = F.when(size % 2 == 0, "h2 class='productTitle'").when(size % 7 == 0, "h3").otherwise("h2 class='title x'")
    price = F.when(size % 3 == 0, F.concat(F.lit("<p class='sale_price'>1 本 税込: ¥"), size.cast("string"), F.lit(",100</p>"))).when(
        size % 3 == 1, F.concat(F.lit("<p class='sale_price'>¥ "), size.cast("string"), F.lit(",000 <b>税抜</b></p>"))
    )
    title = F.when((size % 7 == 0) & (size % 2 == 0), F.lit("<h2>none</h2>")).otherwise(F.concat(F.lit("<"), tag, F.lit("> "), "p_name", F.lit(" ¥1,234 (税込)</h2>")))
    page = F.concat(F.lit("<body>"), title, F.coalesce(price, F.lit("<p>no price</p>")))
    return details.offers(dealt(read(spark, sf_dir, "part")).select(F.col("p_partkey").alias("url"), page.alias("html")))


# A scan of these shops into a state that knows half of their offers: some sold out, some gone from the pages

_KNOWN_SQL = f"""found AS ({_SHOP_OFFERS_SQL}),
state AS (SELECT url, 1.0 AS price_value, CASE WHEN pos % 3 = 0 THEN 'Sold Out' ELSE 'In Stock' END AS stock_status, TIMESTAMP '2020-01-01' AS first_seen, TIMESTAMP '2020-02-02' AS last_seen,
    CASE WHEN pos % 2 = 0 THEN concat('/b/', pos) END AS product_url, 'old' AS name, 'old' AS price, NULL AS image, shop FROM found WHERE page % 2 = 0
  UNION ALL SELECT concat('https://gone.example/', n_nationkey), 1.0, 'In Stock', TIMESTAMP '2020-01-01', TIMESTAMP '2020-02-02', NULL, 'old', 'old', NULL, 'one' FROM nation),
timed AS (SELECT *, TIMESTAMP '2026-01-01' + to_seconds(list_position(['one', 'two', 'three', 'four'], shop) - 1)
    + to_microseconds(row_number() OVER (PARTITION BY shop ORDER BY page DESC, pos DESC) - 1) AS seen FROM found)"""
_SCAN_SQL = f"""WITH {_KNOWN_SQL}, joined AS (
  SELECT coalesce(n.url, o.url) AS url, n.url IS NULL AS gone, CASE WHEN n.url IS NULL THEN 'absent' WHEN o.url IS NULL THEN 'new' WHEN o.stock_status = 'Sold Out' AND n.stock_status = 'In Stock' THEN 'restock' ELSE 'seen' END AS change,
    n.price AS np, n.stock_status AS ns, n.first_seen AS nf, n.seen, n.name AS nn, n.image AS ni, n.shop AS nsh, o.* EXCLUDE (url) FROM timed n FULL OUTER JOIN state o ON n.url = o.url)
SELECT url, CASE WHEN gone THEN price_value ELSE CAST(regexp_replace(np, '[^0-9]', '', 'g') AS DOUBLE) END AS price_value, CASE WHEN gone THEN stock_status ELSE ns END AS stock_status,
  CASE WHEN gone THEN first_seen WHEN nf IS NOT NULL THEN nf WHEN change = 'seen' THEN first_seen ELSE seen END AS first_seen,
  CASE WHEN gone THEN last_seen ELSE TIMESTAMP '2026-01-01' END AS last_seen, product_url, CASE WHEN gone THEN name ELSE nn END AS name, CASE WHEN gone THEN price ELSE np END AS price,
  CASE WHEN gone THEN image ELSE ni END AS image, CASE WHEN gone THEN shop ELSE nsh END AS shop, change FROM joined"""


def _scan(spark: SparkSession, sf_dir: str) -> scanning.Scan:
    found = checkpointed(shops.offers(_shop_pages(spark, sf_dir), SHOPS))  # the pages are read once, for the scan and for what is known
    known = found.where("page % 2 = 0")
    time = lambda day: F.lit(day).cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    old = known.select(
        "url", F.lit(1.0).alias("price_value"), F.when(F.col("pos") % 3 == 0, "Sold Out").otherwise("In Stock").alias("stock_status"), time("2020-01-01").alias("first_seen"), time("2020-02-02").alias("last_seen"),
        F.when(F.col("pos") % 2 == 0, F.concat(F.lit("/b/"), F.col("pos").cast("string"))).alias("product_url"), F.lit("old").alias("name"), F.lit("old").alias("price"), none.alias("image"), "shop",
    )
    gone = read(spark, sf_dir, "nation").select(
        F.concat(F.lit("https://gone.example/"), F.col("n_nationkey").cast("string")).alias("url"), F.lit(1.0).alias("price_value"), F.lit("In Stock").alias("stock_status"), time("2020-01-01").alias("first_seen"),
        time("2020-02-02").alias("last_seen"), none.alias("product_url"), F.lit("old").alias("name"), F.lit("old").alias("price"), none.alias("image"), F.lit("one").alias("shop"),
    )
    return scanning.merged(found, SHOPS, old.unionByName(gone), time("2026-01-01"))


@query(_SCAN_SQL)
def scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).state


@query(
    f"""SELECT shop, count(*) FILTER (WHERE change = 'new') AS "new", count(*) FILTER (WHERE change = 'restock') AS restocked, count(*) FILTER (WHERE change = 'seen') AS seen,
    count(*) FILTER (WHERE change <> 'absent') AS written FROM ({_SCAN_SQL}) GROUP BY shop"""
)
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).statistics
