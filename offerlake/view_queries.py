"""Further registered queries over the views, and over a run's small steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions import display, text
from offerlake.operators import catalog, dictionary, ingest, linkage, stock
from offerlake.plans.roles import dealt
from offerlake.queries import ROLES, SCORE_TABLE, groups, query, read, wide
from offerlake.sources import html


@query(
    f"""WITH {ROLES} SELECT producer_name, location, search_text, row_number() OVER (ORDER BY lower(producer_name), producer_name) AS place FROM (
    SELECT producer_name, arg_min(location, url) FILTER (WHERE location <> '') AS location,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(list(DISTINCT title_producer_jp) FILTER (WHERE title_producer_jp IS NOT NULL), []), coalesce(list(DISTINCT title_producer_en) FILTER (WHERE title_producer_en IS NOT NULL), [])))), ' ') AS search_text
    FROM wide WHERE producer_name <> '' GROUP BY producer_name)"""
)
def producer_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.producer_options(wide(spark, sf_dir)).select("producer_name", "location", "search_text", "place")


@query(f"WITH {ROLES} SELECT count(DISTINCT shop) AS shops, count(*) AS total, count(*) FILTER (WHERE shop = '5-LOW') AS low FROM wide WHERE shop IS NOT NULL")
def shop_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.shop_counts(wide(spark, sf_dir)).select(F.size("counts").cast("long").alias("shops"), "total", F.col("counts")["5-LOW"].alias("low"))


@query(
    f"""WITH {ROLES} SELECT product_url, coalesce(max(product_image), nullif(arg_min(shown, row(price_value IS NULL, price_value, url)), ''), 'no-image') AS image
    FROM (SELECT *, coalesce(image, '') AS shown FROM wide) WHERE product_url IS NOT NULL AND product_url NOT LIKE '%/search?%' GROUP BY product_url"""
)
def group_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("product_url", display.group_image(F.col("product_image"), F.col("items")).alias("image"))


@query(f"WITH {ROLES} SELECT url FROM wide WHERE (product_url IS NULL OR product_url ILIKE '%/SEARCH?%') AND coalesce(product_type, 'beer') = 'beer'")
def to_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.to_link(wide(spark, sf_dir).withColumn("product_url", F.replace("product_url", F.lit("/search?"), F.lit("/Search?")))).select("url")


@query(
    """WITH c AS (SELECT user_id AS url, event_type, props, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT c_custkey AS url, coalesce(c.event_type, CASE WHEN c_custkey % 2 = 0 THEN 'In Stock' END) AS stock_status,
    CASE WHEN c.url IS NOT NULL AND c_custkey % 3 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE c_acctbal END AS price_value, c.ts AS last_seen FROM customer LEFT JOIN c ON c.url = c_custkey"""
)
def stock_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    offers = read(spark, sf_dir, "customer").select(
        key.alias("url"), F.when(key % 2 == 0, "In Stock").alias("stock_status"), F.col("c_acctbal").alias("price_value"), F.lit(None).cast(read(spark, sf_dir, "events").schema["ts"].dataType).alias("last_seen")
    )
    checks = ingest.keep_last(read(spark, sf_dir, "events"), "user_id", F.col("ts"), F.col("event_id")).select(
        F.col("user_id").alias("url"), F.col("event_type").alias("status"), F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("double")).alias("price"), F.col("ts").alias("checked_at")
    )
    return ingest.apply_stock_checks(offers, checks).select("url", "stock_status", "price_value", "last_seen")


@query(
    """SELECT p_partkey AS url, concat('b', p_partkey) AS product_url, CASE p_size % 4 WHEN 0 THEN 'mango' ELSE '' END AS only_ours, CASE p_size % 4 WHEN 1 THEN 'coffee' ELSE '' END AS only_theirs
    FROM part WHERE p_size % 4 IN (0, 1)"""
)
def wrong_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a variant on our side; one before the name on theirs; both the same; none
    k = F.col("p_size") % 4
    name = F.concat("p_name", F.when(k == 0, " Mango").when(k == 2, " with Coffee").otherwise(""))
    other = F.concat(F.when(k == 1, "Coffee ").when(k == 2, "Coffee ").otherwise(""), "p_name")
    linked = dealt(read(spark, sf_dir, "part")).select(F.col("p_partkey").alias("url"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("product_url"), name.alias("name"), other.alias("product_name"))
    return linkage.wrong_variants(linked)


@query("SELECT p_partkey AS page_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'name' ELSE 'price' END AS class, CASE pos WHEN 0 THEN p_name ELSE concat(p_size, '円 & more') END AS text FROM part, range(0, 2) AS r(pos)")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("<div><p class='x'>no</p><b class='big name'> "), "p_name", F.lit("</b><i class='price'>"), F.col("p_size").cast("string"), F.lit("円 <u>&amp;</u> more</i>"))
    return html.page_blocks(dealt(read(spark, sf_dir, "part")).select(F.col("p_partkey").alias("page_id"), page.alias("html")), ["name", "price"])


_PAIRS = "(VALUES " + ", ".join(f"({n}, {row[5]})" for n, row in enumerate(SCORE_TABLE)) + ") AS t(n, score)"


@query(f"SELECT p_partkey, score FROM part JOIN {_PAIRS} ON n = p_partkey % {len(SCORE_TABLE)}")
def score_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part under one of the pairs of names whose scores are known; each distinct pair is scored once."""
    schema = "n int, product_name string, producer_name string, style string, name string, maker string"
    forms = spark.createDataFrame([(n, *row[:5]) for n, row in enumerate(SCORE_TABLE)], schema)
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(SCORE_TABLE)).cast("int").alias("n")).join(F.broadcast(forms), "n")
    return linkage.scored(rows).select("p_partkey", "score")


@query("SELECT p_partkey, p_name AS shown, concat(p_name, ' & <') AS plain, lower(replace(p_name, ' ', '')) AS key FROM part")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        display.shown_name(F.lit("/b/1"), F.lit("beer"), name, F.lit("other")).alias("shown"),
        html.unescape(F.concat(name, F.lit(" &amp; &lt;"))).alias("plain"),
        text.key(name).alias("key"),
    )


@query(
    """SELECT lower(key) AS key, max(entity) AS entity FROM (SELECT p_brand AS entity, unnest([p_brand, concat(p_brand, ' Co'), p_type]) AS key FROM part) GROUP BY lower(key)"""
)
def alias_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    named = part.groupBy("p_brand").agg(F.concat(F.array(F.concat("p_brand", F.lit(" Co")), F.lit("  ")), F.array_sort(F.collect_set("p_type"))).alias("aliases"))
    files = named.select(F.to_json(F.map_from_arrays(F.array("p_brand"), F.array("aliases"))).alias("text"))
    return dictionary.aliases_in(files.unionByName(part.select(F.lit("{broken").alias("text")).limit(3)), "text")


@query(f"WITH {ROLES} SELECT url, last_seen FROM wide WHERE stock_status <> 'Sold Out' AND shop IN ('1-URGENT', '5-LOW') ORDER BY last_seen NULLS FIRST, url LIMIT 100")
def stock_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.to_check(wide(spark, sf_dir), 100, ("1-URGENT", "5-LOW")).select("url", "last_seen")


@query(
    """WITH old AS (SELECT n_nationkey AS entity, CASE WHEN n_nationkey % 3 <> 0 THEN concat('/w/', n_nationkey) END AS url, n_name AS name_en, 'old' AS location FROM nation),
    pages AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN concat('/w/', n_nationkey) WHEN 1 THEN concat('/w/', n_nationkey) WHEN 2 THEN concat('/vanity/', n_nationkey) ELSE concat('/new/', n_nationkey) END AS url,
      CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN concat(n_name, ' renamed') WHEN 2 THEN n_name ELSE concat('fresh ', n_nationkey) END AS name_en FROM nation)
    SELECT entity, CASE WHEN up THEN p.url ELSE old.url END AS url, CASE WHEN up THEN p.name_en ELSE old.name_en END AS name_en, CASE WHEN up THEN 'new' ELSE 'old' END AS location, CASE WHEN up THEN 'updated' ELSE 'kept' END AS change
    FROM (SELECT *, CASE entity % 4 WHEN 0 THEN true WHEN 1 THEN url IS NOT NULL WHEN 2 THEN url IS NULL ELSE false END AS up FROM old) old JOIN pages p ON p.k = entity
    UNION ALL SELECT NULL, url, name_en, 'new', 'inserted' FROM pages WHERE k % 4 = 3 OR (k % 4 = 1 AND k % 3 = 0)"""
)
def merged_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, k = F.col("n_nationkey"), F.col("n_nationkey") % 4
    nation, none = read(spark, sf_dir, "nation"), F.lit(None).cast("string")
    at = lambda place: F.concat(F.lit(place), key.cast("string"))
    empty = [none.alias(c) for c in ("producer_type", "website", "logo")]
    old = nation.select(key.alias("entity"), F.when(key % 3 != 0, at("/w/")).alias("url"), F.col("n_name").alias("name_en"), F.lit("old").alias("location"), *empty, F.lit(None).cast("timestamp").alias("updated_at"))
    name = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat("n_name", F.lit(" renamed"))).when(k == 2, F.col("n_name")).otherwise(at("fresh "))
    pages = nation.select(F.when(k < 2, at("/w/")).when(k == 2, at("/vanity/")).otherwise(at("/new/")).alias("url"), name.alias("producer_name"), F.lit("new").alias("location"), *empty)
    merged = dictionary.merge_producers(old, pages, F.lit("2001-01-01").cast("timestamp"))
    return merged.select("entity", "url", "name_en", "location", "change")
