"""The registered queries of the library's own operators, with equivalent DuckDB SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions import display, matching, text, titles
from offerlake.operators import catalog, dictionary, ingest, keys, linkage, search, stock
from offerlake.plans.roles import benchmark_roles, dealt, read
from offerlake.plans.spec import SearchSpec
from offerlake.sources import html, json_api

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime.datetime(1998, 8, 2)

#: The roles of `plans.roles.benchmark_roles`, and the views, in SQL.
ROLES = r"""
offers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS url,
    concat(o_orderpriority, ' lot ', o_custkey % 97, CASE WHEN o_orderkey % 13 = 0 THEN ' 20% OFF'
      WHEN o_orderkey % 17 = 0 THEN ' SALE!!' WHEN o_orderkey % 19 = 0 THEN ' sale' WHEN o_orderkey % 23 = 0 THEN ' (賞味期限間近)' ELSE '' END) AS name,
    o_totalprice AS price_value, concat(CAST(floor(o_totalprice) AS BIGINT), '円') AS price,
    CASE WHEN o_orderstatus = 'F' THEN 'In Stock' WHEN o_orderstatus = 'O' THEN 'Sold Out'
      WHEN o_orderkey % 2 = 0 THEN 'Dead Link' END AS stock_status,
    o_orderpriority AS shop, o_orderdate AS first_seen, o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS last_seen,
    CASE WHEN o_orderkey % 5 <> 0 THEN concat('/img/', o_orderkey) END AS image,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN concat('/search?q=', o_custkey)
      ELSE CAST(o_custkey AS VARCHAR) END AS product_url
  FROM orders
), extraction AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS url,
    CASE max(l_returnflag) WHEN 'A' THEN 'beer' WHEN 'N' THEN 'set' ELSE 'glass' END AS product_type,
    bool_or(l_linenumber > 6) AS is_set, CASE WHEN max(l_returnflag) <> 'N' THEN concat('品', max(l_returnflag)) END AS title_name_jp,
    concat('Maker ', max(l_linestatus)) AS title_producer_en, CASE WHEN max(l_linestatus) = 'F' THEN '醸造F' END AS title_producer_jp, concat('Beer ', max(l_linenumber)) AS title_name_en
  FROM lineitem GROUP BY l_orderkey
), product AS (
  SELECT CAST(c_custkey AS VARCHAR) AS product_url, c_name AS product_name, c_mktsegment AS style,
    c_acctbal AS rating, (c_custkey % 140) / 10 AS abv, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 120 END AS ibu,
    c_custkey * 7 % 1000 AS rating_count, CASE WHEN c_custkey % 4 <> 0 THEN concat('/label/', c_custkey) END AS product_image,
    CAST(c_nationkey AS VARCHAR) AS producer_url, TIMESTAMP '1998-07-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS fetched_at FROM customer
), producer AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS producer_url, n_name AS producer_name,
    CAST(n_regionkey AS VARCHAR) AS location, CASE WHEN n_nationkey % 2 = 0 THEN concat('醸造所', n_nationkey) END AS producer_name_jp,
    CASE n_nationkey % 3 WHEN 0 THEN 'Micro' WHEN 1 THEN 'Brew Pub' END AS producer_type, concat('/logo/', n_nationkey) AS producer_logo, CAST(n_nationkey AS BIGINT) AS producer_id
  FROM nation
), wide AS (
  SELECT o.*, regexp_matches(o.name, '(?i)[0-9.]+%\s*OFF|SALE|賞味期限') AS is_sale,
    nullif(regexp_extract(o.name, '[0-9.]+%\s*OFF|SALE!*'), '') AS sale_tag, nullif(regexp_extract(o.name, '賞味期限[^】)]+'), '') AS expiry_notice,
    e.product_type, e.is_set, p.product_name, p.style, p.rating, p.producer_url, r.producer_name, r.location,
    p.abv, p.ibu, p.rating_count, p.product_image, r.producer_name_jp, e.title_name_jp, e.title_producer_en, e.title_producer_jp, e.title_name_en,
    p.fetched_at, r.producer_type, r.producer_logo, r.producer_id
  FROM offers o LEFT JOIN extraction e ON o.url = e.url LEFT JOIN product p ON o.product_url = p.product_url
  LEFT JOIN producer r ON p.producer_url = r.producer_url
  WHERE o.stock_status IS DISTINCT FROM 'Dead Link'
), grouped AS (
  SELECT product_url, max(name) AS original_name, max(product_name) AS product_name, max(producer_name) AS producer_name,
    max(style) AS style, max(rating) AS rating, max(location) AS location, max(product_type) AS product_type,
    bool_or(is_set) AS is_set, bool_or(is_sale) AS is_sale, min(price_value) AS min_price, max(price_value) AS max_price,
    max(first_seen) AS newest_seen, count(*) AS total_items, max(abv) AS abv, max(ibu) AS ibu, max(rating_count) AS rating_count,
    max(product_image) AS product_image, max(producer_name_jp) AS producer_name_jp, max(title_name_jp) AS title_name_jp, max(sale_tag) AS sale_tag,
    max(expiry_notice) AS expiry_notice, max(producer_type) AS producer_type, max(producer_logo) AS producer_logo, max(fetched_at) AS fetched_at
  FROM wide WHERE product_url IS NOT NULL AND product_url NOT LIKE '%/search?%' GROUP BY product_url
)
"""
WIDE = "url, name, price_value, stock_status, shop, first_seen, product_url, is_sale, sale_tag, product_type, is_set, product_name, style, rating, producer_name, location, last_seen, image, abv, ibu, rating_count, product_image, producer_name_jp, title_name_jp, price, expiry_notice, title_producer_en, title_producer_jp, title_name_en, fetched_at, producer_type, producer_logo, producer_id"
GROUP = "product_url, original_name, product_name, producer_name, style, rating, location, product_type, is_set, is_sale, min_price, max_price, newest_seen, total_items, abv, ibu, rating_count, product_image, producer_name_jp, title_name_jp, sale_tag, expiry_notice, producer_type, producer_logo, fetched_at"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can express it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def columns(names: str) -> list[str]:
    return names.split(", ")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.wide_view(benchmark_roles(spark, sf_dir))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.group_view(wide(spark, sf_dir))


# Views


@query(f"WITH {ROLES} SELECT {WIDE} FROM wide")
def wide_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select(*columns(WIDE))


@query(f"WITH {ROLES} SELECT {GROUP} FROM grouped")
def group_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select(*columns(GROUP))


@query(
    f"""WITH {ROLES} SELECT product_url, string_agg(url, ',' ORDER BY price_value, url) AS urls
    FROM wide WHERE product_url IS NOT NULL AND product_url NOT LIKE '%/search?%' GROUP BY product_url"""
)
def group_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("product_url", F.array_join("items.url", ",").alias("urls"))


@query(
    f"""WITH {ROLES}, ok AS (SELECT DISTINCT product_url FROM wide WHERE stock_status = 'In Stock')
    SELECT {GROUP} FROM grouped SEMI JOIN ok USING (product_url) ORDER BY newest_seen DESC NULLS LAST, product_url LIMIT 20"""
)
def group_page_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = wide(spark, sf_dir)
    return search.search_groups(everything, catalog.group_view(everything), SearchSpec()).rows.select(*columns(GROUP))


# Filters

_ROW_FILTERS: dict[str, tuple[SearchSpec, str]] = {
    "filter_range": (SearchSpec(min_rating=5000.0, stock="all"), "rating >= 5000"),
    "filter_in": (
        SearchSpec(styles=("BUILDING", "MACHINERY"), shops=("1-URGENT", "5-LOW"), stock="all"),
        "style IN ('BUILDING', 'MACHINERY') AND shop IN ('1-URGENT', '5-LOW')",
    ),
    "filter_stock_and_type": (SearchSpec(product_type="set"), "stock_status = 'In Stock' AND product_type = 'set'"),
    "filter_sold_out": (SearchSpec(stock="sold_out"), "stock_status = 'Sold Out'"),
    "filter_search_any": (
        SearchSpec(search="lOt 1", stock="all"),
        " OR ".join(f"contains(lower(coalesce({c}, '')), 'lot 1')" for c in search.ROW_TEXT),
    ),
    "filter_link_missing": (SearchSpec(link="missing", stock="all"), "product_url IS NULL OR product_url LIKE '%/search?%'"),
    "filter_link_present": (SearchSpec(link="linked", stock="all"), "product_url IS NOT NULL AND product_url NOT LIKE '%/search?%'"),
    "filter_recent": (SearchSpec(days=300, as_of=AS_OF, stock="all"), "first_seen >= TIMESTAMP '1998-08-02' - INTERVAL 300 DAY"),
    "filter_sale": (SearchSpec(only_sale=True, stock="all"), "is_sale"),
    "filter_abv_ibu": (SearchSpec(min_abv=4.5, max_abv=9.0, min_ibu=20, max_ibu=80, stock="all"), "abv >= 4.5 AND abv <= 9 AND ibu >= 20 AND ibu <= 80"),
    "filter_producer": (SearchSpec(producers=("FRANCE", "NATION_3", "CHINA"), stock="all"), "producer_name IN ('FRANCE', 'NATION_3', 'CHINA')"),
}


def _row_filter(spec: SearchSpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search_rows(wide(spark, sf_dir), spec).matching.select(*columns(WIDE))

    return run


for _name, (_spec, _where) in _ROW_FILTERS.items():
    QUERIES[_name] = _row_filter(_spec)
    ORACLES[_name] = f"WITH {ROLES} SELECT {WIDE} FROM wide WHERE {_where}"

_IN_STOCK = "EXISTS (SELECT 1 FROM wide w WHERE w.product_url = g.product_url AND w.stock_status = 'In Stock'{})"
_HAS = "EXISTS (SELECT 1 FROM wide w WHERE w.product_url = g.product_url{})"
_ONE, _TWO = " AND w.shop = '1-URGENT'", " AND w.shop IN ('1-URGENT', '5-LOW')"
_GROUP_FILTERS: dict[str, tuple[SearchSpec, str]] = {
    "contains_item": (SearchSpec(shops=("1-URGENT",)), _IN_STOCK.format(_ONE)),
    "contains_not": (SearchSpec(stock="sold_out"), f"NOT {_IN_STOCK.format('')}"),
    "contains_not_in_shop": (SearchSpec(stock="sold_out", shops=("1-URGENT",)), f"NOT {_IN_STOCK.format(_ONE)} AND {_HAS.format(_ONE)}"),
    "contains_multi": (SearchSpec(shops=("1-URGENT", "5-LOW")), _IN_STOCK.format(_TWO)),
    "contains_shop": (SearchSpec(shops=("1-URGENT", "5-LOW"), stock="all"), _HAS.format(_TWO)),
    "search_groups_text": (SearchSpec(search="RaNcE", stock="all"), "contains(lower(coalesce(product_name, '')), 'rance') OR contains(lower(coalesce(producer_name, '')), 'rance')"),
    "filter_group_abv": (SearchSpec(min_abv=10.0, max_ibu=50, stock="all"), "g.abv >= 10 AND g.ibu <= 50"),
    "filter_group_having": (SearchSpec(min_rating=2000.0, styles=("BUILDING",), stock="all", only_sale=True), "g.rating >= 2000 AND g.style = 'BUILDING' AND g.is_sale"),
}


def _group_filter(spec: SearchSpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        everything = wide(spark, sf_dir)
        return search.search_groups(everything, catalog.group_view(everything), spec).matching.select(*columns(GROUP))

    return run


for _name, (_spec, _where) in _GROUP_FILTERS.items():
    QUERIES[_name] = _group_filter(_spec)
    ORACLES[_name] = f"WITH {ROLES} SELECT {GROUP} FROM grouped g WHERE {_where}"

_SORTED = {
    "newest": "first_seen DESC NULLS LAST",
    "price_asc": "price_value ASC NULLS LAST",
    "price_desc": "price_value DESC NULLS LAST",
    "rating_desc": "rating DESC NULLS LAST",
    "name_asc": "name ASC NULLS LAST",
    "abv_desc": "abv DESC NULLS LAST",
}


def _sorted_page(sort: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = SearchSpec(sort=sort, stock="all", page=3, limit=50)
        return search.search_rows(wide(spark, sf_dir), spec).rows.select(*columns(WIDE))

    return run


for _name, _by in _SORTED.items():
    QUERIES[f"sort_page_{_name}"] = _sorted_page(_name)
    ORACLES[f"sort_page_{_name}"] = f"WITH {ROLES} SELECT {WIDE} FROM wide ORDER BY {_by}, url LIMIT 50 OFFSET 100"


_SORTED_GROUPS = {
    "newest": "newest_seen DESC NULLS LAST",
    "price_asc": "min_price ASC NULLS LAST",
    "price_desc": "max_price DESC NULLS LAST",
    "rating_desc": "rating DESC NULLS LAST",
    "name_asc": "product_name ASC NULLS LAST",
    "abv_desc": "abv DESC NULLS LAST",
}


def _sorted_groups(sort: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        everything = wide(spark, sf_dir)
        spec = SearchSpec(sort=sort, stock="all", page=2, limit=30)
        return search.search_groups(everything, catalog.group_view(everything), spec).rows.select(*columns(GROUP))

    return run


for _name, _by in _SORTED_GROUPS.items():
    QUERIES[f"sort_groups_{_name}"] = _sorted_groups(_name)
    ORACLES[f"sort_groups_{_name}"] = f"WITH {ROLES} SELECT {GROUP} FROM grouped ORDER BY {_by}, product_url LIMIT 30 OFFSET 30"


@query(f"WITH {ROLES} SELECT {WIDE} FROM wide WHERE shop = '1-URGENT' AND stock_status <> 'Sold Out'")
def filter_eq_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).where("shop = '1-URGENT' AND stock_status <> 'Sold Out'").select(*columns(WIDE))


@query(
    f"""WITH {ROLES} SELECT product_url, url, last_seen, image, sale_tag, is_set, stock_status, price, expiry_notice FROM wide
    WHERE product_url IS NOT NULL AND product_url NOT LIKE '%/search?%'"""
)
def group_item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = groups(spark, sf_dir).select("product_url", F.explode("items").alias("item"))
    return items.select("product_url", *(f"item.{c}" for c in ("url", "last_seen", "image", "sale_tag", "is_set", "stock_status", "price", "expiry_notice")))


@query(f"WITH {ROLES} SELECT url, producer_name FROM wide ORDER BY producer_name ASC NULLS FIRST, url LIMIT 40 OFFSET 20")
def nulls_first_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(spark, sf_dir).select("url", "producer_name")
    return rows.orderBy(F.asc_nulls_first("producer_name"), "url").offset(20).limit(40)


# Facets and statistics


@query(f"WITH {ROLES} SELECT shop, count(*) AS n FROM wide WHERE stock_status = 'In Stock' AND style = 'BUILDING' GROUP BY shop")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shop_counts(wide(spark, sf_dir), SearchSpec(shops=("1-URGENT",), styles=("BUILDING",)))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type <> '' GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20")
def facet_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_values(read(spark, sf_dir, "part"), "p_type", 20)


@query(
    f"""WITH {ROLES} SELECT producer_name, max(location) AS location,
    coalesce(string_agg(DISTINCT style, ' ' ORDER BY style), '') AS search_text FROM wide WHERE producer_name IS NOT NULL GROUP BY producer_name"""
)
def facet_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.producer_facet(wide(spark, sf_dir))


@query(
    f"""WITH {ROLES} SELECT count(*) AS offers, count(DISTINCT shop) AS shops,
    count(*) FILTER (WHERE stock_status = 'In Stock') AS in_stock,
    count(*) FILTER (WHERE product_url IS NOT NULL AND product_url NOT LIKE '%/search?%') AS linked,
    string_agg(DISTINCT shop, '|' ORDER BY shop) AS shop_list, max(first_seen) AS newest FROM wide"""
)
def stats_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.statistics(wide(spark, sf_dir))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def reason_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_by(read(spark, sf_dir, "events"), "event_type")


@query(
    """SELECT p_name, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS keys
    FROM part GROUP BY p_name HAVING count(*) > 1"""
)
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.repeated_names(read(spark, sf_dir, "part"), "p_name", "p_partkey")


@query(
    """SELECT o_orderpriority, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 2) AS percent
    FROM orders GROUP BY o_orderpriority"""
)
def share_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.share_of_total(read(spark, sf_dir, "orders"), "o_orderpriority")


# Items of a group

_VISIBLE = f"""WITH {ROLES}, item AS (
  SELECT product_url, url, shop, price_value, last_seen, coalesce(stock_status, '') IN ('Sold Out') AS is_out
  FROM wide WHERE product_url IS NOT NULL AND product_url NOT LIKE '%/search?%'
), told AS (
  SELECT *, bool_or(NOT is_out) OVER (PARTITION BY product_url, shop) AS stocked,
    row_number() OVER (PARTITION BY product_url, shop, is_out ORDER BY last_seen DESC NULLS LAST,
      CASE WHEN price_value > 0 THEN price_value END ASC NULLS LAST, url) AS nth FROM item
)
SELECT product_url, url, shop, price_value, row_number() OVER (PARTITION BY product_url
  ORDER BY CASE WHEN price_value > 0 THEN price_value END ASC NULLS LAST, url) AS place
FROM told WHERE (NOT is_out OR (NOT stocked AND nth = 1))"""


@query(_VISIBLE)
def visible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = search.visible_items(groups(spark, sf_dir), "all")
    return shown.select("product_url", "url", "shop", "price_value", F.col("place").cast("long").alias("place"))


@query(f"SELECT product_url, url, price_value FROM ({_VISIBLE}) WHERE place = 1")
def cheapest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.visible_items(groups(spark, sf_dir), "all").where("place = 1").select("product_url", "url", "price_value")


@query(
    f"""WITH {ROLES} SELECT shop, url, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY shop
    ORDER BY first_seen DESC, url DESC) AS nth FROM wide) WHERE nth = 1"""
)
def latest_per_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.keep_last(wide(spark, sf_dir), "shop", F.col("first_seen"), F.col("url")).select("shop", "url", "first_seen")


# Ingest

_SPLIT = "1998-01-01"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as offers by user: an old state, the odd events, and a new snapshot, the even ones."""
    status = F.when(F.col("event_type").isin("error", "view"), "Sold Out").otherwise("In Stock")
    rows = read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("url"),
        F.col("value").alias("price_value"),
        status.alias("stock_status"),
        F.col("ts").alias("first_seen"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string"))).alias("product_url"),
    )
    old = rows.where("event_id % 2 = 1 AND cast(url AS bigint) % 10 <> 3").withColumn("last_seen", F.col("first_seen"))
    new = rows.where("event_id % 2 = 0 AND cast(url AS bigint) % 10 <> 4")
    last = lambda df: ingest.keep_last(df, "url", F.col("first_seen"), F.col("event_id")).drop("event_id")
    return last(old), last(new)


_SNAPSHOT_SQL = """
rows AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS url, value AS price_value, ts AS first_seen,
    CASE WHEN event_type IN ('error', 'view') THEN 'Sold Out' ELSE 'In Stock' END AS stock_status,
    CASE WHEN event_id % 5 <> 0 THEN concat('p', event_id % 9) END AS product_url FROM events
), old AS (
  SELECT * FROM rows WHERE event_id % 2 = 1 AND CAST(url AS BIGINT) % 10 <> 3
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY first_seen DESC, event_id DESC) = 1
), fresh AS (
  SELECT * FROM rows WHERE event_id % 2 = 0 AND CAST(url AS BIGINT) % 10 <> 4
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY first_seen DESC, event_id DESC) = 1
)"""
_MERGE_SQL = f"""WITH {_SNAPSHOT_SQL}, both_rows AS (
  SELECT coalesce(o.url, n.url) AS url, o.url IS NOT NULL AS known, n.url IS NOT NULL AS seen,
    CASE WHEN n.url IS NULL THEN 'absent' WHEN o.url IS NULL THEN 'new'
      WHEN o.stock_status = 'Sold Out' AND n.stock_status <> 'Sold Out' THEN 'restock' ELSE 'seen' END AS change,
    o.price_value AS op, n.price_value AS np, o.stock_status AS os, n.stock_status AS ns, o.first_seen AS ofs,
    n.first_seen AS nfs, o.product_url AS ou, n.product_url AS nu
  FROM old o FULL OUTER JOIN fresh n ON o.url = n.url)
SELECT url, CASE WHEN {{0}} THEN np ELSE op END AS price_value, CASE WHEN {{0}} THEN ns ELSE os END AS stock_status,
  CASE WHEN {{0}} AND nfs IS NOT NULL THEN nfs WHEN change IN ('new', 'restock') THEN TIMESTAMP '1998-08-02' ELSE ofs END AS first_seen,
  CASE WHEN {{0}} THEN TIMESTAMP '1998-08-02' ELSE ofs END AS last_seen, coalesce(ou, nu) AS product_url, change
FROM both_rows"""


@query(_MERGE_SQL.format("change <> 'absent'"))
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merge_offers(*_snapshots(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"))


@query(_MERGE_SQL.format("change IN ('new', 'restock')"))
def upsert_only_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merge_offers(*_snapshots(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"), only_new=True)


@query(
    """SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = ingest.keep_last(read(spark, sf_dir, "events"), "user_id", F.col("ts"), F.col("event_id"))
    return last.select("user_id", "event_id", "event_type")


@query("SELECT event_type AS service, CAST(ts AS DATE) AS day, count(*) AS requests FROM events GROUP BY ALL")
def usage_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("service"), F.to_date("ts").alias("day"))
    state = ingest.add_usage(spark.createDataFrame([], "service string, day date, requests long"), calls.where("event_id % 3 = 0"))
    return ingest.add_usage(state, calls.where("event_id % 3 <> 0"))


_EVENTS_SQL = "e AS (SELECT CAST(user_id AS VARCHAR) AS url, event_type = 'purchase' AS ok, event_type AS reason, ts AS tried FROM events)"
_LEDGER_SQL = f"""WITH {_EVENTS_SQL}, solved AS (SELECT url, max(tried) FILTER (WHERE ok) AS solved_at FROM e GROUP BY url),
bad AS (SELECT e.url, count(*) AS attempts, arg_max(reason, (tried, reason)) AS reason, min(tried) AS first_at, max(tried) AS last_at
  FROM e JOIN solved s ON e.url = s.url WHERE NOT ok AND (solved_at IS NULL OR tried > solved_at) GROUP BY e.url)
SELECT s.url, coalesce(attempts, 0) AS attempts, reason, first_at, last_at, solved_at IS NOT NULL AND attempts IS NULL AS resolved
FROM solved s LEFT JOIN bad b ON s.url = b.url"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("url"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("reason"), F.col("ts").alias("at")
    )


_EMPTY_LEDGER = "url string, attempts long, reason string, first_at timestamp_ntz, last_at timestamp_ntz, resolved boolean"


@query(_LEDGER_SQL)
def failure_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.record_failures(spark.createDataFrame([], _EMPTY_LEDGER), _attempts(spark, sf_dir))


@query(
    f"""WITH ledger AS ({_LEDGER_SQL}) SELECT DISTINCT CAST(user_id AS VARCHAR) AS url FROM events
    WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT url FROM ledger WHERE NOT resolved AND (attempts >= 3 OR last_at >= TIMESTAMP '2024-01-20' - INTERVAL 3 DAY))"""
)
def anti_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = failure_ledger(spark, sf_dir)
    queue = _attempts(spark, sf_dir).select("url").distinct()
    return ingest.due(queue, ledger, F.lit(datetime.datetime(2024, 1, 20)).cast("timestamp_ntz"))


@query(
    """SELECT user_id, event_id, run_stop FROM (
      SELECT *, min(CASE WHEN run >= 3 THEN pos END) OVER (PARTITION BY user_id) AS run_stop FROM (
        SELECT *, sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, breaks ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
          SELECT *, event_type = 'view' AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
            sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS breaks
          FROM events))) WHERE run_stop IS NULL OR pos < run_stop""".replace("user_id, event_id, run_stop FROM (\n", "user_id, event_id FROM (\n", 1)
)
def scan_stop_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return ingest.stop_after_run(events, "user_id", F.col("event_type") == "view", 3, ["ts", "event_id"]).select("user_id", "event_id")


@query(
    """SELECT user_id, event_id, TIMESTAMP '1998-08-02' + to_seconds(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1) AS seen FROM events"""
)
def reverse_sequence_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit(AS_OF).cast("timestamp_ntz")
    return ingest.sequence_time(read(spark, sf_dir, "events"), start, "user_id", ["event_id"]).select("user_id", "event_id", "seen")


@query(
    """SELECT o_orderkey, coalesce(v, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN
    (SELECT l_orderkey, max(l_returnflag) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""
)
def update_from_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("value"))
    return ingest.update_from(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), pairs, "o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, CASE WHEN NOT p_name LIKE '%a%' THEN p_brand END AS p_brand FROM part")
def null_out_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clear_where(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("p_name").like("%a%"), "p_brand").drop("p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%e%' OR p_name IS NULL")
def delete_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.delete_like(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "%e%")


@query(
    r"""SELECT c_custkey, TRY_CAST(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits,
    TRY_CAST(nullif(regexp_replace(concat(c_name, '.5'), '[^0-9.]', '', 'g'), '') AS DOUBLE) AS num FROM customer"""
)
def numeric_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", text.price_digits(name).alias("digits"), text.number(F.concat(name, F.lit(".5"))).alias("num"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'set' WHEN lower(p_name) LIKE '%red%' THEN 'glass' ELSE 'beer' END AS kind FROM part")
def classify_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(F.col("p_size") > 40, "set"), (F.lower("p_name").like("%red%"), "glass")]
    return keys.classified(read(spark, sf_dir, "part"), "kind", cases, "beer").select("p_partkey", "kind")


# Joins and sets


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(keys, "o_custkey", "left_semi")


@query(
    """SELECT p.p_partkey, f.p_brand AS cached FROM part p LEFT JOIN (SELECT p_name, p_brand FROM part WHERE p_size > 25
    QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1) f ON p.p_name = f.p_name"""
)
def two_hop_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    found = keys.first_known(parts.select("p_partkey", "p_name"), parts.where("p_size > 25"), "p_name", "p_brand", "cached", "p_partkey")
    return found.select("p_partkey", "cached")


@query(
    """SELECT key, min(pos) AS pos FROM (SELECT o_orderkey AS key, 1 AS pos FROM orders WHERE o_totalprice > 200000
    UNION ALL SELECT l_orderkey, 2 FROM lineitem WHERE l_quantity > 49) GROUP BY key"""
)
def candidates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("key"))
    two = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("key"))
    return keys.first_source("key", one, two)


@query("SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return keys.missing_keys(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), lines, "key")


@query(
    """SELECT coalesce(a.k, b.k) AS key, a.k IS NOT NULL AS in_first FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a
    FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL"""
)
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    return keys.differing_keys(orders, "key", F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


# Dictionary


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as entities, with their words as aliases."""
    names = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name_en")).agg(F.min("p_partkey").alias("entity"))
    return names.select("entity", "name_en", F.lit(None).cast("string").alias("name_jp"), F.split("name_en", " ").alias("aliases"))


_ENTITIES = "ent AS (SELECT p_name AS name_en, min(p_partkey) AS entity FROM part GROUP BY p_name)"
_KEYS = f"{_ENTITIES}, names AS (SELECT entity, name_en AS n FROM ent UNION ALL SELECT entity, unnest(string_split(name_en, ' ')) FROM ent), keys AS (SELECT lower(trim(n)) AS key, max(entity) AS entity FROM names WHERE n <> '' GROUP BY 1)"


@query(f"WITH {_KEYS} SELECT p_partkey, entity FROM part LEFT JOIN keys ON lower(trim(split_part(p_name, ' ', 2))) = key")
def dictionary_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"))
    return dictionary.lookup(parts, "word", dictionary.entries(_entities(spark, sf_dir))).select("p_partkey", "entity")


_TERMS = "SELECT item_id, lower(t) AS key FROM (SELECT item_id, unnest(string_split(text, ' ')) AS t FROM benchmark) WHERE t <> ''"


@query(
    f"""WITH d AS (SELECT key, max(item_id) AS entity FROM ({_TERMS}) GROUP BY key), hit AS (
      SELECT doc_id, entity, key FROM documents JOIN d ON contains(lower(text), key))
    SELECT doc_id, entity, key FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, entity ORDER BY length(key) DESC, key) = 1"""
)
def dictionary_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("t")).where("t <> ''")
    keys = terms.groupBy(F.lower("t").alias("key")).agg(F.max("item_id").alias("entity"))
    return dictionary.find_in_texts(read(spark, sf_dir, "documents"), "doc_id", "text", keys)


@query(
    f"""WITH {_ENTITIES}, a AS (SELECT entity, unnest(string_split(name_en, ' ')) AS alias FROM ent),
    o AS (SELECT entity AS owner, lower(split_part(name_en, ' ', 1)) AS plain FROM ent)
    SELECT DISTINCT a.entity, alias, owner FROM a JOIN o ON lower(alias) = plain AND a.entity <> owner"""
)
def dictionary_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = _entities(spark, sf_dir)
    first = entities.withColumn("name_en", F.split_part("name_en", F.lit(" "), F.lit(1)))
    return dictionary.conflicts(first)


# Text


@query(
    r"""SELECT p_partkey, lower(regexp_replace(p_name, '[^\pL\pN]', '', 'g')) AS text_key,
    trim(regexp_replace(concat(p_name, ' 2', 100 + p_size), '\b20\d{2}\b', '', 'g')) AS plain,
    string_split(concat(p_name, ' x ', p_brand), ' x ')[2] AS second FROM part"""
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    dated = F.concat(name, F.lit(" 2"), (F.col("p_size") + 100).cast("string"))
    both = text.collaborators(F.concat(name, F.lit(" x "), F.col("p_brand")))
    return read(spark, sf_dir, "part").select("p_partkey", text.key(name).alias("text_key"), text.without_year(dated).alias("plain"), both[1].alias("second"))


_NAMES = "SELECT p_partkey, concat(p_name, CASE p_size % 5 WHEN 0 THEN ' DDH IPA' WHEN 1 THEN ' Coffee Imperial Stout' WHEN 2 THEN ' LR12 Sake' WHEN 3 THEN ' Brewing Co.' ELSE ' 30% OFF' END) AS t FROM part"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.create_map(*(F.lit(x) for x in (0, " DDH IPA", 1, " Coffee Imperial Stout", 2, " LR12 Sake", 3, " Brewing Co.", 4, " 30% OFF")))
    return dealt(read(spark, sf_dir, "part")).select("p_partkey", F.concat("p_name", ends[F.col("p_size") % 5]).alias("t"))


@query(
    rf"""SELECT p_partkey,
    CASE WHEN t LIKE '% DDH IPA' THEN trim(t[:-9]) WHEN t LIKE '% Imperial Stout' THEN trim(t[:-16]) WHEN t LIKE '% Sake' THEN trim(t[:-6]) END AS style_free,
    regexp_replace(t, ' Brewing Co\.$', '') AS producer_free,
    replace(replace(t, 'DDH', 'double dry hopped'), 'LR12', 'Limited Release 12') AS expanded,
    CASE WHEN t LIKE '%DDH%' THEN 'doubledryhopped' WHEN t LIKE '%Coffee%' THEN 'coffee' ELSE '' END AS variants,
    contains(t, '30% OFF') AS is_sale, nullif(regexp_extract(t, '[0-9.]+%\s*OFF'), '') AS sale_tag FROM ({_NAMES})"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _names(spark, sf_dir).select(
        "p_partkey",
        text.strip_style(t).alias("style_free"),
        text.strip_producer(t).alias("producer_free"),
        text.expand_abbreviations(t).alias("expanded"),
        F.array_join(text.variants(t), ",").alias("variants"),
        text.is_sale(t).alias("is_sale"),
        text.sale_tag(t).alias("sale_tag"),
    )


# Sources


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    """SELECT concat('https://shop/', p_partkey) AS url, p_name AS name, concat(CAST(floor(p_retailprice) AS BIGINT), '円') AS price,
    CASE WHEN p_size > 25 THEN 'In Stock' ELSE 'Sold Out' END AS stock_status, concat(p_brand, '.png') AS image, 'json shop' AS shop,
    TIMESTAMP '2024-01-02 03:04:05' AS first_seen FROM part"""
)
def json_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.struct(
        F.col("p_name").alias("title"),
        F.col("p_partkey").cast("string").alias("handle"),
        F.lit("no time").alias("updated_at"),
        F.lit("2024-01-02T03:04:05Z").alias("published_at"),
        F.array(F.struct(F.format_string("%.2f", "p_retailprice").alias("price"), (F.col("p_size") > 25).alias("available"))).alias("variants"),
        F.array(F.struct(F.concat("p_brand", F.lit(".png")).alias("src"))).alias("images"),
    )
    raw = read(spark, sf_dir, "part").select(F.to_json(payload).alias("payload"))
    found = json_api.offers(raw, "https://shop/", "json shop")
    return found.withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz"))


@query(
    """SELECT p_partkey AS page_id, pos, concat('https://shop/item/', p_partkey, '-', pos) AS url,
      concat(p_name, ' & ', pos) AS name, concat(p_size, ',000円') AS price,
      CASE WHEN (p_size + pos) % 3 = 0 THEN 'Sold Out' ELSE 'In Stock' END AS stock_status, 'html shop' AS shop
    FROM part, (SELECT unnest([0, 1]) AS pos) p"""
)
def html_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def box(pos: int):
        stock = F.when((F.col("p_size") + pos) % 3 == 0, "SOLD OUT").otherwise("在庫あり")
        return F.format_string(
            f'<li class="offer"><a href="/item/%d-{pos}"><b class="name">%s &amp; {pos}</b></a><i class="price">%d,000円</i><u class="stock">%s</u></li>',
            "p_partkey", "p_name", "p_size", stock,
        )

    page = F.concat(F.lit("<html><ul><script>var a='<li class=offer>';</script>"), box(0), F.lit("<li>ad</li>"), box(1), F.lit("</ul>"))
    pages = dealt(read(spark, sf_dir, "part")).select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return html.list_offers(pages, html.OfferMarks("offer", "name", "price", "stock"), "https://shop", "html shop")


@query(
    r"""SELECT page_id, coalesce(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(clean, '(?is)<title[^>]*>(.*?)</title>', 1),
      '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), '') AS title,
      len(regexp_extract_all(clean, '(?i)<a\s[^>]*href')) AS n_links
    FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g') AS clean FROM pages)"""
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_facts(read(spark, sf_dir, "pages"))


# Titles, addresses and display

_TITLES = """SELECT p_partkey, concat('【', p_size, '月入荷予定】', p_name, ' (', p_brand, ')', CASE p_size % 4 WHEN 0 THEN ' SALE!!'
  WHEN 1 THEN ' 6本セット' WHEN 2 THEN ' グラス' ELSE '' END, ' ', p_size, ',000円(税込)') AS t, p_name, p_brand, p_size FROM part"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    end = F.when(size % 4 == 0, " SALE!!").when(size % 4 == 1, " 6本セット").when(size % 4 == 2, " グラス").otherwise("")
    title = F.concat(F.lit("【"), size.cast("string"), F.lit("月入荷予定】"), "p_name", F.lit(" ("), "p_brand", F.lit(")"), end, F.lit(" "), size.cast("string"), F.lit(",000円(税込)"))
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", title.alias("t"))


@query(
    f"""SELECT p_partkey, concat(p_name, ' (', p_brand, ')', CASE p_size % 4 WHEN 1 THEN ' 6本セット' WHEN 2 THEN ' グラス' ELSE '' END) AS plain,
    p_size % 4 = 1 AS is_pack, CASE p_size % 4 WHEN 1 THEN 'set' WHEN 2 THEN 'other' ELSE 'beer' END AS kind FROM ({_TITLES})"""
)
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    kind = titles.product_type(t, F.lit("other"), F.lit(False), F.col("p_brand"))
    return _titles(spark, sf_dir).select("p_partkey", titles.ingest_title(t).alias("plain"), titles.is_set_pack(t).alias("is_pack"), kind.alias("kind"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN NULL ELSE p_brand END AS maker, CASE p_size % 3 WHEN 2 THEN NULL ELSE p_name END AS name FROM part")
def title_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("p_size") % 3
    title = F.when(way == 0, F.concat(F.lit("【"), "p_name", F.lit(" / "), "p_brand", F.lit("】"))).otherwise(F.concat(F.lit("jp ["), "p_brand", F.lit("/"), "p_name", F.lit("]")))
    form = F.when(way == 0, "name_slash_maker").when(way == 1, "maker_slash_name").otherwise("pipe_maker_colon_name")
    maker, name = titles.split_title(title, form)
    return read(spark, sf_dir, "part").select("p_partkey", maker.alias("maker"), name.alias("name"))


@query(
    """SELECT p_partkey, concat('https://s/shopdetail/', p_partkey) AS detail, concat('https://s/v?product_id=', p_partkey) AS product,
    replace(p_name, ' ', '%20') AS encoded, concat(CAST(floor(p_retailprice) AS BIGINT), '円') AS yen FROM part"""
)
def address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    detail = titles.absolute(F.concat(F.lit("/shopdetail/"), key, F.lit("/page2/")), "https://s")
    product = F.concat(F.lit("https://s/v?mode=x&product_id="), key, F.lit("&page=3"))
    price = F.format_number("p_retailprice", 2)
    return read(spark, sf_dir, "part").where("p_retailprice IS NOT NULL").select(
        "p_partkey",
        titles.canonical_url(detail).alias("detail"),
        titles.canonical_url(product).alias("product"),
        titles.percent_encoded(F.col("p_name")).alias("encoded"),
        titles.yen(price).alias("yen"),
    )


_FLAG_SQL = " ".join(f"WHEN regexp_matches(lower(n_name), '{words}') THEN '{sign}'" for words, sign in titles.FLAGS)


@query(f"SELECT n_nationkey, CASE {_FLAG_SQL} ELSE '{titles.NO_FLAG}' END AS flag FROM nation")
def flag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", titles.flag(F.col("n_name")).alias("flag"))


@query(
    f"""WITH {ROLES} SELECT url, CASE WHEN product_url IS NOT NULL AND product_type = 'beer' THEN coalesce(product_name, name) ELSE name END AS shown,
    concat('¥', format('{{:,}}', CAST(floor(price_value) AS BIGINT))) AS money, strftime(first_seen, '%Y/%m/%d') AS day,
    first_seen BETWEEN TIMESTAMP '1998-08-02' - INTERVAL 24 HOUR AND TIMESTAMP '1998-08-02' AS is_new FROM wide"""
)
def shown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = display.shown_name(F.col("product_url"), F.col("product_type"), F.col("product_name"), F.col("name"))
    return wide(spark, sf_dir).select(
        "url",
        shown.alias("shown"),
        display.money(F.floor("price_value")).alias("money"),
        display.day(F.col("first_seen")).alias("day"),
        display.is_new(F.col("first_seen"), F.lit(AS_OF)).alias("is_new"),
    )


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Dead Link' WHEN page_id % 7 = 0 THEN 'Error'
    WHEN contains(lower(html), '"soldout') OR contains(lower(html), ' soldout') THEN 'Sold Out' ELSE 'In Stock' END AS status FROM pages"""
)
def stock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("page_id") % 5 == 0, 404).when(F.col("page_id") % 7 == 0, 503).otherwise(200)
    rules = {"s": stock.StockRule(words=(), classes=("soldout",))}
    found = stock.status(html.visible_text(F.col("html")), F.col("html"), code, rules, F.lit("s"))
    return read(spark, sf_dir, "pages").select("page_id", found.alias("status"))


# More statistics, facets and queues


@query(
    f"""WITH {ROLES} (SELECT 'style' AS kind, style AS value, count(*) AS n, NULL AS location, NULL AS search_text FROM wide WHERE style <> ''
      GROUP BY style ORDER BY n DESC, style LIMIT 3)
    UNION ALL SELECT 'producer', producer_name, count(*), max(location), coalesce(string_agg(DISTINCT style, ' ' ORDER BY style), '') FROM wide
    WHERE producer_name IS NOT NULL GROUP BY producer_name"""
)
def available_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.available_filters(wide(spark, sf_dir), 3)


@query(
    f"""WITH merged AS ({_MERGE_SQL.format("change <> 'absent'")}) SELECT stock_status, count(*) FILTER (WHERE change = 'new') AS "new",
    count(*) FILTER (WHERE change = 'restock') AS restocked, count(*) FILTER (WHERE change = 'seen') AS seen,
    count(*) FILTER (WHERE change <> 'absent') AS written FROM merged GROUP BY stock_status"""
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_statistics(upsert_merge(spark, sf_dir), "stock_status")


@query(
    f"""WITH {ROLES} SELECT url, product_url, first_seen AS fetched_at FROM wide WHERE product_url IS NOT NULL AND product_url NOT LIKE '%/search?%'
    AND NOT contains(lower(coalesce(stock_status, '')), 'out')
    AND (first_seen < TIMESTAMP '1998-08-02' - INTERVAL 5 DAY OR first_seen IS NULL OR product_name IS NULL)
    ORDER BY first_seen NULLS FIRST, url LIMIT 50"""
)
def stale_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(spark, sf_dir).withColumn("fetched_at", F.col("first_seen"))
    return linkage.to_refresh(rows, F.lit(AS_OF).cast("timestamp_ntz")).limit(50).select("url", "product_url", "fetched_at")


@query(
    """SELECT o.o_orderkey, c.c_name FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) o
    JOIN customer c ON o.o_custkey = c.c_custkey"""
)
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    newest = keys.newest_with(read(spark, sf_dir, "orders"), names, "o_custkey", 200, F.desc("o_orderdate"), F.col("o_orderkey"))
    return newest.select("o_orderkey", "c_name")


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN l.v > 40 THEN concat('x', l.v) END, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey AS VARCHAR) END) AS link
    FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey"""
)
def cached_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").cast("long").alias("v"))
    stored = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("/search?q="), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    first = F.when(F.col("v") > 40, F.concat(F.lit("x"), F.col("v").cast("string")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", stored.alias("stored")).join(best, "o_orderkey", "left")
    return rows.select("o_orderkey", linkage.first_link(first, F.col("stored")).alias("link"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand IN ('Brand#12', 'Brand#34') DESC, lower(p_brand), p_brand LIMIT 10")
def selected_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = catalog.count_by(read(spark, sf_dir, "part"), "p_brand")
    return keys.chosen_first(counts, "p_brand", ("Brand#12", "Brand#34"), 10)


# Record linkage


@query(
    """WITH found AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS url, CAST(event_id % 13 AS VARCHAR) AS product_url, 1 + event_id % 3 AS stage FROM events WHERE user_id % 4 <> 0 OR event_id % 13 < 4),
    first AS (SELECT url, product_url, min(stage) AS stage FROM found GROUP BY ALL),
    counts AS (SELECT url, stage, count(*) AS n FROM first GROUP BY ALL),
    needed AS (SELECT url, stage FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY url ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM counts) WHERE had < 5)
    SELECT url, product_url, stage FROM first SEMI JOIN needed USING (url, stage)"""
)
def link_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "events").where("user_id % 4 <> 0 OR event_id % 13 < 4")
    rows = found.select(F.col("user_id").cast("string").alias("url"), (F.col("event_id") % 13).cast("string").alias("product_url"), (F.col("event_id") % 3 + 1).alias("stage"), F.lit(0).alias("pos"))
    return linkage.in_stages(rows).select("url", "product_url", "stage")


@query(
    """SELECT p_partkey, NOT (p_size % 4 = 1 AND p_size % 3 <> 0) AND NOT (p_size % 4 = 2 AND p_size % 3 <> 1) AS ok FROM part"""
)
def link_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    title = F.concat("p_name", F.when(size % 3 == 0, " 2023").when(size % 3 == 1, " cask").otherwise(""))
    name = F.concat("p_name", F.when(size % 4 == 1, " 2023BY").when(size % 4 == 2, " (Cask)").otherwise(""))
    ok = linkage.validated(title, name, F.col("p_type"), F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", ok.alias("ok"))


@query(
    f"WITH {_ENTITIES} SELECT entity, split_part(name_en, ' ', 1) AS alias FROM ent WHERE contains(name_en, ' ') AND length(split_part(name_en, ' ', 1)) > 2"
    + f" AND lower(split_part(name_en, ' ', 1)) NOT IN ({', '.join(repr(w) for w in dictionary.COMMON_WORDS)})"
)
def dictionary_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.propose_aliases(_entities(spark, sf_dir))


@query(f"WITH {_ENTITIES} SELECT count(*) AS entities, 0::BIGINT AS with_japanese, count(*) AS with_aliases, CAST(sum(len(string_split(name_en, ' '))) AS BIGINT) AS aliases FROM ent")
def dictionary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.summary(_entities(spark, sf_dir))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    return parts.select(
        F.col("p_partkey").cast("string").alias("url"),
        F.concat(F.initcap("p_name"), F.when(F.col("p_size") % 3 == 0, " IPA").otherwise("")).alias("name"),
        F.concat("p_brand", F.lit(" Brewing")).alias("maker"),
    )


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id"), F.max("p_type").alias("style"))
    return names.select(
        F.concat(F.lit("p"), "id").alias("product_url"), F.col("p_name").alias("product_name"), F.concat("p_brand", F.lit(" Brewery")).alias("producer_name"), "style"
    )


@query()
def link_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = linkage.candidates(_wanted(spark, sf_dir), _products(spark, sf_dir))
    return linkage.scored(pairs).select("url", "product_url", "score")


@query()
def link_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(_wanted(spark, sf_dir), _products(spark, sf_dir))


@query()
def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", matching.similarity("p_name", "p_type").alias("ratio"))


@query(
    """SELECT p_partkey, nullif(regexp_extract(concat(p_size, ',050円(税込', p_size + 1, ',155円)'), '税込([0-9,]+)', 1), '').replace(',', '')::BIGINT AS price FROM part"""
)
def tax_included_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    title = F.concat(size.cast("string"), F.lit(",050円(税込"), (size + 1).cast("string"), F.lit(",155円)"))
    return read(spark, sf_dir, "part").select("p_partkey", text.tax_included_price(title).alias("price"))


#: Names of a candidate and an expected product, their producers, the candidate's style, and the score that the rules give.
SCORE_TABLE = [
    ("Moon", None, None, "Moon", None, 100),
    ("MOON!", None, None, "moon", None, 100),
    ("Moon", "Sun Brewing", None, "Moon", "Star Brewery", 0),
    ("Moon", "Star Beer Co", None, "Moon", "Star Brewing", 100),
    ("Moon", "Stone Garden Beer", None, "Moon", "Stone Brewing", 100),
    ("Moon", "Riococktail", None, "Moon", "Rio", 100),
    ("Moon", "Sun Brewing", None, "Moon", "Star Brewing x Sun Brewing", 100),
    (None, None, None, "Moon", None, 0),
    ("Moon", None, None, None, None, 100),
    ("!!!", None, None, "Moon", None, 0),
    ("DDH Caligula", None, None, "Double Dry Hopped Caligula", None, 95),
    ("BA Night", None, None, "Barrel Aged Night", None, 95),
    ("LR 7 Night", None, None, "Limited Release 7 Night", None, 95),
    ("Moon Wet", None, None, "Moon", None, 90),
    ("Moon Rise Anniversary", None, None, "Moon Rise", None, 90),
    ("Sun 2023", None, None, "Sun", "Maker", 90),
    ("Sun Maker", None, None, "Sun", "Maker", 90),
    ("Great Divided Line", None, None, "Great Divide", None, 90),
    ("Moonlighter", None, None, "Moonlight", None, 90),
    ("11th Hour", None, None, "Eleventh Hour", None, 85),
    ("Chapter Three", None, None, "Chapter 3", None, 85),
    ("Chapter III", None, None, "Chapter 3", None, 85),
    ("Chapter Ⅲ", None, None, "Chapter 3", None, 85),
    ("Forest Berries", None, None, "Forest Berry", None, 85),
    ("Red Foxes", None, None, "Red Fox", None, 90),
    ("Dark Glass", None, None, "Dark Glas", None, 90),
    ("Golden Foo DDH", None, None, "Golden Foo", None, 0),
    ("Golden Foo", None, None, "Golden Foo Coffee", None, 0),
    ("Golden Foo Coffee", None, None, "Golden Foo", None, 0),
    ("Golden Foo Coffee Stout", None, None, "Golden Foo", None, 90),
    ("Fresh Hop Golden Foo", None, None, "Golden Foo", None, 0),
    ("Golden Weizen", None, "IPA - American", "Golden Stout", None, 0),
    ("Night Porter", None, "IPA - American", "Night Porter", None, 100),
    ("Foo (2023)", None, None, "Foo", None, 75),
    ("Foo Bar – Pilsner", None, None, "Foo Bar [2021]", None, 75),
    ("Foo Bar West Coast IPA", None, None, "Foo Bar Vol. 3", None, 75),
    ("Hopwired Moons", None, None, "Hopwierd Moons", None, 70),
    ("Whisky Smoke", None, None, "Whisky Sour", None, 0),
    ("Entirely Other", None, None, "Golden Foo", None, 0),
    ("どろん（Doron）", None, None, "Doron", None, 75),
]


def _literal(value: str | int | None) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({', '.join(_literal(v) for v in (n, *row))})" for n, row in enumerate(SCORE_TABLE))
    + ") AS t(n, candidate, producer, style, expected, maker, score)"
)
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "n int, candidate string, producer string, style string, expected string, maker string, wanted int"
    rows = spark.createDataFrame([(n, *row) for n, row in enumerate(SCORE_TABLE)], schema).drop("wanted")
    names = ("candidate", "producer", "style", "expected", "maker")
    return rows.withColumn("score", matching.match_score(*map(F.col, names)))


@query("SELECT p_partkey, concat(p_name, ' Reserve') AS plain FROM part")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("DDH "), F.col("p_name"), F.lit(" West Coast IPA Reserve #12 (2023.07)（500ml缶）シリーズ第"), F.col("p_size").cast("string"))
    return dealt(read(spark, sf_dir, "part")).select("p_partkey", text.cleaned(name).alias("plain"))


@query(
    f"""SELECT product_url, url, row_number() OVER (PARTITION BY product_url ORDER BY (shop = '5-LOW') DESC, place) AS place
    FROM ({_VISIBLE}) SEMI JOIN (SELECT DISTINCT product_url FROM ({_VISIBLE}) WHERE shop = '5-LOW') USING (product_url)"""
)
def visible_selected_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = search.visible_items(groups(spark, sf_dir), "all")
    return search.selected_first(items, ("5-LOW",)).select("product_url", "url", "place")


_TOKENS_SQL = """SELECT p_partkey, list_filter(t, lambda x, i: list_position(t, x) = i)[1:6] AS tokens FROM (
    SELECT p_partkey, list_concat([CAST(p_size AS VARCHAR), concat('Limited Release ', p_size), concat('LR', p_size)],
    list_filter(list_reverse(string_split(p_name, ' ')), lambda x: length(x) > 2)) AS t FROM part)"""


@query(f"SELECT p_partkey, array_to_string(tokens, '|') AS tokens FROM ({_TOKENS_SQL})")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" IPA LR"), F.col("p_size").cast("string"))
    return dealt(read(spark, sf_dir, "part")).select("p_partkey", F.array_join(text.search_tokens(name), "|").alias("tokens"))


@query(
    """WITH words AS (SELECT p_partkey, p_brand, replace(lower(p_name), ' ', '') AS whole, string_split(lower(p_name), ' ') AS w FROM part),
    probes AS (SELECT p_partkey AS url, p_brand, 1 AS stage, whole AS probe FROM words
        UNION ALL SELECT p_partkey, p_brand, 3, unnest(list_filter(w, lambda x: length(x) > 2)) FROM words),
    held AS (SELECT p_partkey AS product_url, p_brand, whole AS probe FROM words UNION SELECT p_partkey, p_brand, unnest(w) FROM words),
    first AS (SELECT url, product_url, min(stage) AS stage FROM probes JOIN held USING (p_brand, probe) GROUP BY ALL),
    named AS (SELECT url, count(*) AS n FROM first WHERE stage = 1 GROUP BY url)
    SELECT url, product_url, stage FROM first LEFT JOIN named USING (url) WHERE stage = 1 OR coalesce(n, 0) < 5"""
)
def link_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    offers = part.select(F.col("p_partkey").alias("url"), F.col("p_brand").alias("maker"), F.initcap("p_name").alias("name"), F.lit(None).cast("string").alias("name_jp"))
    products = part.select(F.col("p_partkey").alias("product_url"), F.col("p_name").alias("product_name"), F.concat("p_brand", F.lit(" Brewing")).alias("producer_name"))
    return linkage.retrieve(offers, products).select("url", "product_url", "stage")


@query("""SELECT a.p_partkey AS url, min(b.p_partkey) AS product_url FROM part a JOIN part b ON b.p_name = a.p_name AND contains(lower(b.p_brand), lower(a.p_brand)) GROUP BY ALL""")
def link_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    offers = part.select(F.col("p_partkey").alias("url"), F.lower("p_brand").alias("maker"), F.initcap("p_name").alias("name"))
    products = part.select(F.col("p_partkey").alias("product_url"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("producer_name"))
    return linkage.link_offline(offers, products)


@query(
    """SELECT p_type, count(*) AS n FROM part GROUP BY p_type
    HAVING contains(lower(p_type), 'st') OR contains(lower(max(p_brand)), 'st') OR contains(lower(p_type), '#4') OR contains(lower(max(p_brand)), '#4')"""
)
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_brand").alias("terms"))
    # two texts, as a user types them: by label, and by the terms behind it
    by_label = search.options_like(options, "ST", ("p_type", "terms"))
    return by_label.unionByName(search.options_like(options, "#4", ("p_type", "terms"))).select("p_type", "n").distinct()


@query(
    """SELECT c_custkey AS url FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders
    WHERE CAST(o_orderdate AS TIMESTAMP) > TIMESTAMP '1998-08-02' - INTERVAL 200 DAY) USING (c_custkey)"""
)
def fetch_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"))
    return dictionary.to_fetch(wanted, known, F.lit("1998-08-02").cast("timestamp"), days=200)


# Further queries, registered on import
from offerlake import linking_queries, source_queries, view_queries  # noqa: E402,F401
