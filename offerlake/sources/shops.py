"""Offers of several shops: one rule for each says how its list pages are read.

Pages come as a table (`shop`, `page`, `body`), from the data source below or from files.
JSON pages are read by column expressions; HTML pages become element trees in Arrow batches,
and all that follows - titles, prices, addresses, stock - is the same for every shop.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from offerlake.functions import titles
from offerlake.sources import html, json_api
from offerlake.sources.details import Element, tree

OFFER = "shop string, page int, pos int, url string, name string, price string, image string, stock_status string, first_seen timestamp"


@dataclass(frozen=True)
class ShopRule:
    """How a shop's list pages are read.

    pages: address of a list page, with `{page}`; form: json or html
    json - dates: the times that tell when an offer appeared, the first that can be read; tags: words of which a tag must hold one
    html - item: places of an offer's element, the first that any has; link, name, price, image, brand: places within it,
      `selector@attribute` or a selector; sold: places whose presence, and words (patterns) whose sight, say that it is sold out
    title: `plain` or `clean`, without the shop's notices; price_forms: patterns whose first group is the price's
      number, tried in order; without any the text itself
    stop_after: known offers one after the other at which a scan for new ones ends
    """

    shop: str
    base_url: str
    pages: str = ""
    form: str = "html"
    dates: tuple[str, ...] = ("updated_at", "published_at", "created_at")
    tags: tuple[str, ...] = ()
    item: tuple[str, ...] = ()
    link: tuple[str, ...] = ("a@href",)
    name: tuple[str, ...] = ()
    price: tuple[str, ...] = ()
    image: tuple[str, ...] = ("img@src",)
    brand: tuple[str, ...] = ()
    sold: tuple[str, ...] = ()
    sold_words: tuple[str, ...] = ("SOLD OUT", "売り切れ")
    title: str = "plain"
    price_forms: tuple[str, ...] = ()
    encodings: tuple[str, ...] = html.ENCODINGS
    stop_after: int = 50

    def __post_init__(self):
        if self.form not in ("json", "html") or self.title not in ("plain", "clean") or (self.form == "html" and not self.item):
            raise ValueError(f"not a rule: {self}")


#: Layouts of list pages that shops have; `dataclasses.replace` gives them a shop and its address. Fixed values.
LAYOUTS = {
    "products.json by update": ShopRule("", "", "{base}/products.json?limit=250&page={page}", "json", tags=("beer", "酒類", "ビール")),
    "products.json by publication": ShopRule("", "", "{base}/products.json?limit=250&page={page}", "json", dates=("published_at", "created_at")),
    "inner boxes": ShopRule(
        "", "", "{base}/shopbrand/all_items/page{page}/order/", item=("div.innerBox",), link=("div.imgWrap a@href",), name=("div.detail p.name",),
        price=("div.detail p.price",), image=("div.imgWrap img@src",), sold_words=("売り切れ", "SOLD OUT", "(?:^|[^0-9])0個"), encodings=("euc-jp", "cp932", "shift_jis", "utf-8"),
    ),
    "product list": ShopRule(
        "", "", item=("li.productlist_list", "li.recommend_list"), name=("span.item_name", "img.item_img@alt"), price=("span.item_price",), image=("img.item_img@src",),
        sold_words=("SOLD OUT",), price_forms=("税込([0-9,]+円)",), encodings=("euc-jp",),
    ),
    "photo list": ShopRule(
        "", "", "{base}/products/list.php?category_id=0&disp_number=100&pageno={page}", item=("div.gods_item",), link=("div.listphoto a@href",), name=("div.listrightbloc a",),
        price=("div.listrightbloc .price",), image=("div.listphoto a img@src",), sold=("p.soldout",), sold_words=("SOLD OUT", "売切"),
        price_forms=("税込:\\s*[¥￥]?\\s*([0-9,]+)", "([0-9,]+)"), stop_after=30,
    ),
    "link cards": ShopRule(
        "", "", "{base}/?mode=cate&sort=n&page={page}", item=("a.card",), link=("@href",), name=("img@alt", ".name"), price=("span.price",), sold=("span.soldout",), title="clean",
    ),
    "collection": ShopRule(
        "", "", "{base}/collections/all?page={page}", item=("li.--collection-product-item",), name=(".--item-card-title",), brand=(".--item-card-brand-name",),
        price=(".price-item--regular", ".price-item--sale", ".--item-card-price-text", ".price-item"), image=("img.--item-card-img@src", "img@src", "img@data-src"),
        sold_words=("SOLD OUT", "売り切れ", "在庫なし"), price_forms=("([0-9,]+)",),
    ),
}


def _read(item: Element, places: tuple[str, ...]) -> str | None:
    """The text or attribute of the first place that an element has."""
    for place in places:
        selector, _, attribute = place.partition("@")
        node = item.first(selector) if selector else item
        if node is not None and (not attribute or node.attrs.get(attribute)):
            return node.attrs[attribute].strip() if attribute else node.text()
    return None


def _items(page: Element, rule: ShopRule) -> list[Element]:
    found = (list(page.select(selector)) for selector in rule.item)
    return next((items for items in found if items), [])


def _raw_html(pages: DataFrame, rules: dict[str, ShopRule]) -> DataFrame:
    """What stands in the elements of HTML pages, as it is."""
    schema = "shop string, page int, pos int, href string, name string, price string, image string, brand string, said string, sold boolean"
    names = [part.split()[0] for part in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shop, page, body in zip(batch["shop"], batch["page"], batch["body"], strict=True):
                rule = rules[shop]
                for pos, item in enumerate(_items(tree(html.decoded(body, rule.encodings)), rule)):
                    fields = (_read(item, places) for places in (rule.link, rule.name, rule.price, rule.image, rule.brand))
                    rows.append((shop, page, pos, *fields, item.text(), any(item.first(s) is not None for s in rule.sold)))
            yield pd.DataFrame(rows, columns=names)

    return pages.select("shop", "page", "body").mapInPandas(read, schema)


def _by_shop(rules: dict[str, ShopRule], value) -> Column:
    """A column whose value depends on the shop."""
    return reduce(lambda found, rule: F.when(F.col("shop") == rule.shop, value(rule)).otherwise(found), rules.values(), F.lit(None))


def _html_offers(pages: DataFrame, rules: dict[str, ShopRule]) -> DataFrame:
    def price(rule: ShopRule) -> Column:
        text = F.col("price")
        if not rule.price_forms:
            return text
        numbers = (F.nullif(F.regexp_replace(F.regexp_extract(text, form, 1), "[^0-9]", ""), F.lit("")) for form in rule.price_forms)
        return F.coalesce(*(F.concat(n, F.lit("円")) for n in numbers), text)

    def name(rule: ShopRule) -> Column:
        return titles.ingest_title(F.col("name")) if rule.title == "clean" else F.col("name")

    base = _by_shop(rules, lambda rule: F.lit(rule.base_url))
    words = _by_shop(rules, lambda rule: F.upper("said").rlike("|".join(rule.sold_words).upper()) if rule.sold_words else F.lit(False))
    named = _raw_html(pages, rules).withColumn("name", _by_shop(rules, name))
    branded = ~F.coalesce("brand", F.lit("")).isin("", *rules) & ~F.startswith("name", F.lit("["))
    whole = F.when(branded, F.concat(F.lit("["), "brand", F.lit("] "), "name")).otherwise(F.col("name"))
    absolute = lambda c: F.when(F.startswith(c, F.lit("//")), F.concat(F.lit("https:"), c)).when(c.rlike("^https?:"), c).otherwise(F.concat(base, F.when(F.startswith(c, F.lit("/")), "").otherwise("/"), c))
    return named.select(
        "shop", "page", "pos",
        titles.canonical_url(absolute(F.col("href"))).alias("url"),
        F.coalesce(F.nullif(whole, F.lit("")), F.lit("Unknown")).alias("name"),
        F.coalesce(F.nullif(_by_shop(rules, price), F.lit("")), F.lit("Unknown")).alias("price"),
        absolute(F.col("image")).alias("image"),
        F.when(F.col("sold") | words, "Sold Out").otherwise("In Stock").alias("stock_status"),
        F.lit(None).cast("timestamp").alias("first_seen"),
    )


def _json_offers(pages: DataFrame, rules: dict[str, ShopRule]) -> DataFrame:
    body = F.decode("body", "utf-8")
    read = pages.select("shop", "page", F.from_json(body, f"struct<products:array<{json_api.PAYLOAD}>>").alias("p"))
    listed = read.select("shop", "page", F.posexplode("p.products").alias("pos", "p")).select("shop", "page", "pos", "p.*")

    def wanted(rule: ShopRule) -> Column:
        if not rule.tags:
            return F.lit(True)
        return F.coalesce(F.exists("tags", lambda t: F.lower(t).rlike("|".join(rule.tags))), F.lit(False))

    base = _by_shop(rules, lambda rule: F.lit(rule.base_url))
    price = F.try_element_at("variants", F.lit(1)).price
    available = F.coalesce(F.exists("variants", lambda v: F.coalesce(v.available, F.lit(False))), F.lit(False))
    return listed.where("handle <> ''").where(_by_shop(rules, wanted)).select(
        "shop", "page", "pos",
        F.concat(base, F.lit("/products/"), "handle").alias("url"),
        F.coalesce("title", F.lit("Unknown")).alias("name"),
        titles.yen(price).alias("price"),
        F.try_element_at("images", F.lit(1)).src.alias("image"),
        F.when(available, "In Stock").otherwise("Sold Out").alias("stock_status"),
        _by_shop(rules, lambda rule: json_api.first_time(*rule.dates)).alias("first_seen"),
    )


def offers(pages: DataFrame, rules: list[ShopRule]) -> DataFrame:
    """The offers on the shops' list pages (`shop`, `page`, `body`, bytes), all in one shape (`OFFER`).

    `page` and `pos` keep the order on the site. Offers without a link and merchandise are left
    out, as are pages of shops without a rule; unreadable, empty and null pages give nothing. What a shop
    doesn't say is `Unknown` or null.
    """
    parts = []
    for form, read in (("json", _json_offers), ("html", _html_offers)):
        own = {rule.shop: rule for rule in rules if rule.form == form}
        if own:
            parts.append(read(pages.where(F.col("shop").isin(*own) & F.col("body").isNotNull()), own))
    found = reduce(DataFrame.unionByName, parts)
    return found.where(F.col("url").isNotNull() & ~F.coalesce(titles.is_merchandise(F.col("name")), F.lit(False)))


class _Page(InputPartition):
    def __init__(self, shop: str, page: int, address: str):
        self.shop, self.page, self.address = shop, page, address


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.addresses = json.loads(options["addresses"])
        self.first, self.last = int(options.get("first", "1")), int(options["last"])
        self.seconds = float(options.get("timeout", "30"))

    def partitions(self):
        return [
            _Page(shop, page, address.replace("{page}", str(page))) for shop, address in self.addresses.items() for page in range(self.first, self.last + 1)
        ]

    def read(self, partition):
        try:
            with urllib.request.urlopen(partition.address, timeout=self.seconds) as answer:  # noqa: S310  the rules say what is read
                yield partition.shop, partition.page, answer.read(), None
        except Exception as fault:  # noqa: BLE001  a page that can't be read is a row that says so
            yield partition.shop, partition.page, None, f"{type(fault).__name__}: {fault}"


class ShopPages(DataSource):
    """Spark's data source `shop_pages`: one partition for each shop and page, so that one shop's pages are fetched side by side.

    Options: `addresses`, JSON of shop to address with `{page}`; `first` (1) and `last` page; `timeout` in seconds. A page that
    can't be read has a null `body` and an `error`.
    """

    @classmethod
    def name(cls):
        return "shop_pages"

    def schema(self):
        return "shop string, page int, body binary, error string"

    def reader(self, schema):
        return _Reader(self.options)


def pages(spark: SparkSession, rules: list[ShopRule], last: int, first: int = 1, timeout: float = 30) -> DataFrame:
    """List pages `first` to `last` of every shop: `shop`, `page`, `body`, `error`."""
    spark.dataSource.register(ShopPages)
    addresses = json.dumps({rule.shop: rule.pages.replace("{base}", rule.base_url) for rule in rules})
    options = {"addresses": addresses, "first": str(first), "last": str(last), "timeout": str(timeout)}
    return spark.read.format("shop_pages").options(**options).load()
