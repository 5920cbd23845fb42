"""Searches over the wide view and over groups: predicates, sorts, pages and counts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions.text import is_out
from offerlake.operators.catalog import has_item, has_product
from offerlake.plans.spec import SearchSpec

ROW_TEXT = ("name", "product_name", "producer_name", "style", "shop", "location")
GROUP_TEXT = ("product_name", "producer_name")


def contains_any(columns: tuple[str, ...], wanted: str) -> Column:
    """Case-insensitive substring in any of the columns; the text is taken literally."""
    low = wanted.lower()
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(low)), F.lit(False)) for c in columns))


def _shared(spec: SearchSpec, text: tuple[str, ...], seen: str, columns: list[str]) -> list[Column]:
    found = [contains_any(text, spec.search)] if spec.search else []
    ranges = (("abv", ">=", spec.min_abv), ("abv", "<=", spec.max_abv), ("ibu", ">=", spec.min_ibu), ("ibu", "<=", spec.max_ibu), ("rating", ">=", spec.min_rating))
    for column, side, bound in ranges:
        if bound is not None:
            if column not in columns:
                raise ValueError(f"the view has no {column} to search by")
            found.append(F.col(column) >= bound if side == ">=" else F.col(column) <= bound)
    for column, wanted in (("style", spec.styles), ("producer_name", spec.producers)):
        if wanted:
            found.append(F.col(column).isin(*wanted))
    if spec.product_type:
        found.append(F.col("product_type") == spec.product_type)
    if spec.days is not None:
        found.append(F.col(seen) >= F.lit(spec.as_of) - F.make_dt_interval(F.lit(spec.days)))
    if spec.only_sale:
        found.append(F.col("is_sale"))
    return found


def row_predicate(spec: SearchSpec, columns: list[str], shops: bool = True) -> Column:
    """What an offer must meet; facets leave out the shops."""
    found = _shared(spec, ROW_TEXT, "first_seen", columns)
    if spec.stock != "all":
        found.append(F.col("stock_status") == ("In Stock" if spec.stock == "in_stock" else "Sold Out"))
    if spec.link != "all":
        found.append(has_product(F.col("product_url")) if spec.link == "linked" else ~has_product(F.col("product_url")))
    if shops and spec.shops:
        found.append(F.col("shop").isin(*spec.shops))
    return reduce(lambda a, b: a & b, found, F.lit(True))


def group_predicate(spec: SearchSpec, columns: list[str]) -> Column:
    """What a group must meet: shop and stock must hold for one and the same item."""
    found = _shared(spec, GROUP_TEXT, "newest_seen", columns)
    in_shop: Callable[[Column], Column] = lambda i: i.shop.isin(*spec.shops) if spec.shops else F.lit(True)
    stocked = has_item(lambda i: in_shop(i) & (i.stock_status == "In Stock"))
    if spec.stock == "in_stock":
        found.append(stocked)
    elif spec.stock == "sold_out":
        found += [~stocked, has_item(in_shop)]
    elif spec.shops:
        found.append(has_item(in_shop))
    return reduce(lambda a, b: a & b, found, F.lit(True))


def order(sort: str, group: bool, key: str) -> list[Column]:
    """Sort columns, nulls last, ties by the unique key."""
    cheap, dear, seen, name = ("min_price", "max_price", "newest_seen", "product_name") if group else ("price_value", "price_value", "first_seen", "name")
    by = {
        "newest": F.desc_nulls_last(seen),
        "price_asc": F.asc_nulls_last(cheap),
        "price_desc": F.desc_nulls_last(dear),
        "rating_desc": F.desc_nulls_last("rating"),
        "abv_desc": F.desc_nulls_last("abv"),
        "name_asc": F.asc_nulls_last(name),
    }
    return [by[sort], F.asc(key)]


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    counts: DataFrame
    matching: DataFrame
    limit: int

    def total(self) -> int:
        return self.matching.count()

    def pages(self) -> int:
        return math.ceil(self.total() / self.limit)


def paged(df: DataFrame, spec: SearchSpec, group: bool, key: str) -> DataFrame:
    return df.orderBy(*order(spec.sort, group, key)).offset(spec.offset).limit(spec.limit)


def shop_counts(wide: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matching offers by shop, as if no shop were chosen."""
    return wide.where(row_predicate(spec, wide.columns, shops=False)).groupBy("shop").agg(F.count(F.lit(1)).alias("n"))


def search_rows(wide: DataFrame, spec: SearchSpec) -> Page:
    matching = wide.where(row_predicate(spec, wide.columns))
    return Page(paged(matching, spec, False, "url"), shop_counts(wide, spec), matching, spec.limit)


def search_groups(wide: DataFrame, groups: DataFrame, spec: SearchSpec) -> Page:
    matching = groups.where(group_predicate(spec, groups.columns))
    return Page(paged(matching, spec, True, "product_url"), shop_counts(wide, spec), matching, spec.limit)


def visible_items(groups: DataFrame, stock: str = "in_stock") -> DataFrame:
    """The offers of each group that are shown, cheapest first (`place` from 1).

    Sold-out offers of a shop that still has stock are hidden, and of those left only the
    latest seen of each shop is shown, the cheaper of two. Offers without a price, or priced zero, come last.
    """
    items = groups.select("product_url", F.explode("items").alias("item")).select("product_url", "item.*")
    items = items.withColumn("out", is_out(F.col("stock_status")))
    shop = Window.partitionBy("product_url", "shop")
    price = F.when(F.col("price_value") > 0, F.col("price_value"))
    seen = "last_seen" if "last_seen" in items.columns else "first_seen"
    latest = Window.partitionBy("product_url", "shop", "out").orderBy(F.desc_nulls_last(seen), price.asc_nulls_last(), "url")
    cheap = Window.partitionBy("product_url").orderBy(price.asc_nulls_last(), "url")
    kept = (
        items.withColumn("stocked", F.min("out").over(shop) == F.lit(False))
        .withColumn("nth", F.row_number().over(latest))
        .where(~F.col("out") | (~F.col("stocked") & (F.col("nth") == 1)))
    )
    shown = {"in_stock": ~F.col("out"), "sold_out": F.col("out"), "all": F.lit(True)}[stock]
    return kept.where(shown).withColumn("place", F.row_number().over(cheap)).drop("stocked", "nth", "out")


def selected_first(items: DataFrame, shops: tuple[str, ...]) -> DataFrame:
    """Visible items (`product_url`, `shop`, `place`) of the groups that a chosen shop sells, the chosen shops' first."""
    if not shops:
        return items
    group = Window.partitionBy("product_url")
    chosen = items.withColumn("chosen", F.coalesce(F.col("shop").isin(*shops), F.lit(False)))
    kept = chosen.withColumn("sold", F.max("chosen").over(group)).where("sold")
    return kept.withColumn("place", F.row_number().over(group.orderBy(F.desc("chosen"), "place"))).drop("chosen", "sold")


def options_like(options: DataFrame, wanted: str, columns: tuple[str, ...]) -> DataFrame:
    """The options of a filter whose label or search terms hold the wanted text, case aside; all for an empty text."""
    return options.where(contains_any(columns, wanted)) if wanted else options
