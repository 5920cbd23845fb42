"""Stock status and price of an offer out of its page's text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text
from offerlake.sources import html


@dataclass(frozen=True)
class StockRule:
    """How a shop's page says that nothing is left.

    `words` anywhere in the text and `classes` or image `sources` in the page mean sold
    out. With `needs_cart` a page that has none of the cart marks is sold out too;
    `cart_first` lets a cart mark overrule the words.
    """

    words: tuple[str, ...] = ("SOLD OUT", "売り切れ", "完売")
    classes: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    cart: tuple[str, ...] = ()
    needs_cart: bool = False
    cart_first: bool = False


DEFAULT = StockRule()


def _any_of(text_col: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text_col, F.lit(word.lower()))
    return found


def status(said: Column, source: Column, code: Column, rules: dict[str, StockRule], shop: Column) -> Column:
    """The status of a page by its text, its HTML and its HTTP code.

    404 is a dead link, another code than 200 or no page an error; shops without a rule
    get the default one.
    """
    said, source = F.lower(F.coalesce(said, F.lit(""))), F.lower(source)

    def judged(rule: StockRule) -> Column:
        marked = _any_of(source, tuple(f'"{c}' for c in rule.classes) + tuple(f" {c}" for c in rule.classes))
        marked = marked | _any_of(source, rule.sources)
        cart = _any_of(source, rule.cart)
        out = marked | (_any_of(said, rule.words) & ~cart if rule.cart_first else _any_of(said, rule.words))
        out = out | ~cart if rule.needs_cart else out
        return F.when(out, "Sold Out").otherwise("In Stock")

    found = judged(DEFAULT)
    for name, rule in rules.items():
        found = F.when(shop == name, judged(rule)).otherwise(found)
    return F.when(code == 404, "Dead Link").when((code != 200) | source.isNull() | (source == ""), "Error").otherwise(found)


def check_pages(pages: DataFrame, rules: dict[str, StockRule] | None = None) -> DataFrame:
    """Check fetched pages (`url`, `shop`, `code`, `html`, `checked_at`): `url`, `status`, `price`, `checked_at`.

    The price is the tax-included number of the text; pages in error give none, and are
    left out of what `ingest.apply_stock_checks` takes over.
    """
    said = html.visible_text(F.col("html"))
    judged = pages.select("url", "shop", "code", "html", "checked_at", said.alias("said")).withColumn(
        "status", status(F.col("said"), F.col("html"), F.col("code"), rules or {}, F.col("shop"))
    )
    price = F.when(F.col("status").isin("In Stock", "Sold Out"), text.tax_included_price(F.col("said")))
    return judged.where(F.col("status") != "Error").select("url", "status", price.cast("double").alias("price"), "checked_at")


def to_check(wide: DataFrame, limit: int | None = None, shops: tuple[str, ...] = (), by_rating: bool = False, sold_out: bool = False) -> DataFrame:
    """Offers whose stock is to be checked, those not seen for longest first, or the best rated first.

    Sold-out ones, and those whose stock isn't known, are left out unless `sold_out`; the url settles ties.
    """
    rows = wide if sold_out else wide.where(F.col("stock_status") != "Sold Out")
    rows = rows.where(F.col("shop").isin(*shops)) if shops else rows
    order = F.desc_nulls_last("rating") if by_rating else F.asc_nulls_first("last_seen")
    return rows.orderBy(order, "url").limit(limit) if limit is not None else rows.orderBy(order, "url")
