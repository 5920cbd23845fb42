"""The wide view of offers, the groups of offers of one product, and their facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text, titles
from offerlake.operators.order import numbered
from offerlake.plans.roles import Roles

DEAD = "Dead Link"
#: What a group keeps of each offer, and takes the greatest of; columns that a view lacks are left out.
ITEM = (
    "price_value", "url", "shop", "stock_status", "first_seen", "name", "is_sale", "last_seen", "image", "sale_tag", "expiry_notice",
    "is_set", "price",
)
DESCRIPTIVE = (
    "product_name", "producer_name", "style", "rating", "location", "product_type", "abv", "ibu", "rating_count", "product_image",
    "producer_name_jp", "title_name_jp", "sale_tag", "expiry_notice", "producer_type", "producer_logo", "fetched_at",
)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: a dimension must not multiply what it is joined to."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("row")).select(key, "row.*")


def wide_view(roles: Roles) -> DataFrame:
    """One row for each offer that isn't dead, with its extraction, product and producer."""
    offers = roles.offers.where(~F.col("stock_status").eqNullSafe(DEAD)).select(
        "*",
        text.is_sale(F.col("name")).alias("is_sale"),
        text.sale_tag(F.col("name")).alias("sale_tag"),
        text.expiry_notice(F.col("name")).alias("expiry_notice"),
    )
    wide = offers
    for dimension, key in ((roles.extraction, "url"), (roles.product, "product_url"), (roles.producer, "producer_url")):
        wide = wide.join(dimension if roles.unique else one_per_key(dimension, key), key, "left")
    return wide


def has_product(link: Column, any_case: bool = False) -> Column:
    """Whether a link leads to a product and not to a search, whose mark may be written in `any_case`."""
    return link.isNotNull() & ~(link.ilike("%/search?%") if any_case else link.like("%/search?%"))


def group_view(wide: DataFrame) -> DataFrame:
    """One row for each linked product: names, price range, flags and its offers as `items`."""
    return (
        wide.where(has_product(F.col("product_url")))
        .groupBy("product_url")
        .agg(
            F.max("name").alias("original_name"),
            *(F.max(c).alias(c) for c in DESCRIPTIVE if c in wide.columns),
            F.bool_or("is_set").alias("is_set"),
            F.bool_or("is_sale").alias("is_sale"),
            F.min("price_value").alias("min_price"),
            F.max("price_value").alias("max_price"),
            F.max("first_seen").alias("newest_seen"),
            F.count(F.lit(1)).alias("total_items"),
            F.array_sort(F.collect_list(F.struct(*(c for c in ITEM if c in wide.columns)))).alias("items"),
        )
    )


def has_item(condition) -> Column:
    """Whether one of a group's items meets the condition; unknown counts as no."""
    return F.exists("items", lambda i: F.coalesce(condition(i), F.lit(False)))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, n: int = 200) -> DataFrame:
    """The most frequent values, ties by value; null and empty ones don't count."""
    counts = count_by(df.where(F.col(column) != ""), column)
    return counts.orderBy(F.desc("n"), F.col(column).asc()).limit(n)


def producer_facet(wide: DataFrame) -> DataFrame:
    """For each producer its location and the text that an option search looks in."""
    return (
        wide.where(F.col("producer_name").isNotNull())
        .groupBy("producer_name")
        .agg(
            F.max("location").alias("location"),
            F.array_join(F.array_sort(F.collect_set("style")), " ").alias("search_text"),
        )
    )


def producer_options(wide: DataFrame) -> DataFrame:
    """Producers as a list offers them: `producer_name`, `location`, `flag`, `search_text`, `place` from 1 on.

    The location is the first that isn't empty, in order of url; the text is all names that titles gave the
    producer. Names are placed as a reader expects, whatever their case and accents, equal ones by their bytes.
    """
    named = wide.where(F.col("producer_name") != "")
    names = F.array("title_producer_jp", "title_producer_en")
    options = named.groupBy("producer_name").agg(
        F.min_by("location", F.when(F.col("location") != "", F.col("url"))).alias("location"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(names, lambda n: n != ""))))).alias("names"),
    )
    shown = options.select("producer_name", "location", titles.flag(F.col("location")).alias("flag"), F.array_join("names", " ").alias("search_text"))
    placed = numbered(shown, F.collate("producer_name", "UNICODE_CI"), F.col("producer_name"), name="place")
    return placed.withColumn("place", F.col("place") + 1)


def shop_counts(wide: DataFrame) -> DataFrame:
    """One row: the number of offers of each shop as a map, and their sum."""
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("shop", "n")))).alias("counts")
    one = count_by(wide.where("shop IS NOT NULL"), "shop").agg(counts)  # a row for each shop
    return one.withColumn("total", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, b: a + b))


def available_filters(wide: DataFrame, styles: int = 200) -> DataFrame:
    """The options that filters offer: `kind` (style or producer), `value`, `n`, `location`, `search_text`."""
    none = F.lit(None).cast("string")
    top = top_values(wide.where(F.col("style").isNotNull()), "style", styles)
    by_style = top.select(F.lit("style").alias("kind"), F.col("style").alias("value"), "n", none.alias("location"), none.alias("search_text"))
    counts = count_by(wide.where(F.col("producer_name").isNotNull()), "producer_name")
    producers = producer_facet(wide).join(counts, "producer_name")
    return by_style.unionByName(
        producers.select(F.lit("producer").alias("kind"), F.col("producer_name").alias("value"), "n", "location", "search_text")
    )


def statistics(wide: DataFrame) -> DataFrame:
    """One row of counts over all offers."""
    return wide.agg(
        F.count(F.lit(1)).alias("offers"),
        F.count_distinct("shop").alias("shops"),
        F.count_if(F.col("stock_status") == "In Stock").alias("in_stock"),
        F.count_if(has_product(F.col("product_url"))).alias("linked"),
        F.array_join(F.array_sort(F.collect_set("shop")), "|").alias("shop_list"),
        F.max("first_seen").alias("newest"),
    )


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Counts by value and their percentage of all rows, rounded to two places."""
    counts = count_by(df, column)
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select(
        column, "n", F.round(F.col("n").cast("double") * 100 / F.col("total"), 2).alias("percent")
    )


def repeated_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names that several rows have, with their keys."""
    return (
        df.groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ",").alias("keys"))
        .where("n > 1")
    )
