"""Offers out of JSON payloads of product lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "struct<title:string,handle:string,tags:array<string>,product_type:string,published_at:string,created_at:string,"
    "updated_at:string,variants:array<struct<price:string,available:boolean>>,images:array<struct<src:string>>>"
)


def first_time(*columns: str) -> Column:
    """The first of some ISO times that can be read."""
    return F.coalesce(*(F.try_to_timestamp(F.col(c)) for c in columns))


def offers(payloads: DataFrame, base_url: str, shop: str, column: str = "payload") -> DataFrame:
    """One offer for each payload: url, name, price, stock, image and time. Unreadable ones give nothing."""
    read = payloads.select(F.from_json(column, PAYLOAD).alias("p")).where("p.handle IS NOT NULL").select("p.*")
    price = F.try_element_at("variants", F.lit(1)).price
    available = F.coalesce(F.exists("variants", lambda v: F.coalesce(v.available, F.lit(False))), F.lit(False))
    return read.select(
        F.concat(F.lit(base_url), "handle").alias("url"),
        F.col("title").alias("name"),
        F.concat(F.split_part(price, F.lit("."), F.lit(1)), F.lit("円")).alias("price"),
        F.when(available, "In Stock").otherwise("Sold Out").alias("stock_status"),
        F.try_element_at("images", F.lit(1)).src.alias("image"),
        F.lit(shop).alias("shop"),
        first_time("updated_at", "published_at", "created_at").alias("first_seen"),
    )


def with_tag(payloads: DataFrame, tag: str) -> DataFrame:
    """Products that have a tag, in any case."""
    return payloads.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
