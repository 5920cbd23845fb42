"""What a list of offers shows of a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of images that stand for none. Fixed values.
DEFAULT_IMAGES = ("badge-beer-default", "no_image", "placeholder", "/og/")
NO_IMAGE = "no-image"


def shown_name(link: Column, kind: Column, product_name: Column, offer_name: Column) -> Column:
    """The product's name for a linked beer, else the offer's."""
    return F.when(link.isNotNull() & (kind == "beer"), F.coalesce(product_name, offer_name)).otherwise(offer_name)


def _real(image: Column) -> Column:
    marks = (F.contains(image, F.lit(m)) for m in DEFAULT_IMAGES)
    return F.when(~reduce(lambda a, b: a | b, marks), F.nullif(image, F.lit("")))


def image(product_image: Column, offer_image: Column) -> Column:
    """The product's image unless it is missing or a default, else the offer's."""
    return F.coalesce(_real(product_image), _real(offer_image), F.lit(NO_IMAGE))


def group_image(product_image: Column, items: Column) -> Column:
    """A group's image: the product's, else that of its cheapest item; items without a price come last, equal prices go by url."""
    cheapest = F.array_min(F.transform(items, lambda i: F.struct(i.price_value.isNull().alias("none"), i.price_value, i.url, i.image)))
    return image(product_image, cheapest.image)


def money(price: Column) -> Column:
    """A price in whole yen with thousands apart; a dash for none or zero."""
    return F.when(F.coalesce(price, F.lit(0)) == 0, "¥-").otherwise(F.concat(F.lit("¥"), F.format_number(price, 0)))


def day(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy/MM/dd"), F.lit("-"))


def rating(value: Column) -> Column:
    return F.format_string("%.2f", value.cast("double"))


def is_new(seen: Column, as_of: Column, hours: int = 24) -> Column:
    """Whether it was first seen within some hours before a time."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(seen.cast("timestamp"))
    return F.coalesce(age.between(0, hours * 3600), F.lit(False))
