"""A scan of shops: from list pages to the new state, in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import text
from offerlake.operators import ingest
from offerlake.sources import shops

#: What a state holds beside times and links.
CARRIED = ("name", "price", "image", "shop")


def until_known(found: DataFrame, known: DataFrame, rules: list[shops.ShopRule]) -> DataFrame:
    """Offers of each shop, newest first, before the one that completes its rule's run of known ones (`known`: `url`)."""
    flagged = found.join(known.select("url").distinct().withColumn("_known", F.lit(True)), "url", "left")
    parts = []
    for length in sorted({rule.stop_after for rule in rules}):
        own = flagged.where(F.col("shop").isin(*(rule.shop for rule in rules if rule.stop_after == length)))
        parts.append(ingest.stop_after_run(own, "shop", F.col("_known").isNotNull(), length, ["page", "pos"]))
    return reduce(DataFrame.unionByName, parts).drop("_known").select(*found.columns)


@dataclass(frozen=True)
class Scan:
    """The `state` after a scan, with the `change` of each offer, and the shops' `statistics`."""

    state: DataFrame
    statistics: DataFrame


def scan(
    pages: DataFrame,
    rules: list[shops.ShopRule],
    state: DataFrame,
    now: Column,
    only_new: bool = False,
    full: bool = False,
    reset_dates: bool = False,
    limit: int | None = None,
) -> Scan:
    """Read the shops' list pages (`shop`, `page`, `body`) and merge their offers into a state.

    `state` has url, price_value, stock_status, first_seen, last_seen, product_url and `CARRIED`. With `only_new`
    a shop is read until a run of known offers, unless `full`, and known offers are written only if they are
    restocked. `limit` bounds the offers of a shop. An offer that a shop lists twice counts where
    it stands last, as the oldest. First sights without a date of the shop are `now`, a second for each
    shop before in `rules` and a microsecond for each offer behind; with `reset_dates` those of known offers as well.
    """
    return merged(shops.offers(pages, rules), rules, state, now, only_new, full, reset_dates, limit)


def merged(
    found: DataFrame,
    rules: list[shops.ShopRule],
    state: DataFrame,
    now: Column,
    only_new: bool = False,
    full: bool = False,
    reset_dates: bool = False,
    limit: int | None = None,
) -> Scan:
    """`scan` of offers that are read already (`shops.offers`)."""
    if only_new and not full:
        found = until_known(found, state, rules)
    if limit is not None:
        nth = F.row_number().over(Window.partitionBy("shop").orderBy("page", "pos"))
        found = found.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")
    place = F.array_position(F.array(*(F.lit(rule.shop) for rule in rules)), F.col("shop")) - 1
    timed = ingest.scan_times(found, now, place, "shop", F.col("page"), F.col("pos"))
    one = ingest.keep_last(timed, "url", F.col("page"), F.col("pos"), F.col("shop"))
    kind = state.schema["first_seen"].dataType
    new = one.select(
        "url", text.price_digits(F.col("price")).cast("double").alias("price_value"), "stock_status", F.col("first_seen").cast(kind).alias("first_seen"),
        F.lit(None).cast("string").alias("product_url"), *CARRIED, "seen",
    )
    after = ingest.merge_offers(state, new, now, only_new, first=F.col("seen"), reset=reset_dates, carry=CARRIED)
    return Scan(after, ingest.run_statistics(after, "shop"))
