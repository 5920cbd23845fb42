"""Bring collected offers into the stored state: truncation, change detection, upserts, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions.text import is_out
from offerlake.operators.order import numbered


def keep_last(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(key).orderBy(*(c.desc() for c in order))
    return df.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def stop_after_run(df: DataFrame, source: str, flag: Column, length: int, order: list[str], keep_stop: bool = False) -> DataFrame:
    """Rows of each source before the row that completes a run of `length` flagged rows.

    With `keep_stop` that row stays. A null flag ends a run.
    """
    along = Window.partitionBy(source).orderBy(*order)
    up_to = along.rowsBetween(Window.unboundedPreceding, 0)
    flagged = F.coalesce(flag, F.lit(False))
    runs = df.withColumn("_flag", flagged).withColumn("_pos", F.row_number().over(along))
    runs = runs.withColumn("_breaks", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(up_to))
    within = Window.partitionBy(source, "_breaks").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_run", F.sum(F.col("_flag").cast("int")).over(within))
    stop = F.min(F.when(F.col("_run") >= length, F.col("_pos"))).over(Window.partitionBy(source))
    cut = runs.withColumn("_stop", stop)
    keep = F.col("_stop").isNull() | (F.col("_pos") < F.col("_stop") + int(keep_stop))
    return cut.where(keep).drop("_flag", "_pos", "_breaks", "_run", "_stop")


def sequence_time(df: DataFrame, start: Column, source: str, order: list[str]) -> DataFrame:
    """Give each row a time from `start` on, the last row of a source the earliest: `seen`."""
    back = Window.partitionBy(source).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("seen", start + F.make_dt_interval(secs=F.row_number().over(back) - 1))


def scan_times(df: DataFrame, base: Column, place: Column, shop: str, *order: Column) -> DataFrame:
    """Give each scanned row a time: `base`, a second for each place of its shop, a microsecond for each row behind it.

    `order` is that of the scan, newest first, so the last row of a shop gets the earliest
    time. All rows count, also those without a url. Rows are numbered over ranges, so a large shop is no large task.
    """
    placed = numbered(df, *order, within=shop, name="_nth")
    size = placed.groupBy(shop).agg(F.count(F.lit(1)).alias("_rows"))  # a row for each shop
    same = F.col(f"a.{shop}").eqNullSafe(F.col(f"b.{shop}"))
    behind = (F.col("_rows") - 1 - F.col("_nth")).cast("decimal(18,6)") / F.lit(1_000_000).cast("decimal(18,6)")
    joined = placed.alias("a").join(F.broadcast(size).alias("b"), same).select("a.*", "b._rows")
    return joined.withColumn("seen", base + F.make_dt_interval(secs=place.cast("decimal(18,6)") + behind)).drop("_nth", "_rows")


def merge_offers(
    state: DataFrame, new: DataFrame, now: Column, only_new: bool = False, first: Column | None = None, reset: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Upsert offers by `url`: the state after the merge, with the `change` of each row.

    `change` is new, restock (it was sold out and no longer is), seen or absent. The first sight
    of what is written is the shop's date if it gives one; else now for new and restocked offers,
    and what it was for seen ones. Links are carried over. With `only_new`, seen rows stay as they were.
    `first` is a time to take instead of now for first sights, such as a scan's; with `reset` it also takes
    the place of those that are known. Columns named in `carry` are the new rows' where these are written.
    """
    old = state.select(*(F.col(c).alias(f"old_{c}") if c != "url" else "url" for c in state.columns), F.lit(True).alias("known"))
    both = old.join(new.withColumn("fresh", F.lit(True)), "url", "full_outer")
    known, fresh = F.col("known").isNotNull(), F.col("fresh").isNotNull()
    restock = known & fresh & is_out(F.col("old_stock_status")) & ~is_out(F.col("stock_status"))
    change = F.when(~fresh, "absent").when(~known, "new").when(restock, "restock").otherwise("seen")
    taken = F.col("change").isin("new", "restock") if only_new else F.col("change") != "absent"
    rows = both.withColumn("change", change)
    given = F.when(taken, F.col("first_seen"))
    fresh_sight = F.col("change").isin("new", "restock") | (taken & F.lit(reset))
    sight = F.coalesce(given, F.when(fresh_sight, now if first is None else first).otherwise(F.col("old_first_seen")))
    pick = lambda c: F.when(taken, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    return rows.select(
        "url",
        pick("price_value"),
        pick("stock_status"),
        sight.alias("first_seen"),
        F.when(taken, now).otherwise(F.col("old_last_seen")).alias("last_seen"),
        F.coalesce("old_product_url", "product_url").alias("product_url"),
        *map(pick, carry),
        "change",
    )


def add_usage(state: DataFrame, calls: DataFrame) -> DataFrame:
    """Add calls to the counts by service and day."""
    counted = calls.groupBy("service", "day").agg(F.count(F.lit(1)).alias("requests"))
    return state.unionByName(counted).groupBy("service", "day").agg(F.sum("requests").alias("requests"))


def record_failures(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Fold attempts into the open failures of each url.

    `events` has url, ok, reason and at. A success resolves the entry; failures after the
    last success count on, from the earlier count if there was no success.
    """
    solved = F.max(F.when(F.col("ok"), F.col("at")))
    last = events.groupBy("url").agg(solved.alias("solved_at"))
    failed = events.where(~F.col("ok")).join(last, "url").where("solved_at IS NULL OR at > solved_at")
    since = failed.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("reason", F.struct("at", "reason")).alias("reason"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    old = ledger.select("url", F.col("attempts").alias("had"), F.col("reason").alias("was"), F.col("first_at").alias("since"), F.col("last_at").alias("until"))
    joined = old.join(last, "url", "full_outer").join(since, "url", "left")
    carried = F.when(F.col("solved_at").isNull(), F.coalesce("had", F.lit(0))).otherwise(0)
    return joined.select(
        "url",
        (carried + F.coalesce("n", F.lit(0))).alias("attempts"),
        F.coalesce("reason", "was").alias("reason"),
        F.when(F.col("solved_at").isNull(), F.coalesce("since", "first_at")).otherwise(F.col("first_at")).alias("first_at"),
        F.coalesce("last_at", "until").alias("last_at"),
        (F.col("solved_at").isNotNull() & F.col("n").isNull()).alias("resolved"),
    )


def due(queue: DataFrame, ledger: DataFrame, as_of: Column, attempts: int = 3, days: int = 3, force: bool = False) -> DataFrame:
    """Rows that may be tried: not failed too often, and not too lately."""
    recent = F.col("last_at") >= as_of - F.make_dt_interval(F.lit(days))
    wait = ledger.where(~F.col("resolved") & ((F.col("attempts") >= attempts) | recent))
    return queue if force else queue.join(wait.select("url"), "url", "left_anti")


def update_from(df: DataFrame, pairs: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column from (key, value) rows; of repeated keys the greatest value counts."""
    values = pairs.groupBy(key).agg(F.max("value").alias("value"))
    return df.join(values, key, "left").withColumn(column, F.coalesce("value", column)).drop("value")


def clear_where(df: DataFrame, bad: Column, column: str) -> DataFrame:
    return df.withColumn(column, F.when(~F.coalesce(bad, F.lit(False)), F.col(column)))


def delete_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Delete the rows that are like the pattern; rows with a null stay."""
    return df.where(~F.coalesce(F.col(column).like(pattern), F.lit(False)))


def apply_stock_checks(offers: DataFrame, checks: DataFrame) -> DataFrame:
    """Take status, price and time of the latest check of each offer; offers unchecked stay."""
    latest = keep_last(checks, "url", F.col("checked_at")).select("url", F.col("status").alias("_s"), F.col("price").alias("_p"), F.col("checked_at").alias("_t"))
    joined = offers.join(latest, "url", "left")
    return joined.select(
        *(c for c in offers.columns if c not in ("stock_status", "price_value", "last_seen")),
        F.coalesce("_s", "stock_status").alias("stock_status"),
        F.coalesce("_p", "price_value").alias("price_value"),
        F.coalesce("_t", "last_seen").alias("last_seen"),
    )


def run_statistics(merged: DataFrame, shop: str) -> DataFrame:
    """Per shop how many offers a merge found new, restocked and seen, and how many it wrote."""
    change = F.col("change")
    return merged.groupBy(shop).agg(
        F.count_if(change == "new").alias("new"),
        F.count_if(change == "restock").alias("restocked"),
        F.count_if(change == "seen").alias("seen"),
        F.count_if(change != "absent").alias("written"),
    )
