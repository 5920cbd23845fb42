"""Number rows in a given order without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.plans.lineage import checkpointed


def numbered(df: DataFrame, *order: Column, within: str | None = None, name: str = "nth") -> DataFrame:
    """Add the place of each row from 0 on, in all rows or in those with the same `within`.

    Rows are dealt to ranges of the order and sorted there; a row's number is its place in
    its range and the number of rows in the ranges before, so ranges, not groups, bound a
    task. The order should be total, else equal rows are numbered in any way. A null `within` is
    a group like any other.
    """
    keys = [*([F.asc_nulls_first(within)] if within else []), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    marked = checkpointed(ranged.withColumns({"_range": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    group = [within] if within else []
    counts = marked.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # a group has a row for each range it reaches into
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    same = F.col("m._range") == F.col("s._range")
    if within:
        same = same & F.col(f"m.{within}").eqNullSafe(F.col(f"s.{within}"))
    joined = marked.alias("m").join(starts.alias("s"), same)
    return joined.select(*(F.col(f"m.{c}") for c in df.columns), (F.col("_place") + F.col("_start")).alias(name))
