"""Small set operations over keyed rows that ingest, linking and lists are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_known(rows: DataFrame, cache: DataFrame, on: str, value: str, name: str, *order: str) -> DataFrame:
    """Add to each row the `value` that the first cached row, in the given order, has under the same `on`; null without one.

    One pass over the cache: the least row of each key is kept while rows are aggregated.
    """
    best = cache.groupBy(on).agg(F.min(F.struct(*order, F.col(value).alias("_value"))).alias("_best"))
    return rows.join(best.select(on, F.col("_best._value").alias(name)), on, "left")


def first_source(key: str, *found: DataFrame) -> DataFrame:
    """The keys of several lists of candidates, each once, with the place `pos` (from 1) of the first list that has it."""
    placed = (df.select(key, F.lit(pos).alias("pos")) for pos, df in enumerate(found, 1))
    return reduce(DataFrame.unionByName, placed).groupBy(key).agg(F.min("pos").alias("pos"))


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct keys that are wanted and not known."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def differing_keys(rows: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """Keys for which one of two conditions holds on some row and the other on none: `key`, `in_first`. Rows are read once."""
    flags = rows.groupBy(key).agg(F.bool_or(F.coalesce(first, F.lit(False))).alias("in_first"), F.bool_or(F.coalesce(second, F.lit(False))).alias("_second"))
    return flags.where("in_first <> _second").select(key, "in_first")


def newest_with(rows: DataFrame, facts: DataFrame, on: str, n: int, *order: Column) -> DataFrame:
    """The first `n` rows in the given order, with their facts; the limit comes before the join."""
    return rows.orderBy(*order).limit(n).join(facts, on)


def chosen_first(counts: DataFrame, column: str, chosen: tuple[str, ...], n: int) -> DataFrame:
    """The first `n` options of a filter: the chosen ones first, then by name whatever its case."""
    return counts.orderBy(F.col(column).isin(*chosen).desc(), F.lower(column), column).limit(n)


def classified(rows: DataFrame, name: str, cases: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """Add a class: that of the first case whose condition holds."""
    found = reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(otherwise))
    return rows.withColumn(name, found)
