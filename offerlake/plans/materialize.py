"""Materialised views: every refresh writes a new version, and readers keep theirs until they ask again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "version string, at timestamp"


def _log(folder: str) -> str:
    return f"{folder}/_versions"


def refresh(df: DataFrame, folder: str, name: str | None = None, sort_by: tuple[str, ...] = ()) -> str:
    """Write the rows as a new version and then name it in the folder's log; return its place.

    A version counts once it is in the log, so a failed write is never read. `sort_by`
    sorts within files, so that their statistics let readers skip. With `name` the
    version also becomes that temporary view.
    """
    spark = df.sparkSession
    place = f"{folder}/v-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(place)
    entry = spark.range(1).select(F.lit(place).alias("version"), F.current_timestamp().alias("at"))
    entry.write.mode("append").parquet(_log(folder))
    if name:
        spark.read.parquet(place).createOrReplaceTempView(name)
    return place


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last version that was finished."""
    versions = spark.read.schema(_SCHEMA).parquet(_log(folder))
    return spark.read.parquet(versions.agg(F.max_by("version", "at")).head()[0])
