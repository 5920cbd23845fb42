"""Cut a plan's lineage where its rows must not be computed twice."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _of_this_machine() -> str:
    return tempfile.mkdtemp(prefix="offerlake-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`; only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _of_this_machine()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
