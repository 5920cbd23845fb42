"""Incremental ingest: each micro-batch of collected offers is merged into the stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlake.operators.ingest import keep_last, merge_offers

STATE = "url string, price_value double, stock_status string, first_seen timestamp_ntz, last_seen timestamp_ntz, product_url string"


def state_at(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The state after a version; empty before the first."""
    return spark.read.schema(STATE).parquet(f"{folder}/v{version}") if version >= 0 else spark.createDataFrame([], STATE)


def start_ingest(spark: SparkSession, incoming: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Merge new Parquet files of `incoming` (url, price_value, stock_status, first_seen, product_url, at).

    Batch n writes `folder/vn` from `folder/v(n-1)`; run again after a failure it writes
    the same version once more, so every batch counts once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = keep_last(batch, "url", F.col("at"))
        now = F.coalesce(F.lit(batch.agg(F.max("at")).head()[0]), F.lit(None)).cast("timestamp_ntz")
        merged = merge_offers(state_at(spark, folder, number - 1), new.drop("at"), now).drop("change")
        merged.write.mode("overwrite").parquet(f"{folder}/v{number}")

    schema = "url string, price_value double, stock_status string, first_seen timestamp_ntz, product_url string, at timestamp_ntz"
    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
