"""Bind tables to the four roles that the views are made of: offers, extraction, product, producer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """The four tables; `unique` says that the last three have each key once, so nothing regroups them."""

    offers: DataFrame
    extraction: DataFrame
    product: DataFrame
    producer: DataFrame
    unique: bool = False


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt over as many tasks as the session shuffles to, for work that costs far more than a row's way there.

    A small file is one task, or a few, however much is made of each of its rows.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def benchmark_roles(spark: SparkSession, sf_dir: str) -> Roles:
    """The roles as played by the benchmark tables, with misses and nulls in every join."""
    key = F.col("o_orderkey")
    sale = F.when(key % 13 == 0, " 20% OFF").when(key % 17 == 0, " SALE!!").when(key % 19 == 0, " sale").when(key % 23 == 0, " (賞味期限間近)").otherwise("")
    status = F.when(F.col("o_orderstatus") == "F", "In Stock").when(F.col("o_orderstatus") == "O", "Sold Out")
    offers = read(spark, sf_dir, "orders").select(
        key.cast("string").alias("url"),
        F.concat("o_orderpriority", F.lit(" lot "), (F.col("o_custkey") % 97).cast("string"), sale).alias("name"),
        F.col("o_totalprice").alias("price_value"),
        F.concat(F.floor("o_totalprice").cast("string"), F.lit("円")).alias("price"),
        F.coalesce(status, F.when(key % 2 == 0, "Dead Link")).alias("stock_status"),
        F.col("o_orderpriority").alias("shop"),
        F.col("o_orderdate").alias("first_seen"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 30).cast("int"))).alias("last_seen"),
        F.when(key % 5 != 0, F.concat(F.lit("/img/"), key.cast("string"))).alias("image"),
        F.when(key % 7 == 0, None)
        .when(key % 11 == 0, F.concat(F.lit("/search?q="), F.col("o_custkey").cast("string")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("product_url"),
    )
    kind = F.max("l_returnflag")
    extraction = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("url"))
        .agg(
            F.when(kind == "A", "beer").when(kind == "N", "set").otherwise("glass").alias("product_type"),
            F.bool_or(F.col("l_linenumber") > 6).alias("is_set"),
            F.when(kind != "N", F.concat(F.lit("品"), kind)).alias("title_name_jp"),
            F.concat(F.lit("Maker "), F.max("l_linestatus")).alias("title_producer_en"),
            F.when(F.max("l_linestatus") == "F", "醸造F").alias("title_producer_jp"),
            F.concat(F.lit("Beer "), F.max("l_linenumber").cast("string")).alias("title_name_en"),
        )
    )
    product = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("product_url"),
        F.col("c_name").alias("product_name"),
        F.col("c_mktsegment").alias("style"),
        F.col("c_acctbal").alias("rating"),
        ((F.col("c_custkey") % 140) / 10).alias("abv"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 120).alias("ibu"),
        (F.col("c_custkey") * 7 % 1000).alias("rating_count"),
        F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("/label/"), F.col("c_custkey").cast("string"))).alias("product_image"),
        F.col("c_nationkey").cast("string").alias("producer_url"),
        (F.lit("1998-07-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 40).cast("int"))).alias("fetched_at"),
    )
    producer = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("producer_url"),
        F.col("n_name").alias("producer_name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("醸造所"), F.col("n_nationkey").cast("string"))).alias("producer_name_jp"),
        F.col("n_regionkey").cast("string").alias("location"),
        F.when(F.col("n_nationkey") % 3 == 0, "Micro").when(F.col("n_nationkey") % 3 == 1, "Brew Pub").alias("producer_type"),
        F.concat(F.lit("/logo/"), F.col("n_nationkey").cast("string")).alias("producer_logo"),
        F.col("n_nationkey").cast("long").alias("producer_id"),
    )
    return Roles(offers, extraction, product, producer, unique=True)  # grouped, or by a primary key
