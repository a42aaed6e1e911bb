"""Logs derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.records import checksum
from loomlog.operators.layout import positions

INLINE_MAX = 17
SHARDS = 4


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as operations: a user's last event is the user's value, an error deletes it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_type") == "error", None).otherwise(F.concat("event_type", F.lit("|"), "props"))
    return events.select(
        (F.col("user_id") % SHARDS).cast("int").alias("shard_id"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        value.alias("value"),
        (F.col("event_id") % 3).cast("int").alias("durability"),
        F.floor(F.col("event_id") / 100).alias("commit_id"),
        "ts",
        "event_id",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of those operations in (ts, event_id) order, positions by hour and shard."""
    log = positions(event_ops(spark, sf_dir), ["ts", "event_id"], F.date_trunc("hour", "ts"), INLINE_MAX)
    return log.drop("ts", "len")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a log: the last status of each customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (F.col("o_custkey") % SHARDS).cast("int").alias("shard_id"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"),
        F.lit(2).alias("durability"), F.floor(F.col("o_orderkey") / 100).alias("commit_id"), "o_orderdate", "o_orderkey",
    )
    return positions(orders, ["o_orderdate", "o_orderkey"], F.to_date("o_orderdate"), INLINE_MAX).drop("len", "o_orderdate", "o_orderkey")


def with_checksum(log: DataFrame) -> DataFrame:
    return log.withColumn("checksum", checksum(F.col("key"), F.col("value")))
