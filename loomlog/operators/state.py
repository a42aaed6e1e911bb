"""Current state, point reads, time travel and compaction: folds of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.records import upto
from loomlog.operators.layout import positions
from loomlog.schema import STRICT, TOMBSTONE

COMPACT_BLOCK = 1 << 20


def last_records(log: DataFrame, by: tuple[str, ...] = ("shard_id", "key")) -> DataFrame:
    """The last record of each key in position order, tombstones included.

    row_number() = 1 plans as a group limit on both sides of the exchange, so at most one row per key and task moves.
    """
    order = Window.partitionBy(*by).orderBy(F.col("wal_segment_id").desc(), F.col("next_offset").desc())
    return log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def state(log: DataFrame) -> DataFrame:
    """Live entries: last records without tombstones."""
    return last_records(log).where(F.col("record_type") != TOMBSTONE)


def get(log: DataFrame, *keys) -> DataFrame:
    """Live entries of some keys; the key filter goes below the fold, into the scan."""
    return state(log.where(F.col("key").isin(*keys)))


def get_ref(log: DataFrame, *keys) -> DataFrame:
    """Last records of some keys, tombstones visible."""
    return last_records(log.where(F.col("key").isin(*keys)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key) to (key, value, found). Only asked keys' records are folded; the optimizer picks the join by size."""
    wanted = keys.select("key").distinct()
    live = state(log.join(wanted, "key", "left_semi")).select("key", "value", F.lit(True).alias("found"))
    return wanted.join(live, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def state_at(log: DataFrame, shard: int, segment: int, offset: int) -> DataFrame:
    """One shard's live entries as of a cursor (records that end at or before it)."""
    return state(log.where((F.col("shard_id") == shard) & upto(segment, offset)))


def get_at(log: DataFrame, key, shard: int, segment: int, offset: int) -> DataFrame:
    return state_at(log.where(F.col("key") == key), shard, segment, offset)


def get_at_many(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(shard_id, key, at_segment, at_offset) to those with the value as of then: an as-of join.

    Log and questions are united and sorted by position per (shard, key) once; the last record before each question is
    carried to it by a window. Nothing is multiplied, unlike a range join with many questions of one key.
    """
    records = log.select("shard_id", "key", F.col("wal_segment_id").alias("seg"), F.col("next_offset").alias("off"), F.lit(0).alias("asks"), F.struct("record_type", "value").alias("r"))
    none = F.lit(None).cast(records.schema["r"].dataType)
    questions = asked.select("shard_id", "key", F.col("at_segment").alias("seg"), F.col("at_offset").alias("off"), F.lit(1).alias("asks"), none.alias("r"))
    upto_here = Window.partitionBy("shard_id", "key").orderBy("seg", "off", "asks").rowsBetween(Window.unboundedPreceding, 0)
    told = records.unionByName(questions).withColumn("r", F.last("r", ignorenulls=True).over(upto_here))
    value = F.when(F.col("r.record_type") != TOMBSTONE, F.col("r.value"))
    return told.where("asks = 1").select("shard_id", "key", F.col("seg").alias("at_segment"), F.col("off").alias("at_offset"), value.alias("value"))


def exists(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key) to (key, live, known): ``known`` also counts keys whose last record is a tombstone."""
    wanted = keys.select("key").distinct()
    last = last_records(log.join(wanted, "key", "left_semi")).groupBy("key").agg(F.max((F.col("record_type") != TOMBSTONE)).alias("live"))
    return wanted.join(last, "key", "left").select("key", F.coalesce("live", F.lit(False)).alias("live"), F.col("live").isNotNull().alias("known"))


def compacted(log: DataFrame, inline_max: int) -> DataFrame:
    """The rows of a compacted log: live rows with their seqnos, now strict, offsets derived anew in position order."""
    live = state(log).select("shard_id", "key", "value", F.col("seqno").alias("_seqno"), F.col("wal_segment_id").alias("_seg"), F.col("next_offset").alias("_off"))
    # Seqnos follow positions within a shard, so blocks of them are buckets in order.
    placed = positions(live, ["_seg", "_off"], F.floor(F.col("_seqno") / COMPACT_BLOCK), inline_max)
    return placed.withColumns({"seqno": F.col("_seqno"), "durability": F.lit(STRICT)}).drop("_seqno", "_seg", "_off", "len")
