"""Replay: shard pages, the all-shard walk, merged pages and their cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.errors import InvalidGlobalMergeCursor
from loomlog.functions.records import after

Cursor = tuple[int, int]  # segment, offset


def bounded(log: DataFrame, frontier: DataFrame) -> DataFrame:
    """Records that end at or before their shard's frontier (shard_id, seg, off)."""
    f = F.broadcast(frontier.select("shard_id", F.col("seg").alias("_seg"), F.col("off").alias("_off")))  # a row a shard
    inside = (F.col("wal_segment_id") < F.col("_seg")) | ((F.col("wal_segment_id") == F.col("_seg")) & (F.col("next_offset") <= F.col("_off")))
    return log.join(f, "shard_id").where(inside).drop("_seg", "_off")


def read_from(log: DataFrame, shard: int, cursor: Cursor, limit: int) -> DataFrame:
    """A shard's page: records after the cursor in position order."""
    if limit == 0:
        return log.limit(0)
    return log.where((F.col("shard_id") == shard) & after(*cursor)).orderBy("wal_segment_id", "next_offset").limit(limit)


def read_from_all(log: DataFrame, shard: int, cursor: Cursor, limit: int) -> DataFrame:
    """The walk over shards in turn: the rest of ``shard`` after the cursor, then the following ones."""
    ahead = (F.col("shard_id") > shard) | ((F.col("shard_id") == shard) & after(*cursor))
    return log.where(ahead).orderBy("shard_id", "wal_segment_id", "next_offset").limit(limit)


def checked(cursors: list[Cursor], shard_count: int) -> list[Cursor]:
    if len(cursors) != shard_count:
        raise InvalidGlobalMergeCursor(f"{len(cursors)} cursors for {shard_count} shards")
    return cursors


def since(log: DataFrame, cursors: list[Cursor]) -> DataFrame:
    """Records after each shard's cursor. The vector is small, so it becomes predicates that reach the scan."""
    any_ = F.lit(False)
    for shard, cursor in enumerate(cursors):
        any_ = any_ | ((F.col("shard_id") == shard) & after(*cursor))
    return log.where(any_)


def merged_page(log: DataFrame, cursors: list[Cursor], limit: int, shard_count: int | None = None) -> DataFrame:
    """The first records after the cursors by (seqno, shard): TakeOrderedAndProject, each task sends ``limit`` rows at most."""
    if limit == 0:  # before the vector is looked at
        return log.limit(0)
    checked(cursors, shard_count if shard_count is not None else len(cursors))
    return since(log, cursors).orderBy("seqno", "shard_id").limit(limit)


def merged_all(log: DataFrame) -> DataFrame:
    """The whole log in merged order."""
    return log.orderBy("seqno", "shard_id")


def merged_pages(log: DataFrame, size: int) -> DataFrame:
    """Adds page and item numbers of a full merged read in pages.

    Seqnos of a shard have no gaps from 1 on, so the place of (seqno, shard) in the merge is the sum over shards of
    min(last seqno, seqno) less one where the shard comes later: only shard counts are needed, no global sort.
    """
    ends = log.groupBy("shard_id").agg(F.max("seqno")).collect()  # a row a shard
    place = F.lit(-1).cast("long")
    for shard, last in ends:
        place = place + F.least(F.lit(last), F.col("seqno") - F.when(F.col("shard_id") >= shard, 0).otherwise(1))
    numbered = log.withColumn("_place", place)
    return numbered.withColumns({"page": F.floor(F.col("_place") / size), "item": F.col("_place") % size}).drop("_place")


def next_cursors(page: DataFrame, cursors: list[Cursor]) -> DataFrame:
    """The merge cursor behind a page: the end of each shard's last emitted record, else where it stood."""
    spark = page.sparkSession
    stood = spark.createDataFrame([(k, s, o) for k, (s, o) in enumerate(cursors)], "shard_id int, seg long, off long")
    moved = page.groupBy("shard_id").agg(F.max(F.struct("wal_segment_id", "next_offset")).alias("p"))
    return stood.join(F.broadcast(moved), "shard_id", "left").select("shard_id", F.coalesce("p.wal_segment_id", "seg").alias("wal_segment_id"), F.coalesce("p.next_offset", "off").alias("wal_offset"))


def page_stats(page: DataFrame) -> DataFrame:
    """Counters of a page: items and the bytes of their keys and values."""
    return page.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("bytes"))


def valid_prefix(records: DataFrame) -> DataFrame:
    """Recovery: each shard's records before its first bad one (column ``ok``). The first bad places are an aggregate of a row
    a shard, so no shard is read by one task."""
    place = F.struct("wal_segment_id", "next_offset")
    bad = records.where(~F.coalesce("ok", F.lit(False))).groupBy("shard_id").agg(F.min(place).alias("_bad"))
    found = records.join(F.broadcast(bad), "shard_id", "left")  # a row a shard
    return found.where(F.col("_bad").isNull() | (place < F.col("_bad"))).drop("_bad")
