"""Appending: sequence numbers, byte offsets, segments, commit windows and tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.records import record_length, record_type, value_length


def positions(rows: DataFrame, order: list[str], bucket: Column, inline_max: int) -> DataFrame:
    """Adds seqno, wal_segment_id 0, wal_offset and next_offset per shard.

    Running counts and sums are taken in two levels, within (shard, bucket) and over the few bucket totals, so the
    number of tasks follows the number of buckets and not the number of shards. ``bucket`` must not decrease along
    ``order`` within a shard.
    """
    rows = rows.withColumn("record_type", record_type(F.col("value"), inline_max))
    rows = rows.withColumns({"value_len": value_length(F.col("value")), "len": record_length(F.col("key"), F.col("value"), F.col("record_type")), "bucket": bucket})
    totals = rows.groupBy("shard_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"))
    ahead = Window.partitionBy("shard_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard_id", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("b0"))
    own = Window.partitionBy("shard_id", "bucket").orderBy(*order)
    local = rows.withColumns({"k": F.row_number().over(own).cast("long"), "upto": F.sum("len").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    return (
        local.join(starts, ["shard_id", "bucket"])
        .withColumns({"seqno": F.col("n0") + F.col("k"), "wal_segment_id": F.lit(0).cast("long"), "next_offset": F.col("b0") + F.col("upto")})
        .withColumn("wal_offset", F.col("next_offset") - F.col("len"))
        .drop("bucket", "k", "upto", "n0", "b0")
    )


def segments(rows: DataFrame, limit: int) -> DataFrame:
    """(shard_id, seqno, len) to (shard_id, seqno, wal_segment_id, wal_offset, next_offset) with rotation at ``limit``.

    A running sum that restarts can't be a window function; it is a fold over each shard's sorted stream that carries two
    numbers from batch to batch. A record beyond the limit gets a segment of its own.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, tail = None, 0, 0
        for batch in batches:
            shards, sizes = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            out_segment, out_start, ends = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.cumsum(sizes)
            edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(sizes) else []
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if shards[first] != shard:
                    shard, segment, tail = shards[first], 0, 0
                k = first
                while k < last:  # a step a segment
                    before = ends[k] - sizes[k]
                    fits = min(int(np.searchsorted(ends, before + limit - tail, "right")), last) if tail <= limit else k
                    if fits <= k and tail:
                        segment, tail = segment + 1, 0
                        continue
                    fits = max(fits, k + 1)
                    out_segment[k:fits], out_start[k:fits] = segment, tail + ends[k:fits] - sizes[k:fits] - before
                    tail += ends[fits - 1] - before
                    k = fits
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out_segment), pa.array(out_start), pa.array(out_start + sizes)], ["shard_id", "seqno", "wal_segment_id", "wal_offset", "next_offset"])

    chosen = rows.select("shard_id", F.col("seqno").cast("long"), F.col("len").cast("long"))
    return chosen.repartition("shard_id").sortWithinPartitions("shard_id", "seqno").mapInArrow(fold, "shard_id int, seqno long, wal_segment_id long, wal_offset long, next_offset long")


def commit_windows(log: DataFrame) -> DataFrame:
    """Per commit and shard: start, end, record count, first and last seqno."""
    return log.groupBy("shard_id", "commit_id").agg(
        F.min("wal_offset").alias("start_offset"),
        F.max("next_offset").alias("end_offset"),
        F.count(F.lit(1)).alias("record_count"),
        F.min("seqno").alias("first_seqno"),
        F.max("seqno").alias("last_seqno"),
    )


def tokens(batch: DataFrame) -> DataFrame:
    """One token per touched shard: the end position and seqno of its last record."""
    last = F.max(F.struct("wal_segment_id", "next_offset", "seqno"))
    return batch.groupBy("shard_id").agg(last.alias("t")).select("shard_id", "t.wal_segment_id", "t.next_offset", "t.seqno")
