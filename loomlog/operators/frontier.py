"""Frontiers, statistics, durability policy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.records import position
from loomlog.schema import BATCH, STRICT, TOMBSTONE, Config


def frontier(log: DataFrame) -> DataFrame:
    """(shard_id, seg, off): the end of each shard's last record."""
    return log.groupBy("shard_id").agg(F.max(position()).alias("p")).select("shard_id", F.col("p.seg").alias("seg"), F.col("p.off").alias("off"))


def durable_frontier(log: DataFrame) -> DataFrame:
    """The end of each shard's last strict record; (0, 0) where there is none."""
    none = F.struct(F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("off"))
    last = F.coalesce(F.max(F.when(F.col("durability") == STRICT, position())), none)
    return log.groupBy("shard_id").agg(last.alias("p")).select("shard_id", F.col("p.seg").alias("seg"), F.col("p.off").alias("off"))


def windows(log: DataFrame) -> DataFrame:
    """Visible and durable frontier of each shard in one pass."""
    zero = F.lit(0).cast("long")
    return log.groupBy("shard_id").agg(F.max(position()).alias("v"), F.max(F.when(F.col("durability") == STRICT, position())).alias("d")).select(
        "shard_id",
        F.col("v.seg").alias("visible_segment"), F.col("v.off").alias("visible_offset"),
        F.coalesce("d.seg", zero).alias("durable_segment"), F.coalesce("d.off", zero).alias("durable_offset"),
    )


def counts(log: DataFrame, live: DataFrame) -> DataFrame:
    """Records, tombstones and live entries of each shard."""
    all_ = log.groupBy("shard_id").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("record_type") == TOMBSTONE, 1)).alias("tombstones"), F.max("seqno").alias("last_seqno"))
    own = live.groupBy("shard_id").agg(F.count(F.lit(1)).alias("entries"))
    return all_.join(own, "shard_id", "left").select("shard_id", "records", "tombstones", "last_seqno", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"))


def dirty(log: DataFrame) -> DataFrame:
    """Per shard what lies beyond the durable frontier: ops, bytes and the strongest durability among them."""
    d = F.broadcast(durable_frontier(log).select("shard_id", F.col("seg").alias("_seg"), F.col("off").alias("_off")))  # a row a shard
    beyond = (F.col("wal_segment_id") > F.col("_seg")) | ((F.col("wal_segment_id") == F.col("_seg")) & (F.col("next_offset") > F.col("_off")))
    return log.join(d, "shard_id").where(beyond).groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("dirty_ops"), F.sum(F.col("next_offset") - F.col("wal_offset")).alias("dirty_bytes"), F.max("durability").alias("strongest")
    )


def commit_frontiers(log: DataFrame) -> DataFrame:
    """Per commit: whether it syncs (a strict op in it), and how many shards and records it touches."""
    return log.groupBy("commit_id").agg((F.max("durability") == STRICT).alias("syncs"), F.countDistinct("shard_id").alias("shards"), F.count(F.lit(1)).alias("records"))


def policy(events: DataFrame, config: Config) -> DataFrame:
    """The durability policy as a fold: (shard_id, step, kind 'op'|'tick', now_ns, bytes, durability) to the steps that sync.

    A tick syncs a shard that is dirty with batch or strict ops when the time since its first dirty op, its dirty bytes
    or its dirty ops reach their limits. Each shard's stream is folded in order, carrying four numbers.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, since, size, ops, strongest = None, None, 0, 0, -1
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["shard_id"] != shard:
                    shard, since, size, ops, strongest = row["shard_id"], None, 0, 0, -1
                now = row["now_ns"]
                if row["kind"] == "op":
                    since = now if since is None else since
                    size, ops, strongest = size + row["bytes"], ops + 1, max(strongest, row["durability"])
                elif since is not None and now >= since and strongest >= BATCH:
                    if now - since >= config.batch_sync_interval_ns or size >= config.max_dirty_bytes or ops >= config.max_dirty_ops:
                        out.append((shard, row["step"], ops, size))
                        since, size, ops, strongest = None, 0, 0, -1
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard_id", "step", "synced_ops", "synced_bytes"])

    chosen = events.select("shard_id", "step", "kind", "now_ns", "bytes", "durability")
    return chosen.repartition("shard_id").sortWithinPartitions("shard_id", "step").mapInArrow(fold, "shard_id int, step long, synced_ops long, synced_bytes long")
