"""Checkpoints and snapshots as relations, and their validation."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog import errors
from loomlog.operators.frontier import durable_frontier, frontier
from loomlog.operators.state import state
from loomlog.schema import CHECKPOINT_VERSION, DURABLE


def cursors(log: DataFrame, shard_count: int, kind: str) -> DataFrame:
    """A row for each shard, (0, 0) for those without records."""
    spark = log.sparkSession
    ends = durable_frontier(log) if kind == DURABLE else frontier(log)
    every = spark.range(shard_count).select(F.col("id").cast("int").alias("shard_id"))
    zero = F.lit(0).cast("long")
    return every.join(F.broadcast(ends), "shard_id", "left").select("shard_id", F.coalesce("seg", zero).alias("wal_segment_id"), F.coalesce("off", zero).alias("wal_offset"))


def checkpoint(log: DataFrame, shard_count: int, kind: str) -> DataFrame:
    """One row: version, shard_count, kind, high_seqno and cursors by shard. A snapshot's seqno comes from all records."""
    at = cursors(log, shard_count, kind).agg(F.sort_array(F.collect_list(F.struct("shard_id", "wal_segment_id", "wal_offset"))).alias("cursors"))
    high = log.agg(F.coalesce(F.max("seqno"), F.lit(0)).alias("high_seqno"))
    version = [F.lit(CHECKPOINT_VERSION).alias("version"), F.lit(shard_count).alias("shard_count"), F.lit(kind).alias("kind")]
    return high.join(at).select(*version, "high_seqno", "cursors")  # one row each


def captured(log: DataFrame, shard_count: int, kind: str, now_ns: int | None = None) -> dict:
    row = checkpoint(log, shard_count, kind).first()
    return {
        "version": row["version"], "shard_count": row["shard_count"], "kind": kind, "created_at_unix_ns": time.time_ns() if now_ns is None else now_ns,
        "high_seqno": row["high_seqno"], "cursors": [[c["wal_segment_id"], c["wal_offset"]] for c in row["cursors"]],
    }


def violations(asked: DataFrame, windows: DataFrame, kind: str) -> DataFrame:
    """(shard_id, wal_segment_id, wal_offset) against frontier windows: whether each cursor is within reach."""
    ok = lambda s, o: (F.col("wal_segment_id") < F.col(s)) | ((F.col("wal_segment_id") == F.col(s)) & (F.col("wal_offset") <= F.col(o)))
    met = asked.join(F.broadcast(windows), "shard_id", "left")
    zero = F.lit(0).cast("long")
    met = met.withColumns({c: F.coalesce(c, zero) for c in ("visible_segment", "visible_offset", "durable_segment", "durable_offset")})
    reach = ok("visible_segment", "visible_offset")
    if kind == DURABLE:
        reach = reach & ok("durable_segment", "durable_offset")
    return met.select("shard_id", reach.alias("valid"))


def validate(found: dict, windows: DataFrame, shard_count: int) -> None:
    spark = windows.sparkSession
    if found["version"] != CHECKPOINT_VERSION:
        raise errors.UnsupportedCheckpointVersion(str(found["version"]))
    if found["shard_count"] != shard_count or len(found["cursors"]) != shard_count:
        raise errors.CheckpointShardCountMismatch(f"{found['shard_count']} for {shard_count}")
    asked = spark.createDataFrame([(k, s, o) for k, (s, o) in enumerate(found["cursors"])], "shard_id int, wal_segment_id long, wal_offset long")
    if bad := violations(asked, windows, found["kind"]).where("not valid").take(1):
        raise errors.InvalidCheckpointFile(f"the cursor of shard {bad[0]['shard_id']} lies beyond the frontier")


def snapshot(log: DataFrame) -> DataFrame:
    """Entries of a snapshot: live state, no tombstones, whatever the kind of its checkpoint."""
    return state(log).select("shard_id", "key", "value")


def restored(entries: DataFrame, order: str = "key") -> DataFrame:
    """Entries to ops of a fresh log: arrival order by key within each shard."""
    return entries.select("shard_id", "key", "value", F.col(order).alias("arrival"))
