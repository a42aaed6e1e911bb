"""Tailing the log with Structured Streaming: merged tail, consumers, incremental state."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomlog import errors
from loomlog.api import Log
from loomlog.functions.records import after
from loomlog.operators.state import last_records
from loomlog.schema import LOG, TOMBSTONE
from loomlog.sources import files
from loomlog.sources.store import with_checked_values


def tail(log: Log, files_per_trigger: int = 64, start: dict | None = None) -> DataFrame:
    """A stream of the log's records from ``start`` on (see beginning()); Spark's offset log is the resumable cursor.

    A commit's files appear by the rename that publishes it, so the stream has published commits only, each once. The first
    generation is read whole behind the start's cursors. A compaction is followed: its base holds what was delivered already
    and is left out, later commits come. A restore replaces the log: the stream fails with LogReplaced.
    """
    start = start or beginning(log)
    stream = log.spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    rows = stream.parquet(f"{log.store.path}/gen=*/{{base,commits}}").withColumn("_path", F.col("_metadata.file_path"))
    generation, base = F.regexp_extract("_path", r"/gen=(\d+)/", 1).cast("int"), F.col("_path").contains("/base/")
    behind = F.lit(False)
    for shard, (segment, offset) in enumerate(start["cursors"]):
        behind = behind | ((F.col("shard_id") == shard) & after(segment, offset))
    wanted = F.when(generation == start["generation"], behind).otherwise(~base)
    return rows.where((generation >= start["generation"]) & wanted).drop("_path")


def beginning(log: Log, checkpoint: dict | None = None) -> dict:
    """Where a consumer starts: a checkpoint of the present generation, or the log's beginning."""
    if checkpoint is not None:
        log.validate_checkpoint(checkpoint)
    cursors = checkpoint["cursors"] if checkpoint is not None else log.zero_cursors()
    return {"generation": log.store.generation, "cursors": [list(c) for c in cursors]}


def _started(log: Log, folder: str, checkpoint: dict | None) -> dict:
    """The start of a consumer, kept beside its stream's offsets, so a later run goes on from the same one."""
    place = f"{folder}/log-start.json"
    if files.exists(log.spark, place):
        return json.loads(files.read(log.spark, place))
    start = beginning(log, checkpoint)
    files.write(log.spark, place, json.dumps(start).encode())
    return start


def _not_replaced(log: Log, start: dict) -> None:
    for generation in range(start["generation"] + 1, log.store.generation + 1):
        if any(m.get("kind") == "restore" for m in log.store.manifests(generation)):
            raise errors.LogReplaced(f"by generation {generation}")


def consume(log: Log, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True, interval: str = "1 second", since: dict | None = None, files_per_trigger: int = 64) -> StreamingQuery:
    """Each micro-batch, in merged order, to ``handle(rows, batch_id)``; a batch id that comes again after a failure is the
    same batch, so an idempotent handler sees every record exactly once. ``once`` stops at the present end; ``since`` is a
    saved checkpoint behind which the first run starts."""
    start = _started(log, checkpoint, since)
    _not_replaced(log, start)

    def each(batch: DataFrame, batch_id: int) -> None:
        _not_replaced(log, start)
        handle(with_checked_values(batch).orderBy("seqno", "shard_id"), batch_id)

    writer = tail(log, files_per_trigger, start).writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def follow(log: Log, cursors: list[tuple[int, int]], handle: Callable[[list], None], page: int = 256, max_items: int | None = None, idle_rounds: int = 1, seconds: float = 0.2) -> list[tuple[int, int]]:
    """The merged tail as a loop over pages: hands each page's rows on until ``max_items`` were delivered or ``idle_rounds``
    in a row found nothing, and returns the cursors to go on from."""
    left, idle = max_items, 0
    while idle < idle_rounds and (left is None or left > 0):
        rows, behind = log.merged_page(cursors, page if left is None else min(page, left))
        found = rows.collect()  # a page
        if found:
            handle(found)
            left, idle, cursors = None if left is None else left - len(found), 0, behind
        else:
            idle += 1
            if idle < idle_rounds:
                time.sleep(seconds)
    return cursors


def tail_until_idle(query: StreamingQuery, idle_rounds: int, seconds: float = 1.0) -> None:
    """Stops a running tail after that many rounds without input."""
    idle, seen = 0, -1
    while query.isActive and idle < idle_rounds:
        query.awaitTermination(seconds) if seconds >= 1 else query.awaitTermination(1)
        last = query.lastProgress
        batch, rows = (last["batchId"], last["numInputRows"]) if last else (seen, 0)
        idle = 0 if rows and batch != seen else idle + 1
        seen = batch
    query.stop()


STATE = "shard_id int, key binary, seg long, off long, record_type int, value binary"


def _fold(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    best = kept.get if kept.exists else (-1, -1, TOMBSTONE, None)
    for part in parts:
        for row in part.itertuples():
            if (row.wal_segment_id, row.next_offset) > (best[0], best[1]):
                best = (row.wal_segment_id, row.next_offset, row.record_type, row.value)
    kept.update(best)
    yield pd.DataFrame([(key[0], key[1], *best)], columns=["shard_id", "key", "seg", "off", "record_type", "value"])


def state_updates(records: DataFrame) -> DataFrame:
    """The last record of each key so far, emitted when it changes. A batch is folded before it reaches the state store,
    by position, so records may come in any order and a hot key costs one row a task."""
    return records.groupBy("shard_id", "key").applyInPandasWithState(
        _fold, STATE, "seg long, off long, record_type int, value binary", "update", GroupStateTimeout.NoTimeout
    )


DELTAS = 8  # of maintained state, before they are folded into a new base


def maintain(log: Log, target: str, checkpoint: str) -> StreamingQuery:
    """Incremental state as Parquet: each batch adds a delta with the last record of each key in it, in a folder for the batch
    id; after ``DELTAS`` of them base and deltas are folded. The pointer names the folders in use and the last batch, so a
    repeated batch changes nothing, and folders that no pointer names any longer are removed a fold later."""
    spark, pointer, start = log.spark, f"{target}/CURRENT", _started(log, checkpoint, None)
    _not_replaced(log, start)

    def merge(batch: DataFrame, batch_id: int) -> None:
        _not_replaced(log, start)
        at = json.loads(files.read(spark, pointer)) if files.exists(spark, pointer) else {"batch": -1, "folders": [], "old": []}
        if at["batch"] >= batch_id:
            return
        own = f"batch={batch_id}"
        rows = batch
        if fold := len(at["folders"]) > DELTAS:
            rows = rows.unionByName(spark.read.schema(LOG).parquet(*(f"{target}/{f}" for f in at["folders"])))
        last_records(rows).write.mode("overwrite").parquet(f"{target}/{own}")
        now = {"batch": batch_id, "folders": [own] if fold else [*at["folders"], own], "old": at["folders"] if fold else at["old"]}
        files.write(spark, pointer, json.dumps(now).encode())
        for f in at["old"] if fold else ():
            files.remove(spark, f"{target}/{f}")

    return tail(log, start=start).writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(merge).trigger(availableNow=True).start()


def maintained(log: Log, target: str) -> DataFrame:
    at = json.loads(files.read(log.spark, f"{target}/CURRENT"))
    rows = log.spark.read.schema(LOG).parquet(*(f"{target}/{f}" for f in at["folders"]))
    return last_records(rows).where(F.col("record_type") != TOMBSTONE)
