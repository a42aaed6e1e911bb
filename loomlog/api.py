"""The embedded facade: one Python API over the whole log."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog import __version__, errors
from loomlog.functions.records import checksum, route
from loomlog.operators import checkpoint as C
from loomlog.operators import replay as P
from loomlog.operators import state as S
from loomlog.schema import BATCH, DURABLE, OPS, STRICT, TOMBSTONE, VISIBLE, Config
from loomlog.sources import files, metadata
from loomlog.sources.store import Store


def _bytes(x: bytes | str | None) -> bytes | None:
    return x.encode() if isinstance(x, str) else x


@contextmanager
def _record_errors() -> Iterator[None]:
    """Spark's error about a changed record as the log's own."""
    try:
        yield
    except PySparkException as e:
        if found := re.search(r"ChecksumMismatch: (shard \d+, segment \d+, record ending at \d+)", str(e)):
            raise errors.ChecksumMismatch(found[1]) from e
        raise


def _digest(entries: DataFrame) -> dict:
    """Count and an order-free digest of a snapshot's entries: the sum of their hashes modulo 2 ** 64."""
    row = entries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(entries.columns)).cast("decimal(38,0)")).alias("h")).first()
    return {"entry_count": row["n"], "entries_digest": int(row["h"] or 0) % 2**64}


class Log:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.store = spark, Store(spark, path, config)
        self.config = self.store.config
        self._pending: list[tuple[int | None, bytes, bytes | None, int]] = []

    @staticmethod
    def version() -> str:
        return __version__

    # -- writing

    def put(self, key: bytes | str, value: bytes | str, durability: int = STRICT, shard: int | None = None) -> None:
        """Queues a put; visible after commit()."""
        if not key:
            raise errors.EmptyKey("empty key")
        self._pending.append((shard, _bytes(key), _bytes(value), durability))

    def delete(self, key: bytes | str, durability: int = STRICT, shard: int | None = None) -> None:
        if not key:
            raise errors.EmptyKey("empty key")
        self._pending.append((shard, _bytes(key), None, durability))

    def commit(self) -> dict | None:
        """Writes all queued operations as one commit, durable if one of them is strict."""
        if not self._pending:
            return None
        rows = [(s, k, key, value, d) for k, (s, key, value, d) in enumerate(self._pending)]
        window = self.append(self.spark.createDataFrame(rows, OPS))
        self._pending.clear()
        return window

    def append(self, ops: DataFrame, await_durable: bool = False) -> dict:
        """Commits a DataFrame (shard_id null = routed by key, seq, key, value null = delete, durability) at any size."""
        routed = ops.withColumn("shard_id", F.coalesce("shard_id", route(F.col("key"), self.config.shard_count)))
        return self.store.append(routed, await_durable=await_durable)

    def append_batch(self, ops: list[tuple[bytes | str, bytes | str | None]], shard: int | None = None, durability: int = BATCH, await_durable: bool = False) -> dict:
        if not ops:
            raise errors.EmptyBatch("no operations")
        rows = [(shard, k, _bytes(key), _bytes(value), durability) for k, (key, value) in enumerate(ops)]
        return self.append(self.spark.createDataFrame(rows, OPS), await_durable)

    def sync(self) -> None:
        self.store.sync()

    def sync_until(self, window: dict, timeout: float = 10.0) -> None:
        """Waits until a commit is durable; a commit that never was ends in SyncTimeout."""
        until = time.monotonic() + timeout
        while self.store.durable_commit() < window["commit_id"]:
            if time.monotonic() > until:
                raise errors.SyncTimeout(str(window["commit_id"]))
            if any(m["commit_id"] == window["commit_id"] for m in self.store.manifests()):
                self.sync()
            else:
                time.sleep(0.05)

    def tick(self, dirty_since_ns: int, now_ns: int) -> bool:
        """The durability policy over what is not durable yet; True if it synced."""
        upto = self.store.durable_commit()
        late = [m for m in self.store.manifests() if m["commit_id"] > upto]
        ops, size = sum(w["record_count"] for m in late for w in m["shards"]), sum(w["bytes"] for m in late for w in m["shards"])
        strongest = max((m["strongest"] for m in late if m.get("strongest") is not None), default=None)
        if strongest is None or strongest < BATCH or now_ns < dirty_since_ns:
            return False
        if now_ns - dirty_since_ns >= self.config.batch_sync_interval_ns or size >= self.config.max_dirty_bytes or ops >= self.config.max_dirty_ops:
            self.sync()
            return True
        return False

    # -- reading

    def get(self, key: bytes | str) -> bytes:
        with _record_errors():
            found = S.get(self.store.log(), _bytes(key)).where(F.col("shard_id") == route(F.lit(_bytes(key)), self.config.shard_count)).take(1)
        if not found:
            raise errors.KeyNotFound(repr(key))
        return bytes(found[0]["value"])

    def get_or_null(self, key: bytes | str, shard: int | None = None) -> bytes | None:
        where = F.lit(shard) if shard is not None else route(F.lit(_bytes(key)), self.config.shard_count)
        with _record_errors():
            found = S.get(self.store.log(), _bytes(key)).where(F.col("shard_id") == where).take(1)
        return bytes(found[0]["value"]) if found else None

    def get_ref(self, key: bytes | str) -> DataFrame:
        return S.get_ref(self.store.log(), _bytes(key))

    def exists(self, key: bytes | str) -> bool:
        return self.get_or_null(key) is not None

    def exists_ref(self, key: bytes | str) -> bool:
        """True for deleted keys too, until compaction."""
        return not self.get_ref(key).isEmpty()

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return S.multi_get(self.store.log(), keys)

    def get_at(self, shard: int, cursor: tuple[int, int], key: bytes | str, generation: int | None = None) -> bytes | None:
        """The key's value in one shard as of a cursor; a generation, if given, must be the present one."""
        if not 0 <= shard < self.config.shard_count:
            raise errors.InvalidShardId(str(shard))
        if generation is not None and generation != self.store.generation:
            raise errors.InvalidCursor(f"of generation {generation}")
        if tuple(cursor) > self.store.ends()[shard]:
            raise errors.CursorBeyondVisibleFrontier(str(cursor))
        with _record_errors():
            found = S.get_at(self.store.log(), _bytes(key), shard, *cursor).take(1)
        return bytes(found[0]["value"]) if found else None

    def _checked(self, shard: int, cursor: tuple[int, int]) -> tuple[int, int]:
        if not 0 <= shard < self.config.shard_count:
            raise errors.InvalidShardId(str(shard))
        if tuple(cursor) != (0, 0) and cursor[1] and tuple(cursor) <= self.store.ends()[shard]:
            at = (F.col("shard_id") == shard) & (F.col("wal_segment_id") == cursor[0]) & (F.col("next_offset") == cursor[1])
            if self.store.log().where(at).isEmpty():
                raise errors.InvalidCursor(f"{cursor} is not the end of a record")
        return tuple(cursor)

    def read_from(self, shard: int, cursor: tuple[int, int] = (0, 0), limit: int = 256, consistency: str = VISIBLE) -> tuple[DataFrame, tuple[int, int]]:
        """A shard's page and the cursor behind it (where it stood if the page is empty)."""
        page = P.read_from(self.store.log(consistency == DURABLE), shard, self._checked(shard, cursor), limit)
        last = page.agg(F.max(F.struct("wal_segment_id", "next_offset")).alias("p")).first()["p"]
        return page, tuple(last) if last else tuple(cursor)

    def read_from_all(self, shard: int = 0, cursor: tuple[int, int] = (0, 0), limit: int = 256, consistency: str = VISIBLE) -> tuple[DataFrame, tuple[int, tuple[int, int]]]:
        """The walk's page and where to go on: (shard, cursor), with the number of shards as shard once all is read."""
        page = P.read_from_all(self.store.log(consistency == DURABLE), shard, tuple(cursor), limit)
        told = page.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("shard_id", "wal_segment_id", "next_offset")).alias("p")).first()
        if told["n"] < limit:
            return page, (self.config.shard_count, (0, 0))
        return page, (told["p"]["shard_id"], (told["p"]["wal_segment_id"], told["p"]["next_offset"])) if told["n"] else (shard, tuple(cursor))

    def valid_prefix(self) -> DataFrame:
        """Recovery: each shard's records before the first one whose checksum is wrong."""
        rows = self.store.log(verified=False)
        return P.valid_prefix(rows.withColumn("ok", checksum(F.col("key"), F.col("value")) == F.col("checksum"))).drop("ok")

    def zero_cursors(self) -> list[tuple[int, int]]:
        return [(0, 0)] * self.config.shard_count

    def merged_page(self, cursors: list[tuple[int, int]], limit: int, consistency: str = VISIBLE) -> tuple[DataFrame, list[tuple[int, int]]]:
        """A merged page and the cursors behind it."""
        if limit == 0:
            return P.merged_page(self.store.log(), cursors, 0), list(cursors) or self.zero_cursors()
        page = P.merged_page(self.store.log(consistency == DURABLE), cursors, limit, self.config.shard_count)
        behind = {r["shard_id"]: (r["wal_segment_id"], r["wal_offset"]) for r in P.next_cursors(page, cursors).collect()}
        return page, [behind[k] for k in range(self.config.shard_count)]

    def read_all_merged(self, consistency: str = VISIBLE) -> DataFrame:
        return P.merged_all(self.store.log(consistency == DURABLE))

    def frontier(self) -> list[dict]:
        visible, durable = self.store.ends(), self.store.ends(True)
        return [{"shard_id": k, "visible": v, "durable": d} for k, (v, d) in enumerate(zip(visible, durable, strict=True))]

    def stats(self) -> dict:
        log = self.store.log()
        live = S.state(log).count()
        return {"shard_count": self.config.shard_count, "generation": self.store.generation, "entries": live, "pending": len(self._pending), "frontiers": self.frontier()}

    def inspect(self) -> dict:
        log = self.store.log()
        row = log.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("record_type") == TOMBSTONE, 1)).alias("t"), F.coalesce(F.sum(F.col("next_offset") - F.col("wal_offset")), F.lit(0)).alias("b")).first()
        return {"records": row["n"], "tombstones": row["t"], "bytes": row["b"], "commits": len(self.store.manifests())}

    # -- checkpoints, snapshots, compaction

    def checkpoint(self, kind: str = DURABLE) -> dict:
        ends = self.store.ends(kind == DURABLE)
        return {"version": 1, "shard_count": self.config.shard_count, "kind": kind, "created_at_unix_ns": time.time_ns(), "high_seqno": max(self.store.next_seqnos()) - 1, "cursors": [list(e) for e in ends]}

    def save_checkpoint(self, path: str, kind: str = DURABLE) -> dict:
        self.sync()
        found = self.checkpoint(kind)
        files.write(self.spark, path, metadata.encode_checkpoint(found))
        return found

    def load_checkpoint(self, path: str) -> dict:
        found = metadata.decode_checkpoint(files.read(self.spark, path))
        self.validate_checkpoint(found)
        return found

    def validate_checkpoint(self, found: dict) -> None:
        if found["version"] != 1:
            raise errors.UnsupportedCheckpointVersion(str(found["version"]))
        if found["shard_count"] != self.config.shard_count or len(found["cursors"]) != self.config.shard_count:
            raise errors.CheckpointShardCountMismatch(str(found["shard_count"]))
        reach = self.store.ends(found["kind"] == DURABLE)
        if any(tuple(c) > e for c, e in zip(found["cursors"], reach, strict=True)):
            raise errors.InvalidCheckpointFile("a cursor lies beyond the frontier")

    def read_from_checkpoint(self, found: dict, limit: int) -> tuple[DataFrame, dict]:
        """The next page behind a checkpoint and the checkpoint behind the page; all other fields are copied."""
        self.validate_checkpoint(found)
        page, behind = self.merged_page([tuple(c) for c in found["cursors"]], limit, found["kind"])
        return page, found | {"cursors": [list(c) for c in behind]}

    def snapshot(self, path: str, kind: str = DURABLE, strict: bool = False) -> dict:
        """Live state as Parquet with a metadata file. ``strict`` leaves out what is visible but not durable."""
        self.sync()
        meta = self.checkpoint(kind) | {"next_seqnos": self.store.next_seqnos(), "frontiers": self.frontier()}
        C.snapshot(self.store.log(strict and kind == DURABLE)).write.mode("overwrite").parquet(f"{path}/entries")
        meta |= _digest(self.spark.read.parquet(f"{path}/entries"))
        files.write(self.spark, f"{path}/snapshot.json", json.dumps(meta).encode())
        return meta

    def inspect_snapshot(self, path: str) -> dict:
        if not files.exists(self.spark, f"{path}/snapshot.json"):
            raise errors.InvalidSnapshotFile(path)
        return json.loads(files.read(self.spark, f"{path}/snapshot.json"))

    def restore(self, path: str) -> None:
        meta = self.inspect_snapshot(path)
        if meta["shard_count"] != self.config.shard_count:
            raise errors.InvalidSnapshotFile(f"{meta['shard_count']} shards")
        entries = self.spark.read.parquet(f"{path}/entries")
        if any(meta.get(k) != v for k, v in _digest(entries).items()):
            raise errors.SnapshotChecksumMismatch(path)
        self._pending.clear()
        self.store.restore(entries, meta["next_seqnos"])

    def compact(self, shard: int | None = None) -> None:
        if self._pending:
            raise errors.PendingOperationsExist(f"{len(self._pending)} operations")
        self.store.compact(shard)

    def vacuum(self, keep: int = 1) -> list[int]:
        return self.store.vacuum(keep)

    def close(self) -> None:
        """Ends the handle; queued operations that were never committed are refused, not dropped."""
        if self._pending:
            raise errors.PendingOperationsExist(f"{len(self._pending)} operations")

    def __enter__(self) -> Log:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.close()
