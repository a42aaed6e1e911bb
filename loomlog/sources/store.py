"""The log on disk: immutable Parquet commits, generations.

A commit is a folder of Parquet files and a manifest with each touched shard's window. It is written aside and published by
one rename to its number, which fails if another writer took that number, so a commit is there as a whole or not at all and
readers that list commits once see a snapshot. A durable marker names the last commit that is durable. Compaction and restore
write a new generation, whose ``base`` is what they left, and swing one pointer file, so positions and sequence numbers are
never reused within one. Records are checked against their checksum when their value is read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomlog import errors
from loomlog.functions.records import blob_length, checksum, record_length, record_type
from loomlog.operators.layout import positions
from loomlog.operators.state import state
from loomlog.schema import LOG, MAX_KEY_BYTES, STRICT, Config
from loomlog.sources import files

BLOCK = 1 << 20


def with_checked_values(rows: DataFrame) -> DataFrame:
    place = F.format_string("ChecksumMismatch: shard %d, segment %d, record ending at %d", "shard_id", "wal_segment_id", "next_offset")
    ok = F.col("checksum").isNull() | (checksum(F.col("key"), F.col("value")) == F.col("checksum"))
    return rows.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(place).cast("binary")))


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        if files.exists(spark, f"{self.path}/config.json"):
            kept = Config(**json.loads(files.read(spark, f"{self.path}/config.json")))
            if config is not None and config.shard_count != kept.shard_count:
                raise errors.InvalidShardId(f"the log has {kept.shard_count} shards, not {config.shard_count}")
            self.config = replace(config, shard_count=kept.shard_count) if config else kept
        else:
            self.config = config or Config()
            files.write(spark, f"{self.path}/config.json", json.dumps(asdict(self.config)).encode())
            files.write(spark, f"{self.path}/CURRENT", b"0")

    @property
    def generation(self) -> int:
        return int(files.read(self.spark, f"{self.path}/CURRENT"))

    def _at(self, generation: int | None = None) -> str:
        return f"{self.path}/gen={self.generation if generation is None else generation}"

    def manifests(self, generation: int | None = None) -> list[dict]:
        """In commit order, the base first. One small file a commit; compaction folds them into one."""
        root = self._at(generation)
        folders = [f"base/{n}" for n in files.names(self.spark, f"{root}/base")] + [f"commits/{n}" for n in files.names(self.spark, f"{root}/commits")]
        return [json.loads(files.read(self.spark, f"{root}/{f}/_manifest.json")) | {"folder": f} for f in folders if not f.rpartition("/")[2].startswith((".", "_"))]

    def durable_commit(self) -> int:
        path = f"{self._at()}/DURABLE"
        return int(files.read(self.spark, path)) if files.exists(self.spark, path) else -1

    def ends(self, durable: bool = False) -> list[tuple[int, int]]:
        """Each shard's frontier (segment, offset) by the manifests."""
        upto, found = self.durable_commit(), [(0, 0)] * self.config.shard_count
        for m in self.manifests():
            if not durable or m["commit_id"] <= upto:
                for w in m["shards"]:
                    found[w["shard_id"]] = max(found[w["shard_id"]], (w["end"][0], w["end"][1]))
        return found

    def next_seqnos(self) -> list[int]:
        found = [1] * self.config.shard_count
        for m in self.manifests():
            for w in m["shards"]:
                found[w["shard_id"]] = max(found[w["shard_id"]], w["last_seqno"] + 1, w.get("next_seqno", 1))
        return found

    def log(self, durable: bool = False, verified: bool = True) -> DataFrame:
        """Committed records up to the frontier; only published commits' files are named to the reader. A value that is read
        is checked first: a record that was changed on disk ends the query with ChecksumMismatch."""
        upto = self.durable_commit()
        paths = [f"{self._at()}/{m['folder']}" for m in self.manifests() if m["data"] and (not durable or m["commit_id"] <= upto)]
        rows = self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)
        return with_checked_values(rows) if verified else rows

    def append(self, ops: DataFrame, bucket=None, await_durable: bool = False) -> dict:
        """Commits ops (shard_id, seq, key, value, durability), ``seq`` being the arrival order, and publishes a manifest."""
        sums = self._sums(ops)
        if not sums:
            raise errors.EmptyBatch("no operations")
        if astray := [r["shard_id"] for r in sums if r["shard_id"] is None or not 0 <= r["shard_id"] < self.config.shard_count]:
            raise errors.InvalidShardId(str(astray))
        if (longest := max(r["longest"] or 0 for r in sums)) > MAX_KEY_BYTES:
            raise errors.KeyTooLong(f"{longest} bytes")
        manifests, strongest = self.manifests(), max(r["strongest"] for r in sums)
        commit = manifests[-1]["commit_id"] + 1 if manifests else 0
        rows = positions(ops, ["seq"], bucket if bucket is not None else F.floor(F.col("seq") / BLOCK), self.config.inline_max)
        window = self._write(rows, sums, commit, self.ends(), self.next_seqnos(), self._at())
        window |= {"durable": strongest == STRICT or await_durable, "strongest": strongest}
        if not self._publish(window, self._at(), "commits"):
            raise errors.CommitConflict(str(commit))
        if window["durable"]:
            self.sync()
        return window

    def _sums(self, ops: DataFrame) -> list[Row]:
        """A row a shard (and one more where ids are astray): records, bytes, blob bytes, strongest durability, longest key."""
        kind = record_type(F.col("value"), self.config.inline_max)
        of = ops.groupBy("shard_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(record_length(F.col("key"), F.col("value"), kind)).alias("size"), F.sum(blob_length(F.col("value"), kind)).alias("blobs"),
            F.max("durability").alias("strongest"), F.max(F.octet_length("key")).alias("longest"),
        )
        return of.limit(self.config.shard_count + 1).collect()

    def _write(self, rows: DataFrame, sums: list[Row], commit: int, ends: list[tuple[int, int]], seqnos: list[int], root: str, keep_seqno: bool = False) -> dict:
        """Rows with positions from 0 to a Parquet directory with positions behind ``ends``; the manifest, unpublished.

        A shard whose open segment would pass its limit starts a new one; a commit's rows of a shard share a segment, so
        a large commit is a segment of its own.
        """
        size, starts = {r["shard_id"]: r["size"] for r in sums}, []
        for k, (segment, offset) in enumerate(ends):
            full = offset > 0 and offset + size.get(k, 0) > self.config.wal_segment_size
            starts.append((segment + 1, 0) if full else (segment, offset))
        of = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("shard_id") + 1)
        key, value, offset = F.col("key").cast("binary"), F.col("value").cast("binary"), of([o for _, o in starts])
        seqno = F.col("seqno") if keep_seqno else F.col("seqno") + of(seqnos) - 1
        out = rows.select(
            "shard_id", of([s for s, _ in starts]).alias("wal_segment_id"), (F.col("wal_offset") + offset).alias("wal_offset"), (F.col("next_offset") + offset).alias("next_offset"),
            seqno.cast("long").alias("seqno"), key.alias("key"), value.alias("value"), "value_len", "record_type", F.col("durability").cast("int").alias("durability"),
            F.lit(commit).cast("long").alias("commit_id"), checksum(key, value).alias("checksum"),
        )
        data = uuid.uuid4().hex
        out.write.parquet(f"{root}/aside/{data}")
        last = {r["shard_id"]: r["last"] for r in self.spark.read.schema(LOG).parquet(f"{root}/aside/{data}").groupBy("shard_id").agg(F.struct(F.min("seqno"), F.max("seqno")).alias("last")).collect()} if keep_seqno else {}
        shards = []
        for r in sorted(sums, key=lambda r: r["shard_id"]):
            k, (segment, begin) = r["shard_id"], starts[r["shard_id"]]
            first, end = last.get(k, (seqnos[k], seqnos[k] + r["n"] - 1))
            shards.append({"shard_id": k, "start": [segment, begin], "end": [segment, begin + r["size"]], "first_seqno": first, "last_seqno": end, "record_count": r["n"], "bytes": r["size"] + r["blobs"]})
        return {"commit_id": commit, "data": data, "shards": shards}

    def _publish(self, manifest: dict, root: str, where: str) -> bool:
        aside = f"{root}/aside/{manifest['data'] or uuid.uuid4().hex}"
        files.write(self.spark, f"{aside}/_manifest.json", json.dumps(manifest).encode())
        return files.publish(self.spark, aside, f"{root}/{where}/{manifest['commit_id']:012d}")

    def sync(self) -> None:
        """Durable frontier := visible frontier. Parquet and manifests are on the store already; this publishes the fact."""
        if manifests := self.manifests():
            files.write(self.spark, f"{self._at()}/DURABLE", str(manifests[-1]["commit_id"]).encode())

    def _swing(self, rows: DataFrame, sums: list[Row], seqnos: list[int], keep_seqno: bool, kind: str) -> None:
        old = self.generation
        new = old + 1
        root = self._at(new)
        zeros = [(0, 0)] * self.config.shard_count
        manifest = {"commit_id": 0, "data": None, "shards": []}
        if sums:
            manifest = self._write(rows, sums, 0, zeros, [1] * self.config.shard_count, root, keep_seqno)
        had = {w["shard_id"] for w in manifest["shards"]}
        for w in manifest["shards"]:
            w["next_seqno"] = seqnos[w["shard_id"]]
        manifest["shards"] += [{"shard_id": k, "start": [0, 0], "end": [0, 0], "first_seqno": 1, "last_seqno": 0, "record_count": 0, "bytes": 0, "next_seqno": n} for k, n in enumerate(seqnos) if k not in had]
        last = max((m["commit_id"] for m in self.manifests(old)), default=-1)
        if not self._publish(manifest | {"kind": kind, "follows": [old, last]}, root, "base"):
            raise errors.CommitConflict(f"generation {new}")
        files.write(self.spark, f"{root}/DURABLE", b"0")
        files.write(self.spark, f"{self.path}/CURRENT", str(new).encode())

    def vacuum(self, keep: int = 1) -> list[int]:
        """Removes generations but the present one and ``keep`` before it, and what dead writers left aside. No reader or
        consumer may be in them, and no writer at work."""
        gone = [g for g in sorted(int(n[4:]) for n in files.names(self.spark, self.path) if n.startswith("gen=")) if g < self.generation - keep]
        for g in gone:
            files.remove(self.spark, self._at(g))
        files.remove(self.spark, f"{self._at()}/aside")
        return gone

    def compact(self, shard: int | None = None) -> None:
        """Live rows with their seqnos in a new generation; sequence numbers never go down. With ``shard`` only that shard is
        compacted; the others keep their records, at positions of the new generation."""
        from loomlog.operators.state import compacted

        manifests = self.manifests()
        if manifests and self.durable_commit() < manifests[-1]["commit_id"]:
            raise errors.PendingOperationsExist("sync first")
        if shard is None:
            rows = compacted(self.log(), self.config.inline_max)
        else:
            if not 0 <= shard < self.config.shard_count:
                raise errors.InvalidShardId(str(shard))
            log = self.log()
            rest = log.where(F.col("shard_id") != shard)
            seqno = F.col("seqno")
            rest = positions(rest.withColumn("own", seqno), ["own"], F.floor(seqno / BLOCK), self.config.inline_max).withColumn("seqno", F.col("own")).drop("own")
            own = compacted(log.where(F.col("shard_id") == shard), self.config.inline_max)
            rows = own.unionByName(rest.select(*own.columns))
        self._swing(rows, self._sums(rows), self.next_seqnos(), True, "compact")

    def restore(self, entries: DataFrame, next_seqnos: list[int]) -> None:
        """All shards replaced by the entries (shard_id, key, value), strict, with seqnos 1..n in key order."""
        ops, aside = entries.select("shard_id", "key", "value", F.lit(STRICT).alias("durability")), f"{self._at(self.generation + 1)}/aside/{uuid.uuid4().hex}"
        bucket = F.lit(0)
        if entries.count() > BLOCK:  # key ranges of about the same size, whatever the keys look like; written once, as ranges are sampled
            ranged = ops.repartitionByRange("shard_id", "key").withColumn("range", F.spark_partition_id())
            ranged.write.parquet(aside)
            ops, bucket = self.spark.read.schema(ranged.schema).parquet(aside), F.col("range")
        rows = positions(ops, ["key"], bucket, self.config.inline_max)
        highest = [max(a, b) for a, b in zip(self.next_seqnos(), next_seqnos, strict=True)]
        self._swing(rows, self._sums(ops), highest, False, "restore")
        files.remove(self.spark, aside)

    def state(self, durable: bool = False) -> DataFrame:
        return state(self.log(durable))
