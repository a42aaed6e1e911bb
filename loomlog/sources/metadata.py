"""Binary codecs of checkpoint and snapshot files."""

from __future__ import annotations

import struct
import zlib

from loomlog.errors import (
    CheckpointChecksumMismatch,
    InvalidCheckpointFile,
    InvalidSnapshotFile,
    SnapshotChecksumMismatch,
    UnsupportedCheckpointVersion,
)
from loomlog.schema import CHECKPOINT_VERSION, SNAPSHOT_VERSION

# Fixed values of the file formats.
CHECKPOINT_MAGIC, SNAPSHOT_MAGIC = b"CECP", b"CESS"
KINDS = ["visible", "durable"]
HEAD = struct.Struct("<IHB")  # version, shards, kind
TIMES = struct.Struct("<QQ")  # created_at_unix_ns, high_seqno
CURSOR = struct.Struct("<IQ")


def encode_checkpoint(c: dict) -> bytes:
    head = HEAD.pack(c["version"], c["shard_count"], KINDS.index(c["kind"]))
    times = TIMES.pack(c["created_at_unix_ns"], c["high_seqno"])
    cursors = b"".join(CURSOR.pack(*x) for x in c["cursors"])
    return CHECKPOINT_MAGIC + head + b"\0" + times + struct.pack("<I", zlib.crc32(head + times + cursors)) + cursors


def decode_checkpoint(data: bytes) -> dict:
    if len(data) < 32 or data[:4] != CHECKPOINT_MAGIC:
        raise InvalidCheckpointFile("no checkpoint")
    version, shards, kind = HEAD.unpack_from(data, 4)
    if version != CHECKPOINT_VERSION:
        raise UnsupportedCheckpointVersion(str(version))
    cursors = data[32 : 32 + shards * CURSOR.size]
    if len(cursors) < shards * CURSOR.size or kind >= len(KINDS):
        raise InvalidCheckpointFile("cut short")
    if zlib.crc32(data[4:11] + data[12:28] + cursors) != struct.unpack_from("<I", data, 28)[0]:
        raise CheckpointChecksumMismatch("checksum")
    created, high = TIMES.unpack_from(data, 12)
    return {"version": version, "shard_count": shards, "kind": KINDS[kind], "created_at_unix_ns": created, "high_seqno": high, "cursors": [list(x) for x in CURSOR.iter_unpack(cursors)]}


META = struct.Struct("<HQIQIQ")  # shard, next_seqno, visible, durable
ENTRY = struct.Struct("<HII")


def encode_snapshot(checkpoint: dict, meta: list[tuple], entries: list[tuple[int, bytes, bytes]]) -> bytes:
    """For exchange with other programs; entries are held in memory, so large states go to Parquet instead."""
    head = HEAD.pack(SNAPSHOT_VERSION, checkpoint["shard_count"], KINDS.index(checkpoint["kind"]))
    times = TIMES.pack(checkpoint["created_at_unix_ns"], checkpoint["high_seqno"]) + struct.pack("<Q", len(entries))
    body = b"".join([*(CURSOR.pack(*x) for x in checkpoint["cursors"]), *(META.pack(*m) for m in meta), *(ENTRY.pack(s, len(k), len(v)) + k + v for s, k, v in entries)])
    return SNAPSHOT_MAGIC + head + b"\0" + times + struct.pack("<I", zlib.crc32(head + times + body)) + body


def inspect_snapshot(data: bytes) -> dict:
    """The header alone, without checksum."""
    if len(data) < 40 or data[:4] != SNAPSHOT_MAGIC:
        raise InvalidSnapshotFile("no snapshot")
    version, shards, kind = HEAD.unpack_from(data, 4)
    created, high, count = struct.unpack_from("<QQQ", data, 12)
    return {"version": version, "shard_count": shards, "kind": KINDS[kind], "created_at_unix_ns": created, "high_seqno": high, "entry_count": count}


def decode_snapshot(data: bytes) -> tuple[dict, list[tuple], list[tuple[int, bytes, bytes]]]:
    head = inspect_snapshot(data)
    at, shards = 40, head["shard_count"]
    try:
        cursors = [CURSOR.unpack_from(data, at + k * CURSOR.size) for k in range(shards)]
        at += shards * CURSOR.size
        meta = [META.unpack_from(data, at + k * META.size) for k in range(shards)]
        at += shards * META.size
        entries = []
        for _ in range(head["entry_count"]):
            shard, n, m = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            if at + n + m > len(data):
                raise InvalidSnapshotFile("cut short")
            entries.append((shard, data[at : at + n], data[at + n : at + n + m]))
            at += n + m
    except struct.error as cut:
        raise InvalidSnapshotFile("cut short") from cut
    if zlib.crc32(data[4:11] + data[12:36] + data[40:at]) != struct.unpack_from("<I", data, 36)[0]:
        raise SnapshotChecksumMismatch("checksum")
    if any(m[0] != k or m[4:6] > m[2:4] for k, m in enumerate(meta)):
        raise InvalidSnapshotFile("shard metadata")
    return head | {"cursors": [list(c) for c in cursors]}, meta, entries
