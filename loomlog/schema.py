"""Data model: enums, fixed sizes, schemas and configuration of the change log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INLINE, BLOB, TOMBSTONE = 0, 1, 2
ULTRAFAST, BATCH, STRICT = 0, 1, 2
DURABILITIES = {"ultrafast": ULTRAFAST, "batch": BATCH, "strict": STRICT}
VISIBLE, DURABLE = "visible", "durable"

# Fixed values of the record format: a position is a byte offset, so sizes are observable.
RECORD_HEADER_SIZE = 32
RECORD_TRAILER_SIZE = 4
BLOB_REF_SIZE = 32
BLOB_HEADER_SIZE = 32
CHECKPOINT_VERSION = 1
SNAPSHOT_VERSION = 1
MAX_KEY_BYTES = 65_535


@dataclass(frozen=True)
class Config:
    shard_count: int = 4
    inline_max: int = 1024
    wal_segment_size: int = 256 << 20
    batch_sync_interval_ns: int = 1_000_000
    max_dirty_bytes: int = 64 << 10
    max_dirty_ops: int = 1024


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


OPS = "shard_id int, seq long, key binary, value binary, durability int"
LOG = (
    "shard_id int, wal_segment_id long, wal_offset long, next_offset long, seqno long, key binary, value binary, "
    "value_len long, record_type int, durability int, commit_id long, checksum long"
)
CURSORS = "shard_id int, wal_segment_id long, wal_offset long"
STATE = "shard_id int, key binary, value binary, seqno long, wal_segment_id long, next_offset long"
