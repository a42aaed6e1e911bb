"""Scalar expressions: record kinds, lengths, checksums, routing, payloads. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.schema import (
    BLOB,
    BLOB_HEADER_SIZE,
    BLOB_REF_SIZE,
    INLINE,
    RECORD_HEADER_SIZE,
    RECORD_TRAILER_SIZE,
    TOMBSTONE,
)


def record_type(value: Column, inline_max: int) -> Column:
    """A value of ``inline_max`` bytes is inline; null is a tombstone, empty is not."""
    return F.when(value.isNull(), TOMBSTONE).when(F.octet_length(value) <= inline_max, INLINE).otherwise(BLOB)


def value_length(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def record_length(key: Column, value: Column, kind: Column) -> Column:
    body = F.when(kind == INLINE, F.octet_length(value)).when(kind == BLOB, F.lit(BLOB_REF_SIZE)).otherwise(0)
    return (F.lit(RECORD_HEADER_SIZE + RECORD_TRAILER_SIZE) + F.octet_length(key) + body).cast("long")


def blob_length(value: Column, kind: Column) -> Column:
    return F.when(kind == BLOB, F.octet_length(value) + BLOB_HEADER_SIZE + RECORD_TRAILER_SIZE).otherwise(0).cast("long")


def checksum(key: Column, value: Column) -> Column:
    """CRC-32 over key, value and the four zero bytes of the trailer."""
    return F.crc32(F.concat(key.cast("binary"), F.coalesce(value.cast("binary"), F.unhex(F.lit(""))), F.unhex(F.lit("00000000"))))


def route(key: Column, shards: int) -> Column:
    """A shard for each key: the first 32 bits of its MD5 modulo the number of shards."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def payload_field(value: Column, name: str) -> Column:
    """A field of a ``name=value|name=value`` payload."""
    return F.element_at(F.str_to_map(value, F.lit(r"\|"), F.lit("=")), F.lit(name))


def payload(fields: dict[str, Column]) -> Column:
    return F.concat_ws("|", *(F.concat(F.lit(f"{k}="), v) for k, v in fields.items()))


def after(segment: int, offset: int) -> Column:
    """Position predicate as scalar comparisons, which reach the Parquet scan (a struct comparison does not)."""
    return (F.col("wal_segment_id") > segment) | ((F.col("wal_segment_id") == segment) & (F.col("next_offset") > offset))


def upto(segment: int, offset: int) -> Column:
    return (F.col("wal_segment_id") < segment) | ((F.col("wal_segment_id") == segment) & (F.col("next_offset") <= offset))


def position() -> Column:
    return F.struct(F.col("wal_segment_id").alias("seg"), F.col("next_offset").alias("off"))
