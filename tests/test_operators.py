"""Invariants and folds on small inputs."""

import random

import pytest
from conftest import DATA
from loomlog import errors
from loomlog.operators import frontier, layout
from loomlog.schema import Config
from loomlog.sources import metadata
from loomlog.sources.derive import event_log, with_checksum


def test_segment_fold_matches_a_loop(spark):
    rng = random.Random(1)
    sizes = {s: [rng.randint(1, 60) for _ in range(200)] + [500] + [3] for s in range(3)}
    rows = spark.createDataFrame([(s, k + 1, n) for s, x in sizes.items() for k, n in enumerate(x)], "shard_id int, seqno long, len long")
    got = {(r["shard_id"], r["seqno"]): (r["wal_segment_id"], r["wal_offset"], r["next_offset"]) for r in layout.segments(rows, 100).collect()}
    for s, x in sizes.items():
        segment = tail = 0
        for k, n in enumerate(x):
            if tail and tail + n > 100:
                segment, tail = segment + 1, 0
            assert got[s, k + 1] == (segment, tail, tail + n)
            tail += n


def test_policy_thresholds(spark):
    config = Config(batch_sync_interval_ns=100, max_dirty_bytes=1000, max_dirty_ops=3)
    rows = [
        (0, 1, "op", 0, 10, 1), (0, 2, "tick", 50, 0, 0), (0, 3, "tick", 100, 0, 0),  # by time
        (1, 1, "op", 0, 10, 0), (1, 2, "tick", 1000, 0, 0),  # ultrafast never
        (2, 1, "op", 0, 1000, 1), (2, 2, "tick", 0, 0, 0),  # by bytes
        (3, 1, "op", 0, 1, 1), (3, 2, "op", 0, 1, 2), (3, 3, "op", 0, 1, 0), (3, 4, "tick", 0, 0, 0),  # by ops
    ]
    df = spark.createDataFrame(rows, "shard_id int, step long, kind string, now_ns long, bytes long, durability int")
    assert sorted((r["shard_id"], r["step"], r["synced_ops"]) for r in frontier.policy(df, config).collect()) == [(0, 3, 1), (2, 2, 1), (3, 4, 3)]


def test_checksum_is_crc32_of_key_value_and_trailer(spark):
    import zlib

    for r in with_checksum(event_log(spark, DATA)).limit(50).collect():
        assert r["checksum"] == zlib.crc32(r["key"].encode() + (r["value"] or "").encode() + b"\0\0\0\0")


def test_snapshot_codec_round_trip_and_damage():
    checkpoint = {"version": 1, "shard_count": 2, "kind": "durable", "created_at_unix_ns": 5, "high_seqno": 9, "cursors": [[0, 10], [1, 20]]}
    meta = [(0, 3, 0, 10, 0, 10), (1, 9, 1, 20, 1, 20)]
    entries = [(0, b"a", b""), (1, b"b", b"x" * 48)]
    data = metadata.encode_snapshot(checkpoint, meta, entries)
    head, got_meta, got = metadata.decode_snapshot(data)
    assert (got_meta, got) == (meta, entries) and head["cursors"] == checkpoint["cursors"] and metadata.inspect_snapshot(data)["entry_count"] == 2
    with pytest.raises(errors.InvalidSnapshotFile):
        metadata.decode_snapshot(data[:-3])
    with pytest.raises(errors.SnapshotChecksumMismatch):
        metadata.decode_snapshot(data[:36] + bytes([data[36] ^ 1]) + data[37:])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
