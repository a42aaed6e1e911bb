"""The store and the facade on literal fixtures."""

import pytest
from loomlog import errors
from loomlog.api import Log
from loomlog.schema import BATCH, BLOB, INLINE, STRICT, TOMBSTONE, ULTRAFAST, Config


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path / "log"), Config(shard_count=2, inline_max=8))


def kinds(page):
    return [(bytes(r["key"]), r["record_type"], r["seqno"]) for r in page.collect()]


def test_put_get_delete_and_reopen(spark, tmp_path):
    path, config = str(tmp_path / "one"), Config(shard_count=1, inline_max=16)
    log = Log(spark, path, config)
    log.put("user:1", "hello")
    assert log.get_or_null("user:1") is None  # not committed yet
    log.put("user:2", "x" * 50)
    log.delete("user:3")
    log.commit()
    again = Log(spark, path)
    assert again.config.shard_count == 1
    assert again.get("user:1") == b"hello" and again.get("user:2") == b"x" * 50
    assert kinds(again.read_from(0)[0]) == [(b"user:1", INLINE, 1), (b"user:2", BLOB, 2), (b"user:3", TOMBSTONE, 3)]
    with pytest.raises(errors.KeyNotFound):
        again.get("user:3")
    assert again.exists_ref("user:3") and not again.exists("user:3")
    with pytest.raises(errors.InvalidShardId):
        Log(spark, path, Config(shard_count=3))


def test_empty_value_is_not_a_tombstone(log):
    log.put("k", "")
    log.commit()
    assert log.get("k") == b""


def test_durability_policy(spark, tmp_path):
    config = Config(shard_count=1, batch_sync_interval_ns=100, max_dirty_bytes=1 << 20, max_dirty_ops=1000)
    log = Log(spark, str(tmp_path / "d"), config)
    log.append_batch([("k1", "v")], 0, BATCH)
    (end,) = log.frontier()
    assert end["visible"] > (0, 0) and end["durable"] == (0, 0)
    assert not log.tick(0, 50) and log.tick(0, 100)
    assert log.frontier()[0]["durable"] == log.frontier()[0]["visible"]
    log.append_batch([("k2", "v")], 0, ULTRAFAST)
    assert not log.tick(0, 1000)
    window = log.append_batch([("k3", "v")], 0, STRICT)
    log.sync_until(window)
    with pytest.raises(errors.SyncTimeout):
        log.sync_until({"commit_id": 99}, timeout=0.2)


def test_merged_pages_end_and_resume(log):
    for shard, key in ((0, "a"), (1, "b"), (0, "c")):
        log.append_batch([(key, "v")], shard)
    at, sizes, seen = log.zero_cursors(), [], []
    for _ in range(5):
        page, after = log.merged_page(at, 1)
        rows = page.collect()
        sizes.append(len(rows))
        seen += [(r["seqno"], r["shard_id"]) for r in rows]
        previous, at = at, after
    assert sizes == [1, 1, 1, 0, 0] and previous == at
    assert seen == sorted(seen) == [(r["seqno"], r["shard_id"]) for r in log.read_all_merged().collect()]
    assert log.merged_page(log.zero_cursors(), 0)[0].isEmpty()
    with pytest.raises(errors.InvalidGlobalMergeCursor):
        log.merged_page([(0, 0)], 1)


def test_time_travel_and_cursor_errors(log):
    first = log.append_batch([("user:42", "email=a|name=b")], 0)["shards"][0]["end"]
    log.append_batch([("user:42", "email=c|name=b")], 0)
    log.append_batch([("user:42", None)], 0)
    assert log.get_at(0, first, "user:42") == b"email=a|name=b"
    assert log.get_or_null("user:42", shard=0) is None
    with pytest.raises(errors.CursorBeyondVisibleFrontier):
        log.get_at(0, (0, 10**9), "user:42")
    with pytest.raises(errors.InvalidShardId):
        log.get_at(7, first, "user:42")
    with pytest.raises(errors.InvalidCursor):
        log.read_from(0, (0, first[1] - 1))
    assert len(log.read_from(0, tuple(first))[0].collect()) == 2


def test_checkpoint_files(spark, log, tmp_path):
    log.append_batch([("a", "1")], 0, STRICT)
    log.append_batch([("b", "2")], 1, STRICT)
    path = str(tmp_path / "c.bin")
    saved = log.save_checkpoint(path)
    assert log.load_checkpoint(path) == saved
    page, after = log.read_from_checkpoint(saved, 10)
    assert page.isEmpty() and after == saved
    data = open(path, "rb").read()
    for bad, error in ((data[:-2], errors.InvalidCheckpointFile), (data[:28] + bytes([data[28] ^ 1]) + data[29:], errors.CheckpointChecksumMismatch)):
        open(path, "wb").write(bad)
        (tmp_path / ".c.bin.crc").unlink(missing_ok=True)
        with pytest.raises(error):
            log.load_checkpoint(path)
    with pytest.raises(errors.InvalidCheckpointFile):
        log.validate_checkpoint(saved | {"cursors": [[9, 0], [0, 0]]})
    with pytest.raises(errors.CheckpointShardCountMismatch):
        log.validate_checkpoint(saved | {"shard_count": 3})


def test_snapshot_restore_then_append(log, tmp_path):
    log.append_batch([("user:1", "Alice"), ("user:2", "Carol"), ("gone", "x")])
    log.append_batch([("user:1", "Bob"), ("gone", None)])
    path = str(tmp_path / "s")
    assert log.snapshot(path)["entry_count"] == 2
    before = log.store.next_seqnos()
    log.append_batch([("user:1", "Eve"), ("user:2", None)])
    log.restore(path)
    assert log.get("user:1") == b"Bob" and log.get("user:2") == b"Carol" and not log.exists_ref("gone")
    assert all(a >= b for a, b in zip(log.store.next_seqnos(), before, strict=True))
    log.append_batch([("user:3", "Dan")])
    assert log.get("user:3") == b"Dan" and log.get("user:1") == b"Bob"


def test_compact_then_append(log):
    for n in range(3):
        log.append_batch([("k1", f"a{n}"), ("k2", f"long value {n}"), ("k3", f"c{n}")], 0)
    log.append_batch([("k3", None)], 0)
    with pytest.raises(errors.PendingOperationsExist):
        log.compact()
    log.sync()
    state = {(r["key"], r["value"], r["seqno"]) for r in log.store.state().select("key", "value", "seqno").collect()}
    size, seqnos, old = log.inspect()["bytes"], log.store.next_seqnos(), log.store.generation
    log.compact()
    assert log.inspect()["bytes"] < size and log.store.next_seqnos() == seqnos
    assert {(r["key"], r["value"], r["seqno"]) for r in log.store.state().select("key", "value", "seqno").collect()} == state
    with pytest.raises(errors.InvalidCursor):
        log.get_at(0, (0, 0), "k1", generation=old)
    log.append_batch([("k1", "new")], 0)
    assert log.get_or_null("k1", shard=0) == b"new" and log.store.next_seqnos()[0] == seqnos[0] + 1


def test_errors_of_batches(log):
    with pytest.raises(errors.EmptyBatch):
        log.append_batch([])
    with pytest.raises(errors.EmptyKey):
        log.put("", "v")
    with pytest.raises(errors.InvalidShardId):
        log.append_batch([("k", "v")], 5)
    with pytest.raises(errors.KeyTooLong):
        log.append_batch([("k" * 70_000, "v")], 0)


def test_command_line(spark, tmp_path, capsys):
    from loomlog.cli import main

    path = str(tmp_path / "cli")
    assert main([path, "put", "k", "v"], spark) == 0 and main([path, "get", "k"], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1] == '"v"'
    assert main([path, "delete", "k"], spark) == 0 and main([path, "get", "k"], spark) == 1
    for command in ("stats", "frontier", "inspect", "sync", "compact", "version"):
        assert main([path, command], spark) == 0


def test_tail_and_maintained_state(log, tmp_path):
    from loomlog.streaming.tail import consume, maintain, maintained

    seen = []
    handle = lambda rows, batch: seen.extend((r["seqno"], r["shard_id"]) for r in rows.collect())
    log.append_batch([("a", "1"), ("b", "2")])
    consume(log, str(tmp_path / "cp"), handle).awaitTermination()
    log.append_batch([("a", "3"), ("b", None)])
    consume(log, str(tmp_path / "cp"), handle).awaitTermination()
    assert sorted(seen) == sorted((r["seqno"], r["shard_id"]) for r in log.read_all_merged().collect())
    maintain(log, str(tmp_path / "state"), str(tmp_path / "cp2")).awaitTermination()
    log.append_batch([("c", "4")])
    maintain(log, str(tmp_path / "state"), str(tmp_path / "cp2")).awaitTermination()
    assert {(r["key"], r["value"]) for r in maintained(log, str(tmp_path / "state")).collect()} == {(r["key"], r["value"]) for r in log.store.state().collect()}


def seqnos(rows):
    return sorted((r["shard_id"], r["seqno"]) for r in rows.collect())


def test_unpublished_commits_are_never_read_and_published_ones_always(log, tmp_path, monkeypatch):
    from loomlog.streaming.tail import consume

    seen, cp = [], str(tmp_path / "cp")
    handle = lambda rows, batch: seen.extend(seqnos(rows))
    log.append_batch([("a", "1")], 0)
    consume(log, cp, handle).awaitTermination()
    publish, held = log.store._publish, []
    monkeypatch.setattr(log.store, "_publish", lambda *a: held.append(a) or True)
    log.append_batch([("b", "2")], 0, BATCH)  # written, not published
    consume(log, cp, handle).awaitTermination()
    assert seen == [(0, 1)] == seqnos(log.read_all_merged())
    assert publish(*held[0])
    consume(log, cp, handle).awaitTermination()
    assert seen == [(0, 1), (0, 2)] == seqnos(log.read_all_merged())
    log.append_batch([("dead", "x")], 0, BATCH)  # its writer dies
    monkeypatch.undo()
    log.append_batch([("c", "3")], 0)
    fresh = []
    consume(log, str(tmp_path / "fresh"), lambda rows, batch: fresh.extend(seqnos(rows))).awaitTermination()
    consume(log, cp, handle).awaitTermination()
    assert fresh == seen == seqnos(log.read_all_merged()) and len(seen) == 3 and not log.exists("dead")


def test_two_writers_of_one_number(log, spark, monkeypatch):
    log.append_batch([("a", "1")], 0)
    other = Log(spark, log.store.path)
    held = []
    publish = log.store._publish
    monkeypatch.setattr(log.store, "_publish", lambda *a: held.append(a) or True)
    log.append_batch([("b", "2")], 0, BATCH)
    other.append_batch([("c", "3")], 0)
    assert publish(*held[0]) is False  # append() raises CommitConflict
    monkeypatch.setattr(log.store, "_publish", lambda *a: False)
    with pytest.raises(errors.CommitConflict):
        log.append_batch([("d", "4")], 0)
    assert other.exists("c") or other.get_or_null("c", shard=0) == b"3"
    assert seqnos(other.read_all_merged()) == [(0, 1), (0, 2)]


def test_consumer_follows_compaction_and_fails_on_restore(log, tmp_path):
    from loomlog.streaming.tail import consume

    seen, cp = [], str(tmp_path / "cp")
    handle = lambda rows, batch: seen.extend(seqnos(rows))
    log.append_batch([("a", "1"), ("b", "2")], 0)
    consume(log, cp, handle).awaitTermination()
    log.append_batch([("a", "3")], 0)
    log.sync()
    log.compact()
    log.append_batch([("c", "4")], 0)
    consume(log, cp, handle).awaitTermination()
    assert sorted(seen) == [(0, 1), (0, 2), (0, 3), (0, 4)]
    log.snapshot(str(tmp_path / "s"))
    log.restore(str(tmp_path / "s"))
    with pytest.raises(errors.LogReplaced):
        consume(log, cp, handle)


def test_consumer_from_a_checkpoint_and_capped_tail(log, tmp_path):
    from loomlog.streaming.tail import consume, follow

    log.append_batch([("a", "1"), ("b", "2")], 0)
    log.append_batch([("c", "3")], 1)
    saved = log.save_checkpoint(str(tmp_path / "c.bin"))
    log.append_batch([("d", "4")], 0)
    log.append_batch([("e", "5")], 1)
    seen, cp = [], str(tmp_path / "cp")
    for _ in range(2):
        consume(log, cp, lambda rows, batch: seen.extend(seqnos(rows)), since=saved).awaitTermination()
    assert sorted(seen) == [(0, 3), (1, 2)]
    got, handle = [], lambda rows: got.extend((r["seqno"], r["shard_id"]) for r in rows)
    at = follow(log, log.zero_cursors(), handle, page=2, max_items=3)
    assert len(got) == 3
    follow(log, at, handle, page=2)
    assert got == [(r["seqno"], r["shard_id"]) for r in log.read_all_merged().collect()]


def test_pages_of_a_shard_and_the_walk_go_on_from_their_cursors(log):
    for k in range(3):
        log.append_batch([(f"a{k}", "x"), (f"b{k}", None)], 0)
        log.append_batch([(f"c{k}", "y")], 1)
    at, seen = (0, 0), []
    while (page := log.read_from(0, at, 4))[0].count():
        seen += [r["seqno"] for r in page[0].collect()]
        at = page[1]
    assert seen == [1, 2, 3, 4, 5, 6] and log.read_from(0, at, 4)[1] == at
    shard, at, seen = 0, (0, 0), []
    while shard < 2:
        page, (shard, at) = log.read_from_all(shard, at, 4)
        seen += [(r["shard_id"], r["seqno"]) for r in page.collect()]
    assert seen == seqnos(log.read_all_merged())


def test_changed_records_and_snapshots_are_told(log, spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    log.append_batch([("a", "1"), ("b", "2"), ("c", "3")], 0)
    log.append_batch([("d", "4")], 1)
    log.snapshot(str(tmp_path / "s"))
    entries = spark.read.parquet(str(tmp_path / "s" / "entries"))
    rows = [tuple(r) for r in entries.withColumn("value", F.when(F.col("key") == F.lit(b"a"), F.lit(b"9")).otherwise(F.col("value"))).collect()]
    spark.createDataFrame(rows, entries.schema).write.mode("overwrite").parquet(str(tmp_path / "s" / "entries"))
    with pytest.raises(errors.SnapshotChecksumMismatch):
        log.restore(str(tmp_path / "s"))
    (folder,) = glob.glob(f"{log.store.path}/gen=0/commits/000000000000")
    bad = [tuple(r) for r in spark.read.parquet(folder).withColumn("value", F.when(F.col("key") == F.lit(b"b"), F.lit(b"9")).otherwise(F.col("value"))).collect()]
    spark.createDataFrame(bad, spark.read.parquet(folder).schema).write.mode("append").parquet(str(tmp_path / "bad"))
    for old in glob.glob(f"{folder}/part-*") + glob.glob(f"{folder}/.part-*"):
        __import__("os").unlink(old)
    for new in glob.glob(str(tmp_path / "bad" / "part-*")):
        __import__("shutil").copy(new, folder)
    with pytest.raises(Exception, match="ChecksumMismatch"):
        log.read_all_merged().collect()
    with pytest.raises(errors.ChecksumMismatch, match="shard 0, segment 0"):
        log.get_or_null("b", shard=0)
    assert [(r["shard_id"], r["seqno"]) for r in log.valid_prefix().orderBy("shard_id", "seqno").collect()] == [(0, 1), (1, 1)]


def test_compaction_of_one_shard_and_vacuum(log, spark):
    from loomlog.sources import files

    for k in range(3):
        log.append_batch([("k", f"v{k}")], 0)
        log.append_batch([("k", f"w{k}")], 1)
    log.sync()
    log.compact(1)
    assert seqnos(log.read_all_merged()) == [(0, 1), (0, 2), (0, 3), (1, 3)]
    assert log.store.next_seqnos() == [4, 4] and log.get_or_null("k", shard=0) == b"v2" and log.get_or_null("k", shard=1) == b"w2"
    log.compact()
    log.append_batch([("z", "1")], 0)
    assert log.vacuum(0) == [0, 1] and files.names(spark, log.store.path).count("gen=2") == 1
    assert seqnos(log.read_all_merged()) == [(0, 3), (0, 4), (1, 3)]
    log.sync()
    with pytest.raises(errors.InvalidShardId):
        log.compact(9)
