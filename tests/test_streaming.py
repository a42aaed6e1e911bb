"""Stateful streaming against the batch fold."""

from loomlog.api import Log
from loomlog.schema import TOMBSTONE, Config
from loomlog.streaming.tail import consume, state_updates, tail, tail_until_idle


def test_streaming_state_equals_batch_state(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), Config(shard_count=2))
    log.append_batch([("a", "1"), ("b", "2"), ("c", "3")])
    log.append_batch([("a", "4"), ("b", None)])
    query = state_updates(tail(log, 1)).writeStream.outputMode("update").format("memory").queryName("updates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.sql("select * from updates").collect():
        key = (r["shard_id"], bytes(r["key"]))
        if key not in last or (r["seg"], r["off"]) > last[key][0]:
            last[key] = ((r["seg"], r["off"]), r["record_type"], r["value"])
    live = {k: bytes(v) for k, (_, kind, v) in last.items() if kind != TOMBSTONE}
    assert live == {(r["shard_id"], bytes(r["key"])): bytes(r["value"]) for r in log.store.state().collect()}


def test_tail_stops_when_idle(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), Config(shard_count=2))
    log.append_batch([("a", "1"), ("b", "2")])
    seen = []
    query = consume(log, str(tmp_path / "cp"), lambda rows, batch: seen.extend(rows.select("seqno").collect()), once=False, interval="200 milliseconds")
    tail_until_idle(query, 6)
    assert len(seen) == 2 and not query.isActive
