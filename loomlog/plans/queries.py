"""The query catalogue over the log derived from events, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import records as R
from loomlog.operators import checkpoint as C
from loomlog.operators import frontier as FR
from loomlog.operators import layout as L
from loomlog.operators import replay as P
from loomlog.operators import state as S
from loomlog.schema import BATCH, DURABLE, TOMBSTONE, VISIBLE, Config
from loomlog.sources.derive import INLINE_MAX, SHARDS, event_log, event_ops, order_log

SEGMENT_LIMIT = 16_384
PAGE = 256
START = [(0, 20_000), (0, 0), (0, 40_000), (0, 10_000)]
ASKED = ["user:1", "user:2", "user:3", "user:40", "user:nobody"]
AT = 30_000
CONFIG = Config(batch_sync_interval_ns=1_000_000, max_dirty_bytes=4_096, max_dirty_ops=64)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The derived log in SQL, the base of the other statements.
LOG_SQL = f"""
base AS (
    SELECT CAST(user_id % {SHARDS} AS INTEGER) AS shard_id, 'user:' || user_id AS key,
           CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '|' || props END AS value,
           CAST(event_id % 3 AS INTEGER) AS durability, event_id // 100 AS commit_id, ts, event_id
    FROM events),
kinds AS (
    SELECT *, CASE WHEN value IS NULL THEN 2 WHEN strlen(value) <= {INLINE_MAX} THEN 0 ELSE 1 END AS record_type,
           coalesce(strlen(value), 0) AS value_len
    FROM base),
sized AS (
    SELECT *, 36 + strlen(key) + CASE record_type WHEN 0 THEN value_len WHEN 1 THEN 32 ELSE 0 END AS len FROM kinds),
log AS (
    SELECT shard_id, CAST(0 AS BIGINT) AS wal_segment_id, CAST(sum(len) OVER w - len AS BIGINT) AS wal_offset,
           CAST(sum(len) OVER w AS BIGINT) AS next_offset, row_number() OVER w AS seqno, key, value,
           CAST(value_len AS BIGINT) AS value_len, record_type, durability, CAST(commit_id AS BIGINT) AS commit_id, event_id
    FROM sized WINDOW w AS (PARTITION BY shard_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
lasts AS (
    SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY shard_id, key ORDER BY next_offset DESC) = 1),
live AS (SELECT * FROM lasts WHERE record_type <> 2),
ends AS (
    SELECT shard_id, max(next_offset) AS visible, coalesce(max(CASE WHEN durability = 2 THEN next_offset END), 0) AS durable
    FROM log GROUP BY shard_id)
"""


def query(sql: str | None, *, raw: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if raw else f"WITH {LOG_SQL} {sql}"
        return f

    return add


def _after(cursors: list[tuple[int, int]]) -> str:
    return " OR ".join(f"(shard_id = {k} AND next_offset > {o})" for k, (_, o) in enumerate(cursors))


ENTRY = ["shard_id", "key", "value", "seqno", "next_offset"]
ITEM = ["shard_id", "seqno", "key", "value", "record_type", "durability", "wal_segment_id", "next_offset"]
ITEM_SQL = ", ".join(ITEM)
KEYS_SQL = ", ".join(f"'{k}'" for k in ASKED)


def _numbered(page: DataFrame, *order: str) -> DataFrame:
    """A page with each item's place, so that its order is part of the result. Pages are small."""
    from pyspark.sql import Window

    return page.select(*ITEM, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long").alias("place"))


@query(f"SELECT {', '.join(ENTRY)} FROM live")
def state(spark: SparkSession, d: str) -> DataFrame:
    return S.state(event_log(spark, d)).select(*ENTRY)


@query(f"SELECT {', '.join(ENTRY)} FROM live WHERE key = 'user:7'")
def get(spark: SparkSession, d: str) -> DataFrame:
    return S.get(event_log(spark, d), "user:7").select(*ENTRY)


@query(f"SELECT shard_id, key, record_type, seqno FROM lasts WHERE key IN ({KEYS_SQL})")
def get_ref(spark: SparkSession, d: str) -> DataFrame:
    return S.get_ref(event_log(spark, d), *ASKED).select("shard_id", "key", "record_type", "seqno")


@query("SELECT shard_id, key, record_type, seqno, next_offset, value_len FROM lasts")
def state_index(spark: SparkSession, d: str) -> DataFrame:
    return S.last_records(event_log(spark, d)).select("shard_id", "key", "record_type", "seqno", "next_offset", "value_len")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in ASKED], "key string")


@query(f"SELECT k.key, l.value, l.key IS NOT NULL AS found FROM (SELECT unnest([{KEYS_SQL}]) AS key) k LEFT JOIN live l ON k.key = l.key")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return S.multi_get(event_log(spark, d), _asked(spark))


@query(f"SELECT k.key, coalesce(l.record_type <> 2, FALSE) AS live, l.key IS NOT NULL AS known FROM (SELECT unnest([{KEYS_SQL}]) AS key) k LEFT JOIN lasts l ON k.key = l.key")
def exists(spark: SparkSession, d: str) -> DataFrame:
    return S.exists(event_log(spark, d), _asked(spark))


def _as_of(where: str) -> str:
    return f""", past AS (SELECT * FROM log WHERE {where} QUALIFY row_number() OVER (PARTITION BY shard_id, key ORDER BY next_offset DESC) = 1)
SELECT {', '.join(ENTRY)} FROM past WHERE record_type <> 2"""


@query(_as_of(f"shard_id = 1 AND next_offset <= {AT}"))
def state_at(spark: SparkSession, d: str) -> DataFrame:
    return S.state_at(event_log(spark, d), 1, 0, AT).select(*ENTRY)


@query(_as_of(f"shard_id = 3 AND next_offset <= {AT} AND key = 'user:7'"))
def get_at(spark: SparkSession, d: str) -> DataFrame:
    return S.get_at(event_log(spark, d), "user:7", 3, 0, AT).select(*ENTRY)


@query(f""", asked AS (SELECT DISTINCT shard_id, key, at_offset FROM log, (SELECT unnest([5000, {AT}, 100000]) AS at_offset))
SELECT a.shard_id, a.key, CAST(0 AS BIGINT) AS at_segment, CAST(a.at_offset AS BIGINT) AS at_offset,
       (SELECT arg_max_null(l.value, l.next_offset) FROM log l WHERE l.shard_id = a.shard_id AND l.key = a.key AND l.next_offset <= a.at_offset) AS value
FROM asked a""")
def get_at_many(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    keys = log.select("shard_id", "key").distinct()
    asked = keys.select("shard_id", "key", F.lit(0).cast("long").alias("at_segment"), F.explode(F.array(*(F.lit(x).cast("long") for x in (5000, AT, 100_000)))).alias("at_offset"))
    return S.get_at_many(log, asked)


@query(f"SELECT DISTINCT key, CAST(('0x' || substr(md5(key), 1, 8))::UBIGINT % {SHARDS} AS INTEGER) AS shard_id FROM base")
def route(spark: SparkSession, d: str) -> DataFrame:
    return event_ops(spark, d).select("key").distinct().select("key", R.route(F.col("key"), SHARDS).alias("shard_id"))


@query("SELECT event_id, shard_id, seqno FROM log")
def log_seqno(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("event_id", "shard_id", "seqno")


@query("SELECT shard_id, seqno, wal_offset, next_offset, record_type, value_len FROM log")
def log_layout(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("shard_id", "seqno", "wal_offset", "next_offset", "record_type", "value_len")


@query(f"""WITH RECURSIVE {LOG_SQL}, lens AS (SELECT shard_id, seqno, next_offset - wal_offset AS len FROM log),
fold(shard_id, seqno, wal_segment_id, wal_offset, next_offset) AS (
    SELECT shard_id, seqno, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(len AS BIGINT) FROM lens WHERE seqno = 1
    UNION ALL
    SELECT l.shard_id, l.seqno, CASE WHEN f.next_offset + l.len > {SEGMENT_LIMIT} THEN f.wal_segment_id + 1 ELSE f.wal_segment_id END,
           CASE WHEN f.next_offset + l.len > {SEGMENT_LIMIT} THEN 0 ELSE f.next_offset END,
           CASE WHEN f.next_offset + l.len > {SEGMENT_LIMIT} THEN l.len ELSE f.next_offset + l.len END
    FROM fold f JOIN lens l ON l.shard_id = f.shard_id AND l.seqno = f.seqno + 1)
SELECT * FROM fold""", raw=True)
def log_segments(spark: SparkSession, d: str) -> DataFrame:
    return L.segments(event_log(spark, d).withColumn("len", F.col("next_offset") - F.col("wal_offset")), SEGMENT_LIMIT)


@query("SELECT shard_id, commit_id, min(wal_offset) AS start_offset, max(next_offset) AS end_offset, count(*) AS record_count, min(seqno) AS first_seqno, max(seqno) AS last_seqno FROM log GROUP BY ALL")
def commit_window(spark: SparkSession, d: str) -> DataFrame:
    return L.commit_windows(event_log(spark, d))


@query("SELECT shard_id, CAST(0 AS BIGINT) AS wal_segment_id, max(next_offset) AS next_offset, max(seqno) AS seqno FROM log WHERE commit_id = 3 GROUP BY shard_id")
def append_batch_tokens(spark: SparkSession, d: str) -> DataFrame:
    return L.tokens(event_log(spark, d).where("commit_id = 3"))


@query(f"SELECT {ITEM_SQL}, row_number() OVER (ORDER BY next_offset) AS place FROM log WHERE shard_id = 2 AND next_offset > {AT} ORDER BY next_offset LIMIT 100")
def read_from(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(P.read_from(event_log(spark, d), 2, (0, AT), 100), "next_offset")


@query(f"SELECT {', '.join('l.' + c for c in ITEM)}, row_number() OVER (ORDER BY next_offset) AS place FROM log l JOIN ends e ON l.shard_id = e.shard_id WHERE l.shard_id = 2 AND next_offset > {AT} AND next_offset <= durable ORDER BY next_offset LIMIT 1000000")
def read_from_durable(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    page = P.read_from(P.bounded(log, FR.durable_frontier(log)), 2, (0, AT), 1_000_000)
    # Seqnos of a shard have no gaps, so places follow from the first one without a sort in one task.
    first = log.where((F.col("shard_id") == 2) & R.after(0, AT)).agg(F.min("seqno").alias("first"))
    return page.join(F.broadcast(first)).select(*ITEM, (F.col("seqno") - F.col("first") + 1).alias("place"))  # one row


@query(f"SELECT {ITEM_SQL}, row_number() OVER (ORDER BY shard_id, next_offset) AS place FROM log WHERE shard_id > 1 OR (shard_id = 1 AND next_offset > {AT}) ORDER BY shard_id, next_offset LIMIT 500")
def read_from_all(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(P.read_from_all(event_log(spark, d), 1, (0, AT), 500), "shard_id", "next_offset")


@query(f"SELECT {ITEM_SQL}, row_number() OVER (ORDER BY seqno, shard_id) AS place FROM log WHERE {_after(START)} ORDER BY seqno, shard_id LIMIT {PAGE}")
def merged_page(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(P.merged_page(event_log(spark, d), START, PAGE, SHARDS), "seqno", "shard_id")


@query(f"SELECT {', '.join('l.' + c for c in ITEM)}, row_number() OVER (ORDER BY seqno, l.shard_id) AS place FROM log l JOIN ends e ON l.shard_id = e.shard_id WHERE next_offset <= durable AND ({_after(START).replace('shard_id', 'l.shard_id')}) ORDER BY seqno, l.shard_id LIMIT {PAGE}")
def merged_page_durable(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    return _numbered(P.merged_page(P.bounded(log, FR.durable_frontier(log)), START, PAGE, SHARDS), "seqno", "shard_id")


@query(f"SELECT {ITEM_SQL} FROM log LIMIT 0")
def merged_page_zero(spark: SparkSession, d: str) -> DataFrame:
    return P.merged_page(event_log(spark, d), START, 0).select(*ITEM)


@query(f""", page AS (SELECT * FROM log WHERE {_after(START)} ORDER BY seqno, shard_id LIMIT {PAGE}),
moved AS (SELECT shard_id, max(next_offset) AS o FROM page GROUP BY shard_id)
SELECT CAST(s.k AS INTEGER) AS shard_id, CAST(0 AS BIGINT) AS wal_segment_id, CAST(coalesce(m.o, s.o) AS BIGINT) AS wal_offset
FROM (VALUES {', '.join(f'({k}, {o})' for k, (_, o) in enumerate(START))}) s(k, o) LEFT JOIN moved m ON m.shard_id = s.k""")
def merged_next_cursor(spark: SparkSession, d: str) -> DataFrame:
    return P.next_cursors(P.merged_page(event_log(spark, d), START, PAGE, SHARDS), START)


@query(f"SELECT shard_id, seqno, (row_number() OVER (ORDER BY seqno, shard_id) - 1) // {PAGE} AS page, (row_number() OVER (ORDER BY seqno, shard_id) - 1) % {PAGE} AS item FROM log")
def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.merged_pages(event_log(spark, d), PAGE).select("shard_id", "seqno", "page", "item")


@query(f"SELECT {ITEM_SQL} FROM log")
def read_all_merged(spark: SparkSession, d: str) -> DataFrame:
    return P.merged_all(event_log(spark, d)).select(*ITEM)


@query("SELECT count(*) AS items, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM log")
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.page_stats(event_log(spark, d))


@query(", bad AS (SELECT *, CASE WHEN event_id % 1000 = 999 THEN 0 ELSE 1 END AS ok FROM log), p AS (SELECT *, min(ok) OVER (PARTITION BY shard_id ORDER BY next_offset) AS a FROM bad) SELECT shard_id, seqno, next_offset FROM p WHERE a = 1")
def recover(spark: SparkSession, d: str) -> DataFrame:
    return P.valid_prefix(event_log(spark, d).withColumn("ok", F.col("event_id") % 1000 != 999)).select("shard_id", "seqno", "next_offset")


@query("SELECT shard_id, CAST(0 AS BIGINT) AS visible_segment, visible AS visible_offset, CAST(0 AS BIGINT) AS durable_segment, durable AS durable_offset FROM ends")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    return FR.windows(event_log(spark, d))


@query("SELECT l.shard_id, count(*) AS records, count(CASE WHEN record_type = 2 THEN 1 END) AS tombstones, max(seqno) AS last_seqno, CAST(coalesce((SELECT count(*) FROM live v WHERE v.shard_id = l.shard_id), 0) AS BIGINT) AS entries FROM log l GROUP BY l.shard_id")
def stats(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    return FR.counts(log, S.state(log))


@query(", t AS (SELECT record_type, count(*) AS records, CAST(sum(next_offset - wal_offset) AS BIGINT) AS bytes FROM log GROUP BY record_type) SELECT * FROM t")
def inspect(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).groupBy("record_type").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("next_offset") - F.col("wal_offset")).alias("bytes"))


@query("SELECT l.shard_id, count(*) AS dirty_ops, CAST(sum(next_offset - wal_offset) AS BIGINT) AS dirty_bytes, max(durability) AS strongest FROM log l JOIN ends e ON l.shard_id = e.shard_id WHERE next_offset > durable GROUP BY l.shard_id")
def dirty_stats(spark: SparkSession, d: str) -> DataFrame:
    return FR.dirty(event_log(spark, d))


@query("SELECT commit_id, max(durability) = 2 AS syncs, count(DISTINCT shard_id) AS shards, count(*) AS records FROM log GROUP BY commit_id")
def commit_frontiers(spark: SparkSession, d: str) -> DataFrame:
    return FR.commit_frontiers(event_log(spark, d))


@query(f"""WITH RECURSIVE {LOG_SQL},
ops AS (SELECT shard_id, seqno * 2 AS step, 1 AS op, seqno * 20000 AS now_ns, next_offset - wal_offset AS bytes, durability FROM log),
steps AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY step) AS k
    FROM (SELECT * FROM ops UNION ALL SELECT shard_id, step + 1, 0, now_ns, 0, 0 FROM ops WHERE step % 20 = 0)),
fold(shard_id, k, step, since, ops, bytes, strongest, synced, synced_ops, synced_bytes) AS (
    SELECT shard_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), -1, false, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
    FROM (SELECT DISTINCT shard_id FROM steps)
    UNION ALL
    SELECT shard_id, k, step, CASE WHEN op = 1 THEN coalesce(since, now_ns) WHEN syncs THEN NULL ELSE since END,
           CASE WHEN syncs THEN 0 ELSE ops + op END, CASE WHEN syncs THEN 0 ELSE old_bytes + bytes END,
           CASE WHEN op = 1 THEN greatest(strongest, durability) WHEN syncs THEN -1 ELSE strongest END, syncs, ops, old_bytes
    FROM (SELECT s.shard_id, s.k, s.step, s.op, s.now_ns, s.bytes, s.durability, f.since, f.ops, f.bytes AS old_bytes, f.strongest,
                 s.op = 0 AND coalesce(s.now_ns >= f.since, false) AND f.strongest >= {BATCH} AND (s.now_ns - f.since >= {CONFIG.batch_sync_interval_ns}
                 OR f.bytes >= {CONFIG.max_dirty_bytes} OR f.ops >= {CONFIG.max_dirty_ops}) AS syncs
          FROM fold f JOIN steps s ON s.shard_id = f.shard_id AND s.k = f.k + 1))
SELECT shard_id, step, synced_ops, synced_bytes FROM fold WHERE synced""", raw=True)
def durability_ticks(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    ops = log.select("shard_id", (F.col("seqno") * 2).alias("step"), F.lit("op").alias("kind"), (F.col("seqno") * 20_000).alias("now_ns"), (F.col("next_offset") - F.col("wal_offset")).alias("bytes"), "durability")
    ticks = ops.where(F.col("step") % 20 == 0).select("shard_id", F.col("step") + 1, F.lit("tick").alias("kind"), "now_ns", F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("durability"))
    return FR.policy(ops.union(ticks), CONFIG)


def _checkpoint_sql(column: str) -> str:
    return f"""SELECT 1 AS version, {SHARDS} AS shard_count, '{column}' AS kind, (SELECT max(seqno) FROM log) AS high_seqno, k AS shard_id,
CAST(0 AS BIGINT) AS wal_segment_id, coalesce({column}, 0) AS wal_offset FROM (SELECT CAST(unnest(range({SHARDS})) AS INTEGER) AS k) LEFT JOIN ends ON shard_id = k"""


def _rows(found: DataFrame) -> DataFrame:
    return found.select("version", "shard_count", "kind", "high_seqno", F.explode("cursors").alias("c")).select("version", "shard_count", "kind", "high_seqno", "c.shard_id", "c.wal_segment_id", "c.wal_offset")


@query(_checkpoint_sql("visible"))
def checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return _rows(C.checkpoint(event_log(spark, d), SHARDS, VISIBLE))


@query(_checkpoint_sql("durable"))
def checkpoint_durable(spark: SparkSession, d: str) -> DataFrame:
    return _rows(C.checkpoint(event_log(spark, d), SHARDS, DURABLE))


@query(f"SELECT CAST(k AS INTEGER) AS shard_id, o <= coalesce(durable, 0) AS valid FROM (VALUES (0, 1000), (1, 0), (2, 999999999), (3, 5)) v(k, o) LEFT JOIN ends ON shard_id = k")
def checkpoint_valid(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(0, 0, 1000), (1, 0, 0), (2, 0, 999_999_999), (3, 0, 5)], "shard_id int, wal_segment_id long, wal_offset long")
    return C.violations(asked, FR.windows(event_log(spark, d)), DURABLE)


@query(f"SELECT {', '.join('l.' + c for c in ITEM)} FROM log l JOIN ends e ON l.shard_id = e.shard_id WHERE next_offset > durable")
def read_from_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    found = C.captured(log, SHARDS, DURABLE, 0)
    return P.since(log, [tuple(c) for c in found["cursors"]]).select(*ITEM)


@query("SELECT CAST(k AS INTEGER) AS shard_id, CAST(0 AS BIGINT) AS wal_segment_id, CAST(0 AS BIGINT) AS wal_offset FROM (SELECT unnest(range(4)) AS k)")
def zero_cursors(spark: SparkSession, d: str) -> DataFrame:
    return C.cursors(event_log(spark, d).limit(0), SHARDS, VISIBLE)


@query("SELECT shard_id, key, value FROM live")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return C.snapshot(event_log(spark, d))


@query("SELECT l.shard_id, count(*) AS entries, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes, (SELECT max(seqno) + 1 FROM log g WHERE g.shard_id = l.shard_id) AS next_seqno FROM live l GROUP BY l.shard_id")
def snapshot_inspect(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    next_ = log.groupBy("shard_id").agg((F.max("seqno") + 1).alias("next_seqno"))
    entries = C.snapshot(log).groupBy("shard_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("bytes"))
    return entries.join(F.broadcast(next_), "shard_id")  # a row a shard


@query("""SELECT shard_id, key, value, row_number() OVER w AS seqno, CAST(sum(next_offset - wal_offset) OVER w AS BIGINT) AS next_offset
FROM live WINDOW w AS (PARTITION BY shard_id ORDER BY key ROWS UNBOUNDED PRECEDING)""")
def snapshot_restore(spark: SparkSession, d: str) -> DataFrame:
    ops = C.restored(C.snapshot(event_log(spark, d)))
    return L.positions(ops, ["arrival"], F.substring("arrival", 1, 16), INLINE_MAX).select("shard_id", "key", "value", "seqno", "next_offset")


@query("""SELECT shard_id, key, value, seqno, 2 AS durability, CAST(sum(next_offset - wal_offset) OVER w AS BIGINT) AS next_offset
FROM live WINDOW w AS (PARTITION BY shard_id ORDER BY seqno ROWS UNBOUNDED PRECEDING)""")
def compact(spark: SparkSession, d: str) -> DataFrame:
    return S.compacted(event_log(spark, d), INLINE_MAX).select("shard_id", "key", "value", "seqno", "durability", "next_offset")


@query("""SELECT CAST(o_custkey % 4 AS INTEGER) AS shard_id, CAST(o_custkey AS VARCHAR) AS key, o_orderstatus AS value
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""", raw=True)
def order_state(spark: SparkSession, d: str) -> DataFrame:
    return S.state(order_log(spark, d)).select("shard_id", "key", "value")


@query("SELECT s_suppkey, 'email=' || s_name || '|name=' || s_acctbal AS payload, s_name AS email FROM supplier", raw=True)
def payload_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    rows = rows.select("s_suppkey", R.payload({"email": F.col("s_name"), "name": F.col("s_acctbal").cast("string")}).alias("payload"))
    return rows.select("s_suppkey", "payload", R.payload_field(F.col("payload"), "email").alias("email"))


@query("SELECT record_type = 2 AS tombstone, count(*) AS n FROM log GROUP BY 1")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).groupBy((F.col("record_type") == TOMBSTONE).alias("tombstone")).agg(F.count(F.lit(1)).alias("n"))
