"""Shared plumbing of the corpus operators: tables, staging folders, skew-safe lookups."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES = 4 << 20
SIEVE_BITS = 1 << 27  # bits of a sieve at most (16 MB)
PART_BITS = 1 << 15  # bits of a bitmap that bitmap_construct_agg makes


def lean(spark: SparkSession) -> None:
    """Holds the Arrow batches that this session sends to Python to ``ARROW_BYTES`` (10,000 long texts are far more)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (now := re.fullmatch(r"(\d+)b?", spark.conf.get(name))) is None or int(now[1]) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a single-machine session
    (tests) gets an own one; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    The files go with freed() or when the driver process ends; a lazily read result may need them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomlog-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As staged(), but a table bucketed by ``key``: later joins on it move the other side only. freed() drops it."""
    spark = df.sparkSession
    name = f"loomlog_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    atexit.register(_remove, spark, path)
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(shuffle_partitions(spark), key).saveAsTable(name)
    out = spark.table(name)
    out._staged_at, out._table = path, name
    return out


def freed(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing will read again."""
    for df in tables:
        if name := getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_staged_at", None):
            _remove(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sieved(df: DataFrame, key: str, ids: DataFrame, most_bits: int = SIEVE_BITS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids`` (one column, staged), and few others: about one in 16, more where
    ``most_bits`` are less than 16 for each of ids. For a join that would move wide rows: they stay where they are, and
    only a bitmap of hashed ids, ``most_bits`` at most, is broadcast in parts of ``PART_BITS``."""
    bits, enough = PART_BITS, min(most_bits, 16 * ids.count())
    while bits < enough:
        bits *= 2
    place = lambda column: F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits)).cast("int")
    own = ids.select(place(ids.columns[0]).alias("p")).select(F.floor(F.col("p") / PART_BITS).alias("sieve_part"), (F.col("p") % PART_BITS).cast("long").alias("at"))
    # Dealt by part first, so there is one bitmap a part and not one a task and part.
    parts = own.repartition("sieve_part").groupBy("sieve_part").agg(F.bitmap_construct_agg("at").alias("sieve_bits"))
    met = df.withColumn("sieve_at", place(key)).withColumn("sieve_part", F.floor(F.col("sieve_at") / PART_BITS)).join(F.broadcast(parts), "sieve_part")
    byte = F.conv(F.hex(F.expr(f"substring(sieve_bits, cast((sieve_at % {PART_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.where(F.getbit(byte, F.col("sieve_at") % 8) == 1).select(*df.columns)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator needs, under fixed names, so other columns of ``docs`` cannot clash."""
    lean(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
