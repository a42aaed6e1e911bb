"""Exact dedup by a tree merge of digest runs (DataFrame functions only).

Every row gets a digest (SHA-256, with xxHash64 and the byte length as an independent check) and belongs to one of
``runs`` runs. Level 0 reduces each run to one entry per digest; then, in rounds, ``fan_in`` neighbouring runs are
merged into one, each entry keeping the surviving identifier and the number of rows, until one run is left. The
verdict goes down the same tree, so a digest that a third of all rows share is never gathered in one task: every
exchange is keyed by (digest, run at that level) and a key has at most ``fan_in`` entries or one run's rows.

Cases: null text counts as empty; empty texts are equal to one another; rows with the same identifier and text count
as rows of one group and are all kept or all dropped; null identifiers lose against others and a group of only null
identifiers keeps them (keep_id null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import shuffle_partitions, staged, table, text_of

FAN_IN = 8
KEY = ["digest", "check", "n_bytes"]


def digests(docs: DataFrame, id_col: str, text: Column, runs: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"),
    )


def tree_merge(entries: DataFrame, runs: int, keep: str, fan_in: int = FAN_IN) -> DataFrame:
    """``entries`` (KEY, run, doc_id) to (KEY, run, keep_id, group_size) for each run a digest occurs in."""
    pick = {"max": F.max, "min": F.min}[keep]
    level = entries.groupBy(*KEY, "run").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    levels = [level]
    while runs > 1:
        runs = -(-runs // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy(*KEY, "run")
            .agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
        levels.append(level)
    verdict = levels.pop()
    while levels:
        below = levels.pop().select(*KEY, "run")
        verdict = (
            below.withColumn("up", F.floor(F.col("run") / fan_in))
            .join(verdict.withColumnRenamed("run", "up"), [*KEY, "up"])
            .drop("up")
        )
    return verdict


def runs_for(spark: SparkSession, fan_in: int = FAN_IN) -> int:
    runs = fan_in
    while runs < shuffle_partitions(spark):
        runs *= fan_in
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    runs = runs_for(spark)
    entries = staged(digests(docs, id_col, text_of(text_col), runs), "digests")
    verdict = tree_merge(entries, runs, keep)
    return entries.join(verdict, [*KEY, "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
