"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all columns of its documents pass through,
whatever their names.

Cases: verdicts are on rows, not on identifiers. Null and repeated identifiers are told apart by a row key (in order of
identifier, nulls last, then of the text's digest), so of rows that are equal in all columns one stays, and a row never goes
because another one shares its identifier. Null and empty texts have no letter and go in the language stage; given to a later
stage, they are equal to one another, near-duplicates of nothing, hold no benchmark item, and are packed as the end id alone.
Ties go to the smallest identifier. Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontamination, exact_dedup, langid, neardup, packing
from loomlog.llm.common import staged

SHINGLE, PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, whose language is told with less than even odds, or that fit no learned language go."""
    return langid.accepted(docs)


def _free(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; it gets (doc_id, text) with a unique key for doc_id."""
    names, key, gone = docs.columns, _free(docs, "row_key"), _free(docs, "gone_key")
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:
        order = [F.col("doc_id").asc_nulls_last(), F.sha2("text", 256).asc_nulls_first()]
        keyed = staged(docs.orderBy(*order).withColumn(key, F.monotonically_increasing_id()), "keyed")
    verdict = judge(keyed.select(F.col(key).alias("doc_id"), "text"))
    dropped = verdict.where(~F.col("kept")).select(F.col("doc_id").alias(gone))
    return keyed.join(dropped, F.col(key) == F.col(gone), "left_anti").select(*names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier stays."""
    return _kept(docs, lambda rows: exact_dedup.exact_dedup(rows, keep="min"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near-duplicates the row with the smallest identifier stays."""
    return _kept(docs, lambda rows: neardup.near_duplicates(rows, k=SHINGLE, percent=PERCENT))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("packing", packed),
]

ORACLE_SQL = None  # language ID, near-dedup and packing are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` in turn over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
