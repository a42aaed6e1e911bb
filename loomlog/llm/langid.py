"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased letter by letter, all else is one space. N-grams are hashed into ``BUCKETS``. Counts by language
are summed over the cluster from all labelled documents. The log-probability matrix has BUCKETS x languages entries,
is checked against ``MATRIX_BYTES`` and broadcast; batches are scored in numpy by gathering and segment sums.

Cases: null, empty and letterless texts are ``und`` with score 0; rows without identifier or label are not learned
from; equal likelihoods go to the first language by name; without anything to learn from all is ``und``; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.arrays import chunks, code_points, mix, sums
from loomlog.llm.common import id_and_text, table

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MATRIX_BYTES = 256 << 20
UNKNOWN = "und"
#: accepted() wants a mean log-likelihood per n-gram of at least this quantile of the learned documents, less so many nats
#: for clean documents that are unlike most, less NOISE / sqrt(n-grams) for short ones.
FIT_QUANTILE, FIT_SLACK, NOISE = 0.01, 1.5, 4.0
FIT_DIGITS = 3  # so there are some 35,000 different fits at most


@cache
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for k in range(sys.maxunicode + 1):
        if (c := chr(k)).isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """By order, the bucket of the n-gram at each place (BUCKETS where it would leave its text); where texts begin; letters in each."""
    points, at = code_points(column)
    x = letters()[points]
    kept = x != 0
    n_letters = sums(kept.astype(np.float32), at)
    kept[1:] |= x[:-1] != 0
    y = x[kept].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(kept)])[at]
    out, h = [], y + np.uint64(1)
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + y[order - 1 :] + np.uint64(1)
        if order in ORDERS:
            bucket = np.full(len(y), BUCKETS, np.int32)
            bucket[: len(h)] = mix(h + np.uint64(order << 56)) >> np.uint64(64 - BITS)
            for back in range(1, order):
                ends = at[1:] - back
                bucket[ends[ends >= at[:-1]]] = BUCKETS
            out.append(bucket)
    return out, at, n_letters


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def counts(labelled: DataFrame) -> DataFrame:
    """(lang, text) to (lang, bucket, n); bucket -1 counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in chunks(batches, 1):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            buckets, at, _ = grams(batch.column(1))
            of_row = np.repeat(np.arange(len(langs)), np.diff(at))
            for lang in set(langs):
                mine = (langs == lang)[of_row]
                total = found.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for bucket in buckets:
                    total += np.bincount(bucket[mine], minlength=BUCKETS + 1)
                docs[lang] = docs.get(lang, 0) + int((langs == lang).sum())
        for lang, total in found.items():
            used = np.flatnonzero(total[:BUCKETS])
            bucket, n = np.append(used, -1), np.append(total[used], docs[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(bucket, pa.int64()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    return labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(doc_id, lang, text) to languages, log-probabilities (BUCKETS + 1 x languages) and log-priors, from every row that has all three."""
    labelled = labelled.where("lang is not null and text is not null and doc_id is not null")
    most = MATRIX_BYTES // (4 * BUCKETS)
    if labelled.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages need more than {MATRIX_BYTES} bytes of log-probabilities")
    found = counts(labelled.select("lang", "text")).toPandas()
    langs = sorted(found["lang"].unique())
    matrix, docs = np.zeros((BUCKETS + 1, len(langs))), np.ones(len(langs))
    for j, lang in enumerate(langs):
        mine = found[found["lang"] == lang]
        docs[j] = mine.loc[mine["bucket"] < 0, "n"].sum()
        some = mine[mine["bucket"] >= 0]
        matrix[some["bucket"].to_numpy(), j] = some["n"]
    if langs:
        matrix[:BUCKETS] = np.log((matrix[:BUCKETS] + SMOOTHING) / (matrix[:BUCKETS].sum(0) + SMOOTHING * BUCKETS))
        matrix[BUCKETS] = 0
    return langs, matrix.astype(np.float32), np.log(docs / max(1, docs.sum()))


class Scorer:
    def __init__(self, model: tuple[list[str], np.ndarray, np.ndarray]):
        self.langs, matrix, self.prior = model
        self.by_lang = [np.ascontiguousarray(matrix[:, j]) for j in range(len(self.langs))]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Names and posteriors."""
        return self.fitting(column)[:2]

    def fitting(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, posteriors, and the mean log-likelihood per n-gram in the told language plus NOISE / sqrt(n-grams)."""
        buckets, at, n_letters = grams(column)
        if not self.langs:
            return np.full(len(at) - 1, UNKNOWN, dtype=object), np.zeros(len(at) - 1), np.full(len(at) - 1, -np.inf)
        told = np.tile(self.prior, (len(at) - 1, 1))
        for j, logs in enumerate(self.by_lang):
            told[:, j] += sum(sums(logs[bucket], at) for bucket in buckets)
        known = n_letters > 0
        top = 1 / np.exp(told - told.max(1, keepdims=True)).sum(1) if len(told) else np.zeros(0)
        best, n = told.argmax(1), np.maximum(1, sum(sums((bucket != BUCKETS).astype(np.float32), at) for bucket in buckets))
        own = (told[np.arange(len(told)), best] - self.prior[best]) / n + NOISE / np.sqrt(n)
        return np.where(known, np.array(self.langs, dtype=object)[best], UNKNOWN), np.where(known, top, 0.0), np.where(known, own, -np.inf)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, text) to (doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in chunks(batches, 1):
            names, top = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(top)], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(score, "doc_id long, lang_pred string, score double")


def train_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return docs.where(~held_out(id_col, 3, 1)).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    model = model or fit(train_rows(docs, id_col, text_col, lang_col))
    found = predict(id_and_text(docs, id_col, text_col), model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def fits_from(learned: DataFrame, shared) -> float:
    """The least fit of a document in a learned language, from all those learned (doc_id, lang, text): the quantile is
    worked out from how often each fit, rounded to ``FIT_DIGITS``, occurs."""

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in chunks(batches, 0):
            own = scorer.fitting(batch.column(0))[2]
            yield pa.RecordBatch.from_arrays([pa.array(own[np.isfinite(own)])], ["fit"])

    often = learned.select("text").mapInArrow(fits, "fit double").groupBy(F.round("fit", FIT_DIGITS).alias("fit")).count()
    found = often.agg(F.percentile("fit", F.lit(FIT_QUANTILE), F.col("count"))).first()[0]
    return -np.inf if found is None else found - FIT_SLACK


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text has a language that the model tells with ``least`` posterior and
    fits that language about as well as the documents learned from; other languages and letter junk go."""
    learned = train_rows(docs, id_col, text_col, lang_col).where("lang is not null and text is not null and doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(fit(learned))
    floor = fits_from(learned, shared)
    place = docs.columns.index(text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(place).fill_null("")], ["t"])
            kept = [t >= least and f >= floor for part in chunks(iter([own]), 0) for t, f in zip(*scorer.fitting(part.column(0))[1:], strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
