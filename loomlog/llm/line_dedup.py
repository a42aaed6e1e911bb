"""Removal of repeated runs of lines by winnowing over line hashes.

Lines (runs of characters other than the line end) are hashed, and every ``GRAM`` lines in a row as well. Of each window of
``RUN - GRAM + 1`` such hashes, which is a run of ``RUN`` lines, the least is selected (the last of equal ones); so equal runs
select the same fingerprint at the same offset, and no run of ``RUN`` lines goes without one. Only selected fingerprints are
sent, once a place: two of three places, as many windows choose the same. Positions are joined by fingerprint in an external
sort, and each match is extended both ways, over the lines before and after, to the runs that chose it (their hashes travel
along); every run that also starts earlier goes. Touching runs make up longer ones. Map tasks settle what they hold first;
very large groups are flushed and settled by a second sort, by runs.

With ``words``, shorter runs of more than that many words (blank-separated, in 1 to ``RUN - 1`` lines) count as well: they
are sent whole, under their own hash. The number of lines of a run travels in the low bits of its mark.

A line goes if a run that counts and covers it also starts earlier (smaller identifier, or earlier in the same
text), judged on the input. Cases: null, empty and line-end-only texts have no lines; texts of fewer lines stay; rows
without identifier come last and rows with the same identifier are ordered by their text's digest; an empty table gives
no rows; other columns are ignored. Kept lines are joined by single line ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.arrays import chunks
from loomlog.llm.common import id_and_text, staged, table
from loomlog.llm.shingles import IN_LINE, grams, words
from loomlog.llm.suffix_dedup import HELD, REPEAT, SUFFIX, WINDOW, by_name, firsts, joined, ordered, tuples, windows

RUN = 3
GRAM = 2
LONG = 50  # words above which a run counts in op4_line_dedup_long, however few its lines
LINES = 8  # bits of a mark that hold its run's number of lines


FINGERPRINTS = "kind int, name long, marks array<long>, mark long, doc long, start long"


def selected(lines: np.ndarray, at: np.ndarray, run: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashed lines, whose texts begin at ``at``, the selected places, their fingerprints, and for each place the marks of
    the runs that chose it: in column j that of the run that begins j lines before it, 0 for none."""
    width = run - gram + 1
    row = np.searchsorted(at, np.arange(len(lines)), "right") - 1
    begin = np.flatnonzero(np.arange(len(lines)) + run <= at[row + 1])
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)
    names = grams(lines, gram)
    choice = width - 1 - np.lib.stride_tricks.sliding_window_view(names, width)[begin, ::-1].argmin(1)
    place, where = np.unique(begin + choice, return_inverse=True)
    marks = np.zeros((len(place), width), np.int64)
    marks[where, choice] = marked(grams(lines, run)[begin], run)
    return place, names[place].view(np.int64), marks


def marked(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(LINES) << np.uint64(LINES) | np.uint64(n)).view(np.int64)


def lines_of(mark: np.ndarray) -> np.ndarray:
    return mark & ((1 << LINES) - 1)


def runs(marks: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches extended both ways: mark, document and first line of each run around the fingerprints."""
    k, j = np.nonzero(marks)
    return marks[k, j], doc[k], start[k] - j


def fingerprints(docs: DataFrame, run: int, gram: int, long: int | None = None) -> DataFrame:
    """(doc, text) to SUFFIX tuples (name: fingerprint; marks: of the runs that chose it; start: its first line) and REPEATs."""
    if not 0 < gram <= run < 1 << LINES:
        raise ValueError(f"a run has {gram} to {(1 << LINES) - 1} lines")
    width = run - gram + 1

    def batch_of(kind: int, n: int, **columns) -> pa.RecordBatch:
        of = {"kind": pa.array(np.full(n, kind, np.int32)), "name": pa.nulls(n, pa.int64()), "marks": pa.nulls(n, pa.list_(pa.int64())), "mark": pa.nulls(n, pa.int64())} | columns
        return pa.RecordBatch.from_arrays([of[c.split()[0]] for c in FINGERPRINTS.split(", ")], [c.split()[0] for c in FINGERPRINTS.split(", ")])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            name, marks, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first = firsts((name, *marks.T), doc, start)
            kept, gone = order[first], order[~first]
            for k in range(0, len(kept), 100_000):
                some = kept[k : k + 100_000]
                lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * width, pa.array(marks[some].ravel()))
                yield batch_of(SUFFIX, len(some), name=pa.array(name[some]), marks=lists, doc=pa.array(doc[some]), start=pa.array(start[some]))
            if len(gone):
                mark, doc, start = runs(marks[gone], doc[gone], start[gone])
                found = joined(doc, start, lines_of(mark))
                yield batch_of(REPEAT, len(found), **{c: found.column(c) for c in ("mark", "doc", "start")})

        for batch in chunks(batches, 1):
            lines, at, begun = words(batch.column(1), IN_LINE, fold=False)
            if not len(lines):
                continue
            doc, row = np.asarray(batch.column(0)), np.searchsorted(at, np.arange(len(lines)), "right") - 1
            found = [selected(lines, at, run, gram)]
            if long is not None:
                spoken = np.searchsorted(words(batch.column(1), fold=False)[2], np.append(begun, np.iinfo(np.int64).max))
                for k in range(1, run):
                    whole = grams(lines, k)
                    begin = np.flatnonzero((np.arange(len(whole)) + k <= at[row[: len(whole)] + 1]) & (spoken[k : k + len(whole)] - spoken[: len(whole)] > long))
                    marks = np.zeros((len(begin), width), np.int64)
                    marks[:, 0] = marked(whole[begin], k)
                    found.append((begin, whole[begin].view(np.int64), marks))
            for place, name, marks in found:
                if len(place):
                    held.append((name, marks, doc[row[place]], place - at[row[place]]))
            if sum(len(x[0]) for x in held) > HELD:
                yield from settled()
        if held:
            yield from settled()

    return docs.mapInArrow(select, FINGERPRINTS)


def extended(rows: DataFrame) -> DataFrame:
    """Positions joined by fingerprint, to REPEATs of whole runs, and to WINDOW tuples of flushed groups."""

    def settle(group: pa.Table, flushed: bool) -> Iterator[pa.RecordBatch]:
        lists, doc, start = group.column("marks").combine_chunks(), group.column("doc").to_numpy(), group.column("start").to_numpy()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        mark, doc, start = runs(np.asarray(lists.flatten()).reshape(len(doc), -1), doc, start)
        order, first = firsts((mark,), doc, start)
        gone, kept = order[~first], order[first]
        if len(gone):
            yield joined(doc[gone], start[gone], lines_of(mark[gone]))
        if flushed:
            yield tuples(WINDOW, mark[kept], None, doc[kept], start[kept])

    return by_name(rows, ["doc", "start"], settle, ["name", "marks", "doc", "start"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, gram: int = GRAM, texts: bool = False, words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, n_runs, kept_sha256 (and the kept text if ``texts``)."""
    rows = ordered(id_and_text(docs, id_col, text_col))
    first = staged(fingerprints(rows.select("doc", "text"), run, gram, words), "fingerprints")
    second = staged(extended(first.where(F.col("kind") == SUFFIX)), "runs")
    gone = [x.where(F.col("kind") == REPEAT).select("doc", "start", "mark") for x in (first, second)]
    found, large = gone[0].union(gone[1]), second.where(F.col("kind") == WINDOW)
    if not large.isEmpty():
        found = found.union(windows(large, lines_of).select("doc", "start", "mark"))
    found = found.groupBy("doc").agg(F.collect_list(F.struct("start", "mark")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            out = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = [x for x in text.split("\n") if x]
                drop: set[int] = set()
                for g in gone or ():
                    drop.update(range(g["start"], g["start"] + g["mark"]))
                kept = "\n".join(x for k, x in enumerate(lines) if k not in drop)
                runs = sum(k - 1 not in drop for k in drop)
                out.append((len(lines), len(drop), runs, hashlib.sha256(kept.encode()).hexdigest(), kept if texts else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256", "kept"])

    done = rows.join(found, "doc", "left").select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string, kept string")
    return done if texts else done.drop("kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op4_line_dedup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4_line_dedup, and runs of one and two lines go too if they have more than ``LONG`` words."""
    return line_dedup(table(spark, sf_dir, "documents"), words=LONG)


ORACLE = """
WITH lines AS (
    SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')) AS line,
           generate_subscripts(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), 1) AS k
    FROM documents),
runs AS (
    SELECT doc_id, k, line, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
later AS (
    SELECT *, CASE WHEN third IS NOT NULL AND row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, k) > 1
                   THEN 1 ELSE 0 END AS again
    FROM runs),
marked AS (
    SELECT doc_id, k, line, max(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone
    FROM later),
edges AS (
    SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), 0) = 0 THEN 1 ELSE 0 END AS begins
    FROM marked)
SELECT d.doc_id, count(e.k) AS n_lines, coalesce(sum(gone), 0)::BIGINT AS n_removed, coalesce(sum(begins), 0)::BIGINT AS n_runs,
       sha256(coalesce(string_agg(CASE WHEN gone = 0 THEN line END, chr(10) ORDER BY k), '')) AS kept_sha256
FROM documents d LEFT JOIN edges e ON d.doc_id = e.doc_id GROUP BY d.doc_id
"""
