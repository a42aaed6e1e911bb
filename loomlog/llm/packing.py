"""Packing of token ids into sequences by non-negative least squares over length combinations.

Every document becomes its token ids plus an end id. It is cut into full windows and one rest piece, so a piece and
its checksum follow from its document alone and texts are tokenised once. Piece lengths are counted in bins (a fixed
number of them). On the driver, shallow combinations of bins that fill a window exactly are enumerated and their
repeat counts are solved against the histogram by NNLS, rounded down to what is there, and the rest is filled greedily,
largest first. The plan has a size that depends on the number of bins only. Pieces then find their slot by their rank
within their bin; ranks come from per-(run, bin) counts, so a bin that holds most rows is still dealt over many tasks.

Cases: null and empty texts have the end id alone; repeated rows are packed as rows of their own; null identifiers are
carried along; an empty table gives no rows; other columns are ignored. A text that holds a special token's string is
encoded as the tokenizer does it by default.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, shuffle_partitions, staged, table

WINDOW = 2048
END_ID = 1
BINS = 256
CACHED = 300_000  # chunks whose ids a worker remembers
CACHED_CHARS = 48
MARKS = ".,;:!?\"'%&$*#|-)"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Token ids as little-endian uint32 bytes. Texts are split before single spaces that a visible character follows:
    the byte-level pattern always starts a new pre-token there, so ids of the parts, joined, are the ids of the text."""

    def __init__(self, path: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.full = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.full.get_added_tokens_decoder().values()) or r"(?!)")
        self.odd = re.compile(r" (?:\s|\Z)")
        outer = self

        class Cache(dict):
            def __missing__(self, chunk: str) -> bytes:
                # Letters and final marks: the letters' ids, then the marks', as letters always end a pre-token.
                word = chunk.rstrip(MARKS)
                if word != chunk and word[-1:].isalpha():
                    ids = self[word] + outer.marks[chunk[len(word) :]]
                else:
                    ids = array("I", outer.ordinary(" " + chunk)).tobytes()
                if len(chunk) <= CACHED_CHARS:
                    if len(self) >= CACHED:
                        self.clear()
                    self[chunk] = ids
                return ids

        class Marks(dict):
            def __missing__(self, marks: str) -> bytes:
                ids = array("I", outer.ordinary(marks)).tobytes()
                if len(self) < CACHED_CHARS and len(marks) < CACHED_CHARS:
                    self[marks] = ids
                return ids

        self.marks = Marks()

        self.cache = Cache()

    def __call__(self, text: str) -> bytes:
        if self.special.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.odd.search(text):
            return array("I", self.ordinary(text)).tobytes()
        head, *rest = text.split(" ")
        return array("I", self.ordinary(head)).tobytes() + b"".join(map(self.cache.__getitem__, rest))


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to the pieces of each document."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    for column, x in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(cut, PIECES)


def combinations(bins: int = BINS) -> list[tuple[int, ...]]:
    """Shallow combinations of bins that fill a window: one to three different lengths, the first perhaps repeated."""
    found = {(bins,)}
    for a in range(1, bins):
        for times in range(1, bins // a + 1):
            rest = bins - a * times
            if rest == 0:
                found.add((a,) * times)
                continue
            found.add(tuple(sorted((a,) * times + (rest,), reverse=True)))
            if times <= 3:
                for b in range(max(1, rest // 8), rest // 2 + 1, 2 if times > 1 else 1):
                    found.add(tuple(sorted((a,) * times + (b, rest - b), reverse=True)))
    return sorted(found, reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300, enough: float = 2e-3) -> np.ndarray:
    """Least squares with x >= 0 by an active set, until what is left is ``enough`` of b or no column gains."""
    x, active, at_b = np.zeros(a.shape[1]), [], a.T @ b
    for _ in range(rounds):
        left = b - a[:, active] @ x[active]
        gain = a.T @ left
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 0 or np.abs(left).sum() <= enough * np.abs(b).sum():
            break
        active.append(best)
        while active:
            own = a[:, active]
            z = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(active)), at_b[active])
            falling = z <= 0
            if not falling.any():
                x[active] = z
                break
            old = x[active]
            moved = np.maximum(old + np.min(old[falling] / (old[falling] - z[falling])) * (z - old), 0)
            moved[falling & (moved <= moved[falling].min())] = 0
            x[active] = moved
            active = [c for c in active if x[c] > 0]
    return x


def plan(histogram: np.ndarray, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """histogram[k]: pieces of bin k (1 to bins). (combination, repeats) that use each piece exactly once."""
    left = histogram.astype(np.int64).copy()
    made = []
    if left[bins]:
        made.append(((bins,), int(left[bins])))
        left[bins] = 0
    if left.any():
        shapes = [c for c in combinations(bins) if c[0] < bins and all(left[k] for k in set(c))]
        if shapes:
            matrix = np.zeros((bins + 1, len(shapes)))
            for j, c in enumerate(shapes):
                np.add.at(matrix[:, j], list(c), 1)
            scale = float(left.sum())
            solved = nnls(matrix, left / scale) * scale
            for j in np.argsort(-solved):
                need = matrix[:, j].astype(np.int64)
                used = need > 0
                times = min(int(solved[j]), int((left[used] // need[used]).min()))
                if times > 0:
                    made.append((shapes[j], times))
                    left -= times * need
    while left.any():
        room, shape, rest = bins, [], left.copy()
        for k in range(bins, 0, -1):
            n = int(min(rest[k], room // k))
            shape += [k] * n
            room -= n * k
        need = np.bincount(shape, minlength=bins + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        made.append((tuple(shape), times))
        left -= times * need
    return made


def slots(made: list[tuple[tuple[int, ...], int]], bins: int = BINS) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bin: first rank, first sequence and place of each of its stretches of slots."""
    stretches: dict[int, list[tuple[int, int, int]]] = {}
    taken, first = np.zeros(bins + 1, np.int64), 0
    for shape, times in made:
        for place, k in enumerate(shape):
            stretches.setdefault(k, []).append((int(taken[k]), first, place))
            taken[k] += times
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in stretches.items()}


def pack(cut: DataFrame, window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """Pieces to pieces with sequence_id and offset."""
    spark, width = cut.sparkSession, -(-window // bins)
    runs = 4 * shuffle_partitions(spark)
    cut = cut.withColumns({"bin": F.ceil(F.col("length") / width).cast("int"), "run": F.pmod(F.xxhash64("doc_id", "start"), F.lit(runs))})
    counts = staged(cut.groupBy("bin", "run").count(), "bins")
    histogram = np.zeros(bins + 1, np.int64)
    for k, n in counts.groupBy("bin").agg(F.sum("count")).collect():
        histogram[k] = n
    at = slots(plan(histogram, bins), bins)
    before = counts.select("bin", "run", (F.sum("count").over(Window.partitionBy("bin").orderBy("run")) - F.col("count")).alias("before"))
    order = Window.partitionBy("bin", "run").orderBy("doc_id", "start", "length", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(order)).join(before, ["bin", "run"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_, rank = (np.asarray(batch.column(c)) for c in (5, 6))
            sequence, spot = np.zeros(len(bin_), np.int64), np.zeros(len(bin_), np.int64)
            for k in np.unique(bin_):
                mine, (starts, firsts, places) = bin_ == k, at[int(k)]
                j = np.searchsorted(starts, rank[mine], "right") - 1
                sequence[mine], spot[mine] = firsts[j] + rank[mine] - starts[j], places[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(spot)], [*columns, "sequence_id", "place"])

    placed = ranked.select(*columns, "bin", "rank").mapInArrow(place, PIECES + ", sequence_id long, place long")
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(staged(pieces(id_and_text(docs, id_col, text_col), path, window, end_id), "pieces"), window)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
