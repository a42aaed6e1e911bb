"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are words (runs of letters and digits in lower case). A document holds an item if some stretch of its words
is within ``ALLOWED`` percent of the item's words in edit distance. Every place of a text begins a window of each item size
in use (items of up to 4 words: their own size; longer ones: the largest of ``SIZES`` for them, at each of their
places). Windows go through ``WALKS`` CGK random walks, which turn edit distance into Hamming distance: at each step the
symbol under the pointer is written, and a random bit of the symbol and the step says whether the pointer moves. ``SAMPLES``
samples of some places of each embedding (``SIZES``) are bucket keys; an item window with an equal key makes the document's
window a candidate. Samples of an item that saw fewer different words than the least are not indexed, as they say next to
nothing. There is no other search. The numbers are set for a recall of ``RECALL`` at the allowed distance (tests hold
it against brute force for items of 1 to 40 words at 10, 20 and 30 percent; equal windows always meet). Candidates are
checked exactly: first whether enough of the item's words are near, which every stretch within the distance has, then by
the least edit distance between the item and any stretch there. Edits are of words: an item whose words are misspelled one
in four is beyond 20 percent.

All is decided within a document's row, so there is no exchange. Items are broadcast in blocks of ``BLOCK_BYTES`` at
most; more items are more passes. Cases: null and empty texts hold nothing; items without a word match nothing; null
identifiers are carried along; repeated rows are told each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.arrays import chunks, mix
from loomlog.llm.common import lean, table, text_of
from loomlog.llm.shingles import ALPHANUMERIC, words

ALLOWED = 20  # percent of an item's words
SIZES = {5: (5, 3, 2), 12: (8, 4, 3)}  # items of so many words on: words of a window, places of a sample, different words at least
WALKS, SAMPLES = 8, 2
REACH = 1.5  # steps of a walk by words of the window
BITMAP = 18  # bits of a key that its bitmap tells
PLACES = 1 << 14  # windows that are embedded at once
RECALL = 0.99
BLOCK_BYTES = 32 << 20
FOUND = "doc_id long, item_id long, edits long, item_words long, first_word long, last_word long"


def kind_of(n: int) -> tuple[int, int, int]:
    """For an item of n words the words of a window, places of a sample, different words at least."""
    return max((k, v) for k, v in SIZES.items() if k <= n)[1] if n >= min(SIZES) else (n, n, 1)


def walks(words_: np.ndarray, kinds: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(size, number of the key, keys of the windows that begin at each word, pointers at the sample's places), for each walk,
    kind and sample."""
    longest = int(REACH * max(m for m, _, _ in kinds)) + 1
    wide = np.concatenate([words_, np.zeros(longest, np.uint64)])
    seeds = np.random.default_rng(2016).integers(1, 2**64, WALKS, np.uint64, endpoint=False)
    chosen = {}
    for m, symbols, _ in kinds:  # a sample's places are spread over the walk
        u = np.random.default_rng(2017 + m).random((WALKS, SAMPLES, symbols))
        chosen[m] = ((np.arange(symbols) + u) * max(1, int(REACH * m)) / symbols).astype(np.int64)
    for walk, seed in enumerate(seeds):
        moves, at = mix(wide ^ seed), np.arange(len(words_))
        written, wanted = {}, {int(t) for places in chosen.values() for t in places[walk].ravel()}
        for step in range(max(wanted) + 1):
            if step in wanted:
                written[step] = wide.take(at), at.copy()
            at += ((moves >> np.uint64(step)) & np.uint64(1)).view(np.int64).take(at)
        for m, places in chosen.items():
            for sample in range(SAMPLES):
                h = np.full(len(words_), walk * SAMPLES + sample + 1, np.uint64)
                for t in places[walk, sample].tolist():
                    h *= np.uint64(0x100000001B3)
                    h += written[t][0]
                    h ^= h >> np.uint64(29)
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                yield m, walk * SAMPLES + sample, h, [written[t][1] for t in places[walk, sample].tolist()]


def least_edits(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, first, end) of the stretch of text nearest to the item, the earliest of the shortest such; None beyond most."""
    one = 1 << 30  # of an edit; less the place at which the stretch begins, so later beginnings win
    place = np.arange(len(text) + 1, dtype=np.int64)
    cost = -place
    for i, word in enumerate(item, 1):
        row = cost + one
        np.minimum(row[1:], cost[:-1] + one * (text != word), out=row[1:])
        row[0] = i * one
        cost = np.minimum.accumulate(row - one * place) + one * place
    end = int(cost.argmin())
    edits = -(-int(cost[end]) // one)
    return (edits, edits * one - int(cost[end]), end) if edits <= most else None


@dataclass
class Items:
    """Benchmark items ready for search; small, sent to every task."""

    ids: list
    words: list[np.ndarray]
    allowed: int
    buckets: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # keys, items, places in them, bitmap

    def __post_init__(self) -> None:
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.distance = self.lengths * self.allowed // 100
        self.kinds = sorted({kind_of(n) for n in self.lengths.tolist()})
        self.marks = np.random.default_rng(2018).integers(1, 2**64, max(len(self.words), 1), np.uint64, endpoint=False)
        own = [np.unique(mix(w ^ m)) for w, m in zip(self.words, self.marks, strict=False)]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        found: dict[tuple[int, int], list] = {}
        for k, w in enumerate(self.words):
            m, _, least = kind_of(len(w))
            places = np.arange(len(w) - m + 1)
            every = [(c, keys[places], sum(((x != y)[places] for x, y in zip(at[:-1], at[1:], strict=True)), np.ones(len(places), int))) for _, c, keys, at in walks(w, [kind_of(len(w))])]
            if not any((seen >= least).any() for *_, seen in every):
                least = 0
            for c, keys, seen in every:
                some = seen >= least
                found.setdefault((m, c), []).append((keys[some], np.full(int(some.sum()), k), places[some]))
        for family, parts in found.items():
            key, item, place = map(np.concatenate, zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            bitmap = np.zeros(1 << BITMAP, bool)
            bitmap[(key >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
            self.buckets[family] = key[order], item[order], place[order], bitmap

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, word at which it would begin) of the windows that share a key with one of an item."""
        found = [np.zeros(0, np.int64)]
        ahead = int(REACH * max(m for m, _, _ in self.kinds)) + 1
        for a in range(0, len(text), PLACES):
            n = min(PLACES, len(text) - a)
            for m, c, keys, _ in walks(text[a : a + n + ahead], self.kinds):
                known, item, place, bitmap = self.buckets[m, c]
                some = np.flatnonzero(bitmap[(keys[:n] >> np.uint64(64 - BITMAP)).astype(np.int64)])
                some = some[known.take(np.searchsorted(known, keys[some]), mode="clip") == keys[some]]
                if not len(some):
                    continue
                low = np.searchsorted(known, keys[some])
                many = np.searchsorted(known, keys[some], "right") - low
                which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                begins = np.repeat(some, many) + a - place[which]
                found.append(np.unique(item[which] << 40 | begins + (1 << 20)))
        told = np.unique(np.concatenate(found))
        return told >> 40, (told & ((1 << 40) - 1)) - (1 << 20)

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, last word) of the items in a column of texts, the best place of each."""
        text, at, _ = words(pc.utf8_lower(column), ALPHANUMERIC)
        if not len(text) or not self.words:
            return []
        item, begin = self.candidates(text)
        # Begins may lie up to the distance before or behind the text that the window was in.
        row = np.clip(np.searchsorted(at, np.maximum(begin, 0), "right") - 1, 0, len(at) - 2)
        spread = [(item, begin, row)]
        for step in (-1, 1):
            other = row + step
            while len(other):
                inside = (other >= 0) & (other < len(at) - 1)
                other = np.clip(other, 0, len(at) - 2)
                far = (at[other + 1] <= begin - self.distance[item]) if step < 0 else (at[other] >= begin + self.lengths[item] + self.distance[item])
                if not (more := inside & ~far).any():
                    break
                spread.append((item[more], begin[more], other[more]))
                other = np.where(more, other, -1 if step < 0 else len(at)) + step
        item, begin, row = map(np.concatenate, zip(*spread, strict=True))
        near = self.near(text, at, item, begin, row)
        item, begin, row = item[near], begin[near], row[near]
        order = np.lexsort((begin, item, row))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        last = None
        for r, k, start in zip(row[order].tolist(), item[order].tolist(), begin[order].tolist(), strict=True):
            n, d = int(self.lengths[k]), int(self.distance[k])
            if best.get((r, k), (1,))[0] == 0 or last is not None and last[:2] == (r, k) and start <= last[2]:
                continue
            a, b = max(int(at[r]), start - d), min(int(at[r + 1]), start + n + 3 * d)
            last = r, k, start + d  # places up to d behind this one are searched with it
            exact = text[max(start, a) : max(start, a) + n]
            told = (0, start - a, start - a + n) if start >= a and start + n <= b and np.array_equal(exact, self.words[k]) else least_edits(self.words[k], text[a:b], d)
            if told:
                place = (told[0], a + told[1] - int(at[r]), a + told[2] - int(at[r]) - 1)
                best[r, k] = min(best.get((r, k), place), place)
        return sorted((r, k, *place) for (r, k), place in best.items())

    def near(self, text: np.ndarray, at: np.ndarray, item: np.ndarray, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether as many words as any stretch within the distance has are words of the item."""
        out = np.zeros(len(item), bool)
        some = 2_000
        for a in range(0, len(item), some):
            k = item[a : a + some]
            d, n, r = self.distance[k], self.lengths[k], row[a : a + some]
            low, high = np.maximum(begin[a : a + some] - d, at[r]), np.minimum(begin[a : a + some] + n + d, at[r + 1])
            size = np.maximum(high - low, 0)
            of = np.repeat(np.arange(len(k)), size)
            place = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            pair = mix(text[place] ^ self.marks[k[of]])
            there = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
            out[a : a + some] = np.bincount(of, there, len(k)) >= n - d
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, allowed: int) -> Iterator[Items]:
    """The items, in blocks of bounded size."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    number = -(-size // BLOCK_BYTES)
    for block in range(number):
        held = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == block).orderBy("item_id", "text").collect()
        text, at, _ = words(pc.utf8_lower(pa.array([r["text"] for r in held], pa.string())), ALPHANUMERIC)
        some = [(r["item_id"], text[a:b]) for r, a, b in zip(held, at[:-1], at[1:], strict=True) if b > a]
        yield Items([i for i, _ in some], [w for _, w in some], allowed)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", allowed: int = ALLOWED) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, edits, item_words, first_word, last_word."""
    lean(docs.sparkSession)
    rows, out = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), None
    for block in blocks(items, item_id, item_text, allowed):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, 1):
                found = shared.value.search(batch.column(1))
                own = batch.column(0).take(pa.array([r for r, *_ in found], pa.int64()))
                rest = [[shared.value.ids[k] for _, k, *_ in found], [e for _, _, e, *_ in found], [len(shared.value.words[k]) for _, k, *_ in found], [f for *_, f, _ in found], [e for *_, e in found]]
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int64()) for x in rest)], [x.split()[0] for x in FOUND.split(", ")])

        more = rows.mapInArrow(find, FOUND)
        out = more if out is None else out.union(more)
    return out if out is not None else rows.sparkSession.createDataFrame([], FOUND)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", allowed: int = ALLOWED) -> DataFrame:
    """The rows of ``docs``, all columns kept, that hold no item."""
    place = docs.columns.index(text_col)
    lean(docs.sparkSession)
    for block in blocks(items, item_id, item_text, allowed):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def sift(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = np.ones(len(batch), bool)
                known = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(place).fill_null("")], ["k", "t"])
                for part in chunks(iter([known]), 1):
                    first = part.column(0)[0].as_py()
                    for r, *_ in shared.value.search(part.column(1)):
                        kept[first + r] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(sift, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
