"""Removal of repeated byte strings by external induced sorting of sampled suffixes.

Sorting all suffixes of a corpus needs many times its size on disk, so the reduced problem of induced sorting is a locally
consistent *sample* of suffixes, as the leftmost-type suffixes are: the place of the least ``GRAM``-byte hash in each window
of ``length`` bytes. Equal windows hold their sampled suffix at the same offset, and each window belongs to exactly one
sampled suffix. Suffix tuples (name, place and what is known of the suffix) go through a recursion of external sorts, each
carrying on only what the one above left ambiguous; a sort is Spark's external sorter, sorted runs on disk that are merged
through a priority queue, and its output is read as a stream:

1. tuples are sorted by name (the first ``GRAM`` bytes), context (the bytes of all windows of the suffix), document and
   place. A name that occurs once induces that all its windows are unique; within a name, the first suffix of each context
   stays and later ones are repeats as a whole. Names with several contexts are ambiguous;
2. ambiguous suffixes are sorted by the bytes that follow, and the stream carries the common-prefix value of neighbours. The
   order of all windows is induced from it: windows at the same offset d before their sampled suffix are equal if no
   common-prefix value between them is under length - d and the d bytes to the left agree;
3. windows of names with very many suffixes (more than ``GROUP`` in a task, or ``BUSY`` contexts: the ``BUSY_NAMES`` largest
   such names) get names of their own and are sorted by name, document and place.

Map tasks settle ``HELD`` tuples at a time, so a passage in a third of all documents sends one tuple for some 20 MB of text;
texts beyond a chunk are read in overlapping parts. Streams carry one row (or one group of bounded size) from batch to batch,
so memory is bounded and no size limit changes a result. Ambiguous names are broadcast only up to ``BROADCAST_NAMES``; beyond,
they are joined by document. Names are 64-bit hashes, contexts 40 bits more.

A byte goes if a ``length``-byte string that covers it also starts earlier (smaller identifier, or earlier in the same
text), judged on the input. Cases: null and empty texts have no bytes; texts shorter than ``length`` stay; rows without
identifier come last, rows with the same identifier are ordered by their text's digest, and of identical rows one is
the earlier; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.arrays import CHUNK_BYTES, chunks, flat, mix
from loomlog.llm.common import freed, id_and_text, shuffle_partitions, staged, table
from loomlog.llm.shingles import _constants, powers

LENGTH = 100
GRAM = 16
BROADCAST_NAMES = 4_000_000
BUSY, BUSY_NAMES = 50_000, 20_000  # contexts of a name above which it is dealt out by window; most such names, by contexts
HELD = 500_000  # tuples that a map task settles at once
GROUP = 50_000  # tuples of one name that a task holds at once
TUPLES = "kind int, name long, mark long, doc long, start long, bytes binary"
NAMES = ["kind", "name", "mark", "doc", "start", "bytes"]
REPEAT, SUFFIX, CONTEXT, WINDOW = range(4)


def tuples(kind: int, name=None, mark=None, doc=None, start=None, bytes_=None) -> pa.RecordBatch:
    """Rows of the common schema. REPEAT: mark is the number of bytes that go from start on."""
    n = len(doc)
    long = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), long(name), long(mark), long(doc), long(start), pa.nulls(n, pa.binary()) if bytes_ is None else bytes_], NAMES)


def parts(batches: Iterator[pa.RecordBatch], length: int, most: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(doc, bytes, where rows begin, place of the first byte in its text, batch) of chunks; a text beyond a chunk comes in
    parts that overlap, so that each window is in exactly one."""
    for batch in chunks(batches, 1, most):
        doc, (data, at) = np.asarray(batch.column(0)), flat(batch.column(1))
        if len(batch) == 1 and len(data) > most:
            for a in range(0, len(data), most):
                own = data[a : a + most + length - 1]
                yield doc, own, np.array([0, len(own)]), a, batch
        else:
            yield doc, data, at, 0, batch


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of hashed bytes times powers; sums[b] - sums[a], scaled down by the power of a, is a hash of the bytes a to b."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_constants()[0][data] * powers(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def sampled(data: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """The sampled suffixes of a chunk of texts, in order of place: row, name, p (place), first and last window start, context."""
    n, span = len(data), length - GRAM + 1
    if n < length:
        return None
    down, sums = powers(n + 1)[1], prefix_sums(data)
    name = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = (name & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    inside = np.zeros(n + 1, np.int64)
    long = np.diff(at) >= length
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(windows):
        return None
    place = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    ends = np.append(begins[1:], len(windows)) - 1
    low, high, p = windows[begins], windows[ends], place[begins]
    shape = ((p - low) << 8 | (high - low)).astype(np.uint64)
    context = mix((sums[high + length] - sums[low]) * down[low] + shape * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    row = np.searchsorted(at, low, "right") - 1
    return {"row": row, "name": name[p].view(np.int64), "p": p, "low": low, "high": high, "context": context.astype(np.int64)}


def joined(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """REPEAT rows, with touching stretches of a document made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    if len(doc):
        top = end.copy()
        fresh = np.ones(len(doc), bool)
        # Ends within a document, as a running maximum with each document lifted above the ones before.
        lift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64) * (int(end.max()) + 1)
        top = np.maximum.accumulate(end + lift) - lift
        fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > top[:-1])
        at = np.flatnonzero(fresh)
        last = np.append(at[1:], len(doc)) - 1
        doc, start, end = doc[at], start[at], top[last]
    return tuples(REPEAT, mark=end - start, doc=doc, start=start)


def firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, then document and start, and which rows in it are the first of their keys."""
    order = np.lexsort((start, doc, *reversed(keys)))
    first = np.zeros(len(order), bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[order][1:] != k[order][:-1]
    return order, first


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """Level 1, map side: (doc, text) to SUFFIX tuples (mark: context, high - low; start: low) and REPEATs of what was held."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            name, mark, doc, start = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            order, first = firsts((name, mark), doc, start)
            kept, gone = order[first], order[~first]
            for k in range(0, len(kept), 100_000):
                yield tuples(SUFFIX, *(x[kept[k : k + 100_000]] for x in (name, mark, doc, start)))
            if len(gone):
                yield joined(doc[gone], start[gone], (mark[gone] & 0xFF) + length)

        for doc, data, at, shift, _ in parts(batches, length):
            if (s := sampled(data, at, length)) is not None:
                held.append((s["name"], s["context"] << 8 | (s["high"] - s["low"]), doc[s["row"]], s["low"] - at[s["row"]] + shift))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from settled()
        if held:
            yield from settled()

    return docs.mapInArrow(sample, TUPLES)


def in_order(rows: DataFrame, order: list, read, held: list[str]) -> DataFrame:
    """An external sort by ``order`` within names dealt over tasks; ``read`` gets the sorted stream."""
    return rows.select(*held).repartition(shuffle_partitions(rows.sparkSession), "name").sortWithinPartitions("name", *order).mapInArrow(read, TUPLES)


def by_name(rows: DataFrame, order: list, settle, held: list[str]) -> DataFrame:
    """``settle`` gets whole groups of names in order, or a flushed part of a very large one."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []
        parted = None  # the name of the group that was flushed last

        def settled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            rest = int(np.searchsorted(whole.column(0).to_numpy(), parted, "right")) if parted is not None and whole.column(0)[0].as_py() == parted else 0
            if rest:
                yield from settle(whole.slice(0, rest), True)
            if rest < len(whole):
                yield from settle(whole.slice(rest).combine_chunks(), False)

        for batch in batches:
            if not len(batch):
                continue
            name = np.asarray(batch.column(0))
            last = int(np.searchsorted(name, name[-1]))  # where the last group, perhaps unfinished, begins
            if last or (carried and carried[0].column(0)[0].as_py() != name[0]):
                yield from settled([*carried, batch.slice(0, last)] if last else carried)
                carried = []
            carried.append(batch.slice(last))
            if sum(map(len, carried)) > GROUP:
                yield from settle(pa.Table.from_batches(carried).combine_chunks(), True)
                parted = carried[0].column(0)[0].as_py()
                carried = []
        if carried:
            yield from settled(carried)

    return in_order(rows, order, groups, held)


def named(rows: DataFrame, length: int) -> DataFrame:
    """Level 1, reduce side: SUFFIX tuples to REPEATs, and to SUFFIX tuples of ambiguous names."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, several, pending = (None, None), None, None  # last row's name and mark; a name known to be ambiguous; a name's only context so far
        for batch in batches:
            if not len(batch):
                continue
            name, mark, doc, start = own = [np.asarray(batch.column(c)) for c in range(4)]
            fresh = np.ones(len(name), bool)
            fresh[1:] = (name[1:] != name[:-1]) | (mark[1:] != mark[:-1])
            fresh[0] = (name[0], mark[0]) != last
            last = name[-1], mark[-1]
            if not fresh.all():
                yield joined(doc[~fresh], start[~fresh], (mark[~fresh] & 0xFF) + length)
            seen = [x[fresh] for x in own]
            if pending is not None:
                seen = [np.concatenate([[p], x]) for p, x in zip(pending, seen, strict=True)]
            if not len(seen[0]):
                continue
            edges = np.flatnonzero(np.concatenate([[True], seen[0][1:] != seen[0][:-1], [True]]))
            size = np.diff(edges)
            sent = np.repeat(size, size) > 1
            if several is not None:
                sent |= seen[0] == several
            yield tuples(SUFFIX, *(x[sent] for x in seen))
            several, pending = (seen[0][-1], None) if sent[-1] else (None, [x[-1] for x in seen])

    return in_order(rows, ["mark", "doc", "start"], judge, ["name", "mark", "doc", "start"])


def contexts(docs: DataFrame, wanted, busy: np.ndarray, length: int) -> DataFrame:
    """Level 2, map side: CONTEXT tuples (start: first window; mark: number of windows, and place of the sampled suffix;
    bytes: those of all windows) of the names wanted, but for busy ones."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value if wanted is not None else None
        for doc, data, at, shift, batch in parts(batches, length):
            if (s := sampled(data, at, length)) is None:
                continue
            if known is not None:
                half = (s["name"] >> 32).astype(np.int32)
                j = np.minimum(np.searchsorted(known, half), max(len(known) - 1, 0))
                asked = known[j] == half if len(known) else np.zeros(len(half), bool)
            else:  # the names of each document came with it
                lists = batch.column(2)
                own = np.asarray(lists.flatten())
                row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
                pairs = set(zip(row.tolist(), own.tolist(), strict=True))
                asked = np.fromiter(((r, x) in pairs for r, x in zip(s["row"].tolist(), s["name"].tolist(), strict=True)), bool, len(s["row"]))
            asked &= ~np.isin(s["name"], busy)
            s = {k: v[asked] for k, v in s.items()}
            own, start = doc[s["row"]], s["low"] - at[s["row"]] + shift
            order, first = firsts((s["name"], s["context"]), own, start)
            kept = order[first]
            low, high, p, raw = s["low"][kept], s["high"][kept], s["p"][kept], data.tobytes()
            cut = pa.array([raw[a : b + length] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
            yield tuples(CONTEXT, s["name"][kept], (high - low + 1) << 8 | (p - low), own[kept], start[kept], cut)

    return docs.mapInArrow(collect, TUPLES)


def busy_windows(docs: DataFrame, busy: np.ndarray, length: int) -> DataFrame:
    """Level 2, map side, for names with very many contexts: WINDOW tuples of their suffixes and REPEATs of the chunk, so
    the work on such a name is dealt out by window and not by name."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, at, shift, _ in parts(batches, length):
            if (s := sampled(data, at, length)) is None or not (asked := np.isin(s["name"], busy)).any():
                continue
            down, sums = powers(len(data) + 1)[1], prefix_sums(data)
            low, number, row = s["low"][asked], (s["high"] - s["low"] + 1)[asked], s["row"][asked]
            begin = np.repeat(low - np.cumsum(number) + number, number) + np.arange(number.sum())
            window = mix((sums[begin + length] - sums[begin]) * down[begin]).view(np.int64)
            row = np.repeat(row, number)
            own, start = doc[row], begin - at[row] + shift
            order, first = firsts((window,), own, start)
            gone, kept = order[~first], order[first]
            yield tuples(WINDOW, window[kept], None, own[kept], start[kept])
            if len(gone):
                yield joined(own[gone], start[gone], np.full(len(gone), length))

    return docs.mapInArrow(spread, TUPLES)


def halves(unclear: DataFrame) -> np.ndarray:
    """The upper halves of the names, sorted: a few more suffixes are sent, half as much is broadcast. Tasks' results stay
    small enough to come without the block manager's buffers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.asarray(b.column(0)) for b in batches]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(np.concatenate(own)).tobytes()], pa.binary())], ["part"])

    half = unclear.select(F.shiftright("name", 32).cast("int").alias("half")).distinct()
    parts = half.repartition(64, "half").mapInArrow(pack, "part binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["part"], np.int32) for r in parts)]))


def common_prefixes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Of each stretch of bytes and the one before it the length of the common prefix, up to ``most``; 0 for the first."""
    out = np.zeros(len(begin), np.int64)
    for a in range(0, len(begin), 2_000):
        rows = np.arange(max(a - 1, 0), min(a + 2_000, len(begin)))
        place = np.minimum(begin[rows, None] + np.arange(most), len(data) - 1)
        grid = np.where(np.arange(most) < size[rows, None], data[place].astype(np.int16), -1)
        same = (grid[1:] == grid[:-1]) & (grid[1:] >= 0)
        out[rows[1:]] = np.where(same.all(1), most, same.argmin(1))
    return out


def induced(rows: DataFrame, length: int) -> DataFrame:
    """Level 2, reduce side: CONTEXT tuples to REPEATs, and to WINDOW tuples of flushed groups."""

    def settle(group: pa.Table, flushed: bool) -> Iterator[pa.RecordBatch]:
        name_, at_most = group.column("name").to_numpy(), 10_000
        cuts = [0]
        while cuts[-1] < len(name_):  # parts of whole names
            at = min(cuts[-1] + at_most, len(name_)) - 1
            cuts.append(int(np.searchsorted(name_, name_[at], "right")))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = group.slice(a, b - a).combine_chunks()
            name, mark, doc, start = (part.column(c).to_numpy() for c in ("name", "mark", "doc", "start"))
            number, place = mark >> 8, mark & 0xFF
            raw = part.column("bytes").combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            data, at = flat(raw.cast(pa.large_binary()).view(pa.large_string()))
            suffix = at[:-1] + place
            prefix = common_prefixes(data, suffix, at[1:] - suffix, length)
            prefix[1:][name[1:] != name[:-1]] = -1
            prefix[:1] = -1
            down, sums = powers(len(data) + 1)[1], prefix_sums(data)
            gone: list[tuple[np.ndarray, np.ndarray]] = []
            for d in range(int((place - number).min()) + 1, int(place.max()) + 1):  # windows that begin d bytes before their suffix
                mine = np.flatnonzero((place >= d) & (place - number < d))
                begin, own, from_ = suffix[mine] - d, doc[mine], start[mine] + place[mine] - d
                if flushed:
                    window = mix((sums[begin + length] - sums[begin]) * down[begin]).view(np.int64)
                    order, first = firsts((window,), own, from_)
                    kept = order[first]
                    yield tuples(WINDOW, window[kept], None, own[kept], from_[kept])
                else:  # equal: one run of suffixes that agree on length - d bytes, and the same bytes to the left
                    run = np.maximum.accumulate(np.where(prefix < length - d, np.arange(len(prefix)), 0))[mine]
                    left = ((sums[begin + d] - sums[begin]) * down[begin]).view(np.int64)
                    again = np.bincount(run, minlength=len(prefix))[run] > 1
                    own, from_, run, left = own[again], from_[again], run[again], left[again]
                    order, first = firsts((run, left), own, from_)
                gone.append((own[order[~first]], from_[order[~first]]))
            doc, start = (np.concatenate(x) for x in zip(*gone, strict=True))
            if len(doc):
                yield joined(doc, start, np.full(len(doc), length))

    follows = F.expr("substring(bytes, cast((mark & 255) + 1 as int))")
    return by_name(rows, [follows], settle, ["name", "mark", "doc", "start", "bytes"])


def windows(rows: DataFrame, length) -> DataFrame:
    """Level 3: WINDOW tuples to REPEATs of ``length``, a number or a function of the names; all but the first of each name."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            name, doc, start = (np.asarray(batch.column(c)) for c in range(3))
            again = np.zeros(len(name), bool)
            again[1:] = name[1:] == name[:-1]
            again[0] = last is not None and name[0] == last
            last = name[-1]
            if again.any():
                yield joined(doc[again], start[again], length(name[again]) if callable(length) else np.full(int(again.sum()), length))

    return in_order(rows, ["doc", "start"], judge, ["name", "doc", "start"])


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """(doc, text) with unique doc to (doc, start, mark): stretches to remove, perhaps overlapping."""
    spark = docs.sparkSession
    first = staged(suffixes(docs, length), "suffixes")
    second = staged(named(first.where(F.col("kind") == SUFFIX), length), "names")
    found = [x.where(F.col("kind") == REPEAT).select("doc", "start", "mark") for x in (first, second)]
    unclear = second.where(F.col("kind") == SUFFIX)
    counts = staged(unclear.groupBy("name").count(), "counts")
    most = counts.where(F.col("count") > BUSY).orderBy(F.col("count").desc(), "name").limit(BUSY_NAMES).collect()
    busy = np.array(sorted(r["name"] for r in most), np.int64)
    if counts.count() <= BROADCAST_NAMES:
        sent = contexts(docs, spark.sparkContext.broadcast(halves(counts)), busy, length)
    else:
        asked = unclear.groupBy("doc").agg(F.collect_set("name").alias("names"))
        sent = contexts(docs.join(asked, "doc").select("doc", "text", "names"), None, busy, length)
    third = staged(induced(sent, length), "induced")
    found.append(third.where(F.col("kind") == REPEAT).select("doc", "start", "mark"))
    large = third.where(F.col("kind") == WINDOW)
    if len(busy):
        dealt = staged(busy_windows(docs, busy, length), "busy")
        found.append(dealt.where(F.col("kind") == REPEAT).select("doc", "start", "mark"))
        large = large.union(dealt.where(F.col("kind") == WINDOW))
    if not large.isEmpty():
        found.append(windows(large, length).where(F.col("kind") == REPEAT).select("doc", "start", "mark"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def ordered(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with doc: the identifier where it is unique, else a number in order of identifier and digest."""
    doubled = rows.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if doubled.isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    sorted_ = rows.withColumn("digest", F.sha2("text", 256)).orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    return staged(sorted_.select("doc_id", "text", F.monotonically_increasing_id().alias("doc")), "ordered")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes if ``texts``)."""
    rows = ordered(id_and_text(docs, id_col, text_col))
    found = repeats(rows.select("doc", "text"), length).groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("mark").alias("sizes"))
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            data, at = flat(batch.column(1))
            out = []
            for k in range(len(batch)):
                own = data[at[k] : at[k + 1]]
                mask = np.zeros(len(own) + 1, np.int32)
                for a, n in zip(batch.column(2)[k].as_py() or (), batch.column(3)[k].as_py() or (), strict=True):
                    mask[a] += 1
                    mask[a + n] -= 1
                gone = np.cumsum(mask[:-1]) > 0
                kept = own[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(own), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, kinds[1:], strict=True))], [x for x, _ in kinds])

    done = rows.join(found, "doc", "left").select("doc_id", "text", "starts", "sizes").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if texts else done.drop("kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


ORACLE = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (
    SELECT doc_id, o, substr(h, 2 * o + 1, 2198) AS b FROM texts, unnest(range(0, length(h) // 2 - 99, 1000)) AS u(o)),
windows AS (
    SELECT doc_id, o + s AS s, hash(substr(b, 2 * s + 1, 200)) AS name
    FROM blocks, unnest(range(least(1000, length(b) // 2 - 99))) AS u(s)),
again AS (
    SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, s) > 1),
islands AS (
    SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k
    FROM (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM islands GROUP BY doc_id, k),
gaps AS (
    SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
    UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (coalesce(b, length(h) / 2) - a))::BIGINT), '' ORDER BY a) AS h
    FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, (length(t.h) / 2)::BIGINT AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(s.a) AS n_spans,
       sha256(unhex(coalesce(any_value(k.h), t.h))) AS kept_sha256
FROM texts t LEFT JOIN spans s ON t.doc_id = s.doc_id LEFT JOIN kept k ON t.doc_id = k.doc_id GROUP BY t.doc_id, t.h
"""
