"""Near-duplicates by SetSketch registers.

A document's set of word shingles becomes ``m`` registers: for each register every shingle has an exponential value,
the least is kept, on a truncated logarithmic scale of base ``B``, so registers of parts merge by maximum and equal
registers are about as likely as the sets are similar. Documents with equal sets form a class first (tree merge), and
only its representative goes on. Bands of registers are bucket keys; rows and bands are chosen so that a pair at the
threshold is missed with probability ``MISS`` at most. Pairs are then found without ever listing a bucket's pairs:

1. rounds of leaders: each member outside its bucket's largest component meets a random member of that component, another
   one in each bucket and round; the ``ASKED`` met most often are checked on full sets, and linked components are hooked
   together. There are ``ROUNDS`` at most; what they miss is left to step 2;
2. where a bucket still has several components, the members outside its largest one are queries against its other
   members, in blocks. The joint likelihood of both register vectors and set sizes estimates the similarity. First only
   registers are compared; members with a near partner of another component (in buckets of up to ``SMALL`` members, one
   that no round checked) then meet once more with their sets, pairs with an estimate near the threshold are checked on
   these, and a block returns a spanning forest of its links: at most one link less than it has components.

So every pair that shares a band and whose estimate lies within ``MARGIN`` is either in one component or was compared.
Sets are of 64-bit shingle hashes, so "full sets" are equal up to collisions of these.

Cases: null, empty and blank texts have no set and are linked with nothing; texts of fewer words than a shingle are one
shingle; rows with one identifier are one node, with the least of their texts; rows without identifier stay alone (component null, kept); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.arrays import chunks, mix
from loomlog.llm.common import bucketed, freed, id_and_text, sieved, staged, table
from loomlog.llm.components import components
from loomlog.llm.shingles import sets

B = 1.02
TOP = 2400  # registers are truncated to 0 .. TOP
MISS = 1e-6
MOST_REGISTERS = 128
MARGIN = 0.16
BLOCK, BLOCK_BYTES = 2048, 16 << 20  # members of a block, and bytes of their sets and registers
SMALL = 16  # members of a bucket whose pairs are listed
ROUNDS, ASKED = 2, 3  # rounds of leaders; leaders that a member is checked against in a round
EQUAL_AT_LEAST = 0.5  # equal registers, below which no likelihood is worked out


def bands(percent: int) -> tuple[int, int]:
    """Rows of a band and number of bands for a threshold."""
    for rows in range(8, 1, -1):
        number = int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** rows))))
        if rows * number <= MOST_REGISTERS:
            return rows, number
    return 2, MOST_REGISTERS // 2


def registers(found: list[np.ndarray], m: int) -> np.ndarray:
    """One row of m registers for each non-empty set."""
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 2**64, m, np.uint64, endpoint=False) | np.uint64(1)
    shifts = rng.integers(0, 2**64, m, np.uint64, endpoint=False)
    out = np.zeros((len(found), m), np.uint16)
    sizes = np.array([len(x) for x in found])
    some = np.flatnonzero(sizes)
    first = 0
    while first < len(some):  # some 200,000 shingles at a time stay in the processor's cache
        last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[some[first:]]), 200_000, "right")))
        part = some[first:last]
        flat_, at = np.concatenate([found[k] for k in part]), np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
        for j in range(m):
            least = np.minimum.reduceat(flat_ * factors[j] + shifts[j], at)
            value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
            out[part, j] = np.clip(np.floor(1 + -np.log(np.maximum(value, 1e-300)) / np.log(B)), 0, TOP)
        first = last
    return out


def sketch(docs: DataFrame, k: int, rows: int, number: int) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, digest, registers, keys)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(11).integers(1, 2**64, rows, np.uint64, endpoint=False) | np.uint64(1)
        for batch in chunks(batches, 1, 1 << 20):
            found = sets(batch.column(1), k)
            regs = registers(found, rows * number)
            keys = np.arange(number, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + (regs.reshape(len(found), number, rows).astype(np.uint64) * factors).sum(2, dtype=np.uint64)
            keys = mix(keys).view(np.int64)
            full = [len(x) > 0 for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], pa.binary()),
                    pa.array([r.tobytes() if f else None for r, f in zip(regs, full, strict=True)], pa.binary()),
                    pa.array([x if f else [] for x, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "registers", "keys"],
            )

    return docs.mapInArrow(draw, "doc_id long, n_shingles long, digest binary, registers binary, keys array<long>")


def likeliest(more: np.ndarray, less: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity, 0.5 at least, under which it is likeliest that ``more`` registers of a exceed b's and ``less`` fall short."""
    share = n_a / (n_a + n_b)
    other = 1 - share
    above = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / np.log(B)
    best, at = np.full(len(more), -np.inf), np.zeros(len(more))
    for similarity in np.linspace(0.5, 1, 51):
        possible = similarity <= np.minimum(share / other, other / share) + 1e-9
        p, q = above(share - other * similarity), above(other - share * similarity)
        told = more * np.log(p) + less * np.log(q) + (m - more - less) * np.log(np.maximum(1 - p - q, 1e-12))
        better = possible & (told > best)
        best[better], at[better] = told[better], similarity
    return at


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, hub) to (a, b) of those whose full sets are similar enough; hub is the one of both that may be in very many pairs.

    The other's text comes from the bucketed table as it lies; hubs' texts are shuffled, so that large ones are split at run
    time (texts in buckets can't be)."""
    member, hub = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")), texts.sparkSession.read.schema(texts.schema).parquet(texts._staged_at)
    left = texts.select(F.col("doc_id").alias("member"), F.col("text").alias("text_a"))
    right = hub.select(F.col("doc_id").alias("hub"), F.col("text").alias("text_b"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2, 1 << 20):
            ok = [similar(x, y, percent) for x, y in zip(sets(batch.column(2), k), sets(batch.column(3), k), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.withColumn("member", member).join(left, "member").join(right, "hub")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(hold, "a long, b long")


def near_pairs(group: pa.Table, rows: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, member, estimate) of whole groups (members first in each) whose estimate is near the threshold.

    A pair that shares several bands counts in the first one only.
    """
    key, block, asked, comps, sizes, band, least = (group.column(c).to_numpy() for c in ("key", "block", "asked", "component", "n", "band", "least"))
    query = group.column("query").to_numpy(zero_copy_only=False)
    change = (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (asked[1:] != asked[:-1])
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    of = np.cumsum(np.concatenate([[0], change]))
    members = np.add.reduceat(~query, starts)
    regs = np.stack([np.frombuffer(x, np.uint16) for x in group.column("registers").to_pylist()]).astype(np.int16)
    asking = np.flatnonzero(query & (members[of] > 0))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    ends = np.cumsum(members[of[asking]])
    first = 0
    while first < len(asking):  # some 20,000 pairs at a time
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 20_000, "right")))
        some, n = asking[first:last], members[of[asking[first:last]]]
        x = np.repeat(some, n)
        y = np.repeat(starts[of[some]], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        fit = (comps[x] != comps[y]) & (np.minimum(sizes[x], sizes[y]) >= least[x] * np.maximum(sizes[x], sizes[y]))
        x, y = x[fit], y[fit]
        diff = regs[x] - regs[y]
        equal = diff == 0
        fit = (equal.sum(1) >= EQUAL_AT_LEAST * diff.shape[1]) & (equal.reshape(len(x), number, rows).all(2).argmax(1) == band[x])
        x, y, diff = x[fit], y[fit], diff[fit]
        told = likeliest((diff > 0).sum(1), (diff < 0).sum(1), diff.shape[1], sizes[x].astype(float), sizes[y].astype(float))
        fit = told >= least[x]
        out.append((x[fit], y[fit], told[fit]))
        first = last
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forest(group: pa.Table, x: np.ndarray, y: np.ndarray, told: np.ndarray, percent: int) -> list[int]:
    """Which of the pairs, best estimates first, are similar on full sets and link two components not linked so far."""
    comps, full = group.column("component").to_numpy(), group.column("set")
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    kept, held = [], {}
    for k in np.lexsort((y, x, -told)).tolist():
        a, b = root(int(comps[x[k]])), root(int(comps[y[k]]))
        if a == b:
            continue
        both = []
        for row in (int(x[k]), int(y[k])):
            if row not in held:
                held[row] = np.frombuffer(full[row].as_buffer(), np.uint64)  # a view
            both.append(held[row])
        if similar(*both, percent):
            parent[a] = b
            kept.append(k)
    return kept


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n = len(np.intersect1d(x, y, assume_unique=True))
    return n > 0 and 100 * n >= percent * (len(x) + len(y) - n)


def residual(mixed: DataFrame, rows: int, number: int, percent: int, what: str) -> DataFrame:
    """Rows dealt by (key, block, asked) to ``what``: marks (key, band, id, component, n, a, b) of the members of pairs near
    the threshold, with the pair itself in buckets of up to ``SMALL`` members and null in larger ones; or, where sets came
    along, a spanning forest of links (a, b). Either may repeat."""
    group, most = ["key", "block", "asked"], SMALL
    schema = "key long, band int, id long, component long, n long, a long, b long" if what == "marks" else "a long, b long"

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []

        def settled() -> pa.RecordBatch:
            whole = pa.Table.from_batches(carried).combine_chunks()
            x, y, told = near_pairs(whole, rows, number)
            ids = whole.column("id").to_numpy()
            if what == "marks":
                large = whole.column("all").to_numpy()[x] > most
                both = np.unique(np.concatenate([x[large], y[large]]))
                x, y = x[~large], y[~large]
                at = np.concatenate([both, x, y])
                own = [pa.array(whole.column(c).to_numpy()[at]) for c in ("key", "band", "id", "component", "n")]
                ends = [pa.array(np.concatenate([both, *[end(ids[x], ids[y])] * 2]), pa.int64(), mask=np.arange(len(at)) < len(both)) for end in (np.minimum, np.maximum)]
                return pa.RecordBatch.from_arrays([*own, *ends], ["key", "band", "id", "component", "n", "a", "b"])
            kept = forest(whole, x, y, told, percent)
            x, y = x[kept], y[kept]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y]), pa.int64()), pa.array(np.maximum(ids[x], ids[y]), pa.int64())], ["a", "b"])

        for whole in batches:
            for batch in (whole.slice(k, 2_000) for k in range(0, len(whole), 2_000)):
                same = np.ones(len(batch), bool)  # rows of the last group, perhaps unfinished
                for c in range(3):
                    x = np.asarray(batch.column(c))
                    same &= x == x[-1]
                last = int(np.argmax(same))
                if last or (carried and any(carried[-1].column(c)[-1] != batch.column(c)[0] for c in range(3))):
                    if last:
                        carried.append(batch.slice(0, last))
                    yield settled()
                    carried = []
                carried.append(batch.slice(last))
        if carried:
            yield settled()

    sent = [*group, "query", "id", "component", "n", "band", "least", "registers", "all" if what == "marks" else "set"]
    dealt = mixed.withColumn("least", F.lit(percent / 100 - MARGIN)).select(*sent).repartition(*group)
    return dealt.sortWithinPartitions(*group, "query").mapInArrow(close, schema)


def dealt(rows: DataFrame) -> DataFrame:
    """Members (key, component, n and more) of buckets with several components to their blocks: each as a member, those outside
    the bucket's largest component as queries too; with the members of the bucket (all). Counts are of ``rows``, so buckets
    that shrank need fewer blocks. Rows should be narrow: what is wide joins them afterwards."""
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") * 8 + 300).alias("size"))
    largest = F.max_by(F.struct("component", "c", "size"), F.struct("c", "component"))
    main = sizes.groupBy("key").agg(largest.alias("main"), F.sum("c").alias("all"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    upto = lambda c, size: F.ceil(F.greatest(c / BLOCK, size / BLOCK_BYTES, F.lit(1e-9))).cast("int")
    main = main.select("key", "main.component", "all", upto(F.col("all"), F.col("size")).alias("blocks"), upto(F.col("all") - F.col("main.c"), F.col("size") - F.col("main.size")).alias("asking")).withColumnRenamed("component", "main")
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    spot = lambda query, block, asked: F.struct(F.lit(query).alias("query"), block.alias("block"), asked.alias("asked"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    there = each("asking", lambda k: spot(False, place(F.col("blocks")), k))
    asked = each("blocks", lambda k: spot(True, k, place(F.col("asking"))))
    spots = F.explode(F.when(F.col("component") == F.col("main"), there).otherwise(F.concat(there, asked)))
    return rows.join(main, "key").select(*rows.columns, "all", spots.alias("spot")).select(*rows.columns, "all", "spot.*")


def sets_of(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(id), with repeats, to (id, set): the full set of each document as bytes."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets(batch.column(1), k)], pa.binary())], ["id", "set"])

    wanted = texts.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return wanted.select("doc_id", "text").mapInArrow(draw, "id long, set binary")


def classes(known: DataFrame) -> DataFrame:
    """(doc_id, rep): the least identifier with the same set; ``known`` has an identifier once. The least is worked out before anything moves; on the
    way back, a join, the narrow rows of a set still meet in one task."""
    same = ["digest", "n_shingles"]
    some = known.where("n_shingles > 0").select("doc_id", *same)
    return some.join(some.groupBy(*same).agg(F.min("doc_id").alias("rep")), same).select("doc_id", "rep")


def buckets(met: DataFrame) -> DataFrame:
    """(key, band, id, n) of buckets with several members, each member its own component: with a random leader."""
    any_ = F.struct(F.xxhash64("key", "id"), "id")
    of = met.groupBy("key").agg(F.min(any_)["id"].alias("leader"), F.count(F.lit(1)).alias("all")).where("all > 1")
    return met.join(of, "key").select("key", "band", "id", "n", F.col("id").alias("component"), F.col("leader").alias("main"), "leader")


def labelled(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(key, band, id, n) with the component of each, itself where it has none."""
    return shared.join(label, "id", "left").select("key", "band", "id", "n", F.coalesce("component", "id").alias("component"))


def leaders(shared: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """(key, band, id, n) and (id, component) to open members (component, main, leader besides): the bucket has several
    components, and the leader is a random member of the largest one."""
    own = labelled(shared, label)
    any_ = F.struct(F.xxhash64("key", "id", F.lit(turn)), "id")
    sizes = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min(any_)["id"].alias("leader"))
    largest = F.max_by(F.struct("component", "leader"), F.struct("c", F.xxhash64("key", "component", F.lit(turn))))
    main = sizes.groupBy("key").agg(largest.alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return own.join(main.select("key", F.col("main.component").alias("main"), "main.leader"), "key")


def contracted(label: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) with each end moved to its component, where it has one."""
    both = links.select("a", "b")
    for side in ("a", "b"):
        known = label.select(F.col("id").alias(side), F.col("component").alias("up"))
        both = both.join(known, side, "left").withColumn(side, F.coalesce("up", side)).select("a", "b")
    return both


def hooked(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after new links: each component moves to the least one that it is linked with, and on to where that one
    moves. Chains may stay in parts; components() over what all links still join has the last word."""
    both = links if label is None else contracted(label, links)
    up = staged(both.where("a <> b").groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("to")), "hooks")
    further = up.select(F.col("id").alias("to"), F.col("to").alias("on"))
    up = up.join(further, "to", "left").select("id", F.coalesce("on", "to").alias("component"))
    if label is None:
        return staged(up, "labels")
    moved = label.join(up.select(F.col("id").alias("component"), F.col("component").alias("on")), "component", "left").select("id", F.coalesce("on", "component").alias("component"))
    return staged(moved.union(up.join(label.select("id"), "id", "left_anti")), "labels")


def linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) to (doc_id, n_shingles) and to (node, component) over all documents linked with a smaller one."""
    rows, number = bands(percent)
    drawn = staged(sketch(docs, k, rows, number), "sketch")
    known = drawn.where("doc_id is not null")
    again = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), (F.min("digest") != F.max("digest")).alias("differ")).where("c > 1")
    again = again.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.max("differ"), F.lit(False)).alias("differ")).first()
    if again["differ"]:
        docs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        known = staged(sketch(docs, k, rows, number), "sketch")
    elif again["c"]:
        known = staged(known.dropDuplicates(["doc_id"]), "sketch")
    members = staged(classes(known), "classes")
    same = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = members.where("doc_id = rep").select("doc_id")
    own = known.where("n_shingles > 0").join(reps, "doc_id", "left_semi")
    met = staged(own.select(F.posexplode("keys").alias("band", "key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")), "bands")
    open_ = staged(buckets(met), "buckets")
    freed(met)
    shared = open_.select("key", "band", "id", "n")
    sketched = known.select(F.col("doc_id").alias("id"), "registers")
    sketched = staged(sketched.join(shared.select("id").distinct(), "id", "left_semi"), "sketched")
    wanted = sketched.select(F.col("id").alias("doc_id"))
    # An inner join, as Spark would move a semi join below the sieve. Identifiers of sketched are unique.
    texts = sieved(docs, "doc_id", wanted).join(wanted, "doc_id").select("doc_id", "text").dropDuplicates(["doc_id"])
    texts = bucketed(texts, "doc_id", "texts")
    label, tried, found = None, None, []
    for turn in range(ROUNDS):
        asking = open_.where("component <> main").groupBy("id").agg(F.collect_list("leader").alias("met"))  # a leader a band
        often = F.transform(F.array_distinct("met"), lambda x: F.struct(F.size(F.filter("met", lambda y: y == x)).alias("n"), x.alias("hub")))
        asked = asking.select("id", F.explode(F.slice(F.sort_array(often, asc=False), 1, ASKED)).alias("p")).select("id", "p.hub")
        asked = asked.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), "hub").groupBy("a", "b").agg(F.min("hub").alias("hub"))
        asked = staged(asked if tried is None else asked.join(tried, ["a", "b"], "left_anti"), "pairs")
        found.append(staged(verified(asked, texts, k, percent), "links"))
        label, tried = hooked(label, found[-1]), asked if tried is None else tried.union(asked)
        if turn + 1 < ROUNDS:
            open_ = staged(leaders(shared, label, turn), "open")
    mixed = dealt(labelled(shared, label)).join(sketched, "id")
    marks = staged(residual(mixed, rows, number, percent, "marks"), "marks")
    own = ["key", "band", "id", "component", "n"]
    unasked = marks.where("a is not null").join(tried, ["a", "b"], "left_anti").select(*own)
    near = staged(marks.where("a is null").select(*own).union(unasked).distinct(), "near")
    if not near.isEmpty():
        mixed = dealt(near).join(sketched, "id").join(sets_of(near, texts, k), "id")
        found.append(staged(residual(mixed, rows, number, percent, "links"), "links"))
    freed(texts)
    # The labels follow from the links, and with them the links may as well hold between the ends' components.
    left = label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(contracted(label, reduce(DataFrame.union, found)))
    of = staged(components(left), "components")
    # Of equal sets each follows its representative.
    follow = same.join(of.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    return drawn.select("doc_id", "n_shingles"), of.union(follow)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sizes, found = linked(id_and_text(docs, id_col, text_col), k, percent)
    joined = sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.col("component").isNull().alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


#: An exact join over shingles.
ORACLE = r"""
WITH RECURSIVE spoken AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 3 THEN w ELSE w[k : k + 2] END) AS g
    FROM spoken, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS u(k)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reached AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION SELECT r.node, l.o FROM reached r JOIN (SELECT a AS n, b AS o FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.n)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reached r ON r.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
