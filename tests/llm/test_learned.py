"""Held-out accuracy of the learned operators, and near-duplicates against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from loomlog.llm import langid, neardup, toxicity
from loomlog.llm.common import sieved
from loomlog.llm.components import components
from loomlog.llm.registry import QUERIES

LARGER = DATA.replace("sf0.001", "sf0.01")


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_language_id"](spark, LARGER).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_accepted_rejects_foreign_text_and_junk(spark):
    rng = random.Random(9)
    foreign = ["Это обычный русский текст о погоде и о природе в нашей стране", "这是一个关于天气和自然的普通中文文本我们喜欢它", "Wczoraj poszliśmy na spacer do lasu i znaleźliśmy dużo grzybów"]
    foreign += ["x" * 500, "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(300))]
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + k, x, None) for k, x in enumerate(foreign)], docs.schema)
    told = {r["doc_id"] for r in langid.language_id(docs).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in langid.accepted(docs.union(more)).collect()} == told


def test_language_model_and_bound_come_from_all_learned_documents(spark, monkeypatch):
    """45,000 labelled documents, with 20 languages of one document each; a sample would lose some of them."""
    n, one = 45_000, 20
    rows = [(3 * k, f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} and text", f"l{k:02d}" if k < one else "en") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    langs, _, prior = langid.fit(docs)
    assert langs == ["en", *(f"l{k:02d}" for k in range(one))]
    assert np.exp(prior) * n == pytest.approx([n - one, *[1] * one])
    seen, kept = [], langid.fits_from

    def watched(learned, shared):
        seen.extend([{r["doc_id"] for r in learned.select("doc_id").collect()}, kept(learned, shared), shared.value])
        return seen[1]

    monkeypatch.setattr(langid, "fits_from", watched)
    langid.accepted(docs)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert len(learned) > 25_000 and seen[0] == {r[0] for r in learned}
    fits = langid.Scorer(seen[2]).fitting(pa.array([r[1] for r in learned]))[2]
    assert seen[1] == pytest.approx(np.quantile(fits, langid.FIT_QUANTILE) - langid.FIT_SLACK, abs=2e-3)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = QUERIES["op7_toxicity"](spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_tapes(clause, weights):
    """The grammar read off the words one by one, without states."""
    words = toxicity.WORD.findall(clause.lower())
    kind = [toxicity.CLASSES.get(w, "o") for w in words]
    out = dict.fromkeys(toxicity.TAPES, 0.0)
    for k, w in enumerate(words):
        before = kind[max(0, k - toxicity.REACH) : k]
        negated, reported = "n" in before, "r" in kind[:k]
        if kind[k] == "t" and not negated and not reported:
            last = [j for j in range(k) if kind[j] in "ht"]
            out["threats"] += bool(last) and kind[last[-1]] == "h" and k - last[-1] <= toxicity.NEAR
        if w in weights:
            aimed = "t" in kind[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]
            out["negated" if negated else "reported" if reported else "aimed" if aimed else "plain"] += weights[w]
    return out


def test_composed_grammar_matches_a_plain_reading():
    rng = random.Random(13)
    weights = {"idiot": 2.0, "scum": 1.5, "trash": 1.0, "burn": 0.5}
    vocabulary = [*weights, "you", "they", "kill", "not", "never", "said", "isn't", "tree", "blue", "walks", "and", "the"]
    for _ in range(2000):
        clauses = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 3))]
        got = toxicity.tapes(". ".join(clauses), toxicity.Lexicon(weights, {}))[: len(toxicity.TAPES)]
        want = [plain_tapes(c, weights) for c in clauses]
        assert got == pytest.approx([float(np.log1p(sum(w[t] for w in want))) for t in toxicity.TAPES])


def test_language_scores_match_plain_counts(spark):
    """Counts, smoothing and posteriors worked out once more in plain Python over n-grams as strings."""
    docs = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    learned = [r for r in docs if r["text"] and r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]

    def units(text):
        x = re.sub(r"\0+", "\0", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else "\0" for c in text))
        x = x.removeprefix("\0")
        return Counter(x[k : k + n] for n in langid.ORDERS for k in range(len(x) - n + 1)), any(c.isalpha() for c in text)

    counts, priors = defaultdict(Counter), Counter(r["lang"] for r in learned)
    for r in learned:
        counts[r["lang"]].update(units(r["text"])[0])
    totals = {k: sum(c.values()) for k, c in counts.items()}
    got = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, DATA).collect()}
    same = 0
    for r in docs[:200]:
        found, any_letter = units(r["text"] or "")
        if not any_letter:
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            same += 1
            continue
        logs = {k: np.log(priors[k] / len(learned)) + sum(n * np.log((counts[k][g] + langid.SMOOTHING) / (totals[k] + langid.SMOOTHING * langid.BUCKETS)) for g, n in found.items()) for k in counts}
        same += got[r["doc_id"]]["lang_pred"] == max(sorted(logs), key=logs.get)
    assert same >= 0.98 * len(docs[:200])  # hashed n-grams may collide


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs, k, percent):
    found = {d: shingles(t, k) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d, s in found.items():
        for x in s:
            inverted[x].append(d)
    for d in docs:
        for y, n in Counter(y for x in found[d] for y in inverted[x] if y < d).items():
            if 100 * n >= percent * (len(found[d]) + len(found[y]) - n):
                parent[max(root(d), root(y))] = min(root(d), root(y))
    return {d: root(d) for d in docs}, {d: len(s) for d, s in found.items()}


@pytest.mark.parametrize("k, percent, small, rounds", [(3, 85, 16, 2), (5, 80, 16, 3), (3, 85, 2, 1)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, k, percent, small, rounds):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK", 2048 if small > 3 else 4)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = {}
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs[len(docs)] = " ".join(copy)
    docs[len(docs)] = ""
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want, sizes = brute_components(docs, k, percent)
    rows = neardup.near_duplicates(df, k=k, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def family(n, edits, seed=11):
    """Texts whose pairs lie just above and below 0.85."""
    rng = random.Random(seed)
    base, docs = [f"w{rng.randrange(5000)}" for _ in range(200)], {}
    for d in range(n):
        copy = list(base)
        for _ in range(rng.randint(edits - 2, edits + 2)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        docs[d] = " ".join(copy)
    return docs


def test_links_of_a_family_near_the_threshold_grow_with_its_members(spark, monkeypatch):
    rows, kept = {}, neardup.residual

    def counted(mixed, *rest):
        out = kept(mixed, *rest)
        if rest[-1] != "marks":
            rows[size] = rows.get(size, 0) + out.count()
            rows["dealt", size] = rows.get(("dealt", size), 0) + mixed.count()
        return out

    monkeypatch.setattr(neardup, "residual", counted)
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    for size in (300, 600):
        docs = family(size, 6)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, k=3, percent=85).collect()}
        assert got == brute_components(docs, 3, 85)[0]
    print(rows)
    assert rows.get(600, 0) <= 3 * rows.get(300, 0) + 600 and rows.get(("dealt", 600), 0) <= 48 * 600


def test_near_duplicates_recall_on_the_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()}
    want, _ = brute_components(docs, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in QUERIES["op5_near_duplicates"](spark, LARGER).collect()}
    assert got == want


def shuffled(spark):
    """Bytes that all stages so far wrote for a shuffle."""
    none, sc = spark._jvm.java.util.ArrayList(), spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_near_duplicates_move_only_texts_that_share_a_bucket(spark):
    rng = random.Random(5)
    docs = {d: " ".join(f"{rng.getrandbits(64):016x}" for _ in range(1500)) for d in range(300)}
    docs |= {300 + d: docs[d] + " another end" for d in range(3)}
    name, size = "spark.sql.autoBroadcastJoinThreshold", sum(map(len, docs.values()))
    before = spark.conf.get(name)
    df, moved = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3).localCheckpoint(), shuffled(spark)
    try:
        spark.conf.set(name, "-1")  # as where there are too many identifiers to broadcast
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, k=3, percent=85).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {d: d % 300 for d in docs}
    assert shuffled(spark) - moved < 0.5 * size


def test_near_duplicates_run_few_tasks(spark):
    """With partitions that nothing coalesces, small tasks are what takes the time."""
    rng = random.Random(3)
    docs = family(60, 6) | {60 + d: t for d, t in family(40, 4, 12).items()}
    docs |= {100 + d: " ".join(f"{rng.getrandbits(32):x}" for _ in range(60)) for d in range(40)}
    docs |= {140 + d: docs[100 + d] + " end" for d in range(20)}
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in own}
    df, sc = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3).localCheckpoint(), spark.sparkContext
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        sc.setJobGroup("few-tasks", "")
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, k=3, percent=85).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == brute_components(docs, 3, 85)[0]
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few-tasks") for s in told.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))
    assert tasks <= 1100


@pytest.mark.parametrize("repeats", ["same", "other"])
def test_near_duplicates_of_repeated_identifiers(spark, repeats):
    docs = family(30, 6)
    rows = list(docs.items()) + [(d, docs[d] if repeats == "same" else docs[d] + " zz") for d in range(0, 30, 2)] + [(None, docs[0]), (40, "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = brute_components(docs | {40: ""}, 3, 85)
    found = neardup.near_duplicates(df, k=3, percent=85).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in found)


@pytest.mark.parametrize("number, bits", [(0, 1 << 27), (1, 1 << 27), (5000, 1 << 27), (5000, 1 << 15), (90_000, 1 << 27)])
def test_sieve_loses_no_row(spark, number, bits):
    df = spark.range(30_000).selectExpr("if(id = 0, null, id - 15000) as doc_id", "'x' as text")
    ids = {7 * k - 14_000 for k in range(number)}
    rows = sieved(df, "doc_id", spark.range(number).selectExpr("id * 7 - 14000 as id"), bits).collect()
    got, want = {r["doc_id"] for r in rows}, ids & set(range(-14_999, 15_000))
    assert len(got) == len(rows) and want <= got
    assert bits == 1 << 15 or len(got - want) < 6000


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5)]
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(k, 100) for k in range(101, 161)} | {(k, 7) for k in range(200, 260)}


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    names, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = before
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == names
        found = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert found.items() <= kept.items()
        if name == "exact_dedup":
            first = {}
            for d in sorted(kept):
                first.setdefault(kept[d], d)
            assert set(found) == set(first.values())
        if name == "near_dedup":
            want, _ = brute_components(kept, p.SHINGLE, p.PERCENT)
            assert set(found) == {d for d in kept if want[d] == d}
        kept = found
    assert len(kept) > 0.7 * len(before)
    pieces = p.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in pieces} == set(kept)


def test_pipeline_stages_judge_rows(spark):
    import corpus_pipeline as p

    names = "doc_id long, text string, lang string, _gone long, row_key int, kept boolean, gone_key string"
    rows = [(1, "aaa b"), (5, "aaa b"), (5, "only copy of this text"), (None, "n n"), (None, "n n"), (7, "twice"), (7, "twice"), (8, None), (9, ""), (None, "lone")]
    docs = spark.createDataFrame([(*r, "en", 1, 2, True, "g") for r in rows], names)
    want = [(1, "aaa b"), (5, "only copy of this text"), (7, "twice"), (8, None), (None, "lone"), (None, "n n")]
    key = lambda r: (str(r[0]), str(r[1]))
    found = p.exact(spark, docs, DATA)
    assert found.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=key) == sorted(want, key=key)
    want.append((9, ""))  # texts without words are near to nothing
    assert sorted(((r["doc_id"], r["text"]) for r in p.near(spark, docs, DATA).collect()), key=key) == sorted(want, key=key)
    kept = p.decontaminated(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    pieces = p.packed(spark, docs, DATA).collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(r[0] for r in rows)


def test_pipeline_stages_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, row_key int")
    for _, stage in p.STAGES:
        assert stage(spark, docs, DATA).collect() == []
