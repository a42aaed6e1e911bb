"""Operators against SQL, brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from loomlog.llm import decontamination, line_dedup, packing, pii, secrets, suffix_dedup
from loomlog.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, same):
    same(QUERIES[name], ORACLES[name])


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def test_secrets_base_and_random_tokens(spark):
    rng = random.Random(3)
    parts = ["token", "SECRET", "api_key", "Apikey", " ", "=", ":", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef0123", "é", "😀", "\n", ".", "password", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(200)] + ["é token=abcdef12 " * 600]
    secret = "0F6IWSNV5aNDbSb4qvmrb/CW8c8vfOYY"
    texts.append(f"see {secret} and SomeLongCamelCaseIdentifierName, this_is_a_long_snake_case_name_2, {'z' * 40}")
    rows = secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = base_secrets(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, x, _ in want) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        if r["doc_id"] == len(texts) - 1:
            assert r["spans"] == f"random:4:{4 + len(secret)}"


ORDINARY = """SomeLongCamelCaseIdentifierName this_is_a_long_snake_case_name_2 MAX_NUMBER_OF_OPEN_CONNECTIONS getElementsByTagNameNS
    Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungen anticonstitutionnellement electroencefalografista responsibilities-and-duties
    usr/local/share/python/site-packages 2024-01-15-12-30-45-backup-file ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/
    internationalization HTTPServerRequestHandlerFactory zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz 00000000000000000000 xyxyxyxyxyxyxyxyxyxyxyxy
    test_secrets_base_and_random_tokens incomprehensibilities""".split()


def test_secrets_recall_by_encoding_and_length(spark):
    rng, texts, want = random.Random(8), [], []
    lower = "abcdefghijklmnopqrstuvwxyz"
    forms = {"base32": (lower.upper() + "234567", (20, 24, 32)), "base36": (lower + "0123456789", (20, 32)), "letters": (lower, (24, 32)), "base64": (lower + lower.upper() + "0123456789+/", (20, 32, 44)), "HEX": ("0123456789ABCDEF", (24, 32)), "url": (lower + lower.upper() + "0123456789_-", (22, 43))}
    for name, (letters, lengths) in forms.items():
        for n in lengths:
            for k in range(60):
                token = "".join(rng.choice(letters) for _ in range(n))
                around = ORDINARY[:19] if k % 2 else []
                texts.append(" ".join([token, *around]))
                want.append((name, n, f"random:0:{n}"))
    rows = secrets.secrets(spark.createDataFrame([*enumerate(texts), (len(texts), " ".join(ORDINARY)), *((len(texts) + 1 + k, x) for k, x in enumerate(ORDINARY))], "doc_id long, text string")).collect()
    found, wrong = {}, [r["spans"] for r in rows if r["doc_id"] >= len(texts) and r["spans"]]
    for r in rows:
        if r["doc_id"] < len(texts):
            name, n, span = want[r["doc_id"]]
            got = r["spans"].split(",")
            found.setdefault((name, n), []).append(span in got)
            wrong += [x for x in got if x and not x.split(":")[1] == "0"]
    assert not wrong
    assert {k: sum(v) for k, v in found.items() if sum(v) < 0.9 * len(v)} == {}


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    passes = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    return sorted((m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if passes[k](m.group()))


@pytest.mark.parametrize("letters", ["a@.b1-+_ ", "0123.456 78-9", "+1 ()2345-.67890"])
def test_pii_base_matches_the_patterns(letters):
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        own, every = pii.spans(text)
        assert sorted(own) == base_pii(text) and set(own) <= set(every)


@pytest.mark.parametrize(
    "text, found, kind",
    [
        ("mail john dot doe at example dot com now", "john dot doe at example dot com", 0),
        ("x j.doe [at] mail (dot) org y", "j.doe [at] mail (dot) org", 0),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ fine", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", 0),
        ("jоhn@exаmple.com", "jоhn@exаmple.com", 0),
        ("at 192 dot 168 dot 1 dot 12 it", "192 dot 168 dot 1 dot 12", 1),
        ("four one one one one one one one one one one one one one one one", "four one one one one one one one one one one one one one one one", 2),
        ("call +1 five five five one two three four five six seven now", "+1 five five five one two three four five six seven", 3),
    ],
)
def test_pii_disguises_map_back(text, found, kind):
    assert [(text[a:b], k) for a, b, k in pii.spans(text)[1]] == [(found, kind)]


@pytest.mark.parametrize(
    "text, found, kind",
    [
        ("tel plus null vier neun acht sieben sechs fünf vier drei zwei eins ja", "plus null vier neun acht sieben sechs fünf vier drei zwei eins", 3),
        ("tel plus un deux trois quatre cinq six sept huit neuf zéro ici", "plus un deux trois quatre cinq six sept huit neuf zéro", 3),
        ("tel plus uno dos tres cuatro cinco seis siete ocho nueve cero si", "plus uno dos tres cuatro cinco seis siete ocho nueve cero", 3),
        ("call plus one five five five one two three four five six seven now", "plus one five five five one two three four five six seven", 3),
        ("call plus 1 555 123 4567 now", "plus 1 555 123 4567", 3),
        ("host one nine two dot one six eight dot one dot one up", "one nine two dot one six eight dot one dot one", 1),
        ("hôte un neuf deux point un six huit point un point un ici", "un neuf deux point un six huit point un point un", 1),
        ("write john at example.com please", "john at example.com", 0),
        ("write  john  at  example  dot  com  please", "john  at  example  dot  com", 0),
        ("call +1 five fİve five one two three four five sİx seven now", "+1 five fİve five one two three four five sİx seven", 3),
        ("juan arroba ejemplo punto es", "juan arroba ejemplo punto es", 0),
        ("hans [ät] beispiel punkt de heute", "hans [ät] beispiel punkt de", 0),
        ("jean arobase exemple point fr merci", "jean arobase exemple point fr", 0),
    ],
)
def test_pii_disguises_of_four_languages(text, found, kind):
    assert [(text[a:b], k) for a, b, k in pii.spans(text)[1]] == [(found, kind)]


def test_pii_words_of_four_languages_stay():
    for text in ("look at this.that", "we met at noon.Then left", "un point de vue", "null Punkt acht", "uno dos tres cuatro cinco", "two plus two is four", "plus 5 degrees", "version one point two"):
        assert pii.spans(text) == ([], [])


def test_pii_time_is_linear():
    import time

    text, took = "one two one two one two dot 5 a@b.co 1.2.3.4 x dot y at z dot org, ", {}
    for n in (400, 1600):
        began = time.process_time()
        own, every = pii.spans(text * n)
        took[n] = time.process_time() - began
        assert len(own) == 2 * n and len(every) > 2 * n
    assert took[1600] < 8 * took[400]


def brute_deobfuscated(text):
    """Each step on the whole string, places kept by a list; spans by looking at every place."""
    tape = (text, list(range(len(text) + 1)))
    for step in (pii.plain_letters, pii.plain_digits, pii.plain_signs):
        tape = step(tape)
    return {(tape[1][a], k) for a, b, k in base_pii(tape[0])}


def test_pii_added_spans_come_from_the_normalised_text():
    rng = random.Random(7)
    parts = ["john", " dot ", " at ", "example", "com", " ", "one", "two ", "plus ", "five five five", "１２", "@", ".", "192", " [at] ", "а", "+1 ", "org, "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        own, every = pii.spans(text)
        assert sorted(own) == base_pii(text) and set(own) <= set(every)
        added = [x for x in every if x not in own]
        starts = brute_deobfuscated(text)
        assert all((a, k) in starts and 0 <= a < b <= len(text) for a, b, k in added)
        found = pii.deobfuscated(text)
        assert not found or {(a, k) for a, _, k in found} == starts
        assert all((a, b, k) in every or any(k == z and a < y and x < b for x, y, z in own) for a, b, k in found)


def test_pii_leaves_words_alone():
    assert all(pii.ODD.match(chr(k)) for k in pii.homoglyphs())
    for text in ("look at this. dot it", "one two three four five", "meet at ten dot", "élan à côté"):
        assert pii.spans(text) == ([], [])


def brute_repeats(docs, n):
    seen, out = set(), {}
    for d in sorted(docs):
        text = docs[d].encode()
        gone = bytearray(len(text))
        for s in range(len(text) - n + 1):
            if text[s : s + n] in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(text[s : s + n])
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[d] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture
def rows_a_batch(spark):
    yield lambda n: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("group, names, busy, held, batch", [(20_000, 4_000_000, 500, 500_000, 10_000), (3, 4_000_000, 500, 1, 2), (20_000, -1, 500, 500_000, 10_000), (20, 4_000_000, 5, 30, 7), (20_000, 4_000_000, 500, 1, 2)])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, rows_a_batch, group, names, busy, held, batch):
    monkeypatch.setattr(suffix_dedup, "BUSY", busy)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    rows_a_batch(batch)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_NAMES", names)
    rng = random.Random(5)
    source = "".join(rng.choice("ab é") for _ in range(900))
    docs = {200: "a" * 600, 201: "ab" * 200, 202: "", 203: "a" * 39}
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 800)
            parts.append(source[a : a + rng.randint(1, 200)] if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 60))))
        docs[k] = "".join(parts)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed(df, length=40).collect()}
    assert got == brute_repeats(docs, 40)


def brute_lines(docs, run, words):
    lines = {d: [x for x in (docs[d] or "").split("\n") if x] for d in docs}
    seen, gone = set(), {d: set() for d in docs}
    for d in sorted(docs):
        for s in range(len(lines[d])):
            for k in range(1, run + 1):
                part = tuple(lines[d][s : s + k])
                if len(part) == k and (k == run or words is not None and len(re.findall(r"[^\x20\x09-\x0D]+", "\n".join(part))) > words):
                    if part in seen:
                        gone[d].update(range(s, s + k))
                    seen.add(part)
    return {d: (len(lines[d]), len(gone[d]), sum(k - 1 not in gone[d] for k in gone[d]), "\n".join(x for k, x in enumerate(lines[d]) if k not in gone[d])) for d in docs}


def test_texts_beyond_a_chunk_come_in_parts():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 950, 3000, 20)]
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, 6, 7]), pa.array(texts)], ["doc", "text"])
    found = []
    for doc, data, at, shift, _ in suffix_dedup.parts(iter([batch]), 40, 1000):
        s = suffix_dedup.sampled(data, at, 40)
        for k in range(len(s["row"]) if s else 0):
            row = int(s["row"][k])
            for w in range(int(s["low"][k]), int(s["high"][k]) + 1):
                start = w - int(at[row]) + shift
                assert data[w : w + 40].tobytes().decode() == texts[int(doc[row]) - 4][start : start + 40]
                found.append((int(doc[row]), start))
    assert sorted(found) == [(4 + k, s) for k, x in enumerate(texts) for s in range(len(x) - 39)]


def test_winnowing_selects_less_than_every_place():
    rng = np.random.default_rng(1)
    lines = rng.integers(0, 2**63, 3000, np.uint64)
    place, name, marks = line_dedup.selected(lines, np.array([0, 3000]), 3, 2)
    assert 0.6 < len(place) / 2998 < 0.72 and (marks != 0).sum() == 2998
    _, again, _ = line_dedup.selected(lines[100:110], np.array([0, 10]), 3, 2)
    assert set(again.tolist()) <= set(name.tolist())


@pytest.mark.parametrize("group, words, batch", [(20_000, 5, 10_000), (20_000, None, 10_000), (3, 5, 2), (3, None, 2)])
def test_line_dedup_matches_brute_force(spark, monkeypatch, rows_a_batch, group, words, batch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(line_dedup, "HELD", 500_000 if batch > 2 else 1)
    rows_a_batch(batch)
    rng = random.Random(6)
    known = [" ".join(rng.choice(["a", "b", "é\t", " "]) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    docs = {k: "\n".join(rng.choice(known) for _ in range(rng.randint(0, 6))) for k in range(80)}
    docs |= {200: "one\nw w w w w w end\ntwo", 201: "three\nw w w w w w end\nfour", 202: "u u u\nv v v\nfive", 203: "six\nu u u\nv v v", 204: "short", 205: "short", 206: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    rows = line_dedup.line_dedup(df, words=words, texts=True).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_runs"], r["kept"]) for r in rows} == brute_lines(docs, 3, words)
    removed = {r["doc_id"]: r["n_removed"] for r in rows}
    assert [removed[d] for d in (201, 203, 205)] == ([1, 2, 0] if words else [0, 0, 0])


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def least(item, text):
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        row = [i]
        for j, o in enumerate(text, 1):
            row.append(min(cost[j - 1] + (w != o), cost[j] + 1, row[j - 1] + 1))
        cost = row
    return min(cost)


def edited(rng, words, n, vocabulary):
    x = list(words)
    for _ in range(n):
        q = rng.randrange(len(x))
        if rng.random() < 0.5:
            x[q] = rng.choice(vocabulary).upper()
        elif rng.random() < 0.5 and len(x) > 1:
            del x[q]
        else:
            x.insert(q, rng.choice(vocabulary))
    return x


def held(items, texts, allowed):
    out = {}
    for r, text in enumerate(texts):
        w = words_of(text)
        for k, item in items.items():
            if len(set(item) & set(w)) >= (1 - allowed / 100) * len(set(item)) - 1 and (e := least(item, w)) <= len(item) * allowed // 100:
                out[r, k] = e
    return out


def found_in(items, texts, allowed):
    block = decontamination.Items(list(items), [hashed(x) for x in items.values()], allowed)
    return {(r, block.ids[k]): edits for r, k, edits, *_ in block.search(pa.array(texts))}


def hashed(x):
    return decontamination.words(pa.array([" ".join(x)]), decontamination.ALPHANUMERIC)[0]


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(4)
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    known = {r["item_id"]: words_of(r["text"]) for r in items.collect()}
    vocabulary = [w for x in known.values() for w in x]
    texts = []
    for _ in range(150):
        x = known[rng.choice(list(known))]
        x = edited(rng, x, rng.randint(0, int(len(x) * 0.26)), vocabulary)
        texts.append(" ".join([*rng.choices(vocabulary, k=rng.randint(0, 30)), *x, *rng.choices(vocabulary, k=rng.randint(0, 30))]))
    got, want = found_in(known, texts, 20), held(known, texts, 20)
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got)
    assert len(got) >= decontamination.RECALL * len(want) > 50


@pytest.mark.parametrize("allowed", [10, 20, 30])
def test_decontamination_recall_by_length(allowed):
    rng = random.Random(allowed)
    vocabulary = [f"word{k}" for k in range(4000)]
    items = {n: rng.sample(vocabulary, n) for n in range(1, 41)}
    texts = []
    for n, x in items.items():
        for around in (0, 20, 20, 20):
            y = edited(rng, x, n * allowed // 100, vocabulary)
            texts.append(" ".join([*rng.choices(vocabulary, k=around), *y, *rng.choices(vocabulary, k=around)]))
    got, want = found_in(items, texts, allowed), held(items, texts, allowed)
    assert set(got) <= set(want) and all(got[x] >= want[x] for x in got)
    assert len(got) >= 0.97 * len(want) and len(want) >= 150
    exact = [" ".join([*rng.choices(vocabulary, k=9), *x, "end"]) for x in items.values()]
    assert {(n - 1, n) for n in items} <= set(found_in(items, exact, allowed))


def test_least_edits_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 8))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        edits, first, end = decontamination.least_edits(np.array(item, np.uint64), np.array(text, np.uint64), 99)
        assert edits == least(item, text) and 0 <= first <= end <= len(text)
        assert edits == min(least(item, text[a:b]) for a, b in [(first, end)]) and end - first <= len(item) + edits


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op9_packing"](spark, DATA).collect()
    encoder, by_doc, by_sequence = Tokenizer.from_file(path), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        ids = [*encoder.encode(docs[d] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    tokens = sum(r["length"] for r in rows)
    assert tokens >= 0.9 * 2048 * len(by_sequence)


def test_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, full, rng = packing.Encoder(path), Tokenizer.from_file(path), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "Ж", "1", "½", "٣", "!", "’s", "'s", "\xa0", "　", "😀", "<|endoftext|>", "the ", "é", "Ⅷ", "\x1c", "字", "ǅ", "don't.", "word,"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("shape", ["short", "long", "even", "one"])
def test_plan_places_every_piece_once(shape):
    rng = np.random.default_rng(3)
    histogram = np.zeros(257, np.int64)
    lengths = {"short": rng.integers(1, 30, 5000), "long": rng.integers(150, 256, 3000), "even": rng.integers(1, 257, 5000), "one": np.array([7])}[shape]
    np.add.at(histogram, lengths, 1)
    made = packing.plan(histogram)
    used = np.zeros(257, np.int64)
    for combination, times in made:
        assert sum(combination) <= 256 and times > 0
        np.add.at(used, list(combination), times)
    assert (used == histogram).all()
    sequences = sum(times for _, times in made)
    if shape in ("short", "even"):
        assert lengths.sum() >= 0.97 * 256 * sequences
