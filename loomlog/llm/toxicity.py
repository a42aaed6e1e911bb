"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols: a class (harm verb, target, negation, reporting verb, other; small fixed lists) and whether the
word is an insult (words and word beginnings with weights learned from labelled documents). Five transducers read a clause's
symbols, each given by its states and its step: insult (one state, passes weights on), threat (a harm verb still awaits its
target), target (words since the last one), negation (words it still holds over) and reported speech (open until the clause
ends). COMPOSED is their composition: a table of the reachable joint states, and for each symbol the next state, the tape
that an insult's weight goes to, and whether a threat is complete. A target may also follow its insult, so the target
transducer runs over the clause backwards as well. What is scored are matched clauses: a document's clause tapes are summed and
a logistic layer, fit on the same documents, weighs the tapes. Training takes a bounded sample: ``TRAIN_DOCS`` labelled
documents in expectation (all where there are fewer). Labels join by identifier; label, language, source and identifier are
never inputs of a score.

Cases: null and empty texts get the score of a document without any match; null labels and identifiers aren't learned
from; repeated rows are scored each; with a single class of labels the score is 0.5 at most everywhere; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, table
from loomlog.llm.langid import held_out

TRAIN_DOCS = 12_000
PREFIXES = (4, 5, 6, 7)
SUPPORT, EVIDENCE, WEIGHT = 3, 12.0, 0.7  # documents, G-squared and log ratio that an entry needs
REMEMBERED = 200_000
REACH, NEAR = 3, 5  # words over which negation holds; words between a target and its insult, a harm verb and its target

# Function words of the grammar.
NEGATION = "not no never without nicht kein keine nie ne pas jamais ni nunca sin don't isn't can't won't doesn't didn't aren't wasn't"
REPORTED = "said says called calls wrote quoted claimed sagte nannte schrieb dit appelle disait dijo llamaba"
TARGET = "you your yours they them he she him her his du dich dir ihr sie tu te toi vous ils tú usted ustedes ellos"
HARM = "kill hurt beat destroy burn shoot stab töten schlagen verletzen tuer frapper brûler matar golpear quemar"

WORD, CLAUSE = re.compile(r"[^\W\d_]+(?:'t(?![^\W_]))?"), re.compile(r"[.!?;:\n]+")
CLASSES = {w: k for k, words in (("n", NEGATION), ("r", REPORTED), ("t", TARGET), ("h", HARM)) for w in words.split()}
TAPES = ("plain", "aimed", "negated", "reported", "threats")
SYMBOLS = [(kind, hit) for kind in "onrth" for hit in (False, True)]

#: Transducers: first state, and the step from a state over a symbol to the next state and what is known of the symbol.
TRANSDUCERS: dict[str, tuple[int, Callable[[int, str, bool], tuple[int, bool]]]] = {
    "insult": (0, lambda s, kind, hit: (0, hit)),
    "threat": (0, lambda s, kind, hit: (NEAR if kind == "h" else 0 if kind == "t" else max(s - 1, 0), kind == "t" and s > 0)),
    "target": (0, lambda s, kind, hit: (NEAR if kind == "t" else max(s - 1, 0), s > 0 or kind == "t")),
    "negation": (0, lambda s, kind, hit: (REACH if kind == "n" else max(s - 1, 0), s > 0)),
    "reported": (0, lambda s, kind, hit: (int(s or kind == "r"), bool(s))),
}


def composed(names: tuple[str, ...]) -> list[list[tuple[int, dict[str, bool]]]]:
    """The composition of transducers: for each reachable joint state, by symbol, the next state and what each one tells."""
    first = tuple(TRANSDUCERS[n][0] for n in names)
    number, table_, todo = {first: 0}, [], [first]
    for state in todo:
        row = []
        for kind, hit in SYMBOLS:
            steps = [TRANSDUCERS[n][1](s, kind, hit) for n, s in zip(names, state, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append((number[after], {n: told for n, (_, told) in zip(names, steps, strict=True)}))
        table_.append(row)
    return table_


def emitted(told: dict[str, bool]) -> tuple[str | None, bool]:
    """The tape of an insult's weight, and whether a threat is complete."""
    tape = "negated" if told["negation"] else "reported" if told["reported"] else "aimed" if told["target"] else "plain"
    return tape if told["insult"] else None, told["threat"] and not told["negation"] and not told["reported"]


COMPOSED = [[(after, *emitted(told)) for after, told in row] for row in composed(("insult", "threat", "target", "negation", "reported"))]
BACKWARDS = [[(after, told["target"]) for after, told in row] for row in composed(("target",))]
PLACE = {symbol: k for k, symbol in enumerate(SYMBOLS)}


class Lexicon(dict):
    """Word to weight: its own entry, else that of its longest known beginning, else 0."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings

    def __missing__(self, word: str) -> float:
        weight = self.words.get(word)
        for n in reversed(PREFIXES) if weight is None else ():
            if len(word) >= n and (weight := self.beginnings.get(word[:n])) is not None:
                break
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = weight or 0.0
        return self[word]


def tapes(text: str, lexicon: Lexicon) -> np.ndarray:
    """What the composed transducer emits for a text, as features."""
    sums, strongest, n_words, hits, kinds = dict.fromkeys(TAPES, 0.0), 0.0, 0, 0, set()
    for clause in CLAUSE.split(text.lower()):
        words = WORD.findall(clause)
        n_words += len(words)
        weights = list(map(lexicon.__getitem__, words))
        if not any(weights) and not any(CLASSES.get(w) == "h" for w in words):
            continue
        symbols = [PLACE[CLASSES.get(w, "o"), bool(x)] for w, x in zip(words, weights, strict=True)]
        ahead, state = [False] * len(symbols), 0  # whether a target comes soon
        for k in range(len(symbols) - 1, -1, -1):
            state, ahead[k] = BACKWARDS[state][symbols[k]]
        state, score = 0, 0.0
        for word, weight, symbol, soon in zip(words, weights, symbols, ahead, strict=True):
            state, tape, threat = COMPOSED[state][symbol]
            if threat:
                sums["threats"] += 1
            if tape:
                sums["aimed" if soon and tape == "plain" else tape] += weight
                score += weight
                hits += 1
                kinds.add(word)
        strongest = max(strongest, score)
    total = sum(sums[k] for k in TAPES[:4])
    per = 100 * total / (n_words + 10)
    return np.array([*(np.log1p(sums[k]) for k in TAPES), np.log1p(strongest), np.log1p(total), np.log1p(per), per / 10, np.log1p(len(kinds)), np.log1p(hits), np.log1p(n_words) / 5])


def learn(texts: list[str], toxic: np.ndarray) -> dict:
    """The lexicon and the logistic layer, as plain values."""
    docs, uses, totals = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for text, t in zip(texts, toxic, strict=True):
        found = Counter()
        for word in WORD.findall(text.lower()):
            found[word] += 1
        totals[t] += sum(found.values())
        units: Counter = Counter()
        for word, n in found.items():
            units["=" + word] += n
            for k in PREFIXES:
                if len(word) >= k:
                    units["^" + word[:k]] += n
        docs[t].update(units.keys())
        uses[t].update(units)
    n1, n0, scored = totals[1] + 1, totals[0] + 1, []
    for unit, d in docs[1].items():
        if d >= SUPPORT:
            a, b = uses[1][unit], uses[0][unit]
            weight = float(np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0))
            # G-squared over documents, so that one long text isn't evidence of its own.
            m1, m0, e = int(toxic.sum()) or 1, int((1 - toxic).sum()) or 1, docs[0][unit]
            p = (d + e) / (m1 + m0)
            g = 2 * (d * np.log(d / (m1 * p)) + (e * np.log(e / (m0 * p)) if e else 0.0))
            if weight >= WEIGHT and d / m1 > e / m0 and g >= EVIDENCE:
                scored.append((unit, weight))
    words = {u[1:]: w for u, w in scored if u[0] == "="}
    beginnings = {u[1:]: w for u, w in scored if u[0] == "^"}
    lexicon = Lexicon(words, beginnings)
    if len(set(toxic.tolist())) < 2:
        return {"words": {}, "beginnings": {}, "mean": [], "scale": [], "w": [], "b": 0.0 if len(toxic) and toxic[0] else -2.0}
    x = np.array([tapes(t, lexicon) for t in texts])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (toxic - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"words": words, "beginnings": beginnings, "mean": mean.tolist(), "scale": scale.tolist(), "w": w[:-1].tolist(), "b": float(w[-1])}


class Scorer:
    def __init__(self, model: dict):
        self.lexicon = Lexicon(model["words"], model["beginnings"])
        self.w = np.array(model["w"]) / np.array(model["scale"]) if model["w"] else np.zeros(0)
        self.b = model["b"] - float(np.dot(self.w, model["mean"])) if model["w"] else model["b"]

    def __call__(self, text: str) -> float:
        told = self.b + (float(np.dot(self.w, tapes(text, self.lexicon))) if len(self.w) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(told, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_docs: int = TRAIN_DOCS) -> dict:
    """(doc_id, text) and (doc_id, label), both without held-out rows, to a model. Learned by one executor task."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    there = known.count()
    if there > train_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < int((1 << 30) * train_docs / there))
    rows = docs.join(known, "doc_id").select("text", "label")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda k: (texts[k], toxic[k]))  # whatever order rows arrive in
        model = learn([texts[k] for k in order], np.array([int(toxic[k] > 0) for k in order], int))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)])], ["model"])

    found = rows.repartition(1).mapInArrow(train, "model string").collect()
    return json.loads(found[0]["model"]) if found else learn([], np.zeros(0, int))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) to (doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = id_and_text(docs, id_col, text_col)
    model = fit(rows.where(~held_out("doc_id", 5, 0)), labels.where(~held_out(id_col, 5, 0)).withColumnRenamed(id_col, "doc_id"), label)
    return scored(rows, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
