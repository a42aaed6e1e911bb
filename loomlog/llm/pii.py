"""Personal data in texts, found through offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are read from the text as it is. Then the text goes through transducers: every
step maps a string with the source place of each of its characters to another such string. (1) homoglyphs: invisible
characters vanish, compatibility forms and look-alike letters become ASCII; (2) spelled digits: runs of digit words
in English, French, German or Spanish become digits, "plus" before them a sign and "dot" between them a dot; (3) disguises:
words for "at" and "dot", in brackets or as words between identifier parts, become signs.
Identifiers of the normalised text are mapped back to source characters; those that meet no base span of their kind are
added. Base spans always stay. Spans are in code points, end exclusive.

Cases: null and empty texts have no spans; repeated rows are read each; null identifiers are carried along; texts are
read whole at any length, each step in linear time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomlog.llm.common import id_and_text, table
from loomlog.llm.span_sql import base_sql

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NO_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASCII_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like the ASCII letters in the same places.
LOOKALIKES = "АВСЕНІЈКМОРЅТХУа\u0441еһіјорѕухΑΒΕΖΗΙΚΜΝΟΡΤΥΧοɡıԁԛԝ"
LOOKED_LIKE = "ABCEHIJKMOPSTXYacehijopsyxABEZHIKMNOPTYXogidqw"
SIGNS = {"․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＠": "@", "﹫": "@"}
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
SPELLED = {w: str(k) for words in DIGIT_WORDS for k, w in enumerate(words.split())} | {"oh": "0", "ein": "1", "zwo": "2", "fuenf": "5", "une": "1"}
AT_WORDS = "at|arobase|arrobase|arroba|klammeraffe|ät"
DOT_WORDS = "dot|point|punkt|punto"
#: Endings that let a bare "at" before a dotted domain count.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|ai|app|dev|eu|uk|us|ca|au|de|at|ch|fr|be|lu|es|mx|ar|cl|pe|it|nl|pt|br|pl|se|no|dk|fi|ie|cz|ru|jp|cn|in|nz|za|example|test"

_word = "|".join(sorted(SPELLED, key=len, reverse=True))
_dots = rf"[\x20]{{0,3}}(?:[\[({{<]\x20?(?:{DOT_WORDS}|\.)\x20?[\])}}>]|\x20(?:{DOT_WORDS})\x20|\.)[\x20]{{0,3}}"
_gap = rf"(?:{_dots}|[\x20,-]{{1,4}}|(?![^\W_]))"
SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:plus[\x20,-]{{1,4}})?(?:(?:{_word}|[0-9]{{1,4}}){_gap}){{4,}}", re.I)
SPELLED_PART = re.compile(rf"(plus)|({_word})|([0-9]+)|({_dots})|([\x20,-]+)", re.I)
_break = rf"(?:{_dots}|[\x20,-]{{1,4}})"
SPELLED_CUE = re.compile(rf"(?<![^\W_])(?:(?:{_word}){_break}(?:{_word}|[0-9])|[0-9]{{1,4}}{_break}(?:{_word})|plus\x20{{1,4}}[0-9])", re.I)
SPOKEN_PLUS = re.compile(r"(?<![^\W_])plus\x20{1,4}(?=[0-9])", re.I)
AT = rf"(?:\x20{{0,3}}[\[({{<]\x20{{0,3}}(?:{AT_WORDS}|@)\x20{{0,3}}[\])}}>]\x20{{0,3}}|\x20{{1,3}}(?:{AT_WORDS})\x20{{1,3}}|\x20{{0,3}}@\x20{{0,3}})"
DOT = rf"(?:\x20{{0,3}}[\[({{<]\x20{{0,3}}(?:{DOT_WORDS}|\.)\x20{{0,3}}[\])}}>]\x20{{0,3}}|\x20{{1,3}}(?:{DOT_WORDS})\x20{{1,3}}|\.)"
MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:{DOT}[A-Za-z0-9_%+-]+){{0,3}})({AT})([A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+){{1,4}})", re.I)
DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
ANY_AT, ANY_DOT = re.compile(AT, re.I), re.compile(DOT, re.I)
SPOKEN = re.compile(rf"\x20+(?:{AT_WORDS})\x20+", re.I)
SPOKEN_DOMAIN = re.compile(rf"[\[({{<]|\x20(?:{DOT_WORDS})\x20", re.I)
PLAUSIBLE = re.compile(rf"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{ENDINGS})", re.I)
DISGUISE_CUE = re.compile(rf"[\[({{<]\x20{{0,3}}(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\x20{{0,3}}[\])}}>]|\x20(?:{DOT_WORDS})\x20|\x20@|@\x20|\x20(?:{AT_WORDS})\x20{{1,3}}[a-z0-9.-]{{1,253}}\.(?:{ENDINGS})(?![a-z0-9])", re.I)


@cache
def homoglyphs() -> dict[int, str]:
    """Code points to ASCII: by compatibility decomposition to a single ASCII character, then the fixed values above."""
    out = {}
    for k in range(0x80, sys.maxunicode + 1):
        if (n := unicodedata.normalize("NFKC", chr(k))) != chr(k) and len(n) == 1 and n.isascii() and n.isprintable() and n != " ":
            out[k] = n
        elif unicodedata.category(chr(k)) == "Cf":
            out[k] = ""
    return out | {ord(a): b for a, b in zip(LOOKALIKES, LOOKED_LIKE, strict=True)} | {ord(a): b for a, b in SIGNS.items()}


#: Every character that homoglyphs() maps is in this class; accented Latin letters are not.
ODD = re.compile(r"[^\x00-\x7f\xc0-\u0130\u0132-\u017e]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part always reaches to its sign, so signs are looked for and their neighbours read."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < sign and (m := DOMAIN.match(text, sign + 1)):
            yield start, m.end()
            done = m.end()
        else:  # a later match cannot begin before this sign
            done = sign + 1
        sign = text.find("@", done)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS)."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if not ASCII_DIGIT.search(text):
        return found
    if "." in text:
        found += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub(r"[^0-9]", "", m.group())) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    if "+" in text:
        found += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return found


Tape = tuple[str, list[int]]  # characters, and for each its source place; one more for the end


def rewrite(tape: Tape, edits: list[tuple[int, int, str]]) -> Tape:
    """Ordered, disjoint (start, end, instead): new characters stand where the old ones began."""
    text, at = tape
    out, places, done = [], [], 0
    for start, end, instead in edits:
        out += text[done:start], instead
        places += at[done:start]
        places += [at[start]] * len(instead)
        done = end
    return "".join([*out, text[done:]]), places + at[done:]


def plain_letters(tape: Tape) -> Tape:
    table_ = homoglyphs()
    return rewrite(tape, [(*m.span(), table_[k]) for m in ODD.finditer(tape[0]) if (k := ord(m.group())) in table_])


def plain_digits(tape: Tape) -> Tape:
    edits = []
    for run in SPELLED_RUN.finditer(tape[0]):
        parts = list(SPELLED_PART.finditer(run.group()))
        if not any(p.group(2) for p in parts):
            continue
        while parts and (parts[-1].group(4) or parts[-1].group(5)):
            parts.pop()
        for p in parts:
            instead = "+" if p.group(1) else SPELLED[p.group(2).lower().replace("\u0307", "")] if p.group(2) else p.group(3) or ("." if p.group(4) else "")
            edits.append((run.start() + p.start(), run.start() + p.end(), instead))
    tape = rewrite(tape, edits)
    return rewrite(tape, [(*m.span(), "+") for m in SPOKEN_PLUS.finditer(tape[0])])


def meets(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span meets one of those taken, which are sorted and disjoint."""
    k = bisect_left(taken, (end, -1)) - 1
    return k >= 0 and taken[k][1] > start


def plain_signs(tape: Tape) -> Tape:
    text, edits = tape[0], []
    for m in MAIL.finditer(text):
        if SPOKEN.fullmatch(m.group(2)) and not SPOKEN_DOMAIN.search(m.group(3)) and not PLAUSIBLE.fullmatch(m.group(3)):  # "at" alone is a word
            continue
        for part, sign, pattern in ((1, ".", ANY_DOT), (2, "@", ANY_AT), (3, ".", ANY_DOT)):
            edits += [(m.start(part) + d.start(), m.start(part) + d.end(), sign) for d in pattern.finditer(m.group(part))]
    taken = [(a, b) for a, b, _ in edits]
    for m in DOTTED.finditer(text):
        if not meets(taken, *m.span()):
            edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in ANY_DOT.finditer(m.group())]
    return rewrite(tape, sorted(e for e in edits if text[e[0] : e[1]] != e[2]))


def deobfuscated(text: str) -> list[tuple[int, int, int]]:
    """Spans, in source places, of the identifiers of the normalised text."""
    odd = not text.isascii() and ODD.search(text)
    if not (odd or SPELLED_CUE.search(text) or DISGUISE_CUE.search(text)):
        return []
    tape: Tape = (text, list(range(len(text) + 1)))
    for step in (plain_letters, plain_digits, plain_signs):
        tape = step(tape)
    found = []
    for start, end, kind in base(tape[0]):
        last = tape[1][end - 1]
        stop = tape[1][bisect_right(tape[1], last, end)] if end < len(tape[1]) else len(text)  # places never fall
        if tape[1][end] - last > 1 and end < len(tape[0]):  # what vanished behind the last character is not part of it
            stop = min(stop, tape[1][end])
        while stop > last + 1 and text[stop - 1] in " ,":
            stop -= 1
        found.append((tape[1][start], stop, kind))
    return found


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each by start and kind."""
    own = base(text)
    more = deobfuscated(text)
    if more:
        of = [sorted((a, b) for a, b, k in own if k == kind) for kind in range(len(KINDS))]
        more = [x for x in more if not meets(of[x[2]], x[0], x[1])]
    key = lambda x: (x[0], x[2], x[1])
    return sorted(own, key=key), sorted({*own, *more}, key=key)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans by kind, digest of the base spans, all spans."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                own, every = spans(text.as_py())
                rows.append((*(sum(x[2] == k for x in own) for k in range(4)), hashlib.sha256(written(own).encode()).hexdigest(), written(every)))
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in names[1:]]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(find, SCHEMA)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op8_personal_data: the base spans."""
    return op8_personal_data(spark, sf_dir).drop("spans")


_digits = "regexp_replace(s, '[^0-9]', '', 'g')"
_digit = f"substr(reverse({_digits}), (j + 1)::BIGINT, 1)::INT"
_luhn = f"list_sum(list_transform(range(length({_digits})), lambda j: (1 + j % 2) * {_digit} - CASE WHEN j % 2 = 1 AND {_digit} > 4 THEN 9 ELSE 0 END)) % 10 = 0"
ORACLE = base_sql([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR right('000' || x, 3)::INT > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_digits}) BETWEEN 12 AND 19 AND {_luhn}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_digits}) BETWEEN 9 AND 15"),
])
