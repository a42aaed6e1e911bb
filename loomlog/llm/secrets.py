"""Secret scans with a randomness test battery (DataFrame functions only).

Base secrets (assign, access, hex) come from regular expressions. Then every token of ``TOKEN`` goes through a battery:
its encoding is inferred (hex, letters of one case, base32, base36, base64 or base64url), and against that alphabet a chi-squared test of
uniformity, a runs test about the alphabet's middle and a test of serial correlation are taken together by Fisher's
method. The null of the false-discovery control is ordinary text: a Markov chain over character classes (``CLASSES``) and
pairs of letters (``PAIRS``). Under it, the likelihood ratio of uniform draws from the inferred alphabet against that text
is over t with a chance of 1/t at most (Markov's inequality), so its inverse is a p-value; a token that the battery tells
from random is never a discovery. These p-values, weighted by length, go through the Benjamini-Hochberg procedure over the
tokens of a document, at rate ``FALSE_DISCOVERIES``. Found tokens that meet no base span are added as kind ``random``.

Spans are in code points, end exclusive. Cases: null and empty texts have no spans; repeated rows are read each; null
identifiers are carried along; texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, table
from loomlog.llm.span_sql import base_sql

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: name, tokens that it takes, its alphabet in order; the first that takes a token is its encoding.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("letters", r"^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64url", r"^[A-Za-z0-9_-]*[_-][A-Za-z0-9_-]*=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Costs in ordinary text: -10 log p as a character from "0" on, rounded down (so no p-value is too small).
#: Next class by the last one: lower case, upper case, digit, sign.
CLASSES = ((0.85, 0.06, 0.04, 0.05), (0.35, 0.55, 0.05, 0.05), (0.15, 0.1, 0.6, 0.15), (0.5, 0.2, 0.2, 0.1))
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Next letter (26 in a row) by the last one: counted in the words of sf0.01's documents (an eighth for each of its four
#: languages) and of Python's library (a half), with 1 in 20 for the same letter again and 1 in 10 for any.
PAIRS = (
    r"KXMMYcYcKb`KOD\YbGGFH\aa_g"
    r"NLX_;fdeTMgCddD_fWXcMgggMd"
    r"OfLeMeg=?gRQaeDdfY_LZefgeg"
    r"M]`J9cf^Feg[f]AegYTXRfaeag"
    r"L^RPHV^`MdcIWBYY^BHMV]_V`X"
    r"H^]ZMF^`@gaOb_@]fHSRLbeg_b"
    r"B[^e;fKTMg`R`PV_gSHUO]bgg^"
    r"CV[f:f]IKg^VbWK]eVRM[]]ge^"
    r"V\MYENYeLedPQ>GZ`VJGdZf`g]"
    r"5g]gAgggaM`fggMagfbfPgggfg"
    r"Uf^[5c]eNgMQdV\\e\MaZcOgef"
    r"Ea_X=HdgGefBabM`ebPUTeegNf"
    r"FTe^9egfEge^JcJIgcU^Xffgcg"
    r"IXNGE]GZRb\V[KI\]WNBVY`gba"
    r"YVSO\P^gOb`WQ>KTaDIPF_Zegf"
    r"?e_]DJfaRgdKdcFHfHZJU_cgTg"
    r"gggfgggggggfgdefMbef1ggggg"
    r"EYW[<aR[Ld\ZWNJ_dEONW]`gXb"
    r"Q^I\>dZNL^aYY`RV]WG@PebfZg"
    r"I^\`Cac?Dgc[a`M]eISIPb_fVT"
    r"TZZb=X_bUgcNRCVS`GQML`fGgd"
    r"Afeg8efe?ggg`cMegeefgMdggg"
    r"EcdZIbg<AggZeSLegJVbffLdgg"
    r"HaBbG^fcKggSUgNJWR]>fXfK`d"
    r"VYY]H^bVNggVSON?fXDCbbSgLc"
    r"PUR[AfX]O^[UUcY][XWT9\ggeK"
)
FALSE_DISCOVERIES = 0.01
RANDOM_AT_LEAST = 1e-3  # battery p-value below which a token isn't random
BLOCK = 256


def zero() -> Column:
    return F.lit(0).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column) -> Column:
    """Sums of what stands before each entry of a non-empty array of longs, in blocks so that long arrays stay linear."""
    add = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(blocks: Column) -> Column:
        ahead = F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, zero(), lambda a, v: a + v)), F.array(zero()), add)
        starts = F.slice(ahead, F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, starts, lambda x, start: F.slice(F.aggregate(x, F.array(start), add), F.lit(1), F.size(x))))

    return let(cut, joined)


def placed(found: Column, between: Column) -> Column:
    """Matches and the texts between them to structs (start, end, s)."""
    gaps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, s: F.struct((F.char_length(g) + F.char_length(s)).cast("long").alias("step"), F.char_length(s).cast("long").alias("n"), s.alias("s")))
    ends = let(gaps, lambda g: F.zip_with(g, running(F.transform(g, lambda x: x["step"])), lambda x, at: F.struct((at + x["step"] - x["n"]).alias("start"), (at + x["step"]).alias("end"), x["s"].alias("s"))))
    return F.when(F.size(found) > 0, ends).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,s:string>>"))


def log_upper_tail(z: Column) -> Column:
    """log P(N(0, 1) > z), to about 1e-4 of P: a logistic form near the middle, Mills' ratio beyond."""

    def of(z: Column) -> Column:
        a = F.abs(z)
        tail = F.when(a < 3, 1 / (1 + F.exp(1.5976 * a + 0.070566 * a * a * a))).otherwise(F.exp(-a * a / 2) / (a * 2.5066))
        return F.log(F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300)))

    return let(z, of)


def battery(token: Column, alphabet: Column) -> Column:
    """Fisher's combination of the three p-values against uniform draws from the alphabet."""
    small = F.substring(alphabet, 1, 1).isin("0", "a")  # hex, base36 and letters know one case
    plain = F.regexp_replace(F.when(small, F.lower(token)).otherwise(token), "=", "")
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    size = F.char_length(alphabet).cast("double")

    def tested(x: Column) -> Column:
        chars, k = x["chars"], x["k"]
        n = F.size(chars).cast("double")
        squares = F.aggregate(F.array_distinct(chars), zero(), lambda acc, d: acc + F.pow(F.size(F.filter(chars, lambda c: c == d)), F.lit(2)).cast("long"))
        codes = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - (k + 1) / 2)
        pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        counted = let(codes, lambda c: F.struct(
            F.size(F.filter(c, lambda v: v > 0)).cast("double").alias("high"),
            F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v).alias("power"),
            F.aggregate(pairs(c), F.struct(F.lit(0.0).alias("product"), F.lit(1).alias("runs")), lambda acc, p: F.struct(
                (acc["product"] + p["a"] * p["b"]).alias("product"), (acc["runs"] + ((p["a"] > 0) != (p["b"] > 0)).cast("int")).alias("runs"))).alias("pairs"),
        ))
        return F.struct(n.alias("n"), k.alias("k"), squares.alias("squares"), counted.alias("c"))

    def combined(x: Column) -> Column:
        n, k, high = x["n"], x["k"], x["c"]["high"]
        chi = (k * x["squares"] / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        mid = 2 * high * (n - high) / n
        spread = F.sqrt(F.greatest(mid * (n * mid - n) / (n * (n - 1)), F.lit(1e-9)))
        runs = F.when((high == 0) | (high == n), F.lit(30.0)).otherwise(F.abs((x["c"]["pairs"]["runs"] - mid - 1) / spread))
        serial = F.abs(x["c"]["pairs"]["product"] / F.greatest(x["c"]["power"], F.lit(1e-9)) * F.sqrt(n))
        two = F.log(F.lit(2.0))
        half = -(log_upper_tail(chi) + F.least(log_upper_tail(runs) + two, F.lit(0.0)) + F.least(log_upper_tail(serial) + two, F.lit(0.0)))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(let(F.struct(chars.alias("chars"), size.alias("k")), tested), combined)


def as_text(token: Column, alphabet: Column) -> Column:
    """A p-value against ordinary text: the inverse likelihood ratio of uniform draws from the alphabet."""
    cost = lambda table_, place: (F.ascii(F.substr(F.lit(table_), place.cast("int"), F.lit(1))) - 48) / 10.0
    steps = "".join(chr(48 + int(-10 * math.log(p))) for row in CLASSES for p in row)
    chars = F.filter(F.split(F.regexp_replace(token, "=", ""), ""), lambda c: c != "")
    places = F.transform(chars, lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    kind = lambda x: F.when(x < 26, 0).when(x < 52, 1).when(x < 62, 2).otherwise(3)
    alone = lambda x: F.when(x < 52, math.log(26)).when(x < 62, math.log(10)).otherwise(math.log(4))

    def step(p: Column) -> Column:
        a, b = p["a"], p["b"]
        letters = cost(PAIRS, a % 26 * 26 + b % 26 + 1)
        return cost(steps, kind(a) * 4 + kind(b) + 1) + F.when((a < 52) & (b < 52), letters).otherwise(alone(b))

    def inverse(x: Column) -> Column:
        n = F.size(x)
        pairs = F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        total = F.aggregate(pairs, math.log(4) + alone(x[0]), lambda acc, p: acc + step(p))
        return F.exp(F.least(n * F.log(F.char_length(alphabet).cast("double")) - total, F.lit(0.0)))

    return let(places, inverse)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans, digest of the base spans, all spans."""
    rows = id_and_text(docs, id_col, text_col)
    none = F.array().cast("array<string>")

    def matches(pattern: str, group: int, cue: str | None = None) -> Column:
        got = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        return F.when(F.col("text").rlike(cue or pattern), got).otherwise(none)

    def between(pattern: str, found: str) -> Column:
        return F.when(F.size(found) > 0, F.split("text", pattern, -1)).otherwise(none)

    rows = rows.withColumns({"assign": matches(ASSIGN, 0, KEYWORDS), "access": matches(ACCESS, 0), "hex": matches(HEX, 0), "random": matches(TOKEN, 0)})
    rows = rows.withColumn("value", F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(none))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}
    rows = rows.select("doc_id", "value", *(placed(F.col(k), between(p, k)).alias(k) for k, p in patterns.items()))
    long_enough = F.transform(F.filter(F.zip_with("assign", "value", lambda p, v: F.struct(p.alias("p"), v.alias("v"))), lambda x: F.char_length(x["v"]) >= 6), lambda x: x["p"])
    rows = rows.withColumn("assign", long_enough)

    def spans(kind: str) -> Column:
        return F.transform(F.col(kind), lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), p["end"].alias("end")))

    rows = rows.withColumn("base", F.array_sort(F.concat(*(spans(k) for k in KINDS[:3]))))
    alphabet = lambda s: F.coalesce(*(F.when(s.rlike(p), F.lit(a)) for _, p, a in ENCODINGS))
    lone = F.filter("random", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.withColumn("tokens", F.filter(lone, lambda t: alphabet(t["s"]).isNotNull()))
    mean = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + F.char_length(t["s"])) / F.size("tokens")
    weighted = lambda t, m: as_text(t["s"], alphabet(t["s"])) * m / F.char_length(t["s"])
    told = lambda t, p: F.when((p <= FALSE_DISCOVERIES) & (battery(t["s"], alphabet(t["s"])) < RANDOM_AT_LEAST), F.lit(float("inf"))).otherwise(p)
    judged = let(mean, lambda m: F.transform("tokens", lambda t: F.struct(let(weighted(t, m), lambda p: told(t, p)).alias("p"), t["start"].alias("start"), t["end"].alias("end"), t["s"].alias("s"))))
    rows = rows.withColumn("judged", F.array_sort(F.when(F.size("tokens") > 0, judged)))
    passing = F.transform(F.col("judged"), lambda t, i: F.when(t["p"] <= FALSE_DISCOVERIES * (i + 1) / F.size("judged"), i + 1).otherwise(0))
    rows = rows.withColumn("discoveries", F.slice("judged", F.lit(1), F.coalesce(F.array_max(passing), F.lit(0))))
    more = F.transform("discoveries", lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    rows = rows.withColumn("every", F.when(F.size("judged") > 0, F.array_sort(F.concat("base", more))).otherwise(F.col("base")))
    names = F.array(*map(F.lit, KINDS))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("every").alias("spans"),
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op1_secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op1_secrets: the base spans."""
    return op1_secrets(spark, sf_dir).drop("spans")


_assign = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ORACLE = base_sql([
    ("assign", _assign, f"length(regexp_extract(s, '{_assign}', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(s) >= 20"),
    ("hex", "[0-9a-f]+", "length(s) >= 24"),
])
